"""Where patterns match, in code points, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

SPAN = "struct<start:int,end:int,rank:int,kind:string,value:string>"
NONE = f"array<{SPAN}>"


def matches(text: Column, pattern: str, kind: str, rank: int) -> Column:
    """Leftmost non-overlapping matches of ``pattern`` as an array of (start, end, rank, kind, value).

    The pieces between the matches and the matches themselves add up to the text, so the running sum of their
    lengths gives every start. ``pattern`` must not match the empty string. Texts without a match cost one search.
    """
    find = F.lit(pattern)

    def located(found: Column) -> Column:
        def starts(pieces: Column) -> Column:
            return F.aggregate(
                F.sequence(F.lit(0), F.size(found) - 1),
                F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
                lambda acc, k: F.struct(
                    (acc["at"] + F.length(pieces[k]) + F.length(found[k])).alias("at"),
                    F.array_append(acc["starts"], acc["at"] + F.length(pieces[k])).alias("starts"),
                ),
                lambda acc: acc["starts"],
            )

        rows = let(
            let(F.split(text, pattern, -1), starts),
            lambda at: F.transform(
                found,
                lambda value, k: F.struct(
                    at[k].alias("start"),
                    (at[k] + F.length(value)).alias("end"),
                    F.lit(rank).alias("rank"),
                    F.lit(kind).alias("kind"),
                    value.alias("value"),
                ),
            ),
        )
        return F.when(F.size(found) > 0, rows.cast(NONE)).otherwise(F.array().cast(NONE))

    return let(F.regexp_extract_all(text, find, F.lit(0)), located)


def digest(spans: Column) -> Column:
    """kind:start:end of every span by start, then rank, joined by commas."""
    parts = F.transform(
        F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"]))),
        lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
    )
    return F.array_join(parts, ",")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
