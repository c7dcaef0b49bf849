"""Values picked by how often they occur, or by how their users' labels lean, and counts for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def values_in_band(
    rows: DataFrame, value: str, above: int, below: int | None = None, counted_by: str | None = None
) -> DataFrame:
    """Values with more than ``above`` (and fewer than ``below``) rows: (value, rows). Missing never counts.

    ``counted_by`` names a column that says for how many rows a row stands.
    """
    size = F.count("*") if counted_by is None else F.sum(counted_by)
    counted = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(size.alias("rows"))
    picked = counted.filter(F.col("rows") > above)
    return picked if below is None else picked.filter(F.col("rows") < below)


def hot_value_split(rows: DataFrame, value: str, hot: DataFrame) -> DataFrame:
    """Every row with ``value_group``: its value if that is in the list, else (or missing) ``other``.

    A plain left join: adaptive execution broadcasts the list if its measured size allows it, and splits the rows of a
    popular value if not.
    """
    marked = hot.select(value, F.col(value).alias("value_group"))
    return rows.join(marked, value, "left").select(*rows.columns, F.coalesce("value_group", F.lit("other")).alias("value_group"))


def _per_user(rows: DataFrame, value: str, key: str) -> DataFrame:
    return rows.groupBy(key, value).agg(F.count("*").alias("n"))


def hot_value_counts(rows: DataFrame, value: str, hot: DataFrame, key: str = "uid") -> DataFrame:
    """(uid, value_group, n): rows per user and listed value, all others as one group.

    Rows are added up per (user, value) before they meet the list.
    """
    split = hot_value_split(_per_user(rows, value, key), value, hot)
    return split.groupBy(key, "value_group").agg(F.sum("n").alias("n"))


def listed_value_counts(rows: DataFrame, value: str, listed: DataFrame, key: str = "uid") -> DataFrame:
    """(uid, value, n): rows per user and listed value."""
    counted = _per_user(rows.filter(F.col(value).isNotNull()), value, key)
    return counted.join(listed.select(value), value, "left_semi").select(key, value, "n")


def label_skewed_values(
    rows: DataFrame,
    value: str,
    labels: DataFrame,
    min_bad: int,
    max_good: int,
    fit_users: DataFrame | None = None,
    key: str = "uid",
) -> DataFrame:
    """Values used by at least ``min_bad`` positive and at most ``max_good`` negative users.

    Rates are over the real class sizes of the labels at hand. ``fit_users`` limits the labels to the
    users a model is fitted on, so that a holdout does not leak. Rows meet the labels before they are deduplicated, so
    only labelled users' pairs are. Best separation first.
    """
    known = labels.filter(F.col("label").isNotNull()).select(key, "label")
    if fit_users is not None:
        known = known.join(fit_users.select(key), key, "left_semi")
    # A user who is labelled several times joins once per different label: the pairs are the same.
    pairs = rows.filter(F.col(value).isNotNull()).select(value, key).join(known.distinct(), key).distinct()
    sizes = known.agg(F.count_if(F.col("label") == 1).alias("bad"), F.count_if(F.col("label") == 0).alias("good"))
    counted = (
        pairs.groupBy(value)
        .agg(
            F.count_if(F.col("label") == 1).alias("bad_times"),
            F.count_if(F.col("label") == 0).alias("good_times"),
        )
        .filter((F.col("bad_times") >= min_bad) & (F.col("good_times") <= max_good))
    )
    return (
        counted.withColumns(
            {
                "bad_ratio": F.try_divide("bad_times", sizes.select("bad").scalar()),
                "good_ratio": F.try_divide("good_times", sizes.select("good").scalar()),
            }
        )
        .withColumn("diff", F.col("bad_ratio") - F.col("good_ratio"))
        .orderBy(F.col("diff").desc(), value)
    )
