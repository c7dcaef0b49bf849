"""Readers that account for every row: malformed rows stand apart with their text, and all rows are counted.

A row is malformed when a number cannot be read or it has too few or too many fields. ``strict`` raises at the first
one instead. All columns are read whatever a query selects, so the counts do not depend on it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import MISSING_TEXTS

FAULT = "malformed_text"


@dataclass(frozen=True)
class Accounted:
    """``rows`` that could be read, ``faults`` (the texts of those that could not), and what ``checked`` counts.

    ``checked`` holds every row, malformed ones with their text in ``malformed_text``; when an action on it has ended,
    ``counts`` has ``read``, ``malformed`` and ``missing_<column>`` of the good rows, without another pass.
    """

    checked: DataFrame
    counts: Observation
    columns: list[str]

    @property
    def rows(self) -> DataFrame:
        return self.checked.where(F.col(FAULT).isNull()).select(*self.columns)

    @property
    def faults(self) -> DataFrame:
        return self.checked.where(F.col(FAULT).isNotNull()).select(FAULT)


def _measures(columns: list[str]) -> list:
    good = F.col(FAULT).isNull()
    missing = [F.count_if(good & F.col(c).isNull()).alias(f"missing_{c}") for c in columns]
    return [F.count(F.lit(1)).alias("read"), F.count(FAULT).alias("malformed"), *missing]


def read_accounted(
    spark: SparkSession,
    path,
    schema: T.StructType,
    sep: str = "\t",
    missing: list[str] = MISSING_TEXTS,
    strict: bool = False,
    name: str = "reader",
) -> Accounted:
    """The rows of ``path`` with their account; ``missing`` texts become null as in the plain readers."""
    full = T.StructType([*schema.fields, T.StructField(FAULT, T.StringType())])
    rows = (
        spark.read.schema(full)
        .option("sep", sep)
        .option("encoding", "UTF-8")
        .option("header", False)
        .option("escape", '"')
        .option("columnPruning", False)
        .option("mode", "FAILFAST" if strict else "PERMISSIVE")
        .option("columnNameOfCorruptRecord", FAULT)
        .csv(path)
    )
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)] if missing else []
    rows = rows.withColumns({c: F.when(~F.col(c).isin(missing), F.col(c)) for c in texts})
    counts = Observation(name)
    return Accounted(rows.observe(counts, *_measures(schema.names)), counts, schema.names)


def account(accounted: Accounted) -> DataFrame:
    """(column, read, malformed, missing): the account as rows, one per column; missing counts good rows only."""
    totals = accounted.checked.agg(*_measures(accounted.columns))
    entries = ", ".join(f"'{c}', missing_{c}" for c in accounted.columns)
    return totals.selectExpr("read", "malformed", f"stack({len(accounted.columns)}, {entries}) as (column, missing)").select(
        "column", "read", "malformed", "missing"
    )
