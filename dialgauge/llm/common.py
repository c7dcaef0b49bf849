"""What several operators share: column helpers and the written copies that cut lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# Words stand between these characters.
WORD_GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where a lambda inside ``body`` uses it for every element."""
    return F.transform(F.array(value), body)[0]


def words(text: str | Column, gap: str = WORD_GAP) -> Column:
    """Words of a text; null has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gap), "")


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` through a table in the shared folder, so that nothing above it is computed again."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 4: rows with 2 are held out of all learning."""
    return F.crc32(F.col(doc_id).cast("string")) % 4
