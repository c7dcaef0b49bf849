"""Header-less text sources and the submission sink.

All readers take one path or a list of paths and a fixed schema, so no inference pass runs and
Spark splits large files freely (the rows hold no line breaks).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas

# Texts that the usual data-frame CSV readers take for a missing value.
MISSING_TEXTS = [
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
]


def _read(spark: SparkSession, path, schema: T.StructType, sep: str, missing: list[str]) -> DataFrame:
    rows = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("encoding", "UTF-8")
        .option("header", False)
        .option("escape", '"')
        .csv(path)
    )
    if not missing:
        return rows
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    return rows.withColumns({c: F.when(~F.col(c).isin(missing), F.col(c)) for c in texts})


def read_voice(spark: SparkSession, path, missing: list[str] = MISSING_TEXTS) -> DataFrame:
    """Voice calls, tab-separated."""
    return _read(spark, path, schemas.VOICE, "\t", missing)


def read_sms(spark: SparkSession, path, missing: list[str] = MISSING_TEXTS) -> DataFrame:
    """SMS, tab-separated; the packed time stays text."""
    return _read(spark, path, schemas.SMS, "\t", missing)


def read_wa(spark: SparkSession, path, missing: list[str] = MISSING_TEXTS) -> DataFrame:
    """S3: web and app access, tab-separated."""
    return _read(spark, path, schemas.WEB, "\t", missing)


def read_labels(spark: SparkSession, path) -> DataFrame:
    """Known labels, tab-separated."""
    return _read(spark, path, schemas.LABELS, "\t", [])


def read_predictions(spark: SparkSession, path) -> DataFrame:
    """An earlier submission read back as labels, comma-separated."""
    return _read(spark, path, schemas.LABELS, ",", [])


def test_roster(spark: SparkSession, start: int, n: int) -> DataFrame:
    """Generated user ids ``u<start>`` .. ``u<start+n-1>``."""
    return spark.range(start, start + n).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("uid"))


test_roster.__test__ = False  # not a test case


def write_tab_text(rows: DataFrame, path: str) -> None:
    """Write rows in the layout the readers above take."""
    rows.write.option("sep", "\t").option("header", False).option("escape", '"').csv(path)


def write_submission(scored: DataFrame, path: str, score: str = "blend", mode: str = "errorifexists") -> None:
    """``uid,label`` without header, best score first.

    The sort is a range partitioning: part files follow each other in score order.
    """
    ranked = scored.orderBy(F.col(score).desc(), "uid")
    ranked.select("uid", "label").write.mode(mode).option("header", False).csv(path)
