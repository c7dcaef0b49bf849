"""From raw documents to packed training windows: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) with the columns of ``documents`` and returns the same columns, the last one
the packed pieces. Null and empty texts fail the first stage. Rows without an id pass the stages that remove by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialgauge.llm import decontam, packing, quality, secrets, similar
from dialgauge.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the log-likelihood ratio reject go."""
    rows = quality.judged(docs, table(spark, sf_dir, "labels"))
    # The row's number keeps the filter above the projections; pushed below them, it would copy their long expressions
    # into itself, several times each.
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    return rows.where("kept and number >= 0").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word similarity of 0.8 or more, or SimHash) the document with the smallest id
    stays; repeated rows become one."""
    groups = similar.near_copies(docs)
    gone = written(groups.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").dropDuplicates(["doc_id", "text"])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    found = decontam.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(written(found.select("doc_id").distinct(), "leaks"), "doc_id", "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 2,048 tokens, one row per piece."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secret_scan),
    ("packing", pack),
]

# Fingerprints, edit distances and tokens are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
