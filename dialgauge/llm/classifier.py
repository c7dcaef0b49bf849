"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every pair of features interacts through the product of two short vectors; the machine sums all pairs in linear time as
half of (square of the sum - sum of the squares). Features are the shares of hashed words (length 1), shares that describe
the text's structure, and the size that the table states. Labels, language, source and id are never features.

Defined cases: a null or empty text has no words and zero shares, and is scored by them; of several labels of an id the
lowest counts; repeated rows get the same score; an empty table gives no rows; without rows of both labels there is
nothing to learn, and every score is the share of good labels (0.5 without any); columns other than the id, the
text and the size are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import FMClassificationModel, FMClassifier
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written

BUCKETS = 1 << 12
# Labelled documents that the machine is fitted on at most; which ones, their ids' hashes decide.
SAMPLE = 8_000
FACTORS, ROUNDS, RATE, DECAY, SEED = 4, 60, 0.05, 1e-3, 7
STRUCTURE = ["symbols", "capitals", "digits", "marks", "distinct", "word_length", "size", "lines", "stated"]


@dataclass(frozen=True)
class Model:
    """A fitted machine, or the score that everything gets where there was nothing to learn."""

    machine: FMClassificationModel | None
    constant: float = 0.5


def _share(text: Column, pattern: str) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def features(docs: DataFrame, text: str = "text", id_col: str = "doc_id", stated: str = "n_chars") -> DataFrame:
    """(id, features): one row per input row. ``stated`` may be missing or null; it then counts as the length."""
    body = F.coalesce(F.col(text), F.lit(""))
    size = F.coalesce(F.col(stated).cast("double"), F.length(body)) if stated in docs.columns else F.length(body)
    rows = docs.select(F.col(id_col).alias("row_id"), body.alias("body"), size.alias("stated_size"))
    rows = rows.select("*", words(F.lower("body")).alias("w"))
    n = F.greatest(F.size("w"), F.lit(1))
    rows = rows.select(
        "row_id",
        "w",
        (4 * _share(F.col("body"), r"[#*$%&|<>]+")).alias("symbols"),
        _share(F.col("body"), r"\p{Lu}+").alias("capitals"),
        (4 * _share(F.col("body"), "[0-9]+")).alias("digits"),
        (4 * _share(F.col("body"), "[!?]+")).alias("marks"),
        (F.size(F.array_distinct("w")) / n).alias("distinct"),
        F.least(F.lit(2.0), F.length(F.array_join("w", "")) / n / 10).alias("word_length"),
        (F.log1p(F.size("w").cast("double")) / 10).alias("size"),
        F.least(F.lit(2.0), 10 * F.size(F.split("body", "\n")) / n).alias("lines"),
        (F.log1p(F.greatest(F.col("stated_size"), F.lit(0))) / 10).alias("stated"),
    )
    counted = HashingTF(inputCol="w", outputCol="tf", numFeatures=BUCKETS).transform(rows)
    shares = Normalizer(inputCol="tf", outputCol="words").transform(counted)
    joined = VectorAssembler(inputCols=[*STRUCTURE, "words"], outputCol="features").transform(shares)
    return joined.select(F.col("row_id").alias(id_col), "features")


def labelled_ids(labels: DataFrame, at_most: int = SAMPLE, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``at_most`` labelled ids, those with the smallest hashes."""
    known = labels.groupBy(id_col).agg(F.min("quality").cast("double").alias("label")).where("label is not null")
    return known.orderBy(F.xxhash64(id_col), id_col).limit(at_most)


def fit(docs: DataFrame, labels: DataFrame, at_most: int = SAMPLE, id_col: str = "doc_id", **columns) -> Model:
    """A machine fitted on at most ``at_most`` rows of ``labels`` (id, quality 0/1) with their documents.

    The chosen ids are broadcast, bounded by ``at_most``; their features are written once and read in every round.
    """
    chosen = F.broadcast(written(labelled_ids(labels, at_most, id_col), "labels"))
    rows = features(docs.join(chosen, id_col, "left_semi"), id_col=id_col, **columns).join(chosen, id_col)
    rows = written(rows.repartition(16, F.xxhash64(id_col)).sortWithinPartitions(id_col), "training")
    sizes = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(sizes) < 2:
        return Model(None, next(iter(sizes), 0.5))
    rows = rows.persist()
    trainer = FMClassifier(
        factorSize=FACTORS, maxIter=ROUNDS, stepSize=RATE, regParam=DECAY, tol=1e-4, seed=SEED, solver="adamW"
    )
    model = trainer.fit(rows)
    rows.unpersist()
    return Model(model)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", **columns) -> DataFrame:
    """(id, score): one row per input row; the score is the chance of label 1."""
    if model.machine is None:
        return docs.select(id_col, F.lit(float(model.constant)).alias("score"))
    found = model.machine.transform(features(docs, id_col=id_col, **columns))
    return found.select(id_col, vector_to_array("probability")[1].alias("score"))
