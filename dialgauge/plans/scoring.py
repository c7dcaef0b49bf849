"""From scores to a submission, and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranking import with_ranks

# Blend weights and thresholds of the two rounds, the cut of the F1 metric, and the
# weights of the combined score.
ROUND_A = {"deep": 1.0, "shallow": 1.0, "threshold": 0.9}
ROUND_B = {"deep": 0.96, "shallow": 1.04, "threshold": 0.911}
F1_CUT = 0.3
AUC_WEIGHT, F1_WEIGHT = 0.6, 0.4

AUC_RANGES = 256


def seed_average(scores: DataFrame) -> DataFrame:
    """M7: (uid, family, seed, score) -> (uid, family, score), the mean over seeds."""
    return scores.groupBy("uid", "family").agg(F.avg("score").alias("score"))


def weighted_blend(averaged: DataFrame, deep: float = 1.0, shallow: float = 1.0) -> DataFrame:
    """M8: (uid, blend), the weighted sum of both families."""
    weight = F.when(F.col("family") == "deep", F.lit(deep)).when(F.col("family") == "shallow", F.lit(shallow))
    return averaged.groupBy("uid").agg(F.sum(weight * F.col("score")).alias("blend"))


def threshold_label(blended: DataFrame, threshold: float = 0.9) -> DataFrame:
    """M9: label 1 from the threshold on."""
    return blended.withColumn("label", F.when(F.col("blend") >= threshold, 1).otherwise(0))


def rank_submission(labelled: DataFrame) -> DataFrame:
    """Best blend first, user id as tie-break, with the place as ``rank`` (1 is best)."""
    return with_ranks(labelled, [F.col("blend").desc(), F.col("uid")]).orderBy("rank")


def by_score(scored: DataFrame) -> DataFrame:
    """(score, pos, rows): equal scores of (label, score) merged, which is all that the metrics below read.

    Kept (in memory, then on disk) until ``spark.catalog.clearCache()``, so that the scores are computed once.
    """
    merged = (
        scored.filter("label is not null and score is not null")
        .groupBy("score")
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count("*").alias("rows"))
    )
    return merged.persist()


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve over (label, score); ties count half. One row: ``auc``.

    Equal scores are merged first. Each distinct score needs the number of rows below it: scores are
    cut into ranges at approximate quantiles, counted up inside a range, and the ranges (at most
    AUC_RANGES + 1) are counted up at the end. So no task sees more than one range, and the result is
    exact wherever the cuts lie. NULL unless both labels occur.
    """
    return merged_auc(by_score(scored))


def merged_auc(merged: DataFrame) -> DataFrame:
    """``auc`` of what ``by_score`` gives."""
    steps = [i / AUC_RANGES for i in range(1, AUC_RANGES)]
    cuts = merged.agg(F.percentile_approx("score", steps, 10_000).alias("cuts")).scalar()
    ranged = merged.withColumn("cuts", cuts).withColumn(
        "part", F.size(F.filter("cuts", lambda cut: cut <= F.col("score")))
    )
    below = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    parts = (
        ranged.withColumn("below", F.coalesce(F.sum("rows").over(below), F.lit(0)))
        .groupBy("part")
        .agg(
            F.sum(F.col("pos") * (F.col("below") + F.col("rows") * F.lit(0.5))).alias("inside"),
            F.sum("pos").alias("pos"),
            F.sum("rows").alias("rows"),
        )
    )
    # One row per range from here on.
    front = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    total = parts.withColumn("below", F.coalesce(F.sum("rows").over(front), F.lit(0))).agg(
        F.sum(F.col("inside") + F.col("pos") * F.col("below")).alias("area"),
        F.sum("pos").cast("double").alias("pos"),
        (F.sum("rows") - F.sum("pos")).cast("double").alias("neg"),
    )
    return total.select(
        F.try_divide(F.col("area") - F.col("pos") * F.col("pos") / 2, F.col("pos") * F.col("neg")).alias("auc")
    )


def f1_at(scored: DataFrame, cut: float = F1_CUT) -> DataFrame:
    """F1 with label 1 from ``cut`` on. One row: ``f1``; 0 if nothing is positive."""
    rows = scored.filter("label is not null and score is not null")
    return merged_f1(rows.select("score", (F.col("label") == 1).cast("long").alias("pos"), F.lit(1).alias("rows")), cut)


def merged_f1(merged: DataFrame, cut: float = F1_CUT) -> DataFrame:
    """``f1_at`` of what ``by_score`` gives."""
    hit = F.col("score") >= cut
    counted = merged.agg(
        F.sum(F.when(hit, F.col("pos"))).alias("tp"),
        F.sum(F.when(hit, F.col("rows"))).alias("called"),
        F.sum("pos").alias("real"),
    )
    return counted.select(F.coalesce(F.expr("try_divide(2 * tp, called + real)"), F.lit(0.0)).alias("f1"))


def combined_score(scored: DataFrame, cut: float = F1_CUT) -> DataFrame:
    """0.6 AUC + 0.4 F1. One row: ``auc, f1, res``."""
    merged = by_score(scored)
    both = merged_auc(merged).withColumn("f1", merged_f1(merged, cut).scalar())
    return both.withColumn("res", AUC_WEIGHT * F.col("auc") + F1_WEIGHT * F.col("f1"))
