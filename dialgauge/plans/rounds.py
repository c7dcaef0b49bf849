"""A contest round from text files to a submission file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import sources
from ..session import scratch_path
from . import assemble, models, scoring, space


@dataclass(frozen=True)
class RoundInputs:
    """Paths of one round. Several paths of a kind are appended, train first.

    ``predictions`` names an earlier submission whose labels are added to the known ones.
    """

    voice: list[str]
    sms: list[str]
    wa: list[str]
    labels: str
    roster_start: int
    roster_size: int
    predictions: str | None = None


def round_matrix(spark: SparkSession, inputs: RoundInputs, **name_thresholds) -> tuple[DataFrame, DataFrame]:
    """Training and score vectors of a round, (uid, label, features) and (uid, features).

    The feature space is fitted on the round's own events, however many values they hold. The vectors are written once to
    the shared folder: boosting reads the training rows many times, and a lost executor then costs a read and not
    the features again.
    """
    voice = sources.union_rounds(*[sources.read_voice(spark, p) for p in inputs.voice])
    sms = sources.union_rounds(*[sources.read_sms(spark, p) for p in inputs.sms])
    wa = sources.union_rounds(*[sources.read_wa(spark, p) for p in inputs.wa])
    labels = sources.read_labels(spark, inputs.labels)
    if inputs.predictions:
        labels = sources.union_pseudo_labels(labels, sources.read_predictions(spark, inputs.predictions))
    roster = sources.test_roster(spark, inputs.roster_start, inputs.roster_size)
    # Names are picked by the labels of the rows that trees grow on, not of those that stop them.
    grown_on = labels.filter(~models.in_holdout(seed=models.STOPPING_SEED)).select("uid")
    counts = assemble.settled_counts(assemble.value_counts(voice, sms, wa))
    values = assemble.feature_values(voice, sms, wa, labels, **{"fit_users": grown_on, "counts": counts, **name_thresholds})
    users = labels.unionByName(roster.join(labels, "uid", "left_anti"), allowMissingColumns=True)
    fitted = space.fit_space(values, space.fixed_names())
    return assemble.split_known(space.feature_vectors(voice, sms, wa, users, fitted, counts))


def run_round(
    spark: SparkSession,
    inputs: RoundInputs,
    out: str,
    deep: models.TreeSettings = models.DEEP_A,
    shallow: models.TreeSettings = models.SHALLOW,
    weights: dict[str, float] = scoring.ROUND_A,
    **name_thresholds,
) -> DataFrame:
    """Features, both ensembles, blend, threshold, ranking, submission. Returns the ranked users.

    The first round takes the defaults; the second ``models.DEEP_B``, ``scoring.ROUND_B`` and the first
    round's submission as ``predictions``.
    """
    train, score = round_matrix(spark, inputs, **name_thresholds)
    ranked_path = scratch_path(spark, "ranked")
    models.score_round(train, score, deep, shallow, weights).write.parquet(ranked_path)
    ranked = spark.read.parquet(ranked_path)
    sources.write_submission(ranked, out)
    return ranked
