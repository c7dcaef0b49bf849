"""Blend, threshold, ranking, metrics."""

import random

import pytest

from dialgauge.plans import scoring


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "label int, score double")


@pytest.mark.parametrize("distinct", [3, 1000])
def test_auc_is_exact(spark, distinct):
    rng = random.Random(distinct)
    pairs = [(int(rng.random() < 0.3), rng.randrange(distinct) / distinct) for _ in range(700)]
    assert scoring.auc(scored(spark, pairs)).first().auc == pytest.approx(brute_auc(pairs), abs=1e-12)
    cubed = [(y, s**3 + 5) for y, s in pairs]
    assert scoring.auc(scored(spark, cubed)).first().auc == pytest.approx(brute_auc(pairs), abs=1e-12)


def test_auc_like_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rng = random.Random(1)
    df = scored(spark, [(int(rng.random() < 0.5), rng.random()) for _ in range(300)])
    expected = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(
        df.selectExpr("cast(label as double) as label", "score")
    )
    assert scoring.auc(df).first().auc == pytest.approx(expected, abs=1e-9)


def test_one_class_has_no_auc(spark):
    assert scoring.auc(scored(spark, [(1, 0.5), (1, 0.2)])).first().auc is None


def test_f1(spark):
    df = scored(spark, [(1, 0.3), (1, 0.1), (0, 0.9), (0, 0.2), (None, 0.9)])
    assert scoring.f1_at(df).first().f1 == pytest.approx(0.5)
    assert scoring.f1_at(scored(spark, [(0, 0.1)])).first().f1 == 0
    row = scoring.combined_score(df).first()
    assert row.res == pytest.approx(0.6 * row.auc + 0.4 * row.f1)


def test_blend_threshold_and_ranking(spark):
    """Scores are binary fractions, so that sums do not depend on rounding."""
    scores = spark.createDataFrame(
        [("u1", "deep", 0, 0.25), ("u1", "deep", 7, 0.75), ("u1", "shallow", 0, 0.375),
         ("u2", "deep", 0, 0.125), ("u2", "shallow", 0, 0.875), ("u3", "deep", 0, 0.25), ("u3", "shallow", 0, 0.75)],
        "uid string, family string, seed int, score double",
    )
    averaged = scoring.seed_average(scores)
    plain = scoring.rank_submission(scoring.threshold_label(scoring.weighted_blend(averaged), 0.9)).collect()
    assert [(r.uid, r.blend, r.label) for r in plain] == [("u2", 1.0, 1), ("u3", 1.0, 1), ("u1", 0.875, 0)]
    b = scoring.ROUND_B
    weighted = {r.uid: r.blend for r in scoring.weighted_blend(averaged, b["deep"], b["shallow"]).collect()}
    assert weighted["u1"] == pytest.approx(0.96 * 0.5 + 1.04 * 0.375)
