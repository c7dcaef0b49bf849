"""Two rounds from files to files, the second on top of the first one's labels."""

from dataclasses import replace

from dialgauge import sources
from dialgauge.catalog import fixtures as fx
from dialgauge.plans import models, rounds, scoring
from dialgauge.session import scratch_path


def test_two_rounds(spark, small):
    def text(df, name):
        path = scratch_path(spark, name)
        sources.write_tab_text(df, path)
        return path

    # The stand-in users, renamed to the ids that the generated roster has.
    voice, sms, wa = (f(spark, small) for f in (fx.voice, fx.sms, fx.web))
    renamed = [df.selectExpr("concat('u', cast(substr(uid, 2) as int) + 5000) as uid", *df.columns[1:]) for df in (voice, sms, wa)]
    users = fx.roster(spark, small).selectExpr("concat('u', cast(substr(uid, 2) as int) + 5000) as uid", "label")
    labels = users.filter("label is not null")
    paths = [text(df, n) for df, n in zip(renamed, ("voice", "sms", "wa"))]
    inputs = rounds.RoundInputs([paths[0]], [paths[1]], [paths[2]], text(labels, "labels"), 5000, 20)
    deep = replace(models.DEEP_A, depth=2, rounds=1, leaf_rows=1, seeds=[0])
    shallow = replace(models.SHALLOW, depth=2, rounds=1, leaf_rows=1, seeds=[0])
    thresholds = {"min_bad": 1, "max_good": 0, "more_than": 1000}

    first_out = scratch_path(spark, "first")
    first = rounds.run_round(spark, inputs, first_out, deep, shallow, scoring.ROUND_A, **thresholds)
    unknown = {r.uid for r in users.filter("label is null").collect()}
    assert {r.uid for r in first.collect()} == unknown
    assert {r.uid for r in sources.read_predictions(spark, first_out).collect()} == unknown

    second_inputs = replace(inputs, predictions=first_out, roster_start=7000, roster_size=3)
    train, score = rounds.round_matrix(spark, second_inputs, **thresholds)
    assert train.count() == 20 and {r.uid for r in score.collect()} == {"u7000", "u7001", "u7002"}
    assert [c for c in train.columns if c != "label"] == score.columns == ["uid", "features"]
