"""Fitted values: rows per label, not per labelled row."""

from dialgauge.catalog import fixtures as fx
from dialgauge.operators.frequent import label_skewed_values
from dialgauge.plans import assemble, space


def test_labels_that_repeat_do_not_multiply_rows(spark):
    rows = spark.sql("select * from values ('a', 'x'), ('a', 'x'), ('b', 'x'), ('b', 'y'), ('c', 'y') as t(uid, name)")
    labels = spark.sql("select * from values ('a', 1), ('a', 1), ('a', 0), ('b', 1), ('c', 0), ('c', 0) as t(uid, label)")
    names = label_skewed_values(rows, "name", labels, 1, 1)
    text = names._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [uid" in text.partition("Join Inner")[2]
    found = {r["name"]: (r["bad_times"], r["good_times"], r["bad_ratio"], r["good_ratio"]) for r in names.collect()}
    assert found == {"x": (2, 1, 2 / 3, 1 / 3), "y": (1, 1, 1 / 3, 1 / 3)}


def test_values_and_cells_are_read_off_counts(spark, small, monkeypatch):
    """The events are counted once: neither the values nor the cells need them again."""
    wa = fx.web(spark, small).unionByName(fx.web(spark, small).limit(900).selectExpr("null as uid", "* except (uid)"))
    tables = fx.voice(spark, small), fx.sms(spark, small), wa
    labels = fx.roster(spark, small).filter("label is not null")
    counts = assemble.settled_counts(assemble.value_counts(*tables))
    thresholds = dict(min_bad=1, max_good=1, more_than=100)
    plain = assemble.feature_values(*tables, labels, **thresholds)
    values = assemble.feature_values(None, None, wa, labels, **thresholds, counts=counts)
    assert sorted(values.collect()) == sorted(plain.collect())
    assert {r["dim"] for r in values.filter("source = 'wa'").collect()} == {"bad", "hot"}
    for frame in (values, assemble.feature_cells(None, None, None, values, counts)):
        assert not [f for f in frame.inputFiles() if "lineitem" in f or "events" in f]
    columns = ["uid", "source", "dim", "key", "slice", "n"]
    found, expected = (
        sorted(map(str, cells.select(columns).collect()))
        for cells in (assemble.feature_cells(None, None, None, values, counts), assemble.feature_cells(*tables, plain))
    )
    assert found == expected and len(found) > 500


def test_names_of_numeric_features_need_no_rows(spark, small):
    tables = (t(spark, small).limit(0) for t in (fx.voice, fx.sms, fx.web))
    matrix = space.numeric_matrix(*tables, fx.roster(spark, small))
    assert space.fixed_names() == space.numeric_names(matrix)
