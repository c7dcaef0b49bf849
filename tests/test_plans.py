"""Shapes of the physical plans."""

import re

import pytest

from dialgauge.catalog.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["voice_in_out", "voice_hour_class_counts", "sms_operator_counts", "wa_bag_flow_share"])
def test_flat_groups_scan_and_shuffle_once(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["voice_daily_count_stats", "sms_distinct", "wa_daily_dura_stats"])
def test_two_level_groups_add_up_before_each_shuffle(spark, small, name):
    text = plan(QUERIES[name](spark, small))
    assert text.count("FileScan") == 1 and text.count("Exchange hashpartitioning") == 2
    assert len(re.findall(r"partial_", text)) >= 2


@pytest.mark.parametrize("name", ["voice_feature_matrix", "sms_feature_matrix", "wa_feature_matrix"])
def test_matrix_places_rows_by_user_once(spark, small, name):
    """As run for tables too large to broadcast: one scan, one exchange of raw rows, and nothing else moves."""
    spark.catalog.clearCache()
    settings = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    for setting in settings:
        spark.conf.set(setting, "-1")
    try:
        matrix = QUERIES[name](spark, small)
        matrix.collect()
        final = plan(matrix).split("Initial Plan")[0]
    finally:
        for setting in settings:
            spark.conf.unset(setting)
    assert "isFinalPlan=true" in final and "ENSURE_REQUIREMENTS" not in final
    placed = set(re.findall(r"REPARTITION_BY_COL, \[plan_id=(\d+)", final))
    scans = set(re.findall(r"FileScan parquet \[[^]]*\]", final))
    assert len(placed) == 1 and len(scans) == 1


def test_columns_and_filters_reach_the_scan(spark, small):
    text = plan(QUERIES["sms_in_out"](spark, small))
    assert "IsNotNull(event_type)" in text and "Not(EqualTo(event_type,error))" in text
    read = re.search(r"ReadSchema: struct<([^>]*)", text).group(1)
    assert "value" not in read and "ts:" not in read


def test_no_python_and_no_cross_join(spark, small):
    for name, query in QUERIES.items():
        if name.startswith(("gbt", "mlp")) or name in ("domain_outer", "train_matrix", "score_matrix"):
            continue
        text = plan(query(spark, small))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
            assert bad not in text, (name, bad)
