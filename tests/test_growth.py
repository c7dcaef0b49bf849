"""What keeps the cost of wide matrices in step with their input."""

from dialgauge.catalog.queries import QUERIES
from dialgauge.operators.aggregate import local_medians
from dialgauge.operators import aggregate
from dialgauge.operators.skew import HOT_ROWS
from dialgauge.operators.wide import for_users
from dialgauge.plans import assemble
from dialgauge.session import sorted_aggregates


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_aggregated_one_after_the_other(spark, small):
    """What is left when the users are joined holds no aggregation of events."""
    for name in ("full_feature_matrix", "domain_outer", "train_matrix", "score_matrix"):
        text = plan(QUERIES[name](spark, small))
        assert "ObjectHashAggregate" not in text and "InMemoryTableScan" not in text, name


def test_values_of_medians_are_worked_out_before_they_are_gathered(spark):
    rows = spark.sql("select * from values ('a', 1, 5), ('a', 0, 7), ('a', 1, 6), ('b', 0, 1) as t(uid, kind, x)")
    found = local_medians(rows, {"m": "case when kind = 1 then x end"})
    assert "collect_list(m" in plan(found)
    assert {r["uid"]: r["m"] for r in found.collect()} == {"a": 5.5, "b": 0.0}


def test_every_row_of_a_user_gets_the_features(spark):
    users = spark.sql("select * from values ('a', 1), ('a', 0), ('b', null), (null, 1) as t(uid, label)")
    table = spark.sql("select 'a' as uid, 2.5d as x, 3 as n")
    rows = sorted(map(str, for_users(users, table).selectExpr("uid", "label", "x", "n").toLocalIterator()))
    assert rows == sorted(
        ["Row(uid='a', label=1, x=2.5, n=3)", "Row(uid='a', label=0, x=2.5, n=3)"]
        + ["Row(uid='b', label=None, x=0.0, n=0)", "Row(uid=None, label=1, x=0.0, n=0)"]
    )


def test_users_of_many_rows_are_gathered_where_one_is_in_memory_at_a_time(spark, monkeypatch):
    """Medians of a user above HOT_ROWS are not searched for by narrowing, and are right."""
    monkeypatch.setattr(aggregate, "grouped_medians", None)
    n = HOT_ROWS + 101
    voice = spark.sql("select 'a' as uid, '1' as tel_opp_num, '139' as tel_opp_head, 5 as tel_opp_len, 1080000L as tel_start_time, 1080100L as tel_end_time, 1 as tel_call_type, 1 as tel_in_and_out")
    sms = spark.sql("select 'a' as uid, '1' as smg_opp_num, '139' as smg_opp_head, 5 as smg_opp_len, '01080000' as smg_start_time, 1 as smg_in_and_out")
    wa = spark.range(n).selectExpr("'a' as uid", "'x' as wa_name", "id * 7 % 20101 as visit_cnt", "1L as visit_dura", "id as up_flow", "id as down_flow", "int(id % 2) as wa_type", "1 as wa_date")
    users = spark.sql("select * from values ('a', 1), ('b', 0) as t(uid, label)")
    rows = {r["uid"]: r for r in assemble.full_feature_matrix(voice, sms, wa, users, {"voice": {}, "sms": {}, "wa": {}}).collect()}
    assert (rows["a"]["wa_count"], rows["a"]["wa_up_flow_median"], rows["b"]["wa_up_flow_median"]) == (n, (n - 1) / 2, 0)
    assert rows["a"]["wa_app_up_flow_median"] == (n - 1) / 2 and rows["a"]["wa_visit_cnt_median"] == (n - 1) / 2


def test_gathering_aggregates_hold_one_group_inside_the_block(spark):
    rows = spark.sql("select * from values ('a', 5), ('b', 6) as t(uid, x)")
    with sorted_aggregates(spark):
        inside = plan(local_medians(rows, {"m": "x"}))
    assert "SortAggregate" in inside and "ObjectHashAggregate" not in inside
    assert "ObjectHashAggregate" in plan(local_medians(rows, {"m": "x"}))
