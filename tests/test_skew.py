"""Hot users, long lists: another plan, the same result."""

import random
import statistics

import pytest

from dialgauge.catalog import fixtures as fx
from dialgauge.catalog.queries import accesses, calls, texts
from dialgauge.operators import (
    Category,
    category_values,
    flat_features,
    hot_value_counts,
    listed_cells,
    listed_value_counts,
    values_in_band,
)
from dialgauge.operators.skew import grouped_medians, split_hot
from dialgauge.plans import sms as sms_plan
from dialgauge.plans import voice as voice_plan
from dialgauge.plans import web as web_plan


def rows_of(df, digits=6):
    def plain(x):
        return round(x, digits) if isinstance(x, float) else x

    return sorted(tuple(plain(x) for x in r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("n_groups", [None, 3])
def test_medians_by_narrowing(spark, n_groups):
    rng = random.Random(7)
    values = {
        "flat": [rng.randint(-5, 5) for _ in range(401)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 12) for _ in range(400)],
        "outlier": [rng.random() for _ in range(299)] + [1e15],
        "same": [0.1] * 10,
        "one": [3.5],
        "two": [1.0, 2.0],
    }
    rows = [(u, float(x), float(-x)) for u, xs in values.items() for x in xs] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "uid string, x double, y double")
    got = {r["uid"]: (r["a"], r["b"]) for r in grouped_medians(df, {"a": "x", "b": "y"}, n_groups).collect()}
    for user, xs in values.items():
        assert got[user] == (statistics.median(map(float, xs)), statistics.median(-float(x) for x in xs)), user
    assert got["none"] == (None, 1.0)


def test_split(spark):
    df = spark.createDataFrame([("a",)] * 5 + [("b",)] * 2, "uid string")
    cold, hot, n = split_hot(df, 2)
    assert n == 1 and {r.uid for r in hot.collect()} == {"a"} and {r.uid for r in cold.collect()} == {"b"}
    assert split_hot(df, 5)[1] is None


def test_hot_users_same_statistics(spark, small):
    voice = calls(spark, small)
    assert rows_of(voice_plan.len_stats(voice)) == rows_of(voice_plan.len_stats(voice, hot_rows=60))
    wa = accesses(spark, small)
    assert rows_of(web_plan.speed_stats(wa)) == rows_of(web_plan.speed_stats(wa, hot_rows=600))
    assert rows_of(web_plan.visit_stats(wa)) == rows_of(web_plan.visit_stats(wa, hot_rows=0))


def test_hot_users_same_matrix(spark, small):
    m = {"day": ["1", "2"], "head": ["139"], "type": ["1"], "len": ["5"], "short": ["000"]}
    voice = calls(spark, small)
    assert rows_of(voice_plan.feature_matrix(voice, m)) == rows_of(voice_plan.feature_matrix(voice, m, hot_rows=60))
    sms = texts(spark, small)
    assert rows_of(sms_plan.feature_matrix(sms, m)) == rows_of(sms_plan.feature_matrix(sms, m, hot_rows=50))
    wa, names = accesses(spark, small), {"bad": ["site1"], "hot": ["app1", "app2"]}
    assert rows_of(web_plan.feature_matrix(wa, names), 3) == rows_of(
        web_plan.feature_matrix(wa, names, hot_rows=600), 3
    )


def test_long_list_goes_by_shuffle(spark, small):
    """A list too large to broadcast gives the same rows; planning either join runs no job."""
    voice, wa = fx.voice(spark, small), fx.web(spark, small)
    assert values_in_band(voice, "tel_opp_num", 9).count() > 3

    def counted():
        hot, names = values_in_band(voice, "tel_opp_num", 9), values_in_band(wa, "wa_name", 50)
        return hot_value_counts(voice, "tel_opp_num", hot), listed_value_counts(wa, "wa_name", names)

    spark.sparkContext.setJobGroup("planning", "")
    try:
        planned = counted()
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("planning")
    finally:
        spark.sparkContext.setJobGroup("", "")
    short = [rows_of(df) for df in planned]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        long = counted()
        assert short == [rows_of(df) for df in long]
        assert all("Broadcast" not in df._jdf.queryExecution().executedPlan().toString() for df in long)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_hot_list_beyond_the_broadcast_bound(spark, small, monkeypatch):
    voice = calls(spark, small)
    broadcast = rows_of(voice_plan.len_stats(voice, hot_rows=60))
    monkeypatch.setattr("dialgauge.operators.skew.BROADCAST_USERS", 0)
    assert broadcast == rows_of(voice_plan.len_stats(voice, hot_rows=60))


def test_values_beyond_any_column_limit(spark):
    """20,000 different short numbers, each with one call: all are values and all are counted."""
    rows = spark.range(20_000).selectExpr("concat('u', id % 7) as uid", "cast(id as string) as number", "id % 2 as io")
    short = {"short": Category("number", {"all": "number_{}"})}
    values = category_values(rows, short)
    cells = listed_cells(rows, short, {"all": None, "in": "io = 1"}, values.filter("key <> '5'"))
    assert values.count() == 20_000
    assert cells.count() == 19_999 and {r.slice for r in cells.select("slice").distinct().collect()} == {"all"}


def test_groups_add_up(spark, small):
    """Slices and classes partition the rows."""
    voice = calls(spark, small)
    both = flat_features(voice, voice_plan.IN_OUT + voice_plan.LEN_CLASS + voice_plan.BAGS + voice_plan.OPP_LEN_CLASS)
    for r in both.collect():
        assert r.tel_fre == r.tel_short_fre + r.tel_mid_fre + r.tel_long_fre
        assert r.tel_fre == r.tel_opp_less_5 + r.tel_opp_less_11 + r.tel_opp_equal_11 + r.tel_opp_over_11
        assert sum(r[f"tel_date_cnt_cat_{b}_count"] for b in range(9)) <= r.tel_fre


def test_two_definitions_of_one_name_are_refused():
    from dialgauge.operators import Flat

    with pytest.raises(ValueError):
        Flat({"a": "count(*)"}) + Flat({"a": "sum(x)"})
