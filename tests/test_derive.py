"""Row-level derivations on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from dialgauge import schemas
from dialgauge.functions import derive as d


def value(spark, sql, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return row.select(F.expr(sql)).first()[0]


@pytest.mark.parametrize(
    "start, end, seconds",
    [(1000000, 1000001, 1), (1235950, 2000010, 20), (9081500, 9091501, 3601), (45235959, 45235959, 0)],
)
def test_call_seconds(spark, start, end, seconds):
    assert value(spark, d.call_seconds("a", "b"), a=start, b=end) == seconds


def test_day_and_hour_without_leading_zero(spark):
    assert value(spark, d.day_of("t"), t=9081500) == 9
    assert value(spark, d.hour_of("t"), t=9081500) == 8
    assert value(spark, d.hour_of("t"), t=45000159) == 0


def test_sms_time_keeps_leading_zero(spark):
    row = spark.createDataFrame([("u1", "1", None, 4, "09081500", 1)], schemas.SMS)
    got = d.with_sms_fields(row).first()
    assert (got.smg_date, got.smg_hour, got.smg_operator) == (9, 8, "other")


@pytest.mark.parametrize("day, bag", [(1, 0), (5, 0), (6, 1), (45, 8), (46, None), (0, None)])
def test_day_bag(spark, day, bag):
    assert value(spark, d.day_bag("x"), x=day) == bag


@pytest.mark.parametrize("n, cls", [(5, "less_5"), (6, "less_11"), (10, "less_11"), (11, "equal_11"), (12, "over_11")])
def test_number_length_class(spark, n, cls):
    assert value(spark, d.number_length_class("x"), x=n) == cls


@pytest.mark.parametrize(
    "hour, classes", [(8, [0]), (9, [1]), (12, [1]), (13, [2]), (14, [2]), (15, [3]), (17, [3, 4]), (18, [4])]
)
def test_hour_17_is_in_two_classes(spark, hour, classes):
    held = [k for k, c in enumerate(d.hour_class_conditions("h")) if value(spark, c, h=hour)]
    assert held == classes


@pytest.mark.parametrize("s, cls", [(0, "short"), (120, "short"), (121, "mid"), (600, "mid"), (601, "long")])
def test_call_length_class(spark, s, cls):
    assert value(spark, d.call_length_class("x"), x=s) == cls


@pytest.mark.parametrize(
    "v, decade", [(0, 0), (9, 0), (10, 1), (99_999, 4), (100_000, 5), (999_999, 5), (1_000_000, 6), (10_000_000, 7)]
)
def test_duration_decade_has_no_gap(spark, v, decade):
    assert value(spark, d.duration_decade("x"), x=v) == decade


@pytest.mark.parametrize(
    "prefix, voice, sms",
    [("139", "yidong", "yidong"), ("186", "liantong", "liantong"), ("153", "dianxin", "dianxin"),
     ("000", "other", "foreign"), ("955", "other", "other")],
)
def test_operator_class(spark, prefix, voice, sms):
    assert value(spark, d.operator_class("x", foreign=False), x=prefix) == voice
    assert value(spark, d.operator_class("x", foreign=True), x=prefix) == sms


def test_missing_prefix_is_other(spark):
    assert spark.sql(f"select {d.operator_class('x', foreign=True)} from (select cast(null as string) x)").first()[0] == "other"


def test_no_visits_gives_null_rate(spark):
    row = spark.createDataFrame([("u1", "a", 0, 10, 6, 5, 0, 1)], schemas.WEB)
    got = d.with_web_fields(row).first()
    assert got.visit_per_dura is None
    assert got.flow_amount == 11
    assert got.download_speed == pytest.approx(6 / 11)
    assert got.amount_speed == pytest.approx(13 / 11)


def test_truncate_goes_toward_zero(spark):
    rows = spark.createDataFrame([("u1", 2.9, -2.9, 3)], "uid string, a double, b double, c int")
    assert tuple(d.truncate_features(rows).first()) == ("u1", 2, -2, 3)


def test_slice_rows(spark):
    rows = spark.createDataFrame([("u1", 0), ("u2", 1), ("u3", None)], "uid string, io int")
    assert [r.uid for r in d.slice_rows(rows, "io", 1).collect()] == ["u2"]
