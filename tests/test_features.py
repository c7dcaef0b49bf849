"""Feature groups on hand-made rows: single observations, empty slices, missing keys, absent users."""

import pytest

from dialgauge import schemas
from dialgauge.functions import derive as d
from dialgauge.operators import label_skewed_values
from dialgauge.plans import assemble
from dialgauge.plans import sms as sms_plan
from dialgauge.plans import voice as voice_plan
from dialgauge.plans import web as web_plan


@pytest.fixture(scope="module")
def voice(spark):
    rows = [
        ("u1", "10086", "100", 5, 1080000, 1080100, 1, 1),
        ("u1", "10086", "100", 5, 1170000, 1170030, 1, 1),
        ("u1", "555", None, 3, 2170000, 2171500, 2, 0),
        ("u2", "555", "139", 11, 3120000, 3120001, 1, 0),
        (None, "555", "139", 11, 3120000, 3120001, 1, 0),
    ]
    return d.with_call_fields(spark.createDataFrame(rows, schemas.VOICE))


@pytest.fixture(scope="module")
def sms(spark):
    rows = [
        ("u1", "10086", "100", 5, "01080000", 1),
        ("u1", None, "000", 12, "01170000", 1),
        ("u1", "777", None, 11, "02170000", 0),
        ("u2", "777", "139", 7, "03120000", 1),
    ]
    return d.with_sms_fields(spark.createDataFrame(rows, schemas.SMS))


@pytest.fixture(scope="module")
def wa(spark):
    rows = [
        ("u1", "站点", 2, 10, 1, 9, 0, 1),
        ("u1", None, 0, 100_000, 3, 1, 1, 1),
        ("u1", "mail", 4, 4, 5, 10, 1, 45),
        ("u3", "mail", 1, 1, 1, 0, 0, 46),
    ]
    return d.with_web_fields(spark.createDataFrame(rows, schemas.WEB))


def by_user(df):
    return {r["uid"]: r.asDict() for r in df.collect()}


def test_in_is_one_and_out_is_zero(voice):
    got = by_user(voice_plan.in_out(voice))
    assert set(got) == {"u1", "u2"}
    assert (got["u1"]["tel_in"], got["u1"]["tel_out"], got["u1"]["tel_fre"]) == (2, 1, 3)
    assert got["u1"]["tel_in_out_ratio"] == pytest.approx(2 / 3)
    assert got["u2"]["tel_in_out_ratio"] == pytest.approx(2.0)


def test_single_observation_has_no_spread(voice):
    got = by_user(voice_plan.len_stats(voice))["u2"]
    assert got["tel_len_std"] == 0 and got["tel_len_median"] == 1 and got["tel_len_in_max"] == 0


def test_length_statistics(voice):
    got = by_user(voice_plan.len_stats(voice))["u1"]
    assert (got["tel_len_sum"], got["tel_len_min"], got["tel_len_max"]) == (990, 30, 900)
    assert got["tel_len_median"] == 60
    assert got["tel_len_in_median"] == 45
    assert got["tel_len_in_std"] == pytest.approx(450**0.5)


def test_days_without_rows_in_a_slice_do_not_count(voice):
    got = by_user(voice_plan.daily_count_stats(voice))["u1"]
    assert (got["tel_date_count"], got["tel_in_date_count"], got["tel_out_date_count"]) == (2, 1, 1)
    assert (got["tel_in_date_mean"], got["tel_date_mean"]) == (2.0, 1.5)
    assert got["tel_date_in_out_diff_sum"] == 1


def test_missing_key_is_one_distinct_value_but_no_category(voice):
    assert by_user(voice_plan.distinct(voice))["u1"]["voice_opp_head_unique_count"] == 2
    heads = {(r.uid, r.tel_opp_head) for r in voice_plan.head_counts(voice).collect()}
    assert heads == {("u1", "100"), ("u2", "139")}


def test_hour_17_counts_twice(voice):
    got = by_user(voice_plan.hour_class_counts(voice))["u1"]
    assert [got[f"tel_hour_div_{k}"] for k in range(5)] == [1, 0, 0, 2, 2]


def test_hot_numbers_and_all_others(voice):
    got = {(r.uid, r.value_group): r.n for r in voice_plan.hot_number_counts(voice, 1).collect()}
    assert got == {("u1", "10086"): 2, ("u1", "555"): 1, ("u2", "555"): 1}
    nothing = {(r.uid, r.value_group): r.n for r in voice_plan.hot_number_counts(voice, 99).collect()}
    assert nothing == {("u1", "other"): 3, ("u2", "other"): 1}


def test_sms_missing_number(sms):
    got = by_user(sms_plan.opp_len_class(sms))["u1"]
    assert (got["smg_opp_unique_count"], got["smg_opp_count"]) == (3, 2)
    assert (got["smg_opp_over_11_unique_count"], got["smg_opp_over_11_count"]) == (1, 0)
    ratio = by_user(sms_plan.opp_len_class_ratio(sms))["u1"]
    assert ratio["smg_opp_less_5_unique_ratio"] == pytest.approx(1 / 3)
    assert ratio["smg_opp_less_5_cnt_ratio"] == pytest.approx(1 / 2)


def test_missing_number_is_in_the_other_group(sms):
    got = {(r.uid, r.value_group): r.n for r in sms_plan.hot_number_counts(sms, (1, 3)).collect()}
    assert got == {("u1", "777"): 1, ("u1", "other"): 2, ("u2", "777"): 1}


def test_differences_need_both_sides(sms):
    got = by_user(sms_plan.distinct(sms))
    assert got["u1"]["smg_in_out_opp_num_unique_diff"] == 1
    assert got["u2"]["smg_in_opp_num_unique"] == 1 and got["u2"]["smg_in_out_opp_num_unique_diff"] == 0
    assert by_user(sms_plan.operator_in_out_diff(sms))["u2"]["yidong_smg_diff_cnt"] == 0


def test_home_without_foreign(sms):
    got = by_user(sms_plan.home(sms))
    assert (got["u1"]["home_fre"], got["u2"]["home_fre"]) == (2, 1)


def test_short_number_variants(sms):
    assert {r.smg_opp_num for r in sms_plan.short_number_counts(sms).collect()} == {"10086", "777"}
    assert {r.smg_opp_num for r in sms_plan.short_number_counts(sms, 5).collect()} == {"10086"}


def test_web_rows_shares_and_decades(wa):
    rows = by_user(web_plan.row_counts(wa))["u1"]
    assert (rows["wa_count"], rows["wa_web_count"], rows["wa_app_count"], rows["wa_cnt_diff"]) == (2, 1, 1, 0)
    assert by_user(web_plan.distinct_names(wa))["u1"]["wa_name_app_unique_count"] == 2
    assert by_user(web_plan.dura_decade_counts(wa))["u1"]["wa_visit_dura_cat_5"] == 1
    for build in (web_plan.bag_flow_share, web_plan.bag_count_share, web_plan.bag_dura_share):
        got = by_user(build(wa))
        assert sum(v for k, v in got["u1"].items() if k != "uid") == pytest.approx(1.0)
        assert all(v == 0 for k, v in got["u3"].items() if k != "uid")  # day 46 is in no bag, flow 0


def test_visit_difference_is_web_minus_app(wa):
    assert by_user(web_plan.visit_stats(wa))["u1"]["wa_visit_cnt_diff"] == -2


def test_no_visits_are_left_out_of_the_daily_rate(wa):
    assert by_user(web_plan.daily_per_visit_stats(wa))["u1"]["wa_visit_per_dura_sum"] == pytest.approx(6.0)


def test_skewed_names_use_labels(spark, wa):
    labels = spark.createDataFrame([("u1", 1), ("u3", 0), ("u9", 0), ("u8", None)], "uid string, label int")
    got = label_skewed_values(wa, "wa_name", labels, 1, 1).collect()
    assert [(r.wa_name, r.bad_times, r.good_times) for r in got] == [("站点", 1, 0), ("mail", 1, 1)]
    assert got[1]["diff"] == pytest.approx(1 - 1 / 2)
    fit = spark.createDataFrame([("u3",)], "uid string")
    assert label_skewed_values(wa, "wa_name", labels, 1, 1, fit).collect() == []
    names = web_plan.skewed_names(wa, labels, 1, 0)
    assert [(r.uid, r.wa_name, r.n) for r in web_plan.skewed_name_counts(wa, names).collect()] == [("u1", "站点", 1)]


def test_matrix_columns_follow_the_data(voice, sms):
    got = by_user(voice_plan.feature_matrix(voice))["u1"]
    assert got["tel_opp_num_10086"] == 2 and got["tel_type_2_fre_out"] == 1 and got["tel_in_date_1"] == 2
    assert got["tel_in_opp_head_cat_100"] == 2  # incoming prefixes are there too
    extended = by_user(voice_plan.feature_matrix(voice, extended=True, more_than=1))
    assert extended["u1"]["hot_tel_opp_num_10086_cnt"] == 2 and extended["u2"]["hot_tel_opp_num_other_cnt"] == 0
    more = by_user(sms_plan.feature_matrix(sms, extended=True, band=(1, 3)))["u1"]
    assert (more["sms_hour_div_17"], more["msg_hour_div_4"], more["hot_msg_opp_num_777_cnt"]) == (2, 2, 1)
    assert more["hot_msg_opp_num_other_cnt"] == 2


def test_manifest_is_applied_as_it_is(voice):
    got = voice_plan.feature_matrix(voice, {"head": ["100", "999"]})
    assert "tel_opp_head_cat_999" in got.columns and "tel_opp_head_cat_139" not in got.columns
    assert by_user(got)["u2"]["tel_opp_head_cat_100"] == 0


def test_truncated_matrix(sms):
    got = by_user(sms_plan.feature_matrix(sms, truncate=True))["u1"]
    assert got["msg_date_mean"] == 1 and got["smg_opp_less_5_unique_ratio"] == 0


def test_assembly(spark, voice, sms, wa):
    manifests = {
        "voice": voice_plan.fit_voice_manifest(voice),
        "sms": sms_plan.fit_sms_manifest(sms),
        "wa": {"bad": [], "hot": ["mail"]},
    }
    raw = (voice.select(schemas.VOICE.names), sms.select(schemas.SMS.names), wa.select(schemas.WEB.names))
    users = spark.createDataFrame([("u1", 1), ("u2", 0), ("u9", 0), ("u3", None)], "uid string, label int")
    full = assemble.full_feature_matrix(*raw, users, manifests)
    got = by_user(full)
    assert set(got) == {"u1", "u2", "u3", "u9"}
    assert got["u3"]["label"] is None and got["u3"]["tel_in"] == 0 and got["u3"]["hot_wa_names_mail_cnt"] == 1
    assert all(v == 0 for k, v in got["u9"].items() if k != "uid")
    known, unknown = assemble.split_known(full)
    assert [r.uid for r in unknown.collect()] == ["u3"]
    matrices = assemble.table_matrices(*raw, manifests)
    train = assemble.train_matrix(users, *matrices)
    score = assemble.score_matrix(users.filter("label is null"), *matrices)
    assert [c for c in train.columns if c != "label"] == score.columns
    assert by_user(train) == by_user(known)
    assert set(by_user(assemble.domain_outer(*matrices))) == {"u1", "u2", "u3"}


def test_fitted_manifests(spark, voice, sms, wa):
    labels = spark.createDataFrame([("u1", 1), ("u3", 0)], "uid string, label int")
    got = assemble.fit_manifests(
        voice.select(schemas.VOICE.names),
        sms.select(schemas.SMS.names),
        wa,
        labels,
        min_bad=1,
        max_good=0,
        more_than=1,
    )
    assert got["wa"] == {"bad": ["站点"], "hot": ["mail"]}
    assert got["sms"]["short"] == ["10086", "777"] and got["voice"]["day"] == ["1", "2", "3"]
