"""Every operator as a query over the test tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas, sources
from ..functions import derive as d
from ..functions.text import named
from ..operators import hot_value_split, values_in_band
from ..operators.states import load_rounds, save_round
from ..plans import assemble, daily_states, models, scoring, space
from ..plans import sms as sms_plan
from ..plans import voice as voice_plan
from ..plans import web as web_plan
from ..session import scratch_path
from ..sources.audit import account, read_accounted
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]


def rounded(rows: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that two engines' last bits do not matter."""
    doubles = {f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return rows.selectExpr(
        *[f"round({named(c)}, {digits}) as {named(c)}" if c in doubles else named(c) for c in rows.columns]
    )


def calls(spark, sf):
    return d.with_call_fields(fx.voice(spark, sf))


def texts(spark, sf):
    return d.with_sms_fields(fx.sms(spark, sf))


def accesses(spark, sf):
    return d.with_web_fields(fx.web(spark, sf))


def labels(spark, sf):
    return fx.roster(spark, sf).filter("label is not null")


def _on(source, build, digits: int = 6) -> Query:
    return lambda spark, sf: rounded(build(source(spark, sf)), digits)


# ---- sources, sinks, unions --------------------------------------------------------------------


def _through_text(fixture, reader) -> Query:
    """Write the stand-in as tab text into the shared folder and read it with the fixed schema."""

    def run(spark, sf):
        path = scratch_path(spark, "text")
        sources.write_tab_text(fixture(spark, sf), path)
        return reader(spark, path)

    return run


def _blended(spark, sf):
    return scoring.weighted_blend(
        scoring.seed_average(fx.scores(calls(spark, sf))), scoring.ROUND_B["deep"], scoring.ROUND_B["shallow"]
    )


def _labelled(spark, sf):
    return scoring.threshold_label(_blended(spark, sf), scoring.ROUND_B["threshold"])


def _scored(spark, sf):
    """(label, score) of the labelled users: the seed average of the deep family.

    Rounded, because averages of equal shares may differ in the last bit and would not tie.
    """
    averaged = scoring.seed_average(fx.scores(calls(spark, sf))).filter("family = 'deep'")
    return averaged.join(labels(spark, sf), "uid").select("uid", "label", F.round("score", 9).alias("score"))


def _roster_size(spark, sf):
    users = fx.roster(spark, sf)
    return sources.test_roster(spark, 5000, users.count())


def _submission(spark, sf):
    path = scratch_path(spark, "submission")
    sources.write_submission(_labelled(spark, sf), path)
    return sources.read_predictions(spark, path)


def _rank_submission(spark, sf):
    """Blends are rounded first, because equal ones may differ in the last bit and would not tie."""
    return scoring.rank_submission(_labelled(spark, sf).withColumn("blend", F.round("blend", 6)))


def _predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    labels(spark, sf).select("uid", "label").write.option("header", False).csv(path)
    return sources.read_predictions(spark, path)


def _union_rounds(spark, sf):
    rows, known = fx.voice(spark, sf), labels(spark, sf).select("uid")
    return sources.union_rounds(rows.join(known, "uid", "left_semi"), rows.join(known, "uid", "left_anti"))


def _union_pseudo_labels(spark, sf):
    return sources.union_pseudo_labels(fx.roster(spark, sf), _labelled(spark, sf))


def _by_source(tables):
    """Rows of several tables with their ``source``; a key is the source, or starts with it."""
    named_rows = [
        rows.withColumn("source", F.lit(key if isinstance(key, str) else key[0])) for key, rows in tables.items()
    ]
    return reduce(DataFrame.unionByName, named_rows)


# How rows are spoiled, by a number of theirs: a letter in the last field, a field too few, a field too many.
FAULTY = {"voice": "tel_end_time", "sms": "cast(smg_start_time as bigint)", "wa": "down_flow"}


def _read_faults(spark, sf):
    """Each table as tab text with planted faults, and the account of reading it back."""
    tables = {"voice": (fx.voice(spark, sf), schemas.VOICE), "sms": (fx.sms(spark, sf), schemas.SMS), "wa": (fx.web(spark, sf), schemas.WEB)}
    accounts = {}
    for source, (rows, schema) in tables.items():
        fields = [f"coalesce(cast({c} as string), '')" for c in schema.names]
        last = f"concat({fields[-1]}, case when {FAULTY[source]} % 10 = 3 then 'x' else '' end)"
        short, line = (f"concat_ws('\t', {', '.join(part)})" for part in (fields[:-1], [*fields[:-1], last]))
        line = f"case {FAULTY[source]} % 10 when 4 then {short} when 5 then concat({line}, '\t1') else {line} end"
        path = scratch_path(spark, "faulty")
        rows.selectExpr(f"{line} as value").write.text(path)
        accounts[source] = account(read_accounted(spark, path, schema, name=source))
    return _by_source(accounts)


def _merged_rounds(source, states, build, moment: str, digits: int = 6) -> Query:
    """Features from the stored states of two rounds: events with an even and with an odd ``moment``."""

    def run(spark, sf):
        rows, path = source(spark, sf), scratch_path(spark, "states")
        for name, odd in (("A", 0), ("B", 1)):
            save_round(states(rows.where(f"cast({moment} as bigint) % 2 = {odd}")), path, name)
        return rounded(build(load_rounds(spark, path)), digits)

    return run


# ---- rows --------------------------------------------------------------------------------------


def _call_duration(spark, sf):
    return calls(spark, sf).select("uid", "tel_start_time", "tel_end_time", "tel_len")


def _call_day_hour(spark, sf):
    return calls(spark, sf).select("uid", "tel_start_time", "tel_date", "tel_hour")


def _sms_day_hour(spark, sf):
    return texts(spark, sf).select("uid", "smg_start_time", "smg_date", "smg_hour")


def _day_bag(spark, sf):
    days = {
        "voice": calls(spark, sf).select("uid", F.col("tel_date").alias("day")),
        "sms": texts(spark, sf).select("uid", F.col("smg_date").alias("day")),
        "wa": fx.web(spark, sf).select("uid", F.col("wa_date").alias("day")),
    }
    return _by_source(days).withColumn("bag", F.expr(d.day_bag("day"))).filter("bag is not null")


def _number_length_class(spark, sf):
    numbers = {
        "voice": fx.voice(spark, sf).select("uid", F.col("tel_opp_len").alias("opp_len")),
        "sms": fx.sms(spark, sf).select("uid", F.col("smg_opp_len").alias("opp_len")),
    }
    return _by_source(numbers).withColumn("cls", F.expr(d.number_length_class("opp_len")))


def _hour_class(spark, sf):
    hours = {
        "voice": calls(spark, sf).select("uid", F.col("tel_hour").alias("hour")),
        "sms": texts(spark, sf).select("uid", F.col("smg_hour").alias("hour")),
    }
    classes = d.hour_class_conditions("hour")
    return _by_source(hours).select("*", *[F.expr(c).cast("int").alias(f"class_{k}") for k, c in enumerate(classes)])


def _call_length_class(spark, sf):
    return calls(spark, sf).select("uid", "tel_len", F.expr(d.call_length_class("tel_len")).alias("cls"))


def _duration_decade(spark, sf):
    return fx.web(spark, sf).select("uid", "visit_dura", F.expr(d.duration_decade("visit_dura")).alias("decade"))


def _operator_class(spark, sf):
    heard = calls(spark, sf).select(F.lit("voice").alias("source"), "uid", F.col("tel_opp_head").alias("head"), F.col("tel_operator").alias("operator"))
    read = texts(spark, sf).select(F.lit("sms").alias("source"), "uid", F.col("smg_opp_head").alias("head"), F.col("smg_operator").alias("operator"))
    return heard.unionByName(read)


def _wa_rates(spark, sf):
    return rounded(
        accesses(spark, sf).select(
            "uid", "wa_date", "visit_per_dura", "flow_amount", "download_speed", "upload_speed", "amount_speed"
        )
    )


def _slice_rows(spark, sf):
    """Both slices of every event table: what each table's rows have in common."""
    tables = {
        "voice": (fx.voice(spark, sf), "tel_in_and_out", "tel_opp_num", "tel_start_time"),
        "sms": (fx.sms(spark, sf), "smg_in_and_out", "smg_opp_num", "smg_start_time"),
        "wa": (fx.web(spark, sf), "wa_type", "wa_name", "wa_date"),
    }
    return _by_source(
        {
            (source, value): d.slice_rows(rows, column, value).selectExpr(
                "uid", f"{value} as slice", f"{name} as name", f"cast({moment} as bigint) as moment"
            )
            for source, (rows, column, name, moment) in tables.items()
            for value in (1, 0)
        }
    )


def _truncate_features(spark, sf):
    """The integer SMS matrix."""
    return sms_plan.feature_matrix(texts(spark, sf), fx.MANIFESTS["sms"], truncate=True)


# ---- joins -------------------------------------------------------------------------------------


def _matrices(spark, sf):
    return assemble.table_matrices(fx.voice(spark, sf), fx.sms(spark, sf), fx.web(spark, sf), fx.MANIFESTS)


def _rounded_matrices(spark, sf):
    """One row per user is rounded, and not every row that a user has in labels or roster."""
    return [rounded(matrix, WIDE_DIGITS) for matrix in _matrices(spark, sf)]


def _domain_outer(spark, sf):
    return rounded(assemble.domain_outer(*_matrices(spark, sf)), WIDE_DIGITS)


def _train_matrix(spark, sf):
    return assemble.train_matrix(fx.roster(spark, sf), *_rounded_matrices(spark, sf))


def _score_matrix(spark, sf):
    unknown = fx.roster(spark, sf).filter("label is null")
    return assemble.score_matrix(unknown, *_rounded_matrices(spark, sf))


def _hot_value_split(spark, sf):
    rows = fx.voice(spark, sf).select("uid", "tel_opp_num", "tel_start_time")
    return hot_value_split(rows, "tel_opp_num", values_in_band(rows, "tel_opp_num", fx.VOICE_HOT))


def _feature_group_outer(spark, sf):
    """One table's flat, daily and keyed groups side by side, without the one-hot columns."""
    return rounded(voice_plan.feature_matrix(calls(spark, sf), manifest={}), WIDE_DIGITS)


# ---- tables ------------------------------------------------------------------------------------

# Flows, durations and their spreads run to 1e8: with three digits they still have eleven.
LARGE_DIGITS = 3
WIDE_DIGITS = 3


def _skewed_names(spark, sf):
    return rounded(web_plan.skewed_names(fx.web(spark, sf), labels(spark, sf), fx.MIN_BAD, fx.MAX_GOOD))


def _skewed_name_counts(spark, sf):
    rows = fx.web(spark, sf)
    names = web_plan.skewed_names(rows, labels(spark, sf), fx.MIN_BAD, fx.MAX_GOOD)
    return web_plan.skewed_name_counts(rows, names)


def _feature_manifest(spark, sf, counts=None):
    tables = fx.voice(spark, sf), fx.sms(spark, sf), fx.web(spark, sf)
    return assemble.feature_values(*tables, labels(spark, sf), fx.MIN_BAD, fx.MAX_GOOD, fx.WEB_HOT, counts=counts)


def _feature_cells(spark, sf):
    """The one-hot part of M1 with values fitted on the data."""
    values = _feature_manifest(spark, sf)
    return assemble.feature_cells(fx.voice(spark, sf), fx.sms(spark, sf), fx.web(spark, sf), values)


def _space(spark, sf, counts=None):
    """The feature space fitted on the data: numeric features, observed values, the names of W2 and W4."""
    return space.fit_space(_feature_manifest(spark, sf, counts), space.fixed_names())


def _vectors(spark, sf):
    """M1 over the fitted space, written to the shared folder: every model reads it from there."""
    tables = fx.voice(spark, sf), fx.sms(spark, sf), fx.web(spark, sf)
    counts = assemble.settled_counts(assemble.value_counts(*tables))
    return space.feature_vectors(*tables, fx.roster(spark, sf), _space(spark, sf, counts), counts)


def _feature_slots(spark, sf):
    return _space(spark, sf).select("slot", "source", "dim", "key", "slice")


def _slot_values(spark, sf):
    """All features of all users, fitted columns included, as rows; small values with more digits."""
    rows = space.slot_values(_vectors(spark, sf))
    return rows.withColumn("value", F.expr("if(abs(value) < 1000, round(value, 6), round(value, 3))")).filter("value <> 0")


# ---- models ------------------------------------------------------------------------------------

# The registered ensembles have their full settings. Those of the ``..._scored_users`` checks: full depth and sampling, but
# two of ten seeds, and leaves that a few hundred labelled users can fill.
FEWER_DEEP = replace(models.DEEP_A, rounds=30, leaf_rows=5, seeds=[0, 7])
FEWER_SHALLOW = replace(models.SHALLOW, rounds=30, leaf_rows=5, seeds=[0, 1])
# What holds for scores of any model is checked with a few rounds.
CHECK_ROUNDS = 3


def _full_feature_matrix(spark, sf):
    tables = fx.voice(spark, sf), fx.sms(spark, sf), fx.web(spark, sf)
    return assemble.full_feature_matrix(
        *tables, fx.roster(spark, sf), fx.MANIFESTS, finish=lambda features: rounded(features, WIDE_DIGITS)
    )


def _train_and_score(spark, sf):
    return assemble.split_known(_vectors(spark, sf))


def _holdout_split(spark, sf):
    known = labels(spark, sf)
    fit, held = models.holdout_split(known)
    return fit.withColumn("held", F.lit(0)).unionByName(held.withColumn("held", F.lit(1)))


def _deep(spark, sf, settings=models.DEEP_A):
    return models.deep_ensemble(*_train_and_score(spark, sf), settings=settings)


def _shallow(spark, sf, settings=models.SHALLOW):
    return models.shallow_ensemble(*_train_and_score(spark, sf), settings=settings)


def _one_table(spark, sf, matrix):
    users = fx.roster(spark, sf)
    path = scratch_path(spark, "matrix")
    users.join(matrix, "uid", "left").na.fill(0, [c for c in matrix.columns if c != "uid"]).write.parquet(path)
    return assemble.split_known(spark.read.parquet(path))


def _perceptron(spark, sf, **settings):
    matrix = sms_plan.feature_matrix(texts(spark, sf), fx.MANIFESTS["sms"])
    return models.perceptron_scores(*_one_table(spark, sf, matrix), **settings)


def _regression(spark, sf, **settings):
    matrix = voice_plan.feature_matrix(calls(spark, sf), fx.MANIFESTS["voice"])
    return models.regression_scores(*_one_table(spark, sf, matrix), **settings)


def _ensemble_scores(fit, settings) -> Query:
    """Whom an ensemble scores, and whether the scores are probabilities."""
    few = replace(settings, rounds=CHECK_ROUNDS)
    in_range = "cast(score between 0 and 1 as int) as in_range"
    return lambda spark, sf: fit(spark, sf, few).selectExpr("uid", "family", "seed", in_range)


def _pair_scores(fit, **few) -> Query:
    """Whom a model of one table scores, and whether both classes' scores add up to 1."""
    adds_up = "cast(abs(p0 + p1 - 1) < 1e-9 as int) as adds_up"
    return lambda spark, sf: fit(spark, sf, **few).selectExpr("uid", adds_up)


QUERIES: dict[str, Query] = {
    # sources, sinks, set operations
    "read_voice": _through_text(fx.voice, sources.read_voice),
    "read_sms": _through_text(fx.sms, sources.read_sms),
    "read_wa": _through_text(fx.web, sources.read_wa),
    "read_faults": _read_faults,
    "read_labels": _through_text(labels, sources.read_labels),
    "test_roster": _roster_size,
    "read_predictions": _predictions,
    "write_submission": _submission,
    "union_rounds": _union_rounds,
    "union_pseudo_labels": _union_pseudo_labels,
    # projections and predicates
    "call_duration": _call_duration,
    "call_day_hour": _call_day_hour,
    "sms_day_hour": _sms_day_hour,
    "day_bag": _day_bag,
    "number_length_class": _number_length_class,
    "hour_class": _hour_class,
    "call_length_class": _call_length_class,
    "duration_decade": _duration_decade,
    "operator_class": _operator_class,
    "wa_rates": _wa_rates,
    "slice_rows": _slice_rows,
    "truncate_features": _truncate_features,
    # joins
    "domain_outer": _domain_outer,
    "train_matrix": _train_matrix,
    "score_matrix": _score_matrix,
    "hot_value_split": _hot_value_split,
    "feature_group_outer": _feature_group_outer,
    # voice
    "voice_in_out": _on(calls, voice_plan.in_out),
    "voice_call_type_counts": _on(calls, voice_plan.call_type_counts),
    "voice_len_mean": _on(calls, voice_plan.len_mean),
    "voice_len_sum": _on(calls, voice_plan.len_sum),
    "voice_len_max": _on(calls, voice_plan.len_max),
    "voice_len_class_counts": _on(calls, voice_plan.len_class_counts),
    "voice_opp_len_class_counts": _on(calls, voice_plan.opp_len_class_counts),
    "voice_daily_count_stats": _on(calls, voice_plan.daily_count_stats),
    "voice_bag_counts": _on(calls, voice_plan.bag_counts),
    "voice_day_counts": _on(calls, voice_plan.day_counts),
    "voice_head_counts": _on(calls, voice_plan.head_counts),
    "voice_short_number_counts": _on(calls, voice_plan.short_number_counts),
    "voice_hot_number_counts": _on(calls, lambda rows: voice_plan.hot_number_counts(rows, fx.VOICE_HOT)),
    "voice_opp_len_counts": _on(calls, voice_plan.opp_len_counts),
    "voice_hour_class_counts": _on(calls, voice_plan.hour_class_counts),
    "voice_distinct": _on(calls, voice_plan.distinct),
    "voice_daily_count_stats_merged": _merged_rounds(
        calls, daily_states.voice_states, daily_states.voice_daily_count_stats, "tel_start_time"
    ),
    "voice_len_moments_merged": _merged_rounds(calls, daily_states.voice_states, daily_states.voice_len_moments, "tel_end_time"),
    "sms_daily_count_stats_merged": _merged_rounds(
        texts, daily_states.sms_states, daily_states.sms_daily_count_stats, "smg_start_time"
    ),
    "wa_daily_visit_stats_merged": _merged_rounds(
        accesses, daily_states.web_states, daily_states.web_daily_visit_stats, "down_flow"
    ),
    "wa_daily_dura_stats_merged": _merged_rounds(
        accesses, daily_states.web_states, daily_states.web_daily_dura_stats, "down_flow", LARGE_DIGITS
    ),
    "voice_len_stats": _on(calls, voice_plan.len_stats),
    "voice_len_stats_hot": _on(calls, lambda rows: voice_plan.len_stats(rows, hot_rows=0)),
    "voice_daily_len_stats": _on(calls, voice_plan.daily_len_stats),
    "voice_operator_len_stats": _on(calls, voice_plan.operator_len_stats),
    "voice_operator_counts": _on(calls, voice_plan.operator_counts),
    "voice_feature_matrix": _on(
        calls, lambda rows: voice_plan.feature_matrix(rows, fx.MANIFESTS["voice"]), WIDE_DIGITS
    ),
    # SMS
    "sms_daily_count_stats": _on(texts, sms_plan.daily_count_stats),
    "sms_bag_counts": _on(texts, sms_plan.bag_counts),
    "sms_day_counts": _on(texts, sms_plan.day_counts),
    "sms_head_counts": _on(texts, sms_plan.head_counts),
    "sms_operator_counts": _on(texts, sms_plan.operator_counts),
    "sms_operator_in_out_diff": _on(texts, sms_plan.operator_in_out_diff),
    "sms_hot_number_counts": _on(texts, lambda rows: sms_plan.hot_number_counts(rows, fx.SMS_BAND)),
    "sms_short_number_counts": _on(texts, sms_plan.short_number_counts),
    "sms_opp_len_class": _on(texts, sms_plan.opp_len_class),
    "sms_opp_len_class_ratio": _on(texts, sms_plan.opp_len_class_ratio),
    "sms_in_out": _on(texts, sms_plan.in_out),
    "sms_foreign": _on(texts, sms_plan.foreign),
    "sms_hour_class_counts": _on(texts, sms_plan.hour_class_counts),
    "sms_hour_counts": _on(texts, sms_plan.hour_counts),
    "sms_opp_len_counts": _on(texts, sms_plan.opp_len_counts),
    "sms_distinct": _on(texts, sms_plan.distinct),
    "sms_daily_spread": _on(texts, sms_plan.daily_spread),
    "sms_home": _on(texts, sms_plan.home),
    "sms_feature_matrix": _on(texts, lambda rows: sms_plan.feature_matrix(rows, fx.MANIFESTS["sms"]), WIDE_DIGITS),
    # web and apps
    "wa_distinct_names": _on(accesses, web_plan.distinct_names),
    "wa_skewed_names": _skewed_names,
    "wa_skewed_name_counts": _skewed_name_counts,
    "wa_hot_name_counts": _on(accesses, lambda rows: web_plan.hot_name_counts(rows, fx.WEB_HOT)),
    "wa_bag_flow_share": _on(accesses, web_plan.bag_flow_share),
    "wa_bag_count_share": _on(accesses, web_plan.bag_count_share),
    "wa_bag_dura_share": _on(accesses, web_plan.bag_dura_share),
    "wa_row_counts": _on(accesses, web_plan.row_counts),
    "wa_daily_visit_stats": _on(accesses, web_plan.daily_visit_stats),
    "wa_visit_stats": _on(accesses, web_plan.visit_stats),
    "wa_daily_dura_stats": _on(accesses, web_plan.daily_dura_stats, LARGE_DIGITS),
    "wa_dura_decade_counts": _on(accesses, web_plan.dura_decade_counts),
    "wa_up_flow_stats": _on(accesses, web_plan.up_flow_stats, LARGE_DIGITS),
    "wa_down_flow_stats": _on(accesses, web_plan.down_flow_stats, LARGE_DIGITS),
    "wa_flow_amount_stats": _on(accesses, web_plan.flow_amount_stats, LARGE_DIGITS),
    "wa_active_days": _on(accesses, web_plan.active_days),
    "wa_daily_per_visit_stats": _on(accesses, web_plan.daily_per_visit_stats, LARGE_DIGITS),
    "wa_speed_stats": _on(accesses, web_plan.speed_stats, LARGE_DIGITS),
    "wa_visit_stats_hot": _on(accesses, lambda rows: web_plan.visit_stats(rows, hot_rows=0)),
    "wa_speed_stats_hot": _on(accesses, lambda rows: web_plan.speed_stats(rows, hot_rows=0), LARGE_DIGITS),
    "wa_feature_matrix": _on(accesses, lambda rows: web_plan.feature_matrix(rows, fx.MANIFESTS["wa"]), WIDE_DIGITS),
    # modelling and scoring
    "full_feature_matrix": _full_feature_matrix,
    "feature_manifest": _feature_manifest,
    "feature_cells": _feature_cells,
    "feature_slots": _feature_slots,
    "feature_slot_values": _slot_values,
    "holdout_split": _holdout_split,
    "gbt_deep_ensemble": _deep,
    "gbt_shallow_ensemble": _shallow,
    "mlp_single_table": _perceptron,
    "gbt_regression_single_table": _regression,
    "gbt_deep_scored_users": _ensemble_scores(_deep, FEWER_DEEP),
    "gbt_shallow_scored_users": _ensemble_scores(_shallow, FEWER_SHALLOW),
    "mlp_scored_users": _pair_scores(_perceptron, rounds=CHECK_ROUNDS),
    "gbt_regression_scored_users": _pair_scores(
        _regression, settings=replace(models.REGRESSION, rounds=CHECK_ROUNDS)
    ),
    "seed_average": lambda spark, sf: rounded(scoring.seed_average(fx.scores(calls(spark, sf)))),
    "weighted_blend": lambda spark, sf: rounded(_blended(spark, sf)),
    "threshold_label": lambda spark, sf: rounded(_labelled(spark, sf)),
    "rank_submission": _rank_submission,
    "auc": lambda spark, sf: rounded(scoring.auc(_scored(spark, sf))),
    "f1_at": lambda spark, sf: rounded(scoring.f1_at(_scored(spark, sf))),
    "combined_score": lambda spark, sf: rounded(scoring.combined_score(_scored(spark, sf))),
}
