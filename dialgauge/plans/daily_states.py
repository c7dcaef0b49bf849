"""The day features of V8, T1, W9 and W11, and V17's exact moments, from merged states."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..operators import daily_features, flat_features
from ..operators.states import day_measures, day_states, state_stats
from . import sms, voice, web

FIRST, SECOND = "slice = 1", "slice = 0"


def voice_states(calls: DataFrame) -> DataFrame:
    return day_states(calls, "tel_date", "tel_in_and_out", {"len": "tel_len"})


def sms_states(texts: DataFrame) -> DataFrame:
    return day_states(texts, "smg_date", "smg_in_and_out", {})


def web_states(accesses: DataFrame) -> DataFrame:
    return day_states(accesses, "wa_date", "wa_type", {"visits": "visit_cnt", "dura": "visit_dura"})


def _three(names: list[str], column: str) -> dict[str, str]:
    return day_measures(dict(zip(names, [(column, None), (column, FIRST), (column, SECOND)])))


def voice_daily_count_stats(states: DataFrame) -> DataFrame:
    spec = replace(voice.DAILY_COUNT, day="day", measures=_three(["calls", "calls_in", "calls_out"], "n"))
    return daily_features(states, spec)


def sms_daily_count_stats(states: DataFrame) -> DataFrame:
    return daily_features(states, replace(sms.DAILY_COUNT, day="day", measures=_three(["sent", "sent_in", "sent_out"], "n")))


def web_daily_visit_stats(states: DataFrame) -> DataFrame:
    names = list(web.DAILY_VISITS.measures)
    return daily_features(states, replace(web.DAILY_VISITS, day="day", measures=_web(names, "visits_sum")))


def web_daily_dura_stats(states: DataFrame) -> DataFrame:
    names = list(web.DAILY_DURA.measures)
    return daily_features(states, replace(web.DAILY_DURA, day="day", measures=_web(names, "dura_sum")))


def _web(names: list[str], column: str) -> dict[str, str]:
    return day_measures(dict(zip(names, [(column, None), (column, _sliced(web.WEB)), (column, _sliced(web.APP))])))


def _sliced(condition: str) -> str:
    return condition.replace("wa_type", "slice")


def voice_len_moments(states: DataFrame) -> DataFrame:
    slices = {"tel_len_": None, "tel_len_in_": FIRST, "tel_len_out_": SECOND}
    return flat_features(states, state_stats("len", slices, ["std", "max", "min", "mean", "sum"]))
