"""Voice features. Input: voice rows with the fields of ``with_call_fields``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions import derive as d
from ..functions.text import quoted_list
from ..operators import (
    Category,
    Daily,
    Flat,
    Keyed,
    category_counts,
    daily_features,
    fit_manifest,
    flat_features,
    hot_value_counts,
    keyed_features,
    long_counts,
    slice_stats,
    values_in_band,
)
from ..operators.aggregate import day_stats
from ..operators.categories import Manifest
from ..operators.skew import HOT_ROWS
from .table import TableFeatures, table_matrix

IN, OUT = "tel_in_and_out = 1", "tel_in_and_out = 0"
SLICES = {"all": None, "in": IN, "out": OUT}
OPERATORS = ["yidong", "liantong", "dianxin", "other"]
HOT_CALLS = 800


def _both_ways(stat: str, name: str) -> Flat:
    stats = slice_stats("tel_len", {"tel_in_": IN, "tel_out_": OUT}, [stat])
    return stats + Flat(derived={f"in_out_{name}_diff": f"tel_in_{name} - tel_out_{name}"})


IN_OUT = Flat(  # V1
    aggs={"tel_in": f"count_if({IN})", "tel_out": f"count_if({OUT})"},
    derived={
        "tel_fre": "tel_in + tel_out",
        # Derived features of a user without calls are 0, this one too.
        "tel_in_out_ratio": "if(tel_in + tel_out > 0, (tel_out + 1) / (tel_in + 1), 0)",
    },
)
LEN_MEAN = _both_ways("mean", "mean")  # V3
LEN_SUM = _both_ways("sum", "sum")  # V4
LEN_MAX = _both_ways("max", "max")  # V5
LEN_CLASS = Flat(  # V6
    {f"tel_{name}_fre": f"count_if({c})" for name, c in d.call_length_conditions("tel_len").items()}
)
OPP_LEN_CLASS = Flat(  # V7
    {f"tel_opp_{name}": f"count_if({c})" for name, c in d.number_length_conditions("tel_opp_len").items()}
)
DAILY_COUNT = Daily(  # V8
    "tel_date",
    {"calls": "count(*)", "calls_in": f"nullif(count_if({IN}), 0)", "calls_out": f"nullif(count_if({OUT}), 0)"},
    day_stats(
        {"tel_date_": "calls", "tel_in_date_": "calls_in", "tel_out_date_": "calls_out"},
        ["mean", "count", "sum", "std"],
    ),
    {f"tel_date_in_out_diff_{s}": f"tel_in_date_{s} - tel_out_date_{s}" for s in ["mean", "count", "sum", "std"]},
)
BAGS = Flat(  # V9
    {f"tel_date_cnt_cat_{b}_count": f"count_if({d.bag_condition('tel_date', b)})" for b in range(d.BAG_COUNT)}
)
HOUR_CLASS = Flat(  # V15
    {
        f"{prefix}hour_div_{k}": f"count_if(({c}){where})"
        for prefix, where in {"tel_": "", "tel_in_": f" and {IN}", "tel_out_": f" and {OUT}"}.items()
        for k, c in enumerate(d.hour_class_conditions("tel_hour"))
    }
)
DISTINCT = Keyed(  # V16
    {"num": "tel_opp_num", "head": "tel_opp_head"},
    {},
    {"voice_opp_num_unique_count": "count_if(dim = 'num')", "voice_opp_head_unique_count": "count_if(dim = 'head')"},
)
LEN_STATS = slice_stats(  # V17
    "tel_len",
    {"tel_len_": None, "tel_len_in_": IN, "tel_len_out_": OUT},
    ["std", "max", "min", "median", "mean", "sum"],
)
DAILY_LEN = Daily(  # V18
    "tel_date",
    {"seconds": "sum(tel_len)"},
    day_stats({"tel_len_date_": "seconds"}, ["std", "max", "min", "median", "mean", "sum"]),
)
OPERATOR_LEN = slice_stats(  # V19
    "tel_len", {f"{o}_tel_len_": f"tel_operator = '{o}'" for o in OPERATORS}, ["std", "sum", "max", "mean"]
)
OPERATOR_COUNT = Flat({f"{o}_fre": f"count_if(tel_operator = '{o}')" for o in OPERATORS[:3]})  # V20

CALL_TYPE = Category(  # V2
    "tel_call_type", {"all": "tel_type_{}_fre", "in": "tel_type_{}_fre_in", "out": "tel_type_{}_fre_out"}
)
DAY = Category("tel_date", {"all": "tel_date_{}", "in": "tel_in_date_{}", "out": "tel_out_date_{}"})  # V10
HEAD = Category(  # V11
    "tel_opp_head",
    {"all": "tel_opp_head_cat_{}", "in": "tel_in_opp_head_cat_{}", "out": "tel_out_opp_head_cat_{}"},
)
SHORT_NUMBER = Category(  # V12
    "case when tel_opp_len <= 5 then tel_opp_num end", {"all": "tel_opp_num_{}"}
)
OPP_LEN = Category(  # V14
    "tel_opp_len", {"all": "tel_opp_len_{}", "in": "tel_in_opp_len_{}", "out": "tel_out_opp_len_{}"}
)

CATEGORIES = {
    "type": CALL_TYPE,
    "day": DAY,
    "head": HEAD,
    "len": OPP_LEN,
    "short": SHORT_NUMBER,
}

FEATURES = TableFeatures(
    flat=IN_OUT
    + LEN_MEAN
    + LEN_SUM
    + LEN_MAX
    + LEN_CLASS
    + OPP_LEN_CLASS
    + BAGS
    + HOUR_CLASS
    + LEN_STATS
    + OPERATOR_LEN
    + OPERATOR_COUNT,
    daily=DAILY_COUNT + DAILY_LEN,
    keyed=DISTINCT,
    categories=CATEGORIES,
    slices=SLICES,
)


def in_out(voice: DataFrame) -> DataFrame:
    """V1: calls in, out, both, and the smoothed ratio."""
    return flat_features(voice, IN_OUT)


def call_type_counts(voice: DataFrame) -> DataFrame:
    """V2: (uid, slice, tel_call_type, n)."""
    return long_counts(category_counts(voice, {"type": CALL_TYPE}, SLICES), SLICES, "tel_call_type")


def len_mean(voice: DataFrame) -> DataFrame:
    """V3: mean call length in, out, and the difference."""
    return flat_features(voice, LEN_MEAN)


def len_sum(voice: DataFrame) -> DataFrame:
    """V4: total call length in, out, and the difference."""
    return flat_features(voice, LEN_SUM)


def len_max(voice: DataFrame) -> DataFrame:
    """V5: longest call in, out, and the difference."""
    return flat_features(voice, LEN_MAX)


def len_class_counts(voice: DataFrame) -> DataFrame:
    """V6: short, middle and long calls."""
    return flat_features(voice, LEN_CLASS)


def opp_len_class_counts(voice: DataFrame) -> DataFrame:
    """V7: calls per class of number length."""
    return flat_features(voice, OPP_LEN_CLASS)


def daily_count_stats(voice: DataFrame) -> DataFrame:
    """V8: calls per day, spread over days, in minus out."""
    return daily_features(voice, DAILY_COUNT)


def bag_counts(voice: DataFrame) -> DataFrame:
    """V9: calls per five-day bag."""
    return flat_features(voice, BAGS)


def day_counts(voice: DataFrame) -> DataFrame:
    """(uid, slice, tel_date, n)."""
    return long_counts(category_counts(voice, {"day": DAY}, SLICES), SLICES, "tel_date")


def head_counts(voice: DataFrame) -> DataFrame:
    """(uid, slice, tel_opp_head, n); a missing prefix has no count."""
    return long_counts(category_counts(voice, {"head": HEAD}, SLICES), SLICES, "tel_opp_head")


def short_number_counts(voice: DataFrame) -> DataFrame:
    """(uid, slice, tel_opp_num, n) for numbers of up to five digits."""
    return long_counts(category_counts(voice, {"short": SHORT_NUMBER}, {"all": None}), ["all"], "tel_opp_num")


def hot_number_counts(voice: DataFrame, more_than: int = HOT_CALLS) -> DataFrame:
    """(uid, value_group, n): calls per user and frequent number, all other numbers together."""
    return hot_value_counts(voice, "tel_opp_num", values_in_band(voice, "tel_opp_num", more_than))


def opp_len_counts(voice: DataFrame) -> DataFrame:
    """(uid, slice, tel_opp_len, n)."""
    return long_counts(category_counts(voice, {"len": OPP_LEN}, SLICES), SLICES, "tel_opp_len")


def hour_class_counts(voice: DataFrame) -> DataFrame:
    """Calls per hour class; hour 17 counts in two classes."""
    return flat_features(voice, HOUR_CLASS)


def distinct(voice: DataFrame) -> DataFrame:
    """Different numbers and prefixes."""
    return keyed_features(voice, DISTINCT)


def len_stats(voice: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Six statistics of call length over all, in, out."""
    return flat_features(voice, LEN_STATS, hot_rows)


def daily_len_stats(voice: DataFrame) -> DataFrame:
    """Six statistics of the daily total length."""
    return daily_features(voice, DAILY_LEN)


def operator_len_stats(voice: DataFrame) -> DataFrame:
    """Statistics of call length per operator."""
    return flat_features(voice, OPERATOR_LEN)


def operator_counts(voice: DataFrame) -> DataFrame:
    """Calls per operator."""
    return flat_features(voice, OPERATOR_COUNT)


def features_for(manifest: Manifest, extended: bool = False) -> tuple[TableFeatures, Manifest]:
    """Feature groups and columns. With a hot list, one column per listed number and one for all the others."""
    hot_numbers = manifest.get("hot", []) if extended else []
    if not hot_numbers:
        return FEATURES, manifest
    hot = Category(
        f"case when tel_opp_num in ({quoted_list(hot_numbers)}) then tel_opp_num else 'other' end",
        {"all": "hot_tel_opp_num_{}_cnt"},
    )
    return replace(FEATURES, categories={**CATEGORIES, "hot": hot}), {**manifest, "hot": [*hot_numbers, "other"]}


def feature_matrix(
    voice: DataFrame,
    manifest: Manifest | None = None,
    extended: bool = False,
    more_than: int = HOT_CALLS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Every voice feature, one row per user.

    ``extended`` adds the frequent numbers (``manifest["hot"]``, or numbers above ``more_than`` calls).
    """
    manifest = fit_voice_manifest(voice, extended, more_than) if manifest is None else manifest
    return table_matrix(voice, *features_for(manifest, extended), hot_rows)


def fit_voice_manifest(voice: DataFrame, extended: bool = False, more_than: int = HOT_CALLS) -> Manifest:
    """The category values that become columns."""
    manifest = fit_manifest(voice, CATEGORIES)
    if extended:
        hot = values_in_band(voice, "tel_opp_num", more_than).limit(5001).collect()
        if len(hot) > 5000:
            raise ValueError("more than 5000 frequent numbers: raise the threshold or use the long form")
        manifest["hot"] = sorted(r["tel_opp_num"] for r in hot)
    return manifest
