"""SMS features. Input: SMS rows with the fields of ``with_sms_fields``."""

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
    values_in_band,
)
from ..operators.aggregate import day_stats
from ..operators.categories import Manifest
from ..operators.skew import HOT_ROWS
from .table import TableFeatures, table_matrix

IN, OUT = "smg_in_and_out = 1", "smg_in_and_out = 0"
SLICES = {"all": None, "in": IN, "out": OUT}
OPERATORS = ["yidong", "liantong", "dianxin", "other"]
HOT_BAND = (1000, 3000)
SHORT_LENGTH = 7

PER_DAY = {"sent": "count(*)", "sent_in": f"nullif(count_if({IN}), 0)", "sent_out": f"nullif(count_if({OUT}), 0)"}

DAILY_COUNT = Daily(  # T1
    "smg_date",
    PER_DAY,
    day_stats(
        {"msg_date_": "sent", "msg_in_date_": "sent_in", "msg_out_date_": "sent_out"},
        ["mean", "count", "sum", "std"],
    ),
    {f"msg_date_in_out_diff_{s}": f"msg_in_date_{s} - msg_out_date_{s}" for s in ["mean", "count", "sum", "std"]},
)
DAILY_SPREAD = Daily(  # T17
    "smg_date",
    PER_DAY,
    day_stats(
        {"smg_date_": "sent", "smg_in_date_": "sent_in", "smg_out_date_": "sent_out"}, ["std", "max", "median"]
    ),
)
BAGS = Flat(  # T2
    {f"msg_date_cnt_cat_{b}_count": f"count_if({d.bag_condition('smg_date', b)})" for b in range(d.BAG_COUNT)}
)
OPERATOR_COUNT = Flat(  # T5
    {
        f"{o}_msg_{way}count": f"count_if(smg_operator = '{o}'{where})"
        for way, where in {"": "", "in_": f" and {IN}", "out_": f" and {OUT}"}.items()
        for o in OPERATORS
    }
)
OPERATOR_DIFF = Flat(  # T6
    {
        f"_{o}_{way}": f"count_if(smg_operator = '{o}' and {where})"
        for o in OPERATORS
        for way, where in {"in": IN, "out": OUT}.items()
    },
    derived={f"{o}_smg_diff_cnt": f"if(_{o}_in > 0 and _{o}_out > 0, _{o}_in - _{o}_out, 0)" for o in OPERATORS},
)
IN_OUT = Flat(  # T11
    {"smg_in_cnt": f"count_if({IN})", "smg_out_cnt": f"count_if({OUT})"},
    derived={"smg_in_out_cnt_diff": "smg_in_cnt - smg_out_cnt"},
)
FOREIGN = Flat({"foreign_fre": "count_if(smg_operator = 'foreign')"})  # T12
HOUR_CLASS = Flat(  # T13
    {
        f"{prefix}hour_div_{k}": f"count_if(({c}){where})"
        for prefix, where in {"msg_": "", "msg_in_": f" and {IN}", "msg_out_": f" and {OUT}"}.items()
        for k, c in enumerate(d.hour_class_conditions("smg_hour"))
    }
)
HOME = Flat(  # T18
    {"_total": f"count_if({IN} or {OUT})", "_foreign": "count_if(smg_operator = 'foreign')"},
    derived={"smg_fre": "_total", "home_fre": "_total - _foreign"},
)

_CLASSES = d.number_length_conditions("smg_opp_len")
OPP_LEN_CLASS = Keyed(  # T9
    {"num": "smg_opp_num"},
    {"n": "count(*)", **{f"n_{c}": f"count_if({where})" for c, where in _CLASSES.items()}},
    {
        "smg_opp_unique_count": "count_if(dim = 'num')",
        "smg_opp_count": "sum(n) filter (where dim = 'num' and key is not null)",
        **{f"smg_opp_{c}_unique_count": f"count_if(dim = 'num' and n_{c} > 0)" for c in _CLASSES},
        **{f"smg_opp_{c}_count": f"sum(n_{c}) filter (where dim = 'num' and key is not null)" for c in _CLASSES},
    },
)
_RATIOS = {
    f"smg_opp_{c}_{short}_ratio": f"coalesce(try_divide({{0}}smg_opp_{c}_{full}, {{0}}smg_opp_{full}), 0)"
    for c in _CLASSES
    for short, full in {"unique": "unique_count", "cnt": "count"}.items()
}
OPP_LEN_RATIO = Keyed(  # T10
    OPP_LEN_CLASS.dims,
    OPP_LEN_CLASS.counts,
    {f"_{name}": sql for name, sql in OPP_LEN_CLASS.aggs.items()},
    {name: sql.format("_") for name, sql in _RATIOS.items()},
)


def _unique_diff(what: str) -> str:
    seen_in, seen_out = f"smg_in_opp_{what}_unique", f"smg_out_opp_{what}_unique"
    return f"if({seen_in} > 0 and {seen_out} > 0, {seen_in} - {seen_out}, 0)"


DISTINCT = Keyed(  # T16
    {"num": "smg_opp_num", "head": "smg_opp_head"},
    {"n_in": f"count_if({IN})", "n_out": f"count_if({OUT})"},
    {
        f"smg_{way}opp_{what}_unique": f"count_if(dim = '{what}'{where})"
        for what in ["num", "head"]
        for way, where in {"": "", "in_": " and n_in > 0", "out_": " and n_out > 0"}.items()
    },
    {f"smg_in_out_opp_{what}_unique_diff": _unique_diff(what) for what in ["num", "head"]},
)

DAY = Category("smg_date", {"all": "msg_date_{}", "in": "msg_in_date_{}", "out": "msg_out_date_{}"})  # T3
HEAD = Category(  # T4
    "smg_opp_head",
    {"all": "smg_opp_head_{}", "in": "msg_in_opp_head_cat_{}", "out": "msg_out_opp_head_cat_{}"},
)
HOUR = Category("smg_hour", {"all": "sms_hour_div_{}"})  # T14
OPP_LEN = Category(  # T15
    "smg_opp_len", {"all": "msg_opp_len_{}", "in": "msg_in_opp_len_{}", "out": "msg_out_opp_len_{}"}
)


def short_number(max_length: int = SHORT_LENGTH) -> Category:  # T8
    return Category(f"case when smg_opp_len <= {max_length} then smg_opp_num end", {"all": "smg_opp_num_{}"})


CATEGORIES = {"day": DAY, "head": HEAD, "len": OPP_LEN, "short": short_number()}

FEATURES = TableFeatures(
    flat=BAGS + OPERATOR_COUNT + OPERATOR_DIFF + IN_OUT + FOREIGN + HOME,
    daily=DAILY_COUNT + DAILY_SPREAD,
    keyed=OPP_LEN_CLASS + Keyed({}, {}, {}, {n: sql.format("") for n, sql in _RATIOS.items()}) + DISTINCT,
    categories=CATEGORIES,
    slices=SLICES,
)


def daily_count_stats(sms: DataFrame) -> DataFrame:
    """SMS per day, spread over days, in minus out."""
    return daily_features(sms, DAILY_COUNT)


def bag_counts(sms: DataFrame) -> DataFrame:
    """SMS per five-day bag."""
    return flat_features(sms, BAGS)


def day_counts(sms: DataFrame) -> DataFrame:
    """(uid, slice, smg_date, n)."""
    return long_counts(category_counts(sms, {"day": DAY}, SLICES), SLICES, "smg_date")


def head_counts(sms: DataFrame) -> DataFrame:
    """T4: (uid, slice, smg_opp_head, n)."""
    return long_counts(category_counts(sms, {"head": HEAD}, SLICES), SLICES, "smg_opp_head")


def operator_counts(sms: DataFrame) -> DataFrame:
    """T5: SMS per operator over all, in, out; foreign senders are in none of the four."""
    return flat_features(sms, OPERATOR_COUNT)


def operator_in_out_diff(sms: DataFrame) -> DataFrame:
    """In minus out per operator, 0 unless there are both."""
    return flat_features(sms, OPERATOR_DIFF)


def hot_number_counts(sms: DataFrame, band: tuple[int, int] = HOT_BAND) -> DataFrame:
    """(uid, value_group, n) for numbers whose frequency lies inside the band, all others together."""
    return hot_value_counts(sms, "smg_opp_num", values_in_band(sms, "smg_opp_num", *band))


def short_number_counts(sms: DataFrame, max_length: int = SHORT_LENGTH) -> DataFrame:
    """(uid, slice, smg_opp_num, n) for numbers of up to ``max_length`` digits."""
    return long_counts(
        category_counts(sms, {"short": short_number(max_length)}, {"all": None}), ["all"], "smg_opp_num"
    )


def opp_len_class(sms: DataFrame) -> DataFrame:
    """Different numbers and SMS, overall and per class of number length."""
    return keyed_features(sms, OPP_LEN_CLASS)


def opp_len_class_ratio(sms: DataFrame) -> DataFrame:
    """The share of each class."""
    return keyed_features(sms, OPP_LEN_RATIO)


def in_out(sms: DataFrame) -> DataFrame:
    """SMS in, out, and the difference."""
    return flat_features(sms, IN_OUT)


def foreign(sms: DataFrame) -> DataFrame:
    """SMS from or to foreign numbers."""
    return flat_features(sms, FOREIGN)


def hour_class_counts(sms: DataFrame) -> DataFrame:
    """SMS per hour class."""
    return flat_features(sms, HOUR_CLASS)


def hour_counts(sms: DataFrame) -> DataFrame:
    """(uid, slice, smg_hour, n)."""
    return long_counts(category_counts(sms, {"hour": HOUR}, {"all": None}), ["all"], "smg_hour")


def opp_len_counts(sms: DataFrame) -> DataFrame:
    """(uid, slice, smg_opp_len, n)."""
    return long_counts(category_counts(sms, {"len": OPP_LEN}, SLICES), SLICES, "smg_opp_len")


def distinct(sms: DataFrame) -> DataFrame:
    """Different numbers and prefixes over all, in, out, and in minus out."""
    return keyed_features(sms, DISTINCT)


def daily_spread(sms: DataFrame) -> DataFrame:
    """Spread, maximum and median of SMS per day."""
    return daily_features(sms, DAILY_SPREAD)


def home(sms: DataFrame) -> DataFrame:
    """All SMS, and those that are not foreign."""
    return flat_features(sms, HOME)


def features_for(manifest: Manifest, extended: bool = False) -> tuple[TableFeatures, Manifest]:
    """Feature groups and columns; ``extended`` adds hours and the numbers of the hot list."""
    if not extended:
        return FEATURES, manifest
    hot_numbers = manifest.get("hot", [])
    categories = {**CATEGORIES, "hour": HOUR}
    if hot_numbers:
        categories["hot"] = Category(
            f"case when smg_opp_num in ({quoted_list(hot_numbers)}) then smg_opp_num else 'other' end",
            {"all": "hot_msg_opp_num_{}_cnt"},
        )
        manifest = {**manifest, "hot": [*hot_numbers, "other"]}
    return replace(FEATURES, flat=FEATURES.flat + HOUR_CLASS, categories=categories), manifest


def feature_matrix(
    sms: DataFrame,
    manifest: Manifest | None = None,
    extended: bool = False,
    band: tuple[int, int] = HOT_BAND,
    hot_rows: int = HOT_ROWS,
    truncate: bool = False,
) -> DataFrame:
    """Every SMS feature, one row per user.

    ``extended`` adds hours and numbers inside the frequency band; ``truncate`` cuts to integers.
    """
    manifest = fit_sms_manifest(sms, extended, band) if manifest is None else manifest
    matrix = table_matrix(sms, *features_for(manifest, extended), hot_rows)
    return d.truncate_features(matrix) if truncate else matrix


def fit_sms_manifest(sms: DataFrame, extended: bool = False, band: tuple[int, int] = HOT_BAND) -> Manifest:
    """The category values that become columns."""
    manifest = fit_manifest(sms, {**CATEGORIES, "hour": HOUR} if extended else CATEGORIES)
    if extended:
        hot = values_in_band(sms, "smg_opp_num", *band).limit(5001).collect()
        if len(hot) > 5000:
            raise ValueError("more than 5000 numbers in the band: narrow it or use the long form")
        manifest["hot"] = sorted(r["smg_opp_num"] for r in hot)
    return manifest
