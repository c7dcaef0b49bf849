"""Web and app access features. Input: access rows with the fields of ``with_web_fields``."""

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
    daily_features,
    flat_features,
    keyed_features,
    label_skewed_values,
    listed_value_counts,
    slice_stats,
    values_in_band,
)
from ..operators.aggregate import day_stats
from ..operators.categories import Manifest
from ..operators.skew import HOT_ROWS
from .table import TableFeatures, table_matrix

WEB, APP = "wa_type = 0", "wa_type = 1"
SLICES = {"all": None, "web": WEB, "app": APP}
HOT_ROWS_OF_NAME = 50_000
MIN_BAD, MAX_GOOD = 35, 70
SPREAD = ["std", "max", "median", "mean", "sum"]
DAY_SPREAD = ["sum", "std", "max", "mean", "median"]


def _by_type(prefix: str, what: str) -> dict[str, str | None]:
    return {f"{prefix}{what}_": None, f"{prefix}web_{what}_": WEB, f"{prefix}app_{what}_": APP}


DISTINCT_NAMES = Keyed(  # W1
    {"name": "wa_name"},
    {"n_web": f"count_if({WEB})", "n_app": f"count_if({APP})"},
    {
        "wa_name_unique_count": "count(*)",
        "wa_name_web_unique_count": "count_if(n_web > 0)",
        "wa_name_app_unique_count": "count_if(n_app > 0)",
    },
)


def _bag_share(total: str, per_bag: str, prefix: str, suffix: str) -> Flat:
    """Share of each five-day bag in a user's total; ``per_bag`` has ``{}`` for the bag's days."""
    bags = range(d.BAG_COUNT)
    return Flat(
        {
            f"_{prefix}total": total,
            **{f"_{prefix}{b}": per_bag.format(d.bag_condition("wa_date", b)) for b in bags},
        },
        derived={f"{prefix}{b}_{suffix}": f"coalesce(try_divide(_{prefix}{b}, _{prefix}total), 0)" for b in bags},
    )


BAG_FLOW = _bag_share("sum(down_flow)", "sum(case when {} then down_flow end)", "wa_date_cat_flow_", "sum")  # W5
BAG_COUNT = _bag_share("count(*)", "count_if({})", "wa_date_cat_", "count")  # W6
BAG_DURA = _bag_share("sum(visit_dura)", "sum(case when {} then visit_dura end)", "wa_date_cat_dura_", "sum")  # W7

ROW_COUNT = Flat(  # W8
    {
        "wa_count": "count(wa_name)",
        "wa_web_count": f"count(case when {WEB} then wa_name end)",
        "wa_app_count": f"count(case when {APP} then wa_name end)",
    },
    derived={"wa_cnt_diff": "wa_web_count - wa_app_count"},
)
DAILY_VISITS = Daily(  # W9
    "wa_date",
    {
        "visits": "sum(visit_cnt)",
        "visits_web": f"sum(case when {WEB} then visit_cnt end)",
        "visits_app": f"sum(case when {APP} then visit_cnt end)",
    },
    day_stats(
        {
            "wa_visit_cnt_date_": "visits",
            "wa_web_visit_cnt_date_": "visits_web",
            "wa_app_visit_cnt_date_": "visits_app",
        },
        DAY_SPREAD,
    ),
    {"wa_visit_cnt_date_diff": "wa_web_visit_cnt_date_sum - wa_app_visit_cnt_date_sum"},
)
VISITS = slice_stats("visit_cnt", _by_type("wa_", "visit_cnt"), SPREAD) + Flat(  # W10
    derived={"wa_visit_cnt_diff": "wa_web_visit_cnt_sum - wa_app_visit_cnt_sum"}
)
DAILY_DURA = Daily(  # W11
    "wa_date",
    {
        "dura": "sum(visit_dura)",
        "dura_web": f"sum(case when {WEB} then visit_dura end)",
        "dura_app": f"sum(case when {APP} then visit_dura end)",
    },
    day_stats(
        {
            "wa_visit_dura_date_": "dura",
            "wa_visit_web_dura_date_": "dura_web",
            "wa_visit_app_dura_date_": "dura_app",
        },
        DAY_SPREAD,
    ),
    {"wa_visit_dura_date_diff": "wa_visit_web_dura_date_sum - wa_visit_app_dura_date_sum"},
)
DURA_DECADE = Flat(  # W12
    {f"wa_visit_dura_cat_{k}": f"count_if({d.duration_decade('visit_dura')} = {k})" for k in range(8)}
)
UP_FLOW = slice_stats("up_flow", _by_type("wa_", "up_flow"), SPREAD)  # W13
DOWN_FLOW = slice_stats("down_flow", _by_type("wa_", "down_flow"), SPREAD)  # W14
FLOW_AMOUNT = slice_stats("flow_amount", _by_type("wa_", "amount_flow"), SPREAD)  # W15
ACTIVE_DAYS = Daily("wa_date", {"accesses": "count(*)"}, {"wa_active_days": "count(accesses)"})  # W16
DAILY_PER_VISIT = Daily(  # W17
    "wa_date", {"per_visit": "sum(visit_per_dura)"}, day_stats({"wa_visit_per_dura_": "per_visit"}, DAY_SPREAD)
)
SPEED = (  # W18
    slice_stats("download_speed", {"download_speed_": None}, SPREAD)
    + slice_stats("upload_speed", {"upload_speed_": None}, SPREAD)
    + slice_stats("amount_speed", {"amount_speed_": None}, SPREAD)
)

# Column names for two name lists that the manifest holds: names leaning to one label, popular names.
NAME_COLUMNS = {"bad": "bad_wa_names_{}_cnt", "hot": "hot_wa_names_{}_cnt"}

FEATURES = TableFeatures(
    flat=BAG_FLOW + BAG_COUNT + BAG_DURA + ROW_COUNT + VISITS + DURA_DECADE + UP_FLOW + DOWN_FLOW + FLOW_AMOUNT + SPEED,
    daily=DAILY_VISITS + DAILY_DURA + ACTIVE_DAYS + DAILY_PER_VISIT,
    keyed=DISTINCT_NAMES,
    slices={"all": None},
)


def distinct_names(wa: DataFrame) -> DataFrame:
    """Different names over all, web, app."""
    return keyed_features(wa, DISTINCT_NAMES)


def skewed_names(
    wa: DataFrame,
    labels: DataFrame,
    min_bad: int = MIN_BAD,
    max_good: int = MAX_GOOD,
    fit_users: DataFrame | None = None,
) -> DataFrame:
    """Names that many positive and few negative users have."""
    return label_skewed_values(wa, "wa_name", labels, min_bad, max_good, fit_users)


def skewed_name_counts(wa: DataFrame, names: DataFrame) -> DataFrame:
    """(uid, wa_name, n) for the names of W2."""
    return listed_value_counts(wa, "wa_name", names)


def hot_name_counts(wa: DataFrame, more_than: int = HOT_ROWS_OF_NAME) -> DataFrame:
    """(uid, wa_name, n) for names with more than ``more_than`` rows."""
    return listed_value_counts(wa, "wa_name", values_in_band(wa, "wa_name", more_than))


def bag_flow_share(wa: DataFrame) -> DataFrame:
    """Share of each bag in the download flow."""
    return flat_features(wa, BAG_FLOW)


def bag_count_share(wa: DataFrame) -> DataFrame:
    """Share of each bag in the rows."""
    return flat_features(wa, BAG_COUNT)


def bag_dura_share(wa: DataFrame) -> DataFrame:
    """Share of each bag in the duration."""
    return flat_features(wa, BAG_DURA)


def row_counts(wa: DataFrame) -> DataFrame:
    """Rows with a name over all, web, app, and web minus app."""
    return flat_features(wa, ROW_COUNT)


def daily_visit_stats(wa: DataFrame) -> DataFrame:
    """Visits per day."""
    return daily_features(wa, DAILY_VISITS)


def visit_stats(wa: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Visits per row."""
    return flat_features(wa, VISITS, hot_rows)


def daily_dura_stats(wa: DataFrame) -> DataFrame:
    """Duration per day."""
    return daily_features(wa, DAILY_DURA)


def dura_decade_counts(wa: DataFrame) -> DataFrame:
    """Rows per decade of duration."""
    return flat_features(wa, DURA_DECADE)


def up_flow_stats(wa: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Upload flow."""
    return flat_features(wa, UP_FLOW, hot_rows)


def down_flow_stats(wa: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Download flow."""
    return flat_features(wa, DOWN_FLOW, hot_rows)


def flow_amount_stats(wa: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Flow both ways."""
    return flat_features(wa, FLOW_AMOUNT, hot_rows)


def active_days(wa: DataFrame) -> DataFrame:
    """Days with any access."""
    return daily_features(wa, ACTIVE_DAYS)


def daily_per_visit_stats(wa: DataFrame) -> DataFrame:
    """Seconds per visit, added up per day."""
    return daily_features(wa, DAILY_PER_VISIT)


def speed_stats(wa: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Download, upload and total speed."""
    return flat_features(wa, SPEED, hot_rows)


def fit_web_manifest(
    wa: DataFrame,
    labels: DataFrame,
    min_bad: int = MIN_BAD,
    max_good: int = MAX_GOOD,
    more_than: int = HOT_ROWS_OF_NAME,
    fit_users: DataFrame | None = None,
    max_values: int = 5000,
) -> Manifest:
    """The names that become columns (W2, W4), fetched as two short lists."""
    manifest = {}
    for dim, names in {
        "bad": skewed_names(wa, labels, min_bad, max_good, fit_users),
        "hot": values_in_band(wa, "wa_name", more_than),
    }.items():
        found = names.select("wa_name").limit(max_values + 1).collect()
        if len(found) > max_values:
            raise ValueError(f"more than {max_values} names: move the thresholds or use the long form")
        manifest[dim] = [r["wa_name"] for r in found]
    return manifest


def _listed_name(names: list[str], column: str) -> Category:
    return Category(f"case when wa_name in ({quoted_list(names)}) then wa_name end", {"all": column})


def features_for(manifest: Manifest) -> tuple[TableFeatures, Manifest]:
    """Feature groups and columns. Only rows of listed names take part in the name counts."""
    categories = {dim: _listed_name(manifest[dim], c) for dim, c in NAME_COLUMNS.items() if manifest.get(dim)}
    return replace(FEATURES, categories=categories), manifest


def feature_matrix(wa: DataFrame, manifest: Manifest, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every web and app feature, one row per user. ``manifest`` as of ``fit_web_manifest``."""
    return table_matrix(wa, *features_for(manifest), hot_rows)
