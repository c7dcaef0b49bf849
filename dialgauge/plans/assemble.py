"""Putting the three tables' features together, and next to labels or a roster."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.derive import with_call_fields, with_sms_fields, with_web_fields
from ..functions.text import named
from ..operators.categories import Category, Manifest, category_counts, category_values, listed_counts
from ..operators.frequent import values_in_band
from ..operators.skew import GATHER_ROWS
from ..operators.wide import for_users, join_wide
from ..session import scratch_path, sorted_aggregates
from . import sms as sms_plan
from . import voice as voice_plan
from . import web as web_plan
from .table import table_matrix


def _settled(matrix: DataFrame, name: str) -> DataFrame:
    """One table's features, written to the shared folder and read from there.

    In one stage, the aggregations of all tables would share a task's memory: some 25 hash maps with a page each
    push out the kept rows and spill. Medians see one user's values at a time, so users of up to ``GATHER_ROWS`` rows can be
    gathered here.
    """
    path = scratch_path(matrix.sparkSession, name)
    with sorted_aggregates(matrix.sparkSession):
        matrix.write.parquet(path)
    return matrix.sparkSession.read.parquet(path)


def domain_outer(*matrices: DataFrame, key: str = "uid") -> DataFrame:
    """Every user of any matrix, features missing on one side are 0."""
    return join_wide(list(matrices), "full", key)


def _users_with_features(users: DataFrame, matrices: tuple[DataFrame, ...], key: str) -> DataFrame:
    """Left joins keep the users' hash partitioning, so no matrix is shuffled again.

    ``label`` (if users have one) stays as it is, features are filled with 0.
    """
    return join_wide(list(matrices), "left", key, users)


def train_matrix(labels: DataFrame, *matrices: DataFrame, key: str = "uid") -> DataFrame:
    """One row per labelled user: ``uid, label, features``."""
    known = labels.filter(F.col("label").isNotNull()).select(key, "label")
    return _users_with_features(known, matrices, key)


def score_matrix(roster: DataFrame, *matrices: DataFrame, key: str = "uid") -> DataFrame:
    """One row per user to be scored: ``uid, features``, columns in the order of the training matrix."""
    return _users_with_features(roster.select(key), matrices, key)


def table_matrices(
    voice: DataFrame, sms: DataFrame, wa: DataFrame, manifests: dict[str, Manifest], hot_rows: int = GATHER_ROWS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """V21, T19 and W19 from raw rows."""
    return (
        _settled(voice_plan.feature_matrix(with_call_fields(voice), manifests["voice"], hot_rows=hot_rows), "voice"),
        _settled(sms_plan.feature_matrix(with_sms_fields(sms), manifests["sms"], hot_rows=hot_rows), "sms"),
        _settled(web_plan.feature_matrix(with_web_fields(wa), manifests["wa"], hot_rows=hot_rows), "wa"),
    )


def fit_manifests(
    voice: DataFrame, sms: DataFrame, wa: DataFrame, labels: DataFrame, **name_thresholds
) -> dict[str, Manifest]:
    """Columns to make, from the data at hand; keep the result to score later data with it."""
    return {
        "voice": voice_plan.fit_voice_manifest(with_call_fields(voice)),
        "sms": sms_plan.fit_sms_manifest(with_sms_fields(sms)),
        "wa": web_plan.fit_web_manifest(wa, labels, **name_thresholds),
    }


Counts = dict[str, DataFrame]


def value_counts(voice: DataFrame, sms: DataFrame, wa: DataFrame) -> Counts:
    """Rows per user, one-hot value and slice, by table: what ``feature_values`` and ``feature_cells`` are read off."""
    return {
        "voice": category_counts(with_call_fields(voice), voice_plan.CATEGORIES, voice_plan.SLICES),
        "sms": category_counts(with_sms_fields(sms), sms_plan.CATEGORIES, sms_plan.SLICES),
        "wa": category_counts(wa, {"name": Category("wa_name")}, {"all": None}),
    }


def settled_counts(counts: Counts) -> Counts:
    """Written to the shared folder and read from there: a fitted space reads them twice, and events once."""
    return {source: _settled(found, f"{source}-counts") for source, found in counts.items()}


def feature_values(
    voice: DataFrame,
    sms: DataFrame,
    wa: DataFrame,
    labels: DataFrame,
    min_bad: int = web_plan.MIN_BAD,
    max_good: int = web_plan.MAX_GOOD,
    more_than: int = web_plan.HOT_ROWS_OF_NAME,
    fit_users: DataFrame | None = None,
    counts: Counts | None = None,
) -> DataFrame:
    """(source, dim, key): every one-hot value that the data at hand calls for, as a table of any length.

    What ``fit_manifests`` fetches for the wide form: observed values of the voice and SMS categories, the web names
    that lean to positive users (``bad``, W2) and the popular ones (``hot``, W4). ``counts``: those of ``value_counts``,
    if they are at hand.
    """
    if counts is None:
        names = {
            "bad": web_plan.skewed_names(wa, labels, min_bad, max_good, fit_users),
            "hot": values_in_band(wa, "wa_name", more_than),
        }
        observed = {
            "voice": category_values(with_call_fields(voice), voice_plan.CATEGORIES),
            "sms": category_values(with_sms_fields(sms), sms_plan.CATEGORIES),
        }
    else:
        counted = counts["wa"].selectExpr("uid", "key as wa_name", "all as n")
        names = {
            "bad": web_plan.skewed_names(counted, labels, min_bad, max_good, fit_users),
            "hot": values_in_band(counted, "wa_name", more_than, counted_by="n"),
        }
        observed = {source: counts[source].select("dim", "key").distinct() for source in ("voice", "sms")}
    parts = [
        *[found.selectExpr(f"'{source}' as source", "dim", "key") for source, found in observed.items()],
        *[found.selectExpr("'wa' as source", f"'{dim}' as dim", "wa_name as key") for dim, found in names.items()],
    ]
    return reduce(DataFrame.unionByName, parts)


def feature_cells(
    voice: DataFrame, sms: DataFrame, wa: DataFrame, values: DataFrame, counts: Counts | None = None
) -> DataFrame:
    """(uid, source, dim, key, slice, n): the one-hot part of M1 in long form, for the values of ``feature_values``.

    ``counts``: those of ``value_counts``, if they are at hand.
    """
    counts = value_counts(voice, sms, wa) if counts is None else counts
    names = {dim: Category("wa_name", {"all": column}) for dim, column in web_plan.NAME_COLUMNS.items()}
    # A name may be in both lists.
    lists = f"explode(array({', '.join(repr(dim) for dim in names)})) as dim"
    tables = {
        "voice": (counts["voice"], voice_plan.CATEGORIES, voice_plan.SLICES),
        "sms": (counts["sms"], sms_plan.CATEGORIES, sms_plan.SLICES),
        "wa": (counts["wa"].selectExpr("uid", lists, "key", "all"), names, {"all": None}),
    }
    parts = [
        listed_counts(*table, values.filter(F.col("source") == source)).withColumn("source", F.lit(source))
        for source, table in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def user_features(
    voice: DataFrame,
    sms: DataFrame,
    wa: DataFrame,
    users: DataFrame,
    manifests: dict[str, Manifest],
    hot_rows: int = GATHER_ROWS,
) -> DataFrame:
    """(uid, all features): one row per different user of ``users``.

    One table's aggregations run after the other's. What is derived comes after all aggregates.
    """
    tables = {
        "voice": (with_call_fields(voice), *voice_plan.features_for(manifests["voice"])),
        "sms": (with_sms_fields(sms), *sms_plan.features_for(manifests["sms"])),
        "wa": (with_web_fields(wa), *web_plan.features_for(manifests["wa"])),
    }
    matrices = [_settled(table_matrix(*table, hot_rows), name) for name, table in tables.items()]
    derived = [n for _, spec, _ in tables.values() for n in spec.derived]
    wide = join_wide(matrices, "left", "uid", users.select("uid").distinct())
    return wide.selectExpr(*[named(c) for c in wide.columns if c not in set(derived)], *[named(n) for n in derived])


def full_feature_matrix(
    voice: DataFrame,
    sms: DataFrame,
    wa: DataFrame,
    users: DataFrame,
    manifests: dict[str, Manifest],
    hot_rows: int = GATHER_ROWS,
    finish: Callable[[DataFrame], DataFrame] = lambda features: features,
) -> DataFrame:
    """M1: every row of ``users`` (uid, label; NULL label = to be scored) with all features.

    As J2 / J3 over the three matrices. ``finish`` (rounding, say) is applied to the features before they meet the rows.
    """
    features = finish(user_features(voice, sms, wa, users, manifests, hot_rows))
    return for_users(users.select("uid", "label"), features)


def split_known(matrix: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows, and rows to be scored (without the label column)."""
    return matrix.filter(F.col("label").isNotNull()), matrix.filter(F.col("label").isNull()).drop("label")


