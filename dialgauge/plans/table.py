"""One event table's features on one row per user."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.text import named
from ..operators.aggregate import Daily, Flat, Keyed, table_parts
from ..operators.categories import Category, Manifest, category_counts, wide_counts
from ..operators.skew import HOT_ROWS, split_hot
from ..operators.wide import join_all, lay_out, pack


@dataclass(frozen=True)
class TableFeatures:
    """All feature groups of a table: one aggregation each for flat, daily, keyed and category groups."""

    flat: Flat
    daily: Daily
    keyed: Keyed
    categories: dict[str, Category] = field(default_factory=dict)
    slices: dict[str, str | None] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        """Columns of the flat, daily and keyed groups, what is derived last."""
        found = [*self.flat.aggs, *self.flat.medians, *self.daily.aggs, *self.keyed.aggs]
        return [*[n for n in found if not n.startswith("_")], *self.derived]

    @property
    def derived(self) -> dict[str, str]:
        return {**self.flat.derived, **self.daily.derived, **self.keyed.derived}


def _packed_parts(
    rows: DataFrame, spec: TableFeatures, manifest: Manifest, n_hot: int | None, key: str, name: str
) -> DataFrame:
    """Join the aggregations on the user. The first has every user, so left joins lose none."""
    parts = table_parts(rows, spec.flat, spec.daily, spec.keyed, n_hot, key)
    if any(manifest.get(dim) for dim in spec.categories):
        counts = category_counts(rows, spec.categories, spec.slices, key)
        parts.append(wide_counts(counts, spec.categories, manifest, key))
    return join_all([pack(part, f"{name}{i}", key) for i, part in enumerate(parts)], "left", key)


def packed_table(
    rows: DataFrame,
    spec: TableFeatures,
    manifest: Manifest,
    hot_rows: int = HOT_ROWS,
    key: str = "uid",
    name: str = "part",
) -> DataFrame:
    """One event kind's aggregations as struct columns, one row per user.

    Rows of ordinary users are read and hashed by user once, sorted by user in place, and kept (in memory, then on disk;
    a lost executor's share is computed again); all aggregations read that copy. Everything after it (both levels of the two-level groups,
    the pivot, the joins) finds its data in place: adaptive execution drops the exchanges once the copy is there.
    This moves narrow rows instead of partial aggregates of several hundred columns.
    Hot users are not gathered: they take partial aggregates, which shrink them before the shuffle.

    The copy serves later matrices of the same rows too and stays until ``spark.catalog.clearCache()``.
    """
    cold, hot, n_hot = split_hot(rows, hot_rows, key)
    out = _packed_parts(cold.repartition(key).sortWithinPartitions(key).persist(), spec, manifest, None, key, name)
    return out if hot is None else out.unionByName(_packed_parts(hot, spec, manifest, n_hot, key, name))


def finished(packed: DataFrame, *specs: TableFeatures) -> DataFrame:
    """Lay out the structs, drop the helpers, add what is derived.

    Users without rows have 0 in every aggregate, and every derived text gives 0 for that.
    """
    wide = lay_out(packed)
    kept = [named(c) for c in wide.columns if not c.startswith("_")]
    derived = [f"{sql} as {named(n)}" for spec in specs for n, sql in spec.derived.items()]
    return wide.selectExpr(*kept, *derived)


def table_matrix(
    rows: DataFrame, spec: TableFeatures, manifest: Manifest, hot_rows: int = HOT_ROWS, key: str = "uid"
) -> DataFrame:
    """The wide table of one event kind, missing = 0."""
    return finished(packed_table(rows, spec, manifest, hot_rows, key), spec)
