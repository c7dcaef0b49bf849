"""Counts per user and category value: long form, and one column per value.

Several categories of a table run in one pass as rows (uid, dim, key, n, ...). The set of values is
taken once, when features are fitted (``fit_manifest``), and applied as it is later on: values
that are not in it get no column.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import named

Manifest = dict[str, list[str]]


@dataclass(frozen=True)
class Category:
    """``key``: SQL of the value, NULL for rows that do not take part.

    ``columns``: column name per slice for the wide form, with ``{}`` for the value.
    """

    key: str
    columns: dict[str, str] = field(default_factory=dict)


def _keyed_rows(rows: DataFrame, categories: dict[str, Category]) -> DataFrame:
    if len(categories) == 1:
        ((dim, category),) = categories.items()
        keyed = rows.selectExpr("*", f"'{dim}' as dim", f"cast({category.key} as string) as key")
    else:
        entries = ", ".join(f"'{dim}', cast({c.key} as string)" for dim, c in categories.items())
        keyed = rows.selectExpr("*", f"stack({len(categories)}, {entries}) as (dim, key)")
    return keyed.filter("key is not null")


def category_counts(
    rows: DataFrame,
    categories: dict[str, Category],
    slices: dict[str, str | None],
    key: str = "uid",
) -> DataFrame:
    """(uid, dim, key) with one count per slice."""
    counts = [
        (F.count("*") if where is None else F.count_if(F.expr(where))).alias(name) for name, where in slices.items()
    ]
    return _keyed_rows(rows, categories).groupBy(key, "dim", "key").agg(*counts)


def long_counts(counts: DataFrame, slices, value: str, key: str = "uid") -> DataFrame:
    """(uid, slice, value, n), only counts above zero. ``value`` names the category column."""
    entries = ", ".join(f"'{s}', `{s}`" for s in slices)
    return counts.selectExpr(
        key, f"key as {value}", f"stack({len(slices)}, {entries}) as (slice, n)"
    ).filter("n > 0").select(key, "slice", value, "n")


def category_values(rows: DataFrame, categories: dict[str, Category]) -> DataFrame:
    """(dim, key, rows): the observed values of every category, however many there are."""
    return _keyed_rows(rows, categories).groupBy("dim", "key").agg(F.count("*").alias("rows"))


def listed_cells(
    rows: DataFrame,
    categories: dict[str, Category],
    slices: dict[str, str | None],
    values: DataFrame,
    key: str = "uid",
) -> DataFrame:
    """(uid, dim, key, slice, n) above zero, for the values (dim, key) of a list and the slices a category has.

    The one-hot features in long form: nothing is fetched and no column is made per value, so the list has no limit. Rows
    are added up per (user, value) before they meet it.
    """
    return listed_counts(category_counts(rows, categories, slices, key), categories, slices, values, key)


def listed_counts(
    counts: DataFrame,
    categories: dict[str, Category],
    slices: dict[str, str | None],
    values: DataFrame,
    key: str = "uid",
) -> DataFrame:
    """``listed_cells`` of rows that are counted already, as by ``category_counts``."""
    counts = counts.join(values.select("dim", "key"), ["dim", "key"], "left_semi")
    entries = ", ".join(f"'{s}', `{s}`" for s in slices)
    wanted = " or ".join(
        f"dim = '{dim}' and slice in ({', '.join(repr(s) for s in category.columns)})"
        for dim, category in categories.items()
    )
    return counts.selectExpr(key, "dim", "key", f"stack({len(slices)}, {entries}) as (slice, n)").filter(
        f"n > 0 and ({wanted})"
    )


def fit_manifest(rows: DataFrame, categories: dict[str, Category], max_values: int = 5000) -> Manifest:
    """Observed values per category, in order.

    Columns are made from them, so their number must stay small; beyond ``max_values`` this raises
    and the long form is the one to use.
    """
    found = _keyed_rows(rows, categories).select("dim", "key").distinct().limit(max_values + 1).collect()
    if len(found) > max_values:
        raise ValueError(f"more than {max_values} category values: use the long form")
    return {dim: sorted(r["key"] for r in found if r["dim"] == dim) for dim in categories}


def wide_counts(
    counts: DataFrame,
    categories: dict[str, Category],
    manifest: Manifest,
    key: str = "uid",
) -> DataFrame:
    """One row per user of ``counts``, one column per slice and manifest value, 0 where there is none."""
    cells = [f"{dim}={v}" for dim in categories for v in manifest.get(dim, [])]
    if not cells:
        return counts.select(key).distinct()
    slices = list(dict.fromkeys(s for c in categories.values() for s in c.columns))
    wide = (
        counts.withColumn("cell", F.concat_ws("=", "dim", "key"))
        .groupBy(key)
        .pivot("cell", cells)
        .agg(*[F.first(s).alias(s) for s in slices])
    )
    out = []
    for dim, category in categories.items():
        for v in manifest.get(dim, []):
            for s, template in category.columns.items():
                source = f"{dim}={v}" if len(slices) == 1 else f"{dim}={v}_{s}"
                out.append(f"coalesce({named(source)}, 0) as {named(template.format(v))}")
    return wide.selectExpr(key, *out)
