"""Per-user aggregates, declared as names and SQL texts.

A feature group is one of three shapes: ``Flat`` (one pass per user), ``Daily`` (per user and day,
then per user) and ``Keyed`` (per user and key, then per user). Groups of one shape add up with
``+``, so a whole table of features is still a single aggregation per shape.

Names that start with an underscore are helpers for ``derived`` and do not come out. An empty slice
gives NULL in the aggregate and 0 in the result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import HOT_ROWS, grouped_medians, split_hot
from .wide import join_wide

Exprs = dict[str, str]

STAT_SQL = {"mean": "avg", "std": "stddev_samp", "sum": "sum", "max": "max", "min": "min", "median": "median"}


def _joined(left: Exprs, right: Exprs) -> Exprs:
    clash = {n for n in left.keys() & right.keys() if left[n] != right[n]}
    if clash:
        raise ValueError(f"two definitions for {sorted(clash)}")
    return {**left, **right}


def sliced(value: str, where: str | None) -> str:
    """The value in the rows of a slice, NULL elsewhere."""
    return value if where is None else f"case when {where} then {value} end"


@dataclass(frozen=True)
class Flat:
    aggs: Exprs = field(default_factory=dict)
    medians: Exprs = field(default_factory=dict)
    derived: Exprs = field(default_factory=dict)

    def __add__(self, other: Flat) -> Flat:
        return Flat(
            _joined(self.aggs, other.aggs),
            _joined(self.medians, other.medians),
            _joined(self.derived, other.derived),
        )


@dataclass(frozen=True)
class Daily:
    day: str
    measures: Exprs
    aggs: Exprs
    derived: Exprs = field(default_factory=dict)

    def __add__(self, other: Daily) -> Daily:
        if self.day != other.day:
            raise ValueError("groups run over different days")
        return Daily(
            self.day,
            _joined(self.measures, other.measures),
            _joined(self.aggs, other.aggs),
            _joined(self.derived, other.derived),
        )


@dataclass(frozen=True)
class Keyed:
    dims: Exprs
    counts: Exprs
    aggs: Exprs
    derived: Exprs = field(default_factory=dict)

    def __add__(self, other: Keyed) -> Keyed:
        return Keyed(
            _joined(self.dims, other.dims),
            _joined(self.counts, other.counts),
            _joined(self.aggs, other.aggs),
            _joined(self.derived, other.derived),
        )


def slice_stats(value: str, slices: dict[str, str | None], stats: list[str]) -> Flat:
    """Statistics of one value over several slices: ``{prefix: condition}``, names are prefix + stat."""
    aggs, medians = {}, {}
    for prefix, where in slices.items():
        for stat in stats:
            if stat == "median":
                medians[prefix + stat] = sliced(value, where)
            else:
                aggs[prefix + stat] = f"{STAT_SQL[stat]}({sliced(value, where)})"
    return Flat(aggs, medians)


def day_stats(measures: dict[str, str], stats: list[str]) -> Exprs:
    """Statistics over days: ``{prefix: measure}``, names are prefix + stat."""
    sql = {**STAT_SQL, "count": "count"}
    return {prefix + stat: f"{sql[stat]}({measure})" for prefix, measure in measures.items() for stat in stats}


def _zero_filled(aggs: Exprs):
    return [F.expr(f"coalesce({sql}, 0) as `{name}`") for name, sql in aggs.items()]


def _finished(grouped: DataFrame, names, derived: Exprs, key: str) -> DataFrame:
    kept = [f"`{n}`" for n in names if not n.startswith("_")]
    return grouped.selectExpr(key, *kept, *[f"{sql} as `{n}`" for n, sql in derived.items()])


def _middle(values: str) -> str:
    """Median of a sorted array, 0 if it is empty."""
    return f"coalesce((get({values}, (size({values}) - 1) div 2) + get({values}, size({values}) div 2)) / 2, 0)"


def local_medians(rows: DataFrame, medians: Exprs, key: str = "uid") -> DataFrame:
    """Medians of ordinary users: at most ``hot_rows`` values each, so they are gathered and sorted,
    which is several times faster than the value maps of ``median``. The values are worked out before the aggregation,
    in generated code: gathering evaluates its argument row by row without it."""
    values = rows.selectExpr(key, *[f"cast({sql} as double) as `{n}`" for n, sql in medians.items()])
    gathered = [F.expr(f"sort_array(collect_list(`{n}`)) as `{n}`") for n in medians]
    return values.groupBy(key).agg(*gathered).selectExpr(key, *[f"{_middle(f'`{n}`')} as `{n}`" for n in medians])


# Fields of a row that whole-stage code generation takes (spark.sql.codegen.maxFields is 100): a wider
# aggregate runs several times slower per row.
AGGREGATE_FIELDS = 90
BUFFER_FIELDS = {"stddev_samp": 3, "avg": 2}


def narrow_groups(aggs: Exprs, limit: int = AGGREGATE_FIELDS) -> list[Exprs]:
    """Aggregates in as few groups as keep each within ``limit`` fields, in the order given."""
    groups: list[Exprs] = []
    room = 0
    for name, sql in aggs.items():
        need = BUFFER_FIELDS.get(sql.partition("(")[0], 1)
        if need > room:
            groups.append({})
            room = limit
        groups[-1][name] = sql
        room -= need
    return groups


def _flat_parts(rows: DataFrame, spec: Flat, n_hot: int | None, key: str) -> list[DataFrame]:
    """The aggregations of a flat group, every one with all users first.

    Wide groups, and gathering for medians, would run without generated code. So they become several
    aggregations, each over the columns it needs.
    """
    parts = [rows.groupBy(key).agg(*_zero_filled(group)) for group in narrow_groups(spec.aggs)]
    if spec.medians and n_hot is None:
        parts.append(local_medians(rows, spec.medians, key))
    elif spec.medians:
        parts = parts or [rows.select(key).distinct()]
        parts.append(grouped_medians(rows, spec.medians, n_hot, key))
    return parts


def flat_local(rows: DataFrame, spec: Flat, key: str = "uid") -> DataFrame:
    """A flat group for rows without hot users; with medians, placed by user."""
    return _finished(_joined_parts(_flat_parts(rows, spec, None, key), key), _names(spec), spec.derived, key)


def flat_hot(rows: DataFrame, spec: Flat, n_hot: int, key: str = "uid") -> DataFrame:
    """A flat group for hot users: partial aggregates as ever, medians by narrowing."""
    return _finished(_joined_parts(_flat_parts(rows, spec, n_hot, key), key), _names(spec), spec.derived, key)


def _names(spec: Flat) -> list[str]:
    return [*spec.aggs, *spec.medians]


def _joined_parts(parts: list[DataFrame], key: str) -> DataFrame:
    return parts[0] if len(parts) == 1 else join_wide(parts, "left", key)


def flat_features(rows: DataFrame, spec: Flat, hot_rows: int = HOT_ROWS, key: str = "uid") -> DataFrame:
    """One row per user.

    Without medians this is a plain partial + final aggregate. With them, the narrow rows of ordinary
    users go to their task once (less to move than gathered values), hot users take the other way.
    """
    if not spec.medians:
        return flat_local(rows, spec, key)
    cold, hot, n_hot = split_hot(rows, hot_rows, key)
    out = flat_local(cold.repartition(key), spec, key)
    return out if hot is None else out.unionByName(flat_hot(hot, spec, n_hot, key))


def daily_part(rows: DataFrame, spec: Daily, key: str = "uid") -> DataFrame:
    """The aggregates of a daily group, helpers included."""
    days = (
        rows.filter(f"{spec.day} is not null")
        .groupBy(key, spec.day)
        .agg(*[F.expr(f"{sql} as `{n}`") for n, sql in spec.measures.items()])
    )
    return days.groupBy(key).agg(*_zero_filled(spec.aggs))


def daily_features(rows: DataFrame, spec: Daily, key: str = "uid") -> DataFrame:
    """Per user and day, then per user. A slice without rows on a day does not count as a day.

    The number of days is bounded, so medians over days may stay inside the aggregation.
    """
    return _finished(daily_part(rows, spec, key), spec.aggs, spec.derived, key)


def keyed_part(rows: DataFrame, spec: Keyed, key: str = "uid") -> DataFrame:
    """The aggregates of a keyed group, helpers included."""
    if len(spec.dims) == 1:
        ((dim, sql),) = spec.dims.items()
        keyed = rows.selectExpr("*", f"'{dim}' as dim", f"{sql} as key")
    else:
        entries = ", ".join(f"'{dim}', cast({sql} as string)" for dim, sql in spec.dims.items())
        keyed = rows.selectExpr("*", f"stack({len(spec.dims)}, {entries}) as (dim, key)")
    if spec.counts:
        groups = keyed.groupBy(key, "dim", "key").agg(*[F.expr(f"{sql} as `{n}`") for n, sql in spec.counts.items()])
    else:
        groups = keyed.select(key, "dim", "key").distinct()
    return groups.groupBy(key).agg(*_zero_filled(spec.aggs))


def keyed_features(rows: DataFrame, spec: Keyed, key: str = "uid") -> DataFrame:
    """Per user and key, then per user. A missing key is one key, as in ``len(unique(x))``.

    Several dimensions (number, prefix, ...) run in one pass; a hot user is split by key.
    """
    return _finished(keyed_part(rows, spec, key), spec.aggs, spec.derived, key)


def table_parts(
    rows: DataFrame, flat: Flat, daily: Daily, keyed: Keyed, n_hot: int | None = None, key: str = "uid"
) -> list[DataFrame]:
    """All aggregations of a table. ``n_hot`` says that the rows are those of so many hot users."""
    return [*_flat_parts(rows, flat, n_hot, key), daily_part(rows, daily, key), keyed_part(rows, keyed, key)]
