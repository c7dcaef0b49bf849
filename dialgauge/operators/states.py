"""Per-day states of events that merge, so a new round adds its events to stored states instead of reading old ones.

A state is one row per (user, day, slice) with the number of rows ``n`` and, for each measure, the number of values, their
sum, sum of squares, minimum and maximum. Measures are whole numbers and their sums exact decimals, so any split of the
events merges to the same state. A state row stands for many events: a user has at most days times slices of them,
however many events they have.

Null measures count in ``n`` only; events without a day or slice keep a state of their own (null); an empty round has no
states and merging it changes nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .aggregate import Exprs, Flat

_WHOLE, _SUM = "decimal(18,0)", "decimal(38,0)"
_PARTS = {"n": "sum", "sum": "sum", "sq": "sum", "min": "min", "max": "max"}


def day_states(rows: DataFrame, day: str, slice_col: str, measures: Exprs, key: str = "uid") -> DataFrame:
    """The states of one round's events: a partial aggregate before the shuffle, one row per (user, day, slice) after."""
    aggs = [F.expr("count(*) as n")]
    for name, sql in measures.items():
        value = f"cast({sql} as {_WHOLE})"
        aggs += [
            F.expr(f"count({sql}) as {name}_n"),
            F.expr(f"cast(sum({value}) as {_SUM}) as {name}_sum"),
            F.expr(f"cast(sum({value} * {value}) as {_SUM}) as {name}_sq"),
            F.expr(f"cast(min({sql}) as bigint) as {name}_min"),
            F.expr(f"cast(max({sql}) as bigint) as {name}_max"),
        ]
    return rows.groupBy(key, F.expr(f"cast({day} as int)").alias("day"), F.expr(f"cast({slice_col} as int)").alias("slice")).agg(*aggs)


def merged_states(*states: DataFrame, key: str = "uid") -> DataFrame:
    """One state per (user, day, slice) from those of several rounds.

    Placed by user: what is added up per user or per user and day afterwards needs no other exchange.
    """
    rows = reduce(DataFrame.unionByName, states)
    aggs = [F.expr("sum(n) as n")]
    for column in rows.columns:
        measure, _, part = column.rpartition("_")
        if measure and part in _PARTS and column != key:
            total = f"{_PARTS[part]}(`{column}`)"
            aggs.append(F.expr(f"cast({total} as {rows.schema[column].dataType.simpleString()}) as `{column}`"))
    return rows.repartition(key).groupBy(key, "day", "slice").agg(*aggs)


def save_round(states: DataFrame, path: str, name: str) -> None:
    """Store one round's states; a round that is stored again replaces itself, others stay."""
    states.write.mode("overwrite").parquet(f"{path.rstrip('/')}/round={name}")


def load_rounds(spark: SparkSession, path: str, rounds: list[str] | None = None, key: str = "uid") -> DataFrame:
    """The merged states of all stored rounds, or of those named."""
    rows = spark.read.parquet(path).withColumn("round", F.col("round").cast("string"))
    if rounds is not None:
        rows = rows.where(F.col("round").isin(rounds))
    return merged_states(rows.drop("round"), key=key)


def _spread(n: str, total: str, squares: str) -> str:
    """Sample standard deviation from exact sums; in doubles where the products leave 38 digits."""
    exact = f"cast(try_subtract(try_multiply(cast({n} as {_WHOLE}), {squares}), try_multiply({total}, {total})) as double)"
    rough = f"greatest(cast({n} as double) * cast({squares} as double) - pow(cast({total} as double), 2), 0e0)"
    return f"case when {n} > 1 then sqrt(coalesce({exact}, {rough}) / {n} / ({n} - 1)) end"


def state_stats(measure: str, slices: dict[str, str | None], stats: list[str]) -> Flat:
    """The statistics of ``slice_stats`` without the median, read from states; conditions speak of ``slice`` and ``day``."""
    aggs: Exprs = {}
    for prefix, where in slices.items():
        part = {
            p: f"{how}({measure}_{p})" + (f" filter (where {where})" if where else "") for p, how in _PARTS.items()
        }
        ways = {
            "sum": f"cast({part['sum']} as bigint)",
            "min": part["min"],
            "max": part["max"],
            "mean": f"cast({part['sum']} as double) / nullif({part['n']}, 0)",
            "std": _spread(part["n"], part["sum"], part["sq"]),
        }
        aggs.update({prefix + stat: ways[stat] for stat in stats})
    return Flat(aggs)


def day_measures(measures: dict[str, tuple[str, str | None]]) -> Exprs:
    """Measures of a ``Daily`` group over states: name -> (state column that is added up, slice condition).

    A slice without rows on a day gives null, as it does over events.
    """
    return {
        name: f"cast(sum({column})" + (f" filter (where {where})" if where else "") + " as bigint)"
        for name, (column, where) in measures.items()
    }
