"""Very active users: telling them apart, and exact medians that no single task has to hold.

Counts, sums and spreads need no care: Spark adds them up before the shuffle. An exact median does,
because it needs a group's values in one task. So users above ``hot_rows`` rows are split off and
their medians are found by narrowing: count values in a few thousand buckets,
step into the bucket that holds the middle rank, repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A user with more rows than this is hot. At most (all rows / HOT_ROWS) users can be. Ordinary users' values are
# gathered: 15 medians of 20,000 values are some 10 MB a user.
HOT_ROWS = 20_000

# The same where one user's values are in memory at a time (``session.sorted_aggregates``): some 50 MB a user.
GATHER_ROWS = 200_000

# Rank searches (hot users x medians) whose state may be broadcast: some 60 bytes each.
BROADCAST_STATES = 1_000_000

# Hot users whose list may be broadcast: some 60 bytes each.
BROADCAST_USERS = 500_000

BUCKETS = 4096
LINEAR_LEVELS = 2


def split_hot(rows: DataFrame, hot_rows: int = HOT_ROWS, key: str = "uid") -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of ordinary users, rows of hot users (None if there are none), and the number of hot users.

    The count reads the key column only. The list of hot users is broadcast up to ``BROADCAST_USERS`` of them; beyond
    that it is joined by shuffle, where adaptive execution splits a hot user's rows.
    """
    hot = rows.groupBy(key).count().filter(F.col("count") > hot_rows).select(key)
    n_hot = hot.count()
    if n_hot == 0:
        return rows, None, 0
    listed = F.broadcast(hot) if n_hot <= BROADCAST_USERS else hot
    return rows.join(listed, key, "left_anti"), rows.join(listed, key, "left_semi"), n_hot


def _bucket(x: Column, lo: Column, hi: Column, log_scale: bool) -> Column:
    """Bucket number of x within [lo, hi], never decreasing in x."""
    if log_scale:
        x, lo, hi = (F.signum(c) * F.log1p(F.abs(c)) for c in (x, lo, hi))
    inner = F.floor((x - lo) / (hi - lo) * BUCKETS)
    return F.when(hi > lo, F.least(F.greatest(inner, F.lit(0)), F.lit(BUCKETS - 1))).otherwise(F.lit(0))


def grouped_medians(
    rows: DataFrame,
    values: dict[str, str],
    n_groups: int | None = None,
    key: str = "uid",
) -> DataFrame:
    """Exact medians per key of several SQL values (NULL is skipped); one row per key.

    Equal values are merged first, keyed by (user, measure, value), so a hot user is spread over
    all tasks. A log-scaled and two linear steps, each with its own least and greatest value, then leave
    a sliver of the value range; the last step ranks what is left in it exactly.
    ``n_groups`` (the number of keys, if known) decides whether the rank state is broadcast.
    """
    entries = ", ".join(f"'{name}', cast({value} as double)" for name, value in values.items())
    freq = (
        rows.selectExpr(key, f"stack({len(values)}, {entries}) as (measure, x)")
        .filter("x is not null")
        .groupBy(key, "measure", "x")
        .agg(F.count("*").alias("n"))
    )
    group = [key, "measure"]
    search = [*group, "target"]
    state = (
        freq.groupBy(*group)
        .agg(F.sum("n").alias("total"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        .withColumn("target", F.expr("explode(array_distinct(array((total - 1) div 2, total div 2)))"))
        .select(*search, F.col("target").alias("rank"), "lo", "hi")
    )
    small = n_groups is not None and n_groups * len(values) * 2 <= BROADCAST_STATES

    def candidates(state: DataFrame) -> DataFrame:
        """Values still in play. Beyond the broadcast bound AQE splits the heavy side of this join."""
        side = F.broadcast(state) if small else state
        return freq.join(side, group).filter(F.col("x").between(F.col("lo"), F.col("hi")))

    def holding_rank(cells: DataFrame, order: str) -> DataFrame:
        """The cell in which the wanted rank falls; ``before`` counts the values in front of it."""
        front = Window.partitionBy(*search).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return (
            cells.withColumn("before", F.coalesce(F.sum("n").over(front), F.lit(0)))
            .filter("before <= rank and rank < before + n")
            .withColumn("rank", F.col("rank") - F.col("before"))
        )

    for level in range(1 + LINEAR_LEVELS):
        cells = (
            candidates(state)
            .withColumn("bucket", _bucket(F.col("x"), F.col("lo"), F.col("hi"), log_scale=level == 0))
            .groupBy(*search, "rank", "bucket")
            .agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        )
        state = holding_rank(cells, "bucket").select(*search, "rank", "lo", "hi")

    middle = holding_rank(candidates(state).select(*search, "rank", "x", "n"), "x")
    return middle.groupBy(key).pivot("measure", list(values)).agg(F.avg("x"))
