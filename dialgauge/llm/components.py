"""Connected components of links between 64-bit ids, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b: long): component is the smallest id reachable.

    Each round every node points to the neighbour (or itself) that comes first in a fixed random order, links are
    rewritten to the nodes pointed to, and those that became loops go. The links left shrink by a constant share
    on average, so the rounds grow with the logarithm of the largest component. Minima are added up before the
    shuffle, and joins meet a node's links with one row per node, so a node with very many links is no hot spot.
    Every round is written to the shared folder: lost executors cost one round. Rows with a null end and loops
    count as no link; a table without links gives no rows.
    """
    left = written(_simple(links), "links")
    steps = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c: F.struct(F.xxhash64(c).alias("order"), F.col(c).alias("id"))
        first = both.groupBy("a").agg(F.min(order("b")).alias("near"))
        step = first.select(F.col("a").alias("node"), F.least(order("a"), F.col("near"))["id"].alias("root"))
        step = written(step, "step")
        steps.append(step)
        left = written(_simple(_follow(_follow(left, "a", step), "b", step)), "links")
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = steps[0]
    for step in steps[1:]:
        roots = _follow(roots, "root", step)
    roots = written(roots, "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return roots.join(written(least, "least"), "root").select("node", "component")


def _simple(links: DataFrame) -> DataFrame:
    ends = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("a") < F.col("b")).alias("ok"))
    return ends.where("ok is not null and a < b").select("a", "b").distinct()


def _follow(rows: DataFrame, column: str, step: DataFrame) -> DataFrame:
    """``rows`` with ``column`` replaced by what ``step`` points to; ids that ``step`` lacks stay."""
    to = step.select(F.col("node").alias(column), F.col("root").alias("_to"))
    joined = rows.join(to, column, "left")
    return joined.select(*[F.coalesce("_to", column).alias(column) if c == column else F.col(c) for c in rows.columns])
