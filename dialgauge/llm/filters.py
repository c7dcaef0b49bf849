"""Filter interaction audit: what each filter removes in every order, and its Shapley share, by path counting.

A document is the set of filters that it fails, so a part (a source) is at most 32 counts. The states of a run are the
subsets of filters applied so far; an edge applies one more. ``edges`` counts the orders that reach a state (forward) and
those that leave it (backward): their product is the number of orders that run through an edge. What an edge removes,
weighted by it and summed over a filter's edges, is the filter's Shapley sum; the steps of one order are five of the
same edges. Nothing is done once per order and document.

Defined cases: a null text is empty, a null source is the empty part; a document without a label, or whose label is null,
is neither good nor toxic, several labels of one id count if any does; equal texts with equal ids are no copies of each
other; a null id is no copy of anything and nothing is a copy of it, and it has no label; repeated rows count each; an
empty table gives no rows; columns other than those named are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT = 200, 50, 2
_CAPITALS, _SYMBOLS = bytes(range(65, 91)), b"#$%&*|"
_BIT = {letter: 1 << k for k, letter in enumerate(FILTERS)}


def failed(text: str | None) -> tuple[int, bytes]:
    """Bits of the filters A to D that a text fails, and a digest of it for E."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    found = raw.split()  # bytes split at blank, tab, line feed, vertical tab, form feed and carriage return only
    fails = _BIT["A"] if len(found) < LEAST_WORDS else 0
    if 100 * len(set(found)) < LEAST_DISTINCT_PERCENT * len(found):
        fails |= _BIT["B"]
    if 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > MOST_CAPITAL_PERCENT * len(text):
        fails |= _BIT["C"]
    if len(raw.translate(None, _SYMBOLS)) < len(raw):
        fails |= _BIT["D"]
    return fails, hashlib.blake2b(raw, digest_size=16).digest()


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, fails): one row per document, ``fails`` with a bit for each of the five filters.

    Copies are found by digests of 16 bytes; no text is moved.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [failed(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "part": batch["part"],
                    "fails": np.array([f for f, _ in found], np.int32),
                    "digest": [digest for _, digest in found],
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), "text")
    rows = written(rows.mapInPandas(run, f"doc_id {kind}, part string, fails int, digest binary"), "failures")
    # Written, so that the join below can split the rows of a text with very many copies.
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("first")), "first-of-text")
    copy = F.when(F.col("doc_id") > F.col("first"), _BIT["E"]).otherwise(0)
    return rows.join(first, "digest").select("doc_id", "part", F.col("fails").bitwiseOR(copy).alias("fails"))


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, fails, n, n_good, n_toxic): documents per part and set of failed filters."""
    mark = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.groupBy("doc_id").agg(mark("quality").alias("good"), mark("toxic").alias("toxic"))
    rows = failures(docs).join(written(marks, "marks"), "doc_id", "left")
    return rows.groupBy("part", "fails").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("n_good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("n_toxic"),
    )


def edges(size: int) -> list[tuple[int, int, int]]:
    """(state, filter bit, orders): the edges of the lattice of ``size`` filters and how many orders run through each."""
    states = sorted(range(1 << size), key=int.bit_count)
    bits = [1 << k for k in range(size)]
    forward, backward = {0: 1}, {states[-1]: 1}
    for state in states[1:]:
        forward[state] = sum(forward[state ^ b] for b in bits if state & b)
    for state in states[-2::-1]:
        backward[state] = sum(backward[state | b] for b in bits if not state & b)
    return [(s, b, forward[s] * backward[s | b]) for s in states for b in bits if not s & b]


def order_steps(filters: str = FILTERS) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter bit) of all orders."""
    bit = {letter: 1 << k for k, letter in enumerate(filters)}
    return [
        ("".join(order), k + 1, sum(bit[x] for x in order[:k]), bit[x])
        for order in itertools.permutations(filters)
        for k, x in enumerate(order)
    ]


def edge_removals(counts: DataFrame, size: int = len(FILTERS)) -> DataFrame:
    """(part, state, bit, orders, and what the edge does to the documents), one row per part and edge."""
    lattice = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("state", "bit", "orders"), e)]) for e in edges(size)])
    at = counts.select("*", F.explode(lattice).alias("edge")).select("*", "edge.*")
    fails, state, bit = F.col("fails"), F.col("state"), F.col("bit")
    alive, hit = fails.bitwiseAND(state) == 0, fails.bitwiseAND(bit) != 0
    total = lambda where, what: F.sum(F.when(where, F.col(what)).otherwise(0))
    return at.groupBy("part", "state", "bit", "orders").agg(
        total(alive & ~hit, "n").alias("kept"),
        total(alive & hit, "n").alias("removed"),
        total(~alive & hit, "n").alias("redundant"),
        total(fails == bit, "n").alias("unique_fails"),
        total(alive & hit, "n_good").alias("good_lost"),
        total(alive & hit, "n_toxic").alias("toxic_lost"),
    )


def interaction_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row per part, order and step; counts are of the part's documents, ``shapley`` is what the step's filter removes in
    all orders together.
    """
    removals = written(edge_removals(failure_counts(docs, labels)), "edges")
    shares = removals.groupBy("part", "bit").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = docs.sparkSession.createDataFrame(order_steps(), "filter_order string, step int, state int, bit int")
    # 600 rows, whatever the data.
    rows = removals.join(F.broadcast(steps), ["state", "bit"]).join(shares, ["part", "bit"])
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return rows.select("part", "filter_order", "step", *counts)
