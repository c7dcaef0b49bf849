"""Filter interaction audit against a run of every order over every document, and against SQL."""

import itertools
import re

import pytest
from compare import connect, difference

from dialgauge.llm import filters, queries
from dialgauge.llm.oracle import ORACLE

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(docs):
    """Set of letters that each (doc_id, text, source) fails, in order."""
    out = []
    for doc_id, text, _ in docs:
        text = text or ""
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        own = set()
        own |= {"A"} if len(found) < 200 else set()
        own |= {"B"} if 100 * len(set(found)) < 50 * len(found) else set()
        own |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text) else set()
        own |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        smaller = [i for i, t, _ in docs if (t or "") == text and i is not None and doc_id is not None and i < doc_id]
        own |= {"E"} if smaller else set()
        out.append(own)
    return out


def by_running_every_order(docs, good, toxic):
    failing = fails(docs)
    out = {}
    for part in {s or "" for _, _, s in docs}:
        rows = [(f, i) for f, (i, _, s) in zip(failing, docs) if (s or "") == part]
        shares = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left, gone = rows, []
            for step, letter in enumerate(order, 1):
                removed = [r for r in left if letter in r[0]]
                left = [r for r in left if letter not in r[0]]
                shares[letter] += len(removed)
                out[part, "".join(order), step] = [
                    len(left),
                    len(removed),
                    sum(letter in f for f, _ in gone),
                    sum(f == {letter} for f, _ in rows),
                    sum(i in good for _, i in removed),
                    sum(i in toxic for _, i in removed),
                ]
                gone = gone + removed
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shares[order[step - 1]])
    return out


def result(frame):
    rows = frame.collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in rows}) == len(rows)
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COUNTS] for r in rows}


LONG = " ".join(f"w{k}" for k in range(250))
TEXTS = [
    *[None, "", "x", "*** ###", LONG, LONG, LONG + " #", LONG.upper(), "same " * 300, "SAME " * 300, "a b|c"],
    *[LONG + "\U0001f600", "one\x0btwo\x85three four " * 60, "X" + "y" * 49, "X" + "y" * 48, LONG],
]


def test_awkward(spark):
    sources = [None, "", "s", "s", "s", "s", "t", "t", "t", "t", "t", "s", "s", "s", "s", "s"]
    docs = [(i, t, s) for i, (t, s) in enumerate(zip(TEXTS, sources))] + [(5, LONG, "s"), (None, LONG, "s"), (20, LONG, "s")]
    labels = [(1, 1, 0), (4, 1, None), (5, 0, 1), (5, 1, 0), (None, 1, 1), (9, None, 1), (99, 1, 1), (20, 1, 1)]
    rows = [(i, t, s, 7, "x") for i, t, s in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, fails int, part string")
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    good, toxic = {1, 4, 5, 20}, {5, 9, 20}
    assert result(filters.interaction_audit(frame, given)) == by_running_every_order(docs, good, toxic)
    assert filters.interaction_audit(frame.limit(0), given).count() == 0
    none = result(filters.interaction_audit(frame, given.limit(0)))
    assert none == by_running_every_order(docs, set(), set())


def test_whole_table(spark, small):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    good, toxic = ({r["doc_id"] for r in labels if r[c] == 1} for c in ("quality", "toxic"))
    assert result(queries.op11_filter_audit(spark, small)) == by_running_every_order(docs, good, toxic)


def test_same_as_sql(spark, small):
    sql = ORACLE["op11_filter_audit"]
    assert difference(queries.op11_filter_audit(spark, small), connect(small), sql) is None


@pytest.mark.parametrize("size", [1, 3, 5])
def test_edges_count_orders(size):
    """Every level of the lattice is crossed once by every order."""
    orders = [set(itertools.accumulate((1 << k for k in p), initial=0)) for p in itertools.permutations(range(size))]
    for state, bit, n in filters.edges(size):
        assert n == sum(state in o and state | bit in o for o in orders)
