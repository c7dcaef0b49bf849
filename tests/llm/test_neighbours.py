"""Embedding near-duplicates against brute force."""

import itertools
import math

import numpy as np
import pytest
from test_duplicates import by_union

from dialgauge.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n long"


def by_brute_force(rows):
    """[(vec_id, n_links, component_id)] in the order of the rows, whose places are the nodes."""

    def usable(label, v):
        return label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)

    unit = {}
    for k, (_, v, label, *_) in enumerate(rows):
        if usable(label, v):
            x = np.array(v, np.float32).astype(float)
            unit[k] = (label, len(v), x / np.linalg.norm(x))
    links = [(a, b) for a, b in itertools.combinations(unit, 2) if unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= 0.98]
    root = by_union(range(len(rows)), links)
    degree = [sum(k in pair for pair in links) for k in range(len(rows))]
    least = {}
    for k, r in root.items():
        least[r] = min((x for x in (least.get(r), rows[k][0]) if x is not None), default=None)
    return [(rows[k][0], degree[k], least[root[k]]) for k in range(len(rows))]


def check(frame, rows, recall=1.0):
    want = by_brute_force(rows)
    got = frame.collect()
    order = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=order) == sorted(want, key=order)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def planted(groups, loose, seed=3, dims=32, spread=0.02):
    """Groups of near copies round random centres, and vectors by themselves, under two labels."""
    rng = np.random.default_rng(seed)
    out = []
    for size in [*groups, *[1] * loose]:
        centre = rng.normal(size=dims)
        centre /= np.linalg.norm(centre)
        label = int(rng.integers(2))
        for _ in range(size):
            v = centre + rng.normal(size=dims) * spread * rng.uniform(0.2, 1.2)
            out.append((label, [float(x) for x in np.float32(v * rng.uniform(0.5, 20))]))
    ids = rng.permutation(len(out))
    return [(int(i), v, label, "x", 1) for i, (label, v) in zip(ids, out)]


@pytest.mark.parametrize("shard, most", [(1000, 2500), (20, 30)])
def test_planted_groups(spark, monkeypatch, shard, most):
    """One shard, many shards, shards that are cut: groups wider than a shard are found whole."""
    keep = neighbours.memberships
    monkeypatch.setattr(neighbours, "memberships", lambda classes, kind: keep(classes, kind, shard, most))
    rows = planted([150, 40, 12, 5, 2, 2], 60)
    check(neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA)), rows)


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "PIVOTS", 3)
    monkeypatch.setattr(neighbours, "ABREAST", 7)
    keep = neighbours.memberships
    monkeypatch.setattr(neighbours, "memberships", lambda classes, kind: keep(classes, kind, 10, 15))
    rows = planted([30, 10, 3], 20)
    check(neighbours.near_duplicates(spark.createDataFrame(rows, SCHEMA)), rows)


def test_awkward(spark):
    near, far = [1.0, 0.01, 0.0], [0.0, 1.0, 0.0]
    rows = [
        *[(0, None, 1), (1, [], 1), (2, [0.0, 0.0, 0.0], 1), (3, [1.0, None, 0.0], 1), (4, [1.0, float("nan"), 0.0], 1)],
        *[(5, [float("inf"), 0.0, 0.0], 1), (6, near, None), (7, near, 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, -0.0, 0.0], 1)],
        *[(9, [1.0, 0.0, 0.0], 1), (9, far, 1), (None, far, 1), (None, far, 2), (10, near, 3), (11, [1.0, 0.01], 1)],
        *[(12, [3e38, 3e36, 0.0], 1), (13, [1e-42, 0.0, 0.0], 1), (14, [1.0], 5), (15, [2.0], 5), (16, [-1.0], 5)],
    ]
    rows = [(*r, "x", 1) for r in rows]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.near_duplicates(frame).collect()
    order = lambda x: tuple((y is None, y or 0) for y in x)
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=order) == sorted(by_brute_force(rows), key=order)
    assert len(got) == len(rows) and all(r["kept"] is not None for r in got)
    assert neighbours.near_duplicates(frame.limit(0)).count() == 0
    assert neighbours.near_duplicates(frame.where("vec_id = 0")).collect()[0]["kept"]


def test_double_components_and_many_copies(spark):
    rows = planted([20, 5], 10)
    rows += [(1000 + k, rows[0][1], rows[0][2], "x", 1) for k in range(200)]
    frame = spark.createDataFrame(rows, SCHEMA.replace("float", "double"))
    check(neighbours.near_duplicates(frame), rows)


def test_whole_table_and_audit(spark, small):
    frame = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    result = queries.op13_embedding_duplicates(spark, small).cache()
    check(result, rows)
    links = [(r["n_links"], r["real_links"]) for r in neighbours.audit(frame, result).collect()]
    assert len(links) == sum(i % 50 == 0 for i, *_ in rows) and all(a == b for a, b in links)


def test_audit_counts_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rows = planted([60, 20], 20)
    frame = spark.createDataFrame(rows, SCHEMA)
    result = frame.selectExpr("vec_id", "0L as n_links")
    real = {i: n for i, n, _ in by_brute_force(rows)}
    got = {r["vec_id"]: (r["n_links"], r["real_links"]) for r in neighbours.audit(frame, result, every=3).collect()}
    assert got == {i: (0, n) for i, n in real.items() if i % 3 == 0}


def test_pruned_graph_leads_everywhere():
    """From any vector a walk along edges that come nearer ends at any other."""
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(120, 8))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    edges = neighbours.pruned(vectors)
    ways = {k: [] for k in range(120)}
    for a, b in edges.tolist():
        ways[a].append(b)
        assert (b, a) in set(map(tuple, edges.tolist()))
    lost = 0
    for a, b in itertools.permutations(range(0, 120, 7), 2):
        at = a
        while at != b:
            step = max(ways[at], key=lambda k: vectors[k] @ vectors[b])
            if vectors[step] @ vectors[b] <= vectors[at] @ vectors[b]:
                lost += 1
                break
            at = step
    assert lost <= 0.02 * 18 * 17
