"""Components and SimHash groups against brute force."""

import itertools
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from dialgauge.llm import queries, simhash
from dialgauge.llm.components import connected_components


def by_union(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def links_of(kind):
    rng = random.Random(3)
    if kind == "path":
        return [(k, k + 1) for k in range(60)]
    if kind == "star":
        return [(50, k) for k in range(100)]
    if kind == "random":
        return [(rng.randrange(200), rng.randrange(200)) for _ in range(120)]
    return []


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    links = links_of(kind)
    frame = spark.createDataFrame(links + [(7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(frame).collect()}
    real = [(a, b) for a, b in links if a != b]
    assert got == by_union({n for link in real for n in link}, real)


def fingerprint(text, size=4):
    """Bit by bit, as the definition reads."""
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not found:
        return 0
    shingles = [" ".join(found[k : k + size]) for k in range(max(1, len(found) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_brute_force(texts):
    prints = {i: fingerprint(t) for i, t in texts.items()}
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    return prints, by_union(prints, near)


def check(rows, texts):
    prints, component = by_brute_force(texts)
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in rows} == component


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    check(queries.op9_simhash_duplicates(spark, small).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def near_copies(n):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    out = []
    for k in range(n):
        copy = list(words)
        copy[rng.randrange(300)] = f"e{k}"
        out.append(" ".join(copy))
    return out


def test_group_of_near_copies_in_blocks(make_docs, monkeypatch):
    """Buckets that are cut into blocks connect what whole ones connect."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    texts = near_copies(80) + ["unlike all others here", "and one more of its own"]
    rows = simhash.near_duplicates(make_docs(texts)).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
    check(rows.collect(), dict(enumerate(texts)))


def test_masks_cover_every_pair_within_the_radius():
    masks = [m & (1 << 64) - 1 for m in simhash.masks(4)]
    rng = random.Random(1)
    assert len(masks) == 31
    for _ in range(20_000):
        difference = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(not difference & m for m in masks)
    assert all(28 <= m.bit_count() <= 36 for m in masks)


def test_awkward(awkward, no_docs):
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(awkward).collect()}
    assert len(rows) == 9
    assert {rows[k]["component_id"] for k in (0, 1, 2)} == {0} and rows[0]["fp"] == 0
    assert rows[7]["component_id"] == rows[6]["component_id"] == 6
    assert simhash.near_duplicates(no_docs).count() == 0


def test_repeated_ids_keep_a_row_each(make_docs):
    rows = simhash.near_duplicates(make_docs(["a b c d e", "a b c d e", "other words of its own"], ids=[5, 5, 9])).collect()
    assert sorted(r["component_id"] for r in rows) == [5, 5, 9]
