"""Near copies at a five-word similarity of 0.8 or more against brute force."""

import itertools
import random

import corpus_pipeline
import pytest
from test_duplicates import by_union

from dialgauge.llm import similar, simhash


def of_words(text, size=5):
    found = (text or "").lower().split()
    return {tuple(found[k : k + size]) for k in range(max(1, len(found) - size + 1))} if found else set()


def jaccard(a, b):
    a, b = of_words(a), of_words(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def edited_texts():
    """Texts of 60 to 400 words with copies of 0.7 to 0.95, a chain, and a copy in capitals."""
    rng = random.Random(11)
    out = []
    for n in (60, 120, 250, 400):
        own = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        out += [" ".join(own), " ".join(own).upper()]
        for share in (0.01, 0.02, 0.03, 0.05):
            copy = list(own)
            for k in rng.sample(range(n), max(1, int(share * n))):
                copy[k] = f"e{rng.randrange(10**6)}"
            out.append(" ".join(copy))
        out.append(" ".join(own[: int(0.85 * n)]))
    return out


@pytest.mark.parametrize("block", [256, 4])
def test_all_pairs_of_the_similarity_are_found(make_docs, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    texts = edited_texts()
    near = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if jaccard(texts[a], texts[b]) >= 0.8]
    prints = [simhash.fingerprint(t, 5) for t in texts]
    beyond = [(a, b) for a, b in near if (prints[a] ^ prints[b]).bit_count() > simhash.RADIUS]
    assert len(beyond) >= 5
    close = [(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS]
    got = {r["doc_id"]: r["component_id"] for r in similar.near_copies(make_docs(texts)).collect()}
    assert got == by_union(range(len(texts)), near + close)


def test_stage_drops_near_copies(spark, make_docs):
    texts = edited_texts()
    kept = corpus_pipeline.near_duplicates(spark, make_docs(texts), "").collect()
    left = [r["text"] for r in kept]
    assert all(jaccard(a, b) < 0.8 for a, b in itertools.combinations(left, 2))


def test_awkward(awkward, no_docs):
    rows = {r["doc_id"]: r["component_id"] for r in similar.near_copies(awkward).collect()}
    assert len(rows) == 9 and {rows[k] for k in (0, 1, 2)} == {0} and rows[7] == rows[6] == 6
    assert similar.near_copies(no_docs).count() == 0
