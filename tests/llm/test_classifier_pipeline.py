"""The classifier on held-out labels, and the pipeline against a plain version."""

import itertools
import zlib

import corpus_pipeline
import pytest
from test_duplicates import by_union
from test_packing import plain  # noqa: F401
from test_similar import of_words
from test_spans import SECRETS, base

from dialgauge.llm import classifier, decontam, queries, simhash


def ranked(pairs):
    """Area under the curve of (label, score)."""
    pairs = sorted(pairs, key=lambda p: p[1])
    total, seen = 0, 0
    positives = sum(p[0] for p in pairs)
    for label, _ in pairs:
        total += seen if label else 0
        seen += not label
    return total / (positives * (len(pairs) - positives))


def test_held_out(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op6_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [(labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert ranked(held) > 0.95


def test_awkward(spark, awkward, no_docs, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    rows = {r["doc_id"]: r["score"] for r in classifier.scored(awkward, model).collect()}
    assert len(rows) == 9 and all(0 <= s <= 1 for s in rows.values()) and rows[6] == rows[7]
    assert classifier.scored(no_docs, model).count() == 0
    # Without rows of both labels there is nothing to learn.
    one = classifier.fit(docs, labels.where("quality = 1"))
    assert {r["score"] for r in classifier.scored(awkward, one).collect()} == {1.0}
    none = classifier.fit(docs, labels.limit(0))
    assert {r["score"] for r in classifier.scored(awkward, none).collect()} == {0.5}


@pytest.fixture(scope="module")
def stages(spark, small):
    """What each stage returns for the smallest table."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], small).cache())
    return out


def texts_of(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns and frame.schema == stages[0].schema


def test_quality_stage(spark, small, stages):
    kept = {r["doc_id"] for r in queries.op1_quality_rules(spark, small).where("kept").collect()}
    assert texts_of(stages[1]) == {i: t for i, t in texts_of(stages[0]).items() if i in kept}


def test_duplicate_stage(stages):
    """Documents with a five-word similarity of 0.8 or more, or fingerprints within the radius, leave their smallest id."""
    before, after = texts_of(stages[1]), texts_of(stages[2])
    prints = {i: simhash.fingerprint(t, 5) for i, t in before.items()}
    sets = {i: of_words(t) for i, t in before.items()}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    links = [
        (a, b)
        for a, b in itertools.combinations(sorted(before), 2)
        if (prints[a] ^ prints[b]).bit_count() <= 4 or alike(a, b)
    ]
    root = by_union(before, links)
    assert after == {i: t for i, t in before.items() if root[i] == i}
    assert len(set(after.values())) == len(after)


def test_benchmark_stage(spark, small, stages):
    before, after = texts_of(stages[2]), texts_of(stages[3])
    found = decontam.contaminated(stages[2], spark.read.parquet(f"{small}/benchmark.parquet"))
    leaks = {r["doc_id"] for r in found.collect()}
    assert leaks and after == {i: t for i, t in before.items() if i not in leaks}


def test_secret_stage(stages):
    before, after = texts_of(stages[3]), texts_of(stages[4])
    assert set(before) == set(after)
    for i, text in after.items():
        assert not base(text, SECRETS)
        assert ("[SECRET]" in text) == bool(base(before[i], SECRETS))
    assert all(r["n_chars"] == len(r["text"]) for r in stages[4].collect())


def test_packing_stage(stages, plain):  # noqa: F811
    from test_packing import check

    texts = texts_of(stages[4])
    assert check(stages[5].collect(), texts, plain) < 0.02


def test_run_is_all_stages(spark, small, stages):
    key = ["doc_id", "start", "length"]
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, small).groupBy("doc_id").sum("length").collect())
    assert got == sorted(tuple(r) for r in stages[5].groupBy("doc_id").sum("length").collect())
    assert set(key) <= set(stages[5].columns)


def test_awkward_documents_go_through(spark, make_docs, small):
    good = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").where("length(text) > 1500").limit(20).collect()]
    docs = make_docs([None, "", "x", *good, good[0], good[0]]).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.unionByName(docs.where("doc_id = 5"))
    for frame, least in ((docs, 1), (docs.limit(0), 0)):
        for _, stage in corpus_pipeline.STAGES:
            frame = stage(spark, frame, small).cache()
        assert frame.count() >= least
