"""Quality rules: counts and verdicts against a plain version in Python."""

import math
import re
import struct
from collections import Counter

import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from dialgauge.llm import quality, queries

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(found[k : k + 5]) for k in range(len(found) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return [len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(covered)]


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def buckets(text):
    tokens = regex.findall(quality.TOKEN, text or "")
    one = [signed(xxhash.xxh64_intdigest(t.encode(), 42)) for t in tokens]

    def pair(k):
        h = xxhash.xxh64_intdigest(struct.pack("<q", one[k]), 42)
        return signed(xxhash.xxh64_intdigest(struct.pack("<q", one[k + 1]), h) if k + 1 < len(one) else h)

    return [h & quality.BUCKETS - 1 for h in one] + [pair(k) & quality.BUCKETS - 1 for k in range(len(one))]


def half_up(x):
    return math.floor(abs(x) + 0.5) * (1 if x > 0 else -1)


def test_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    good = {r["doc_id"] for r in labels if r["quality"] == 1}
    raw, target = Counter(), Counter()
    own = {i: buckets(t) for i, t in texts.items()}
    for i, b in own.items():
        raw.update(b)
        target.update(b if i in good else [])
    n, m = raw.total(), target.total()
    prior = 131_072
    # The trusted share of a bucket, drawn towards the corpus's with the weight of ``prior`` tokens and pairs.
    ratio = {b: half_up(1e6 * math.log((target[b] + prior * raw[b] / n) / (m + prior) / (raw[b] / n))) for b in raw}
    for r in queries.op1_quality_rules(spark, small).collect():
        text = texts[r["doc_id"]]
        counts = base(text)
        assert [r[c] for c in COUNTS] == counts
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        score = sum(ratio[b] for b in own[r["doc_id"]]) / max(1, len(own[r["doc_id"]])) / 1e6
        assert abs(r["score"] - score) < 2e-6
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["score"] >= quality.LEAST)


def test_labels_are_separated(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    rows = queries.op1_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = rows.where("not base_failed").select("quality", "kept").collect()
    bad = [r for r in rows if r["quality"] == 0]
    good = [r for r in rows if r["quality"] == 1]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(not r["kept"] for r in bad) >= 0.9 * len(bad)


@pytest.mark.parametrize("every", [16, 2])
def test_good_documents_without_a_label_stay(spark, small, every):
    """Few labels or many: good documents that the ratio was not fitted on are kept, bad ones are not where many are."""
    sf = small.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r["doc_id"]: r["quality"] for r in labels.collect()}
    fitted = sorted(i for i, q in marks.items() if q == 1)[::every]
    given = spark.createDataFrame([(i, 1) for i in fitted], "doc_id long, quality int")
    rows = quality.judged(docs, given).select("row.doc_id", "base_failed", "kept").collect()
    rows = [r for r in rows if not r["base_failed"]]
    held = [r["kept"] for r in rows if marks.get(r["doc_id"]) == 1 and r["doc_id"] not in set(fitted)]
    bad = [r["kept"] for r in rows if marks.get(r["doc_id"]) == 0]
    assert len(held) > 100 and sum(held) >= 0.95 * len(held)
    assert every > 2 or sum(bad) <= 0.1 * len(bad)


def test_repeats(make_docs):
    texts = [
        "a b c d e a b c d e",
        "a a a a a a a",
        "a a a a a",
        "x a b c d e y a b c d e f a b c d e",
        "one two\none two\n \n \n\none two",
        "a b c d e f a b c d e f",
    ]
    got = {r["row"]["doc_id"]: [r[c] for c in COUNTS] for r in quality.structure(make_docs(texts)).collect()}
    assert got == {k: base(t) for k, t in enumerate(texts)}


def test_awkward(spark, awkward, no_docs):
    labels = spark.createDataFrame([(6, 1), (6, 1), (7, None), (None, 1)], "doc_id long, quality int")
    rows = {r["row"]["doc_id"]: r for r in quality.judged(awkward, labels).collect()}
    assert len(rows) == 9 and all(r["base_failed"] and not r["kept"] for r in rows.values())
    assert rows[0]["score"] == 0.0 and rows[8]["n_words"] == 60_000
    assert rows[6]["row"]["spans"] == "x"
    assert quality.judged(no_docs, labels).count() == 0
    assert {r["score"] for r in quality.judged(awkward, labels.limit(0)).collect()} == {0.0}


def test_verdict_does_not_depend_on_partitions(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    pick = lambda d: sorted((r["id"], r["score"]) for r in quality.judged(d, labels).select(F.col("row.doc_id").alias("id"), "score").collect())
    assert pick(docs) == pick(docs.repartition(7))
