"""Packing: ids against the tokenizers library, exact round trip, best fit against a plain search."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dialgauge.llm import packing, queries


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, texts, plain):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(pieces) == set(texts)
    for doc, own in pieces.items():
        ids = plain(texts[doc] or "") + [1]
        own.sort(key=lambda r: r["start"])
        assert own[0]["start"] == 0 and sum(r["length"] for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(ids)
            assert zlib.crc32(part.tobytes()) == (r["ids_crc32"] if "ids_crc32" in r.asDict() else zlib.crc32(r["ids"]))
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / sum(r["length"] for r in rows)


def test_whole_table(spark, small, plain):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert check(queries.op4_packing(spark, small).collect(), texts, plain) < 0.01


def test_awkward(awkward, no_docs, plain):
    texts = {r["doc_id"]: r["text"] for r in awkward.collect()}
    check(packing.pack(awkward).collect(), texts, plain)
    assert packing.pack(no_docs).count() == 0


def test_special_strings_and_long_runs(make_docs, plain):
    marked = ["<|endoftext|> is one id", "a <|endoftext|> b<|endoftext|>", "<|endoftext|>" * 3 + "é", "<|endoftext |>"]
    texts = [*marked, "<|endoftext|>" + "b" * 30_000, "a" * 30_000, " " * 30_000, "\n\n" * 15_000, "l'été’s 12 ½ 漢字 😀" * 50]
    assert plain(marked[1]) == [64, 220, 50256, 275, 50256]
    check(packing.pack(make_docs(texts)).collect(), dict(enumerate(texts)), plain)


def test_many_groups_in_one_task(make_docs, plain, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 3000)
    texts = [f"number {k} " * (k % 700) for k in range(120)]
    check(packing.pack(make_docs(texts).coalesce(1)).collect(), dict(enumerate(texts)), plain)


def plain_best_fit(lengths, capacity):
    windows, room = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [r for r in room if r >= lengths[i]]
        if not fits:
            windows.append([i])
            room.append(capacity - lengths[i])
        else:
            k = room.index(min(fits))
            windows[k].append(i)
            room[k] -= lengths[i]
    return room


@pytest.mark.parametrize("seed", range(20))
def test_best_fit_leaves_the_same_rooms(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 100])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
    windows = packing.best_fit_decreasing(lengths, capacity)
    assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
    got = sorted(capacity - sum(lengths[i] for i in w) for w in windows)
    assert got == sorted(plain_best_fit(lengths, capacity))


def test_layout_has_every_token_once():
    rng = random.Random(4)
    for _ in range(50):
        lengths = [rng.choice([1, 5, 700, 2048, 2049, 5000]) for _ in range(rng.randint(1, 30))]
        seen = defaultdict(set)
        for sequence in packing.layout(lengths):
            assert sum(p[2] for p in sequence) <= 2048
            for doc, start, length in sequence:
                places = set(range(start, start + length))
                assert not places & seen[doc]
                seen[doc] |= places
        assert all(seen[k] == set(range(n)) for k, n in enumerate(lengths))
