"""Language identification: held-out accuracy, best paths by brute force, mixed texts."""

import itertools
import random

import numpy as np
import pytest

from dialgauge.llm import language, queries


def test_held_out_accuracy(spark, small):
    sf = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op3_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize("seed", range(10))
def test_best_path(seed):
    rng = np.random.default_rng(seed)
    count = rng.integers(0, 7, 5)
    first = np.concatenate(([0], np.cumsum(count)[:-1]))
    scores = rng.normal(0, 4, (count.sum(), 3)).astype(np.float32)
    got = language.best_path(scores, first, count, 5.0)

    def value(path, at):
        own = sum(float(scores[at + k, s]) for k, s in enumerate(path))
        return own - 5.0 * sum(a != b for a, b in zip(path, path[1:]))

    for at, n in zip(first, count):
        best = max((value(p, at) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert abs(value(tuple(got[at : at + n]), at) - best) < 1e-3


def test_more_languages_than_a_byte_holds():
    scores = np.full((4, 200), -9, np.float32)
    scores[[0, 1, 2, 3], [199, 199, 130, 130]] = 9
    got = language.best_path(scores, np.array([0]), np.array([4]), 5.0)
    assert got.tolist() == [199, 199, 130, 130]


LATIN = {"aa": "banana maraca pagana", "oo": "bosopo morolo pogono"}


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(2)
    rows = []
    for k in range(200):
        lang = ["aa", "oo", "ru"][k % 3]
        letters = {"aa": ("bmnprc", "a"), "oo": ("bmslpr", "o"), "ru": ("бмнпрс", "аои")}[lang]
        text = " ".join("".join(rng.choice(p) for p in letters * 3) for _ in range(30))
        rows.append((k, text, lang))
    docs = spark.createDataFrame(rows + [(900, None, "aa"), (901, "x", None)], "doc_id long, text string, lang string")
    return language.fit(docs)


def test_mixed_text_has_spans(two_languages):
    a, o = "banama pacana ramaba " * 5, "sopolo morobo lopobo " * 5
    (lang, score, spans), _ = language.label([a + o.strip(), ""], two_languages)
    assert [s[2] for s in spans] == ["aa", "oo"] and spans[0][:2] == (0, len(a) - 1) and spans[1][0] == len(a)
    assert lang in ("aa", "oo") and 0.4 < score < 0.6


def test_script_decides(two_languages):
    text = "запана " * 4
    assert language.label([text], two_languages)[0][0] == "ru"
    # A script that no language uses: still one of the learned languages.
    assert language.label(["漢字かな"], two_languages)[0][0] in ("aa", "oo", "ru")


def test_awkward(awkward, no_docs, two_languages):
    rows = {r["doc_id"]: r for r in language.identify(awkward, two_languages).collect()}
    assert len(rows) == 9
    assert all(rows[k]["lang_pred"] == "und" and rows[k]["score"] == 0.0 and not rows[k]["spans"] for k in (0, 1, 2, 4))
    assert rows[5]["lang_pred"] != "und" and rows[8]["lang_pred"] != "und"
    assert rows[6]["lang_pred"] == rows[7]["lang_pred"]
    assert language.identify(no_docs, two_languages).count() == 0


def test_nothing_to_learn(awkward, no_docs):
    model = language.fit(no_docs)
    assert {r["lang_pred"] for r in language.identify(awkward, model).collect()} == {"und"}


def test_letters_beyond_the_basic_plane():
    lower, *_ = language.tables()
    codes, begin = language.letters(["aÉ1", "\U00020000\U0001f600"], lower)
    assert codes.tolist() == [ord("a"), ord("é"), 0, 0, 0x20000, 0, 0] and begin.tolist() == [0, 4]
