"""Language identification: scripts narrow the candidates, per-word scores and a Viterbi path label spans.

A language's model is the log share of hashed letter triples (with word ends) in its training texts. A word's score is
the sum over its letters; languages that hardly use the word's script are no candidates. The best path through all words
of a text, with a penalty for every change of language, labels spans; a text's language is the one with most letters.

Defined cases: a null text, and one without a letter, is ``und`` with score 0 and no spans; repeated rows get the same
result; an empty table gives no rows; if nothing can be learned, every text is ``und``; of languages with equally many
letters the first by name wins; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Documents per language that the model is fitted on at most, about: a share by hash of the id.
SAMPLE = 3000
BUCKETS = 1 << 16
# Log odds that a change of language must gain; log odds against a language that does not use the word's script.
SWITCH, FOREIGN = 10.0, 30.0
# Share of a language's letters from which it uses a script.
USES = 0.001
# Letters worked on at a time.
CHARS = 1 << 21
# First code point of each script's ranges; what lies between belongs to the one before.
SCRIPTS = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"),
    (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"),
]


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per code point of the basic plane: its lower-case letter or 0 if it is none, and its script's number; names."""
    names = sorted({name for _, name in SCRIPTS})
    lower = np.zeros(0x10000, np.uint32)
    for code in range(0x10000):
        c = chr(code)
        if c.isalpha():
            lower[code] = ord(c.lower()) if len(c.lower()) == 1 else code
    starts = np.array([s for s, _ in SCRIPTS])
    at = np.searchsorted(starts, np.arange(0x10000), side="right") - 1
    script = np.array([names.index(SCRIPTS[k][1]) for k in range(len(SCRIPTS))], np.uint8)[at]
    return lower, script, np.array(names)


def letters(texts: list[str], lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts' letters in lower case, 0 elsewhere, with a 0 after each text; and the texts' starts."""
    joined = "\0".join(texts) + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le" if sys.byteorder == "little" else "utf-32-be", "surrogatepass"), np.uint32)
    out = lower[np.minimum(codes, 0xFFFF)]
    for k in np.flatnonzero(codes > 0xFFFF):
        out[k] = codes[k] if chr(codes[k]).isalpha() else 0
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return out, np.concatenate(([0], np.cumsum(sizes)[:-1]))


def triples(codes: np.ndarray) -> np.ndarray:
    """Bucket of each place with its two neighbours (0 is a word's end)."""
    with np.errstate(over="ignore"):
        mixed = codes * np.uint32(2654435761)
        left, right = np.roll(codes, 1) * np.uint32(2246822519), np.roll(codes, -1) * np.uint32(3266489917)
        mixed = mixed ^ (left << np.uint32(7)) ^ (left >> np.uint32(9)) ^ (right << np.uint32(13)) ^ (right >> np.uint32(5))
        return ((mixed * np.uint32(668265263)) >> np.uint32(16)).astype(np.int64)


def batched(texts: list) -> Iterator[tuple[int, list[str]]]:
    """(first place, texts) with about ``CHARS`` characters each; null counts as empty."""
    part, size, first = [], 0, 0
    for k, text in enumerate(texts):
        part.append(text if isinstance(text, str) else "")
        size += len(part[-1])
        if size >= CHARS:
            yield first, part
            part, size, first = [], 0, k + 1
    if part:
        yield first, part


class Model:
    """Log shares (buckets x languages), which language uses which script, and the letter tables."""

    def __init__(self, langs: list[str], counts: np.ndarray, script_counts: np.ndarray):
        self.langs = langs
        self.lower, self.script, _ = tables()
        shares = (counts + 0.5) / (counts + 0.5).sum(axis=0)
        self.log_shares = np.log(shares).astype(np.float32)
        used = script_counts >= USES * np.maximum(script_counts.sum(axis=0), 1)
        # Scripts that no language uses rule out none of them.
        self.penalty = np.where(used | ~used.any(axis=1, keepdims=True), 0, -FOREIGN).astype(np.float32)


def words_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of letters."""
    inside = codes > 0
    edges = np.diff(np.concatenate(([0], inside.view(np.int8))))
    starts = np.flatnonzero(edges == 1)
    ends = np.flatnonzero(edges == -1)
    return starts, ends


def best_path(scores: np.ndarray, first: np.ndarray, count: np.ndarray, switch: float) -> np.ndarray:
    """The language of every word: for each text (words first .. first + count) the path with the best sum of scores.

    One step handles the next word of all texts that still have one.
    """
    path = np.zeros(len(scores), np.int16)
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    active = len(count) - np.searchsorted(count[::-1], np.arange(count[0] if len(count) else 0), side="right")
    own = np.arange(scores.shape[1], dtype=np.int16)
    back = np.zeros(scores.shape, np.int16)
    value = np.zeros((len(count), scores.shape[1]), np.float32)
    for t, n in enumerate(active.tolist()):
        now, at = value[:n], first[:n] + t
        if t:
            top = now.argmax(axis=1).astype(np.int16)
            changed = now[np.arange(n), top][:, None] - switch
            stays = now >= changed
            back[at] = np.where(stays, own, top[:, None])
            now = np.where(stays, now, changed)
        value[:n] = now + scores[at]
    state = value.argmax(axis=1).astype(np.int16)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = first[:n] + t
        path[at] = state[:n]
        if t:
            state[:n] = back[at, state[:n]]
    return path


def label(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """(language, share of its letters, spans) of every text; spans are (start, end, language) in code points."""
    codes, begin = letters(texts, model.lower)
    starts, ends = words_of(codes)
    if not len(model.langs) or not len(starts):
        return [("und", 0.0, [])] * len(texts)
    # Sums between two places of one array would lose digits: add up each word's letters by itself.
    per_letter = model.log_shares[triples(codes)]
    per_letter[codes == 0] = 0
    scores = np.add.reduceat(per_letter, starts, axis=0)
    scores += model.penalty[model.script[np.minimum(codes[starts], 0xFFFF)]]
    first = np.searchsorted(starts, begin)
    count = np.diff(np.concatenate((first, [len(starts)])))
    path = best_path(scores, first, count, SWITCH)
    sizes, out = ends - starts, []
    for k, (a, n) in enumerate(zip(first.tolist(), count.tolist())):
        if not n:
            out.append(("und", 0.0, []))
            continue
        own = path[a : a + n]
        weight = np.bincount(own, weights=sizes[a : a + n], minlength=len(model.langs))
        best = int(weight.argmax())
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1, [n]))
        spans = [
            (int(starts[a + i] - begin[k]), int(ends[a + j - 1] - begin[k]), model.langs[own[i]])
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist())
        ]
        out.append((model.langs[best], float(weight[best] / weight.sum()), spans))
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the languages in ``lang`` (null: not learned from), from about ``sample`` documents each."""
    known = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((1, 0)))
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    limits = F.create_map(*[F.lit(x) for name in langs for x in (name, min(1_000_000, sample * 1_000_000 // sizes[name] + 1))])
    taken = known.where(place < limits[F.col("lang")])
    lower, script, names = tables()

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((BUCKETS + len(names), len(langs)), np.int64)
        for batch in batches:
            for k, name in enumerate(langs):
                for _, part in batched(batch["text"][batch["lang"] == name].tolist()):
                    codes, _ = letters(part, lower)
                    inside = codes > 0
                    sums[:BUCKETS, k] += np.bincount(triples(codes)[inside], minlength=BUCKETS)
                    own = script[np.minimum(codes[inside], 0xFFFF)]
                    sums[BUCKETS:, k] += np.bincount(own, minlength=len(names))
        bucket, k = np.nonzero(sums)
        yield pd.DataFrame({"bucket": bucket, "k": k, "n": sums[bucket, k]})

    # At most (BUCKETS + scripts) x languages rows.
    rows = taken.select("text", "lang").mapInPandas(counted, "bucket long, k long, n long")
    totals = rows.groupBy("bucket", "k").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((BUCKETS + len(names), len(langs)))
    sums[totals["bucket"], totals["k"]] = totals["n"]
    return Model(langs, sums[:BUCKETS], sums[BUCKETS:])


def identify(docs: DataFrame, model: Model, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, lang_pred, score, spans): one row per input row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, part in batched(batch[text].tolist()):
                found = label(part, model)
                yield pd.DataFrame(
                    {
                        id_col: batch[id_col].iloc[first : first + len(part)].to_numpy(),
                        "lang_pred": [f[0] for f in found],
                        "score": [f[1] for f in found],
                        "spans": [[dict(zip(("start", "end", "lang"), s)) for s in f[2]] for f in found],
                    }
                )

    kind = docs.schema[id_col].dataType.simpleString()
    spans = "array<struct<start:int,`end`:int,lang:string>>"
    return docs.select(id_col, text).mapInPandas(run, f"{id_col} {kind}, lang_pred string, score double, spans {spans}")
