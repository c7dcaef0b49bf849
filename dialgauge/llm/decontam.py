"""Benchmark decontamination: pigeonhole edit matching of test passages in documents.

A passage with an error budget of k is split into k + 1 pieces; a copy with at most k edits holds one of them
unchanged. An automaton over all pieces finds every exact hit in one pass, and Myers' bit-parallel distance
decides in the text around it. Longer test items are searched for as overlapping passages of at most ``PASSAGE`` words,
one every quarter of a passage: of an item that is copied in part, ``PASSAGE`` * 5 / 4 consecutive words are found
wherever they begin. In scripts without blanks two characters count as a word.

Edits allowed: 5 % of a passage's characters. As no piece is shorter than ``PIECE``, passages of 20 to 31, 40 to 47 and
60 to 63 characters have one edit less.

Both sides are compared as lowered runs of letters and digits with single blanks. Defined cases: null and empty texts
and items match nothing; items of fewer than ``LEAST`` words and ``LEAST_CHARS`` characters are not searched for (single
common words would be found everywhere); repeated documents give repeated rows, repeated items are searched for once; empty tables
give no rows; columns other than the ids and the texts are not looked at.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE, LEAST, LEAST_CHARS = 32, 5, 24
# Words; Thai to Khmer, kana and Han are written without blanks.
_BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORDS = re.compile(f"[{_BARE}]{{1,2}}|[^ {_BARE}]+")
# Share of a passage's characters that may be edited, and the shortest piece: shorter ones hit by chance.
ERRORS, PIECE = 0.05, 16
# Characters of test items searched for in one pass (the broadcast's bound); larger benchmarks take more passes.
PASS_CHARS = 8_000_000


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def budget(length: int) -> int:
    return max(0, min(int(ERRORS * length), length // PIECE - 1))


def passages(item: str) -> list[str]:
    """Overlapping runs of an item's words: as long as equal parts of at most ``PASSAGE`` are, a quarter of that apart."""
    found = [m.span() for m in WORDS.finditer(item)]
    if len(found) < LEAST and len(item) < LEAST_CHARS:
        return []
    size = -(-len(found) // -(-len(found) // PASSAGE))
    last = len(found) - size
    firsts = [*range(0, last, max(1, size // 4)), last]
    return list(dict.fromkeys(item[found[a][0] : found[a + size - 1][1]] for a in firsts))


def pieces(passage: str) -> list[tuple[int, str]]:
    """(offset, piece): one more than the budget."""
    parts = budget(len(passage)) + 1
    cuts = [k * len(passage) // parts for k in range(parts + 1)]
    return [(a, passage[a:b]) for a, b in zip(cuts, cuts[1:])]


def nearest(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` closest to ``pattern``, the first one of the least distance."""
    places: dict[str, int] = defaultdict(int)
    for k, c in enumerate(pattern):
        places[c] |= 1 << k
    everything, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score = everything, 0, len(pattern)
    best = (score, 0)
    for end, c in enumerate(text, 1):
        same = places.get(c, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        more, less = minus | (everything & ~(across | plus)), plus & across
        score += bool(more & top) - bool(less & top)
        more, less = more << 1, less << 1
        plus = (less | ~(down | more)) & everything
        minus = more & down & everything
        if score < best[0]:
            best = (score, end)
    return best


def around(passage: str, text: str, starts: list[int]) -> tuple[int, int, int] | None:
    """(distance, start, end) of the best copy within the budget near one of the supposed starts."""
    k, best = budget(len(passage)), None
    ranges: list[list[int]] = []
    for start in sorted(set(starts)):
        lo, hi = max(0, start - k), min(len(text), start + len(passage) + k)
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = max(hi, ranges[-1][1])
        else:
            ranges.append([lo, hi])
    for lo, hi in ranges:
        part = text[lo:hi]
        at = part.find(passage)
        if at >= 0:
            return 0, lo + at, lo + at + len(passage)
        distance, end = nearest(passage, part)
        if distance <= k and (best is None or distance < best[0]):
            back = nearest(passage[::-1], part[:end][::-1])[1]
            best = (distance, lo + end - back, lo + end)
    return best


def _search(items: list[tuple]):
    """A function over batches of (doc, body) that yields hits on ``items``, a list of (item, normalised text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        whole = [(item, p) for item, text in items for p in passages(text)]
        parts = defaultdict(int)
        for item, _ in whole:
            parts[item] += 1
        hits_of = defaultdict(list)
        for number, (_, passage) in enumerate(whole):
            for offset, piece in pieces(passage):
                hits_of[piece].append((number, offset))
        automaton = ahocorasick.Automaton()
        for piece, where in hits_of.items():
            automaton.add_word(piece, (len(piece), where))
        automaton.make_automaton()
        columns = ["doc", "item", "passages", "found", "distance", "start", "end"]
        for batch in batches:
            rows = []
            for doc, body in zip(batch["doc"].astype(object).where(batch["doc"].notna(), None), batch["body"]):
                starts = defaultdict(list)
                for end, (length, where) in automaton.iter(body) if whole else ():
                    for number, offset in where:
                        starts[number].append(end + 1 - length - offset)
                copies = defaultdict(list)
                for number, supposed in starts.items():
                    item, passage = whole[number]
                    if copy := around(passage, body, supposed):
                        copies[item].append(copy)
                for item, found in copies.items():
                    spread = (sum(c[0] for c in found), min(c[1] for c in found), max(c[2] for c in found))
                    rows.append((doc, item, parts[item], len(found), *spread))
            yield pd.DataFrame(rows, columns=columns)

    return run


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    item_col: str = "item_id",
    item_text: str = "text",
    pass_chars: int = PASS_CHARS,
) -> DataFrame:
    """(doc, item, passages, found, distance, start, end) of every document with a copy of a test passage.

    ``found`` of the item's ``passages`` were found, with ``distance`` edits in sum, between ``start`` and ``end`` of the
    normalised text. The benchmark is read in passes of ``pass_chars`` characters, each small enough to send along.
    """
    items = benchmark.select(F.col(item_col).alias("item"), normalised(F.col(item_text)).alias("body"))
    items = items.groupBy("body").agg(F.min("item").alias("item")).where("body <> '' and item is not null")
    chars = items.agg(F.sum(F.length("body"))).first()[0] or 0
    rounds = max(1, -(-chars // pass_chars))
    bodies = docs.select(F.col(id_col).alias("doc"), normalised(F.col(text)).alias("body"))
    doc_type, item_type = (bodies.schema["doc"].dataType.simpleString(), items.schema["item"].dataType.simpleString())
    schema = f"doc {doc_type}, item {item_type}, passages int, found int, distance int, start int, `end` int"
    out = None
    for k in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(rounds)) == k).select("item", "body").collect()
        found = bodies.mapInPandas(_search([tuple(r) for r in sorted(part)]), schema)
        out = found if out is None else out.unionByName(found)
    return out.select(
        F.col("doc").alias(id_col), F.col("item").alias(item_col), "passages", "found", "distance", "start", "end"
    )
