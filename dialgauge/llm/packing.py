"""Packing: token windows of fixed capacity by best-fit decreasing, with a segment tree over remaining room.

Each task packs the documents that it reads, a bounded group of tokens at a time: no shuffle, no hot group. A group
is cut into full windows and rests; the rests go, longest first, each into the open window with the least room that
holds it. The few windows that end up less than ``FULL`` full are dissolved: their rests are laid end to end into full
windows, and what is left is cut at powers of two, which need no padding.

Defined cases: a null or empty text is the one closing token; repeated rows are packed as often as they occur; an
empty table gives no rows; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

WINDOW = 2048
# Windows filled below this share are dissolved and laid out anew.
FULL = 0.97
# Tokens packed together at most (and the memory of a task: 4 bytes each), but for the last document's.
GROUP = 1 << 22
END = 1
VOCABULARY = "byte_bpe_50k"
# A run without a break longer than this goes to the tokenizer whose time does not grow with the square of a run.
LONG_RUN = re.compile(r"\S{20000}|\s{20000}")


def tokenizer(vocabulary: str = VOCABULARY):
    """A function from texts to lists of ids.

    The ids are those of the ``tokenizers`` file of the vocabulary, its special tokens in a text included. The same
    vocabulary as ranks gives them several times as fast, which the tests compare; texts with a very long run go
    through ``tokenizers`` itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    plain = Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))
    special = {token.content: number for number, token in plain.get_added_tokens_decoder().items()}
    ranks = {token: rank for token, rank in ranks.items() if rank not in special.values()}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(text: str) -> list[int]:
        if len(text) > 20000 and LONG_RUN.search(text):
            return plain.encode(text, add_special_tokens=False).ids
        if any(token in text for token in special):
            return fast.encode(text, allowed_special="all")
        return fast.encode_ordinary(text)

    return encode


class OpenWindows:
    """Open windows by room left: a segment tree whose leaf r counts the windows with room r."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def add(self, window: int, room: int) -> None:
        self.by_room[room].append(window)
        self._change(room, 1)

    def tightest(self, need: int) -> tuple[int, int] | None:
        """Takes out the window with the least room of at least ``need``: (window, room)."""
        node = need + self.leaves
        if not self.counts[node]:
            # Up to the first ancestor with something to the right, then down its leftmost path.
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return self.by_room[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int = WINDOW) -> list[list[int]]:
    """Windows as lists of places in ``lengths`` (each from 1 to ``capacity``); ties keep their order."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    windows: list[list[int]] = []
    open_windows = OpenWindows(capacity)
    for i in order:
        found = open_windows.tightest(lengths[i])
        if found is None:
            windows.append([i])
            window, room = len(windows) - 1, capacity
        else:
            window, room = found
            windows[window].append(i)
        if room > lengths[i]:
            open_windows.add(window, room - lengths[i])
    return windows


def layout(lengths: list[int], capacity: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) for documents of the given token counts."""
    sequences, rests = [], []
    for doc, length in enumerate(lengths):
        whole = length // capacity
        sequences += [[(doc, k * capacity, capacity)] for k in range(whole)]
        if length % capacity:
            rests.append((doc, whole * capacity, length % capacity))
    loose = []
    for window in best_fit_decreasing([r[2] for r in rests], capacity):
        pieces = [rests[i] for i in window]
        used = sum(p[2] for p in pieces)
        if used >= FULL * capacity or used & (used - 1) == 0:
            sequences.append(pieces)
        else:
            loose += pieces
    return sequences + end_to_end(loose, capacity)


def end_to_end(pieces: list[tuple[int, int, int]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pieces cut so that they fill whole windows in order; the last part is cut at powers of two."""
    left = sum(p[2] for p in pieces)
    sequences, current, room = [], [], 0
    for doc, start, length in pieces:
        while length:
            if not room:
                room = capacity if left >= capacity else 1 << (left.bit_length() - 1)
                current = []
                sequences.append(current)
            take = min(room, length)
            current.append((doc, start, take))
            start, length, room, left = start + take, length - take, room - take, left - take
    return sequences


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", id_col: str = "doc_id", capacity: int = WINDOW
) -> DataFrame:
    """One row per piece: id, start and length in its document, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id and offset there. Every id of a document (its text's, then ``END``) lies in exactly one piece.

    Sequence ids are numbered within the task and carry its number in their upper half.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = tokenizer(vocabulary)
        number = TaskContext.get().partitionId() << 32
        names, tokens, held = [], [], 0

        def packed() -> pd.DataFrame:
            nonlocal number
            rows = []
            for sequence in layout([len(t) for t in tokens], capacity):
                offset = 0
                for doc, start, length in sequence:
                    ids = tokens[doc][start : start + length].tobytes()
                    rows.append((names[doc], start, length, ids, len(tokens[doc]), number, offset))
                    offset += length
                number += 1
            columns = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            out = pd.DataFrame(rows, columns=columns)
            return out.astype({id_col: object}) if out[id_col].isna().any() else out

        for batch in batches:
            for name, body in zip(batch[id_col].astype(object).where(batch[id_col].notna(), None), batch[text]):
                ids = encode(body) if isinstance(body, str) else []
                ids.append(END)
                names.append(name)
                tokens.append(np.array(ids, dtype="<u4"))
                held += len(ids)
                if held >= GROUP:
                    yield packed()
                    names, tokens, held = [], [], 0
        if tokens:
            yield packed()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(
        run,
        f"{id_col} {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long",
    )
