"""SimHash near-duplicates: covering locality-sensitive hashing finds every pair within the radius.

Each of the 64 bit places gets a fixed vector of ``radius + 1`` bits; each non-zero vector v makes a mask of the
places whose vector has an odd product with v. Two fingerprints that differ in at most ``radius`` places agree on
all bits of some mask, because ``radius`` vectors cannot span ``radius + 1`` dimensions. So the tables, one per mask,
miss no pair.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows and rows with a
null id each stay a row of the result (a null id never is a component's smallest id unless all its ids are null);
an empty table gives no rows; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

RADIUS = 4
SEED = 42
# Fingerprints that meet in one comparison at most, about: larger buckets are cut into blocks, compared two by two.
BLOCK = 1024
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
# Shingles hashed and counted at a time.
CHUNK = 1 << 16
_LANES = np.arange(8, dtype=np.int64) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: str | None, size: int = 4) -> int:
    """The 64-bit fingerprint of all ``size``-word shingles, as an unsigned number.

    Letters A to Z are lowered, the words are joined by single blanks, and every shingle is a slice of that.
    """
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - size + 1)
    last = ends[min(size, len(found)) - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : min(at + CHUNK, n)].tolist(), last[at : at + CHUNK].tolist())
        hashes = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
        lanes = hashes.view(np.uint8).reshape(-1, 8) + _LANES
        ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    bits = (2 * ones > n).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def print_of(hashes: np.ndarray) -> int:
    """The fingerprint of shingles with these hashes, 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        lanes = hashes[at : at + CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8) + _LANES
        ones += (np.bincount(lanes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int.from_bytes(np.packbits((2 * ones > len(hashes)).astype(np.uint8)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 4, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): one row per input row, fp as a signed 64-bit number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t, size) for t in batch[text]], dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"fp": fps, id_col: batch[id_col]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInPandas(run, f"fp long, {id_col} {kind}")


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks of 64 places, as signed numbers: 2 ** (radius + 1) - 1 of them.

    The places' vectors go round all non-zero values, so that every mask has about half of the places.
    """
    top = (1 << (radius + 1)) - 1
    vectors = [place % top + 1 for place in range(64)]
    out = []
    for v in range(1, top + 1):
        mask = sum(1 << place for place, vector in enumerate(vectors) if (vector & v).bit_count() % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def forest(fps: np.ndarray, side: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within ``radius`` that connect what all links between the fingerprints of one bucket connect.

    ``side`` is 0 for a whole bucket; with two blocks, 1 and 2 for their members, only links across are sought.
    """
    n = len(fps)
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i in range(n - 1):
        near = np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1
        for j in near[(side[near] != side[i]) | (side[near] == 0)].tolist():
            a, b = find(i), find(j)
            if a != b:
                root[b] = a
                out.append((int(fps[i]), int(fps[j])))
    return out


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) links between distinct fingerprints (column fp): enough to connect all that lie within ``radius``.

    Buckets with one member go first. A bucket of more than ``BLOCK`` members is cut into blocks by hash and every
    pair of blocks is compared by itself, so no group grows with the data; each comparison emits a forest, not pairs.
    """
    spark_masks = F.array(*[F.lit(m) for m in masks(radius)])
    entries = distinct.select("fp", F.posexplode(spark_masks).alias("t", "mask"))
    entries = written(entries.select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("k")), "entries")
    sizes = entries.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = entries.join(written(sizes, "buckets"), ["t", "k"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = shared.select("fp", "t", "k", blocks.alias("blocks"), own.alias("own")).select("*", other.alias("other"))
    cut = cut.select(
        "fp",
        "t",
        "k",
        F.least("own", "other").alias("lo"),
        F.greatest("own", "other").alias("hi"),
        F.col("own").alias("own"),
    )
    met = cut.groupBy("t", "k", "lo", "hi").agg(F.sort_array(F.collect_list(F.struct("fp", "own"))).alias("members"))
    members = met.select(
        "lo", "hi", F.transform("members", lambda m: m["fp"]).alias("fps"), F.transform("members", lambda m: m["own"]).alias("own")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for lo, hi, fps, own in zip(batch["lo"], batch["hi"], batch["fps"], batch["own"]):
                side = np.zeros(len(fps), np.int64) if lo == hi else np.where(own == lo, 1, 2)
                out += forest(np.asarray(fps, np.int64).view(np.uint64), side, radius)
            pairs = np.array(out, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return members.mapInPandas(run, "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, size: int = 4, radius: int = RADIUS, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(id, fp, component_id): every row with its fingerprint and the smallest id linked to it, directly or not.

    Rows with equal fingerprints become one before any search, so copies cost nothing there. The components are
    those of fingerprints; each then takes the smallest id of its documents.
    """
    prints = written(fingerprints(docs, size, text, id_col), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    found = connected_components(links(distinct.select("fp"), radius))
    groups = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left")
    groups = groups.select("fp", "least", F.coalesce("component", "fp").alias("component"))
    groups = written(groups, "groups")
    smallest = written(groups.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    named = written(groups.join(smallest, "component").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select(id_col, "fp", "component_id")
