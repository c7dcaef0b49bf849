"""Near copies by the Jaccard similarity of five-word shingles: banded MinHash finds pairs, exact counts decide.

Documents with the same set of shingles become one node first. ``BANDS`` x ``ROWS`` minimum hashes of a set make
``BANDS`` keys. Nodes that share ``COMMON`` keys or more may be similar: buckets of equal keys give a forest of such pairs,
which groups the nodes. Only nodes of such a group get their sets, computed again from their texts, and are compared exactly
with those of the group that they share a key with. So no table of sets is kept, and a set is moved once for
each ``BLOCK`` members of its group. A pair with similarity s shares fewer than three keys with a probability of 1.3e-5
at 0.8 and less above (binomial with 32 trials of s ** 4). Equal SimHash fingerprints and those within its radius link
nodes as well.

Defined cases: words, lowering and shingles are those of :mod:`simhash`; a text of fewer words than a shingle is
one shingle; null and empty texts have the empty set and are one node; repeated rows and rows with a null id each stay a
row of the result; an empty table gives no rows; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

# By name: a task must not look for this package on its worker.
from .simhash import _LOWER, _WORD, SEED, print_of
from .simhash import links as print_links

SIMILAR = 0.8
BANDS, ROWS = 32, 4
# Keys that two nodes share if they are compared.
COMMON = 3
# Members that meet in one comparison at most, about: larger buckets and groups are cut into blocks, compared two by two.
BLOCK = 1024
_DRAWN = np.random.default_rng(SEED)
_FACTORS = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _DRAWN.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Hashes of all ``size``-word shingles, in order."""
    found = _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))
    count = max(1, len(found) - size + 1) if found else 0
    return np.array([xxhash.xxh64_intdigest(b" ".join(found[k : k + size]), SEED) for k in range(count)], np.uint64)


def shingles(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all ``size``-word shingles."""
    return np.unique(hashes(text, size))


def band_keys(own: np.ndarray) -> np.ndarray:
    """``BANDS`` keys of a set of hashes; sets that agree on all ``ROWS`` minima of a band have the same key."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(own), 4096):
        part = own[at : at + 4096, None]
        mixed = (part ^ (part >> np.uint64(31))) * _FACTORS + _ADDED
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * _FACTORS).min(axis=0))
    return np.array([xxhash.xxh32_intdigest(b.tobytes()) for b in least.reshape(BANDS, ROWS)], np.uint32)


def alike(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def partners(i: int, sizes: np.ndarray, keys: np.ndarray, side: np.ndarray, common: int) -> np.ndarray:
    """Members after ``i`` of like size that share ``common`` keys with it or more.

    ``side`` is 0 for a whole bucket or group; with two blocks, 1 and 2 for their members, only pairs across count.
    """
    rest = np.arange(i + 1, len(sizes))
    rest = rest[(side[rest] != side[i]) | (side[rest] == 0)]
    rest = rest[np.minimum(sizes[rest], sizes[i]) >= SIMILAR * np.maximum(sizes[rest], sizes[i])]
    return rest[(keys[rest] == keys[i]).sum(axis=1) >= common]


def forest(nodes: list, sizes: np.ndarray, keys: np.ndarray, side: np.ndarray, sets: list | None = None) -> list[tuple[int, int]]:
    """Links that connect what all pairs of partners connect; with ``sets``, what all similar ones do."""
    root = np.arange(len(nodes))
    out = []
    for i in range(len(nodes) - 1):
        for j in partners(i, sizes, keys, side, COMMON).tolist():
            if root[i] != root[j] and (sets is None or alike(sets[i], sets[j])):
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
    return out


def _named(text: str, id_col: str) -> Column:
    """What tells a row's text and id from others'."""
    return F.xxhash64(F.col(id_col).cast("string"), text)


def _marks(docs: DataFrame, size: int, text: str, id_col: str) -> DataFrame:
    """(id, named, node, fp, keys, size) per row; the node is a hash of the set of shingles. No set is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [hashes(t, size) for t in batch[text]]
            own = [np.unique(h) for h in every]
            yield pd.DataFrame(
                {
                    id_col: batch[id_col],
                    "named": batch["named"],
                    "node": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], np.uint64).view(np.int64),
                    "fp": np.array([print_of(h) for h in every], np.uint64).view(np.int64),
                    "keys": [band_keys(s).view(np.int32) for s in own],
                    "size": np.array([len(s) for s in own], np.int32),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(id_col, text, _named(text, id_col).alias("named"))
    return rows.mapInPandas(run, f"{id_col} {kind}, named long, node long, fp long, keys array<int>, size int")


def _sets(docs: DataFrame, size: int, text: str, id_col: str) -> DataFrame:
    """(node, shingles) of the texts of some rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = [shingles(t, size) for t in batch[text]]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], np.uint64).view(np.int64)
            yield pd.DataFrame({"node": nodes, "shingles": [s.tobytes() for s in own]})

    return docs.select(text).mapInPandas(run, "node long, shingles binary")


def in_blocks(rows: DataFrame, group: str) -> DataFrame:
    """``rows`` (node, ...) of each group with columns lo, hi, own: one row for each pair of blocks that its block is in.

    A group of up to ``BLOCK`` members is one block, so no task's group grows with the data.
    """
    sizes = written(rows.groupBy(group).agg(F.count("*").alias("n")).where("n > 1"), "group-sizes")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cut = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return cut.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("n", "other")


def _links(rows: DataFrame, group: str, with_sets: bool) -> DataFrame:
    """(a, b) links between the members (node, keys, size, and shingles) of each pair of blocks, a forest for each."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lo, hi = rows["lo"].iloc[0], rows["hi"].iloc[0]
        side = np.zeros(len(rows), np.int64) if lo == hi else np.where(rows["own"] == lo, 1, 2)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]] if with_sets else None
        pairs = forest(rows["node"].tolist(), rows["size"].to_numpy(), np.stack(rows["keys"]), side, sets)
        found = np.array(pairs, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": found[:, 0], "b": found[:, 1]})

    columns = [group, "node", "own", "lo", "hi", "keys", "size", *(["shingles"] if with_sets else [])]
    return in_blocks(rows, group).select(columns).groupBy(group, "lo", "hi").applyInPandas(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, size: int, text: str, id_col: str) -> DataFrame:
    """(a, b) links between nodes (columns node, named, keys, size, one row each) that connect all similar ones."""
    entry = F.posexplode("keys").alias("band", "key")
    entries = nodes.where("size > 0").select("node", entry)
    # A bucket is a band and a key.
    bucket = F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("key").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    entries = entries.select("node", bucket.alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = written(entries.join(shared, "bucket"), "buckets")
    near = _links(met.join(nodes.select("node", "keys", "size"), "node"), "bucket", with_sets=False)
    groups = written(connected_components(near), "similar-groups")
    some = written(groups.join(nodes, "node").select("node", "component", "named", "keys", "size"), "to-compare")
    texts = docs.select(text, _named(text, id_col).alias("named")).join(some.select("named"), "named", "left_semi")
    rows = _sets(texts, size, text, id_col).dropDuplicates(["node"]).join(some, "node")
    return _links(rows.select("component", "node", "keys", "size", "shingles"), "component", with_sets=True)


def near_copies(docs: DataFrame, size: int = 5, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, component_id): every row with the smallest id linked to it, directly or not."""
    rows = written(_marks(docs, size, text, id_col), "marks")
    first = F.min_by(F.struct("named", "keys", "size"), F.struct(F.col(id_col), F.col("named")))
    one = rows.groupBy("node").agg(F.min(id_col).alias("least"), first.alias("first"))
    one = written(one.select("node", "least", "first.*"), "nodes")
    seen = written(rows.select("node", "fp").distinct(), "node-prints")
    prints = written(seen.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    near = print_links(prints.select("fp"))
    for end in ("a", "b"):
        near = near.join(prints.select(F.col("fp").alias(end), F.col("first").alias(f"{end}_node")), end)
    equal = seen.join(prints, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    every = links(docs, one, size, text, id_col).unionByName(near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    found = written(connected_components(every.unionByName(equal)), "node-components")
    groups = one.select("node", "least").join(found, "node", "left")
    groups = written(groups.select("node", "least", F.coalesce("component", "node").alias("component")), "node-groups")
    smallest = written(groups.groupBy("component").agg(F.min("least").alias("component_id")), "node-smallest")
    named = written(groups.join(smallest, "component").select("node", "component_id"), "node-names")
    return rows.select(id_col, "node").join(named, "node").select(id_col, "component_id")
