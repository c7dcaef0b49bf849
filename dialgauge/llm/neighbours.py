"""Embedding near-duplicates: a robust-pruned graph over overlapping cluster shards, searched by range from medoids.

Equal vectors of one label become one class first. Random classes are pivots, about one of ``SHARD``; every class goes to
the shards of its two nearest pivots, a shard of more than ``MOST`` is cut by hash. In each shard a pruned neighbour graph
is built (an edge is left out where a shorter way round leads ``ALPHA`` times nearer), edges count both ways, and the
lists that a class got in its shards are united. A search walks from a shard's medoid towards the query with a beam, then
expands everything within ``SLACK`` of the range until nothing new is in it. A hit is verified in double
precision. A hit that is held by other shards too hands the query on to them, until no query has a shard left to
visit: so the united lists are walked across shards, and dense groups wider than a shard are found whole.

A visit counts only hits whose first shard it is, so each is counted once; it returns counts and a forest of links,
never pairs. ``audit`` measures recall against all vectors.

Defined cases: a vector that is null, empty, zero, or has a null or non-finite component, and one without a label, links
with nothing; vectors of different lengths link with nothing; equal vectors link with each other; repeated rows
and rows with a null id each stay a row (a null id is the smallest of its component only if all are null); an empty table
gives no rows; columns other than the three are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import connected_components

LEAST = 0.98
# Classes per pivot, and in a shard before it is cut.
SHARD, MOST = 1000, 2500
ALPHA, DEGREE = 1.05, 32
BEAM, SLACK = 16, 0.03
# Queries that are walked side by side, rows that meet in one task at most, about, and pivots compared at a time.
ABREAST, BLOCK, PIVOTS = 256, 8192, 4096
# Single precision may be off by so much: hits within it are verified.
FLOAT_ERROR = 1e-5


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of length 1 in double precision."""
    rows = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def prepared(rows: DataFrame, kind: str) -> DataFrame:
    """(vec_id, label, raw, cls): ``cls`` is a digest of label and vector, null for rows that link with nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            raws, classes = [], []
            for label, vector in zip(batch["label"], batch["embedding"]):
                own = None if pd.isna(label) or vector is None else np.array([np.nan if x is None else x for x in vector], kind)
                if own is None or not np.isfinite(own).all() or not own.any():
                    raws.append(None)
                    classes.append(None)
                else:
                    raws.append((own + 0.0).astype(kind).tobytes())  # -0.0 becomes 0.0
                    classes.append(hashlib.blake2b(f"{label}:".encode() + raws[-1], digest_size=16).digest())
            yield pd.DataFrame({"vec_id": batch["vec_id"], "label": batch["label"], "raw": raws, "cls": classes})

    own = rows.select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    return own.mapInPandas(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, label string, raw binary, cls binary")


def nearest(vectors: np.ndarray, pivots: np.ndarray, n: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the ``n`` nearest pivots of each vector, nearest first."""
    near = vectors @ pivots.T
    order = np.argsort(-near, axis=1, kind="stable")[:, :n]
    return order, np.take_along_axis(near, order, axis=1)


def pruned(vectors: np.ndarray, alpha: float = ALPHA, degree: int = DEGREE) -> np.ndarray:
    """(edge, 2) places: for each vector the nearest others, leaving out those that a chosen one is ``alpha`` times nearer to.

    All vectors choose side by side. Edges are given both ways.
    """
    near = vectors @ vectors.T
    apart = np.maximum(2 - 2 * near, 0)
    left = near.copy()
    np.fill_diagonal(left, -np.inf)
    rows = np.arange(len(vectors))
    out = []
    for _ in range(degree):
        chosen = left.argmax(axis=1)
        some = np.isfinite(left[np.arange(len(rows)), chosen])
        rows, chosen, left = rows[some], chosen[some], left[some]
        if not len(rows):
            break
        out.append(np.stack([rows, chosen], axis=1))
        left[alpha * alpha * apart[chosen] <= apart[rows]] = -np.inf
        left[np.arange(len(rows)), chosen] = -np.inf
    edges = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return np.unique(np.concatenate([edges, edges[:, ::-1]]), axis=0)


def reached(
    queries: np.ndarray, entries: list[list[int]], vectors: np.ndarray, starts: np.ndarray, ends: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray]:
    """(query, place) of everything that the walks found within ``least``, before it is verified.

    ``starts`` (one more than there are vectors) and ``ends`` are the edges. Each step expands what is among the ``BEAM``
    best so far or within ``SLACK`` of the range.
    """
    found = []
    for at in range(0, len(queries), ABREAST):
        own = queries[at : at + ABREAST]
        near = np.full((len(own), len(vectors)), -np.inf, np.float32)
        fresh = np.zeros(near.shape, bool)
        q = np.repeat(np.arange(len(own)), [len(e) for e in entries[at : at + ABREAST]])
        v = np.concatenate([np.asarray(e, np.int64) for e in entries[at : at + ABREAST]])
        while len(q):
            near[q, v] = np.einsum("ij,ij->i", own[q], vectors[v])
            fresh[q, v] = True
            bar = np.full(len(own), -np.inf, np.float32)
            if near.shape[1] > BEAM:
                bar = -np.partition(-near, BEAM - 1, axis=1)[:, BEAM - 1]
            q, v = np.nonzero(fresh & (near >= np.minimum(bar, least - SLACK)[:, None]))
            fresh[q, v] = False
            sizes = starts[v + 1] - starts[v]
            q = np.repeat(q, sizes)
            v = ends[np.repeat(starts[v] - np.cumsum(sizes) + sizes, sizes) + np.arange(len(q))]
            new = np.unique((q * near.shape[1] + v)[~np.isfinite(near[q, v])])
            q, v = new // near.shape[1], new % near.shape[1]
        q, v = np.nonzero(near >= least - FLOAT_ERROR)
        found.append(np.stack([q + at, v], axis=1))
    both = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what all links (a, b) connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.get(top, top) != top:
            top = root[top]
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        p, q = find(x), find(y)
        if p != q:
            root[q] = p
            out.append((x, y))
    return out


class _Shard:
    """Members of a shard (columns node, raw, weight, home, neighbours, shards) ready to be walked."""

    def __init__(self, held: pd.DataFrame, kind: str):
        self.node = held["node"].to_numpy(np.int64)
        order = np.argsort(self.node)
        self.node, held = self.node[order], held.iloc[order]
        self.vectors = unit(held["raw"].tolist(), kind)
        self.single = self.vectors.astype(np.float32)
        self.weight, self.home = held["weight"].to_numpy(np.int64), held["home"].to_numpy(bool)
        self.shards = held["shards"].tolist()
        lists = [np.frombuffer(x, np.int64) for x in held["neighbours"]]
        sizes = np.array([len(x) for x in lists])
        ends = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        place = np.searchsorted(self.node, ends).clip(max=len(self.node) - 1)
        here = self.node[place] == ends
        self.ends = place[here]
        self.starts = np.concatenate(([0], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[here], minlength=len(sizes)).cumsum()))
        self.medoid = int((self.single @ self.single.mean(axis=0)).argmax())

    def visit(self, node: np.ndarray, vectors: np.ndarray, entry: np.ndarray, shard: str, least: float) -> pd.DataFrame:
        """Counts, a forest of links and further visits of some queries; an entry that the shard lacks is none."""
        place = np.searchsorted(self.node, entry).clip(max=len(self.node) - 1)
        known = (self.node[place] == entry) & (place != self.medoid)
        entries = [[self.medoid, p] if k else [self.medoid] for p, k in zip(place.tolist(), known.tolist())]
        q, v = reached(vectors.astype(np.float32), entries, self.single, self.starts, self.ends, least)
        true = (np.einsum("ij,ij->i", vectors[q], self.vectors[v]) >= least) & (node[q] != self.node[v])
        q, v = q[true], v[true]
        counted = self.home[v]
        n = np.bincount(q[counted], self.weight[v[counted]], len(node)).astype(np.int64)
        out = [pd.DataFrame({"what": "count", "a": node[n > 0], "b": n[n > 0], "shard": None})]
        links = np.array(forest(node[q], self.node[v]), np.int64).reshape(-1, 2)
        out.append(pd.DataFrame({"what": "link", "a": links[:, 0], "b": links[:, 1], "shard": None}))
        further: dict[tuple[int, str], int] = {}
        for x, y in zip(q.tolist(), v.tolist()):
            for other in self.shards[y]:
                if other != shard:
                    further.setdefault((x, other), y)
        out.append(
            pd.DataFrame(
                {
                    "what": "visit",
                    "a": node[[x for x, _ in further]] if further else [],
                    "b": self.node[list(further.values())] if further else [],
                    "shard": [other for _, other in further],
                }
            )
        )
        return pd.concat(out, ignore_index=True)


FOUND = "what string, a long, b long, shard string"


def memberships(classes: DataFrame, kind: str, shard: int = SHARD, most: int = MOST) -> DataFrame:
    """(node, shard, home): the shards of every class (columns node, label, raw), ``home`` for the nearest pivot's."""
    group = ["label", "width"]
    rows = classes.select("node", "label", F.octet_length("raw").alias("width"), "raw")
    drawn = F.xxhash64("node", F.lit(1))
    first = rows.groupBy(group).agg(F.min(F.struct(drawn.alias("order"), F.col("node").alias("node")))["node"].alias("node"))
    picked = rows.join(first.select("node"), "node", "left_semi").unionByName(rows.where(F.pmod(drawn, F.lit(shard)) == 0))
    pivots = written(picked.dropDuplicates(["node"]), "pivots")
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    sizes = sizes.join(pivots.groupBy(group).agg(F.count("*").alias("k")), group)
    sizes = sizes.select(*group, F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("k") / PIVOTS).alias("parts"))
    sizes = written(sizes, "pivot-counts")
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    met = rows.join(sizes, group).select(*group, "node", "raw", own("blocks").alias("block"), every("parts").alias("part"))
    ways = pivots.join(sizes, group).select(*group, "node", "raw", own("parts").alias("part"), every("blocks").alias("block"))

    def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"node": [], "pivot": [], "near": []})
        order, near = nearest(unit(left["raw"].tolist(), kind), unit(right["raw"].tolist(), kind))
        node = np.repeat(left["node"].to_numpy(), order.shape[1])
        return pd.DataFrame({"node": node, "pivot": right["node"].to_numpy()[order.ravel()], "near": near.ravel()})

    place = [*group, "block", "part"]
    near = met.groupBy(place).cogroup(ways.groupBy(place)).applyInPandas(assign, "node long, pivot long, near double")
    best = near.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("near", "pivot")), False), 1, 2).alias("best"))
    chosen = written(best.select("node", F.posexplode("best").alias("rank", "best")).select("node", "rank", "best.pivot"), "chosen")
    large = chosen.groupBy("pivot").agg(F.ceil(F.count("*") / most).alias("cuts"))
    cut = chosen.join(written(large, "cuts"), "pivot")
    # A class's two shards are cut apart by different hashes, so that the graph holds together across cuts.
    sub = F.pmod(F.xxhash64("node", "pivot", F.lit(2)), F.col("cuts"))
    rows = cut.select("node", F.concat_ws(".", "pivot", sub).alias("shard"), (F.col("rank") == 0).alias("home"), "pivot", "cuts")
    return written(rows, "memberships")


def united_graph(held: DataFrame, kind: str) -> DataFrame:
    """(node, neighbours): the lists that a class got in its shards (at most two), united."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows["node"].to_numpy(np.int64)
        edges = pruned(unit(rows["raw"].tolist(), kind).astype(np.float32))
        lists = np.split(node[edges[:, 1]], np.searchsorted(edges[:, 0], np.arange(1, len(node))))
        return pd.DataFrame({"node": node, "neighbours": [x.astype(np.int64).tobytes() for x in lists]})

    built = held.select("shard", "node", "raw").groupBy("shard").applyInPandas(build, "node long, neighbours binary")
    return built.groupBy("node").agg(F.array_join(F.collect_list(F.hex("neighbours")), "").alias("hex")).select(
        "node", F.unhex("hex").alias("neighbours")
    )


def near_links(classes: DataFrame, kind: str, least: float = LEAST) -> tuple[DataFrame, DataFrame]:
    """(node, n) and (a, b): what other classes weigh that a class (node, label, raw, weight) links with, and a forest."""
    members = memberships(classes, kind)
    held = members.select("node", "shard", "home").join(classes.select("node", "raw", "weight"), "node")
    graph = written(united_graph(held, kind), "graph")
    cuts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda c: F.concat_ws(".", "pivot", c))
    lists = members.select("node", cuts.alias("cut")).groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("cut"))).alias("shards"))
    held = written(held.join(graph, "node").join(lists, "node"), "held")

    def own(rows: pd.DataFrame) -> pd.DataFrame:
        one = _Shard(rows, kind)
        here = rows["shard"].iloc[0]
        out = one.visit(one.node, one.vectors, np.full(len(one.node), -1), here, least)
        # The other cuts of a class's shards are visited in any case.
        cuts = [(node, s) for node, shards in zip(one.node.tolist(), one.shards) for s in shards if s != here]
        more = pd.DataFrame({"what": "visit", "a": [n for n, _ in cuts], "b": -1, "shard": [s for _, s in cuts]})
        return pd.concat([out, more], ignore_index=True)

    def handed(key: tuple, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(rows):
            return pd.DataFrame({"what": [], "a": [], "b": [], "shard": []})
        vectors = unit(queries["query"].tolist(), kind)
        return _Shard(rows, kind).visit(queries["node"].to_numpy(np.int64), vectors, queries["entry"].to_numpy(np.int64), key[0], least)

    rounds = [written(held.groupBy("shard").applyInPandas(own, FOUND), "found")]
    seen = [members.select("node", "shard")]
    while True:
        wanted = rounds[-1].where("what = 'visit'").groupBy(F.col("a").alias("node"), "shard").agg(F.max("b").alias("entry"))
        for past in seen:
            wanted = wanted.join(past, ["node", "shard"], "left_anti")
        wanted = written(wanted, "visits")
        if wanted.isEmpty():
            break
        seen.append(wanted.select("node", "shard"))
        loads = written(wanted.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).alias("loads")), "loads")
        queries = wanted.join(classes.select("node", F.col("raw").alias("query")), "node").join(loads, "shard")
        queries = queries.withColumn("load", F.pmod(F.xxhash64("node"), F.col("loads"))).drop("loads")
        ready = held.join(loads, "shard").withColumn("load", F.explode(F.sequence(F.lit(0).cast("long"), F.col("loads") - 1)))
        key = ["shard", "load"]
        rounds.append(written(queries.groupBy(key).cogroup(ready.drop("loads").groupBy(key)).applyInPandas(handed, FOUND), "found"))
    found = rounds[0]
    for more in rounds[1:]:
        found = found.unionByName(more)
    counts = found.where("what = 'count'").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("n"))
    return counts, found.where("what = 'link'").select("a", "b")


def _numbers(rows: DataFrame) -> str:
    """The number type of the vectors' bytes."""
    return "<f4" if rows.schema["embedding"].dataType.elementType == T.FloatType() else "<f8"


def near_duplicates(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row; ``kept`` where the id is the smallest of its component."""
    kind = _numbers(embeddings)
    rows = written(prepared(embeddings, kind), "vectors")
    classes = rows.where("cls is not null").groupBy("cls").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("raw").alias("raw")
    )
    # Numbers of rows of a written table stay as they are once they are written themselves.
    classes = written(written(classes, "classes").withColumn("node", F.monotonically_increasing_id()), "nodes")
    counts, links = near_links(classes.select("node", "label", "raw", "weight"), kind, least)
    named = classes.select("cls", "node", "weight", "least").join(counts, "node", "left")
    named = named.join(connected_components(links), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    named = written(named.select("cls", "least", "component", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "named")
    smallest = written(named.groupBy("component").agg(F.min("least").alias("component_id")), "smallest")
    ready = written(named.join(smallest, "component").select("cls", "n_links", "component_id"), "class-results")
    out = rows.select("vec_id", "cls").join(ready, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )


def audit(embeddings: DataFrame, results: DataFrame, every: int = 50, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, real_links): vectors whose id is divisible by ``every``, found links and those of brute force.

    Each of them is compared with all vectors of its label, in blocks.
    """
    kind = _numbers(embeddings)
    rows = written(prepared(embeddings, kind).where("cls is not null"), "audited")
    group = ["label", "width"]
    rows = rows.withColumn("width", F.octet_length("raw"))
    sizes = written(rows.groupBy(group).agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "audit-blocks")
    rows = rows.join(sizes, group)
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    asked = rows.where(F.col("vec_id") % every == 0).select(*group, "vec_id", "raw", every_block.alias("block"))
    rows = rows.select(*group, "vec_id", "raw", F.pmod(F.xxhash64("vec_id", "cls"), F.col("blocks")).alias("block"))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"vec_id": [], "n": []})
        others, ids = unit(right["raw"].tolist(), kind).T, right["vec_id"].to_numpy()
        counts = []
        for at in range(0, len(left), ABREAST):
            part = left.iloc[at : at + ABREAST]
            hits = unit(part["raw"].tolist(), kind) @ others >= least
            counts.append((hits & (part["vec_id"].to_numpy()[:, None] != ids)).sum(axis=1))
        return pd.DataFrame({"vec_id": left["vec_id"], "n": np.concatenate(counts)})

    place = [*group, "block"]
    met = written(asked, "audit-queries").groupBy(place).cogroup(rows.groupBy(place)).applyInPandas(compare, "vec_id long, n long")
    real = met.groupBy("vec_id").agg(F.sum("n").alias("real_links"))
    return real.join(results.select("vec_id", "n_links"), "vec_id")
