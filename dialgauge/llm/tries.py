"""Conversation prefix trie by truncation peeling: from the deepest level upwards, one level at a time.

A conversation is a path of node ids (a digest of all turns so far). At depth d the nodes that survive from below meet
the conversations that end there; rows with one path become one node, its aggregates are done, its last turn is stripped
and the rest is grouped again. So nodes are discovered and aggregated in one descent, without a table of edges. Grouping
adds up before its shuffle: a prefix that a third of all conversations share is one row per task.

Only digests (16 bytes) and sizes travel, in sections of ``SECTION`` levels: a row never holds more of a path than
one section, however long the conversation. Every level is written before the next one: a lost executor costs one level.
There are as many levels as the longest conversation has turns.

Defined cases: a null role or text is empty; turns with equal numbers stand in the order of their digests; rows with a
null ``conv_id`` belong to no conversation; repeated rows are repeated turns; an empty table gives no rows; columns other
than the four are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import scratch_path
from .common import written

# Conversations in a family of this many ids share the first turns of the first of them.
FAMILY, MOST_SHARED = 5, 8
# A path is the id of the node that its section starts from, then per turn the size of its text and the id it leads to.
SECTION = 16
ID, ENTRY = 16, 24
ROOT = b"\0" * ID
CHUNK_IDS = 4096
NOTHING = hashlib.sha256(b"").hexdigest()
_KEY = "conv_id"
AGGREGATES = (_KEY, "n_convs", "n_children", "n_leaves", "saved_tokens")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, size): a digest of role and text, and the UTF-8 bytes of the text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where(F.col(_KEY).isNotNull()).select(
        F.col(_KEY).cast("long").alias(_KEY),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.substring(F.sha2(marked, 256), 1, 32)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )


def shared_turns(conv_id: str = _KEY) -> Column:
    """How many turns a conversation takes from the first of its family, at most."""
    return (F.crc32(F.col(conv_id).cast("string")) % (MOST_SHARED + 1)).cast("int")


def starts(rows: DataFrame) -> DataFrame:
    """(conv_id, shared, head): every conversation, the number of own turns it loses and what it takes instead.

    ``head`` has at most ``MOST_SHARED`` entries (digest, size) of the family's first conversation.
    """
    order = Window.partitionBy(_KEY).orderBy(F.col("turn").asc_nulls_first(), "digest")
    family = F.col(_KEY) - F.col(_KEY) % FAMILY
    first = rows.where(family == F.col(_KEY)).withColumn("place", F.row_number().over(order))
    first = first.where(F.col("place") <= MOST_SHARED)
    heads = first.groupBy(F.col(_KEY).alias("family")).agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", "size"))).alias("head")
    )
    convs = rows.select(_KEY).distinct().select(_KEY, family.alias("family"), shared_turns().alias("shared"))
    taken = F.slice(F.coalesce("head", F.array().cast("array<struct<place:int,digest:binary,size:bigint>>")), F.lit(1), F.col("shared"))
    return convs.join(heads, "family", "left").select(_KEY, "shared", taken.alias("head"))


def step(node: bytes, digest: bytes) -> bytes:
    """The id of the node that a turn leads to."""
    return hashlib.sha256(node + digest).digest()[:16]


def sections(rows: DataFrame, begun: DataFrame, section: int = SECTION) -> DataFrame:
    """(conv_id, path, ended, section): the rebuilt conversations' paths in sections of ``section`` turns.

    The turns of a conversation stream by in order, after one row of its start; what is kept in between is one section.
    A conversation without turns has one section without entries.
    """
    none = F.lit(None)
    start = begun.select(
        _KEY,
        F.lit(0).alias("kind"),
        none.cast("long").alias("turn"),
        none.cast("binary").alias("digest"),
        none.cast("long").alias("size"),
        "shared",
        F.transform("head", lambda h: h["digest"]).alias("digests"),
        F.transform("head", lambda h: h["size"]).alias("sizes"),
    )
    own = rows.select(
        _KEY,
        F.lit(1).alias("kind"),
        "turn",
        "digest",
        "size",
        none.cast("int").alias("shared"),
        none.cast("array<binary>").alias("digests"),
        none.cast("array<bigint>").alias("sizes"),
    )
    full = ID + section * ENTRY

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, path, at, skip = None, ROOT, 0, 0
        out: list[tuple] = []

        def add(digest: bytes, size: int) -> None:
            nonlocal path, at
            if len(path) == full:
                out.append((conv, path, False, at))
                path, at = path[-ID:], at + 1
            path += int(size).to_bytes(8, "big") + step(path[-ID:], digest)

        def taken() -> pd.DataFrame:
            ready = pd.DataFrame(out, columns=[_KEY, "path", "ended", "section"])
            out.clear()
            return ready

        for batch in batches:
            for c, kind, digest, size, shared, digests, sizes in zip(
                batch[_KEY], batch["kind"], batch["digest"], batch["size"], batch["shared"], batch["digests"], batch["sizes"]
            ):
                if kind == 0:
                    if conv is not None:
                        out.append((conv, path, True, at))
                    conv, path, at, skip = c, ROOT, 0, int(shared)
                    for d, s in zip(digests, sizes):
                        add(bytes(d), s)
                elif skip:
                    skip -= 1
                else:
                    add(bytes(digest), size)
            yield taken()
        if conv is not None:
            out.append((conv, path, True, at))
            yield taken()

    placed = start.unionByName(own).repartition(_KEY).sortWithinPartitions(_KEY, "kind", F.col("turn").asc_nulls_first(), "digest")
    return placed.mapInPandas(run, f"{_KEY} long, path binary, ended boolean, section int")


def _by(column: str, rows: DataFrame, name: str) -> DataFrame:
    """``rows`` through a table with one folder per value of ``column``, so that each is read by itself."""
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    rows.write.partitionBy(column).parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


# The texts below are the same for every depth, so that generated code is compiled once and not per level.
LAST_ID = f"substring(path, octet_length(path) - {ID - 1}, {ID})"
STRIPPED = f"substring(path, 1, octet_length(path) - {ENTRY})"
LAST_SIZE = f"if(octet_length(path) > {ID}, cast(conv(hex(substring(path, octet_length(path) - {ENTRY - 1}, {ENTRY - ID})), 16, 10) as bigint), 0)"


def _level(rows: DataFrame) -> DataFrame:
    """The nodes of one depth from survivors and ended conversations, with their own share added."""
    nodes = rows.groupBy("path").agg(
        F.min(_KEY).alias(_KEY),
        F.sum("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved_tokens").alias("saved_tokens"),
    )
    return nodes.selectExpr(
        "path",
        _KEY,
        "n_convs",
        "n_children",
        "if(n_children = 0, 1L, n_leaves) as n_leaves",
        f"saved_tokens + (n_convs - 1) * {LAST_SIZE} as saved_tokens",
    )


LEVEL = "path binary, " + ", ".join(f"{name} long" for name in AGGREGATES)


def _survivors(nodes: DataFrame, path: Column) -> DataFrame:
    """Nodes of a depth as rows of the depth above."""
    return nodes.select(path.alias("path"), _KEY, "n_convs", F.lit(1).cast("long").alias("child"), "n_leaves", "saved_tokens")


def peel(parts: DataFrame, section: int = SECTION) -> DataFrame:
    """(node, parent, depth, and the aggregates) of all nodes; ``parts`` as of ``sections``, one folder per section."""
    spark, zero = parts.sparkSession, F.lit(0).cast("long")
    depth = F.col("section") * section + ((F.octet_length("path") - ID) / ENTRY).cast("int")
    ended = parts.where("ended").groupBy("path", depth.alias("depth")).agg(F.min(_KEY).alias(_KEY), F.count("*").alias("n_convs"))
    ended = ended.select("path", _KEY, "n_convs", zero.alias("child"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "depth")
    ended = _by("depth", ended, "ended")
    deepest = parts.agg(F.max("section")).first()[0]
    levels = scratch_path(spark, "levels")
    below = None
    for at in range(-1 if deepest is None else deepest, -1, -1):
        if below is not None:
            # A node's smallest member leads to its path in this section, which all its members share.
            above = parts.where(F.col("section") == at).where("not ended").select(_KEY, "path")
            below = _survivors(below.drop("path").join(above, _KEY), F.col("path"))
        for entries in range(section, 0 if at else -1, -1):
            here = ended.where(F.col("depth") == at * section + entries).drop("depth")
            nodes = _level(here if below is None else below.unionByName(here))
            own = f"{levels}/depth={at * section + entries}"
            nodes.write.parquet(own)
            below = spark.read.schema(LEVEL).parquet(own)
            if entries > 1 or not at:
                below = _survivors(below, F.expr(STRIPPED))
    if deepest is None:
        return spark.createDataFrame([], "node binary, parent binary, depth long, " + LEVEL.removeprefix("path binary, "))
    parent = F.expr(f"substring(path, octet_length(path) - {ENTRY + ID - 1}, {ID})")
    nodes = spark.read.schema(f"{LEVEL}, depth int").parquet(levels)
    return nodes.select(F.expr(LAST_ID).alias("node"), F.when(F.col("depth") > 0, parent).alias("parent"), F.col("depth").cast("long").alias("depth"), *AGGREGATES)


def endings(parts: DataFrame, chunk: int = CHUNK_IDS) -> DataFrame:
    """(node, ends_sha256): SHA-256 over the ids of the conversations that end at a node, in order.

    A digest runs over its text from front to back. Ids are sorted by range over all tasks, which join them to chunks; what
    meets in one task per node are those chunks, and they stream through the digest.
    """

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ids = None, []
        for batch in batches:
            out = []
            for n, c in zip(batch["node"], batch[_KEY]):
                if ids and (n != node or len(ids) >= chunk):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = n
                ids.append(c)
            yield pd.DataFrame(out, columns=["node", "first", "ids"])
        if ids:
            yield pd.DataFrame([(node, ids[0], ",".join(map(str, ids)))], columns=["node", "first", "ids"])

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for batch in batches:
            out = []
            for n, ids in zip(batch["node"], batch["ids"]):
                if n != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    ended = parts.where("ended").select(F.expr(LAST_ID).alias("node"), _KEY)
    chunks = ended.repartitionByRange("node", _KEY).sortWithinPartitions("node", _KEY)
    chunks = chunks.mapInPandas(join, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInPandas(digest, "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, section: int = SECTION) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = written(turns(conversations), "turns")
    parts = _by("section", sections(rows, starts(rows), section), "sections")
    nodes = peel(parts, section)
    names = nodes.select(F.col("node").alias("parent"), F.col(_KEY).alias("parent_conv_id"))
    rows = nodes.join(names, "parent", "left").join(endings(parts), "node", "left")
    ends = F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")
    return rows.select(_KEY, "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends)
