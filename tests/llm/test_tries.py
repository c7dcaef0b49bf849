"""Prefix trie of conversations against a plain one, and against SQL."""

import hashlib
import random
import zlib

import pytest
from compare import connect, difference

from dialgauge.llm import queries, tries
from dialgauge.llm.oracle import ORACLE

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, depth string, size long"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [x[-1] for x in sorted(turns, key=lambda x: x[:3])] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = int(c / 5) * 5
        out[c] = own.get(first, [])[:h] + turns[h:]
    return out


def plain_trie(rows):
    members, ends = {}, {}
    for c, turns in rebuilt(rows).items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        parts = [below(k) for k in kids.get(p, [])]
        return (sum(a for a, _ in parts) or 1, own + sum(b for _, b in parts))

    return sorted(
        (
            min(m),
            len(p),
            min(members[p[:-1]]) if p else None,
            len(m),
            len(kids.get(p, [])),
            *below(p),
            hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def found(frame):
    return sorted(tuple(r[c] for c in COLUMNS) for r in frame.select(COLUMNS).collect())


def conversations():
    """Families with shared turns, copies, a long one, ties, nulls, missing firsts of families, negative ids."""
    rng = random.Random(5)
    says = [("user", "hello"), ("assistant", "what is it"), ("user", "größe \U0001f600"), (None, "x"), ("user", None)]
    rows = [(c, t, *rng.choice(says)) for c in range(60) for t in range(rng.randint(1, 12))]
    rows += [(c, t, "user", f"same {t}") for c in range(100, 140) for t in range(11)]
    rows += [(c, t, "user", f"turn {t}" if t < 19 + c % 3 else f"own {c} {t}") for c in range(200, 205) for t in range(25)]
    rows += [(301, None, "b", "late"), (301, None, "a", "early"), (301, 2, "c", ""), (301, 2, "c", ""), (302, 5, None, None)]
    rows += [(-7, 0, "user", "hello"), (-5, 0, "user", "hello"), (None, 0, "user", "lost"), (401, 0, "u", "a"), (402, 0, "u", "a")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("section", [8, 3])
def test_planted(spark, section):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    assert any(not turns for turns in rebuilt(rows).values())
    assert found(tries.prefix_trie(frame, section)) == plain_trie(rows)


def test_ids_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(tries, "CHUNK_IDS", 3)
    rows = [(c, 0, "user", "same") for c in range(1000, 900, -1)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    parts = tries.sections(tries.turns(frame), tries.starts(tries.turns(frame)))
    got = sorted(r["ends_sha256"] for r in tries.endings(parts, 3).collect())
    ends = {}
    for c, turns in rebuilt(rows).items():
        ends.setdefault(tuple(turns), []).append(c)
    assert got == sorted(hashlib.sha256(",".join(map(str, sorted(m))).encode()).hexdigest() for m in ends.values())


def test_long_conversation(spark):
    rows = [(10, t, "user", "word " * 50) for t in range(40)] + [(15, t, "user", "word " * 50) for t in range(33)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    assert found(tries.prefix_trie(frame, 50)) == plain_trie(rows)


def test_empty(spark):
    assert tries.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert tries.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", "x", 3)], SCHEMA)).count() == 0


def test_whole_table(spark, small):
    frame = queries.op12_prefix_trie(spark, small)
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(frame) == plain_trie(rows)
    assert difference(frame, connect(small), ORACLE["op12_prefix_trie"]) is None
