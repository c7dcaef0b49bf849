"""States that merge, and readers that count what they read."""

import math
import random
import statistics

import pytest

from dialgauge import schemas
from dialgauge.operators import flat_features
from dialgauge.operators.states import day_states, load_rounds, merged_states, save_round, state_stats
from dialgauge.session import scratch_path
from dialgauge.sources.audit import FAULT, account, read_accounted


@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(5)
    rows = [(f"u{rng.randint(0, 4)}", rng.randint(1, 3), rng.choice([0, 1, None]), rng.choice([None, 7, rng.randint(-5, 10**9)])) for _ in range(400)]
    rows += [("one", 1, 1, 5), ("none", 1, 1, None), ("nowhen", None, 1, 3)]
    return spark.createDataFrame(rows, "uid string, d int, s int, x long")


def found(rows):
    return sorted(map(tuple, rows.select(sorted(rows.columns)).collect()), key=str)


def test_any_split_merges_to_the_same(events):
    whole = found(day_states(events, "d", "s", {"x": "x"}))
    for parts in (2, 5):
        split = [day_states(events.where(f"pmod(hash(x, d), {parts}) = {k}"), "d", "s", {"x": "x"}) for k in range(parts)]
        assert found(merged_states(*split, split[0].limit(0))) == whole


def test_moments_are_those_of_the_values(events):
    stats = state_stats("x", {"x_": None, "x_in_": "slice = 1"}, ["sum", "min", "max", "mean", "std"])
    got = {r["uid"]: r for r in flat_features(day_states(events, "d", "s", {"x": "x"}), stats).collect()}
    rows = events.collect()
    for uid in {r["uid"] for r in rows}:
        for prefix, fits in (("x_", lambda r: True), ("x_in_", lambda r: r["s"] == 1)):
            xs = [r["x"] for r in rows if r["uid"] == uid and fits(r) and r["x"] is not None]
            want = [sum(xs), min(xs, default=0), max(xs, default=0), sum(xs) / len(xs) if xs else 0, statistics.stdev(xs) if len(xs) > 1 else 0]
            for stat, value in zip(["sum", "min", "max", "mean", "std"], want):
                assert math.isclose(got[uid][prefix + stat], value, rel_tol=1e-12), (uid, prefix, stat)


def test_a_stored_round_replaces_itself(spark, events):
    path = scratch_path(spark, "states")
    halves = [day_states(events.where(f"d = {k} or {k} = 2 and d is null"), "d", "s", {"x": "x"}) for k in (1, 2, 3)]
    for name, states in zip("ABA", [halves[0], halves[1], halves[2]]):
        save_round(states, path, name)
    assert found(load_rounds(spark, path)) == found(merged_states(halves[1], halves[2]))
    assert found(load_rounds(spark, path, ["B"])) == found(halves[1])


def test_one_exchange_after_merging(spark, events):
    path = scratch_path(spark, "states")
    save_round(day_states(events, "d", "s", {"x": "x"}), path, "A")
    stats = flat_features(load_rounds(spark, path), state_stats("x", {"x_": None}, ["sum", "std"]))
    plan = stats._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


LINES = ["u1\t1\t1\t5\t01080000\t1", "u2\t1\tnull\tx\t01080000\t1", "u3\t1\t1\t5\t01080000", "u4\t\tnull\t5\t01080000\t1\t9", "u5\t\tnull\t\t01080000\t0"]


def test_account(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(x,) for x in LINES], "value string").coalesce(1).write.text(path)
    read = read_accounted(spark, path, schemas.SMS)
    got = {r["column"]: (r["read"], r["malformed"], r["missing"]) for r in account(read).collect()}
    assert got["uid"] == (5, 3, 0) and got["smg_opp_head"] == got["smg_opp_num"] == got["smg_opp_len"] == (5, 3, 1)
    # Whatever is selected.
    assert sorted(r["uid"] for r in read.rows.select("uid").collect()) == ["u1", "u5"]
    assert sorted(r[FAULT] for r in read.faults.collect()) == LINES[1:4]
    seen = read_accounted(spark, path, schemas.SMS)
    seen.checked.write.format("noop").mode("overwrite").save()
    assert (seen.counts.get["read"], seen.counts.get["malformed"], seen.counts.get["missing_smg_opp_num"]) == (5, 3, 1)


def test_strict_raises(spark):
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(LINES[0],), (LINES[1],)], "value string").write.text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        read_accounted(spark, path, schemas.SMS, strict=True).rows.select("uid").collect()
