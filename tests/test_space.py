"""Places in a total order, the fitted feature space, and vectors over it."""

import random

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from dialgauge import sources
from dialgauge.catalog import fixtures as fx
from dialgauge.operators.ranking import with_ranks
from dialgauge.plans import assemble, rounds, space
from dialgauge.session import scratch_path


def test_ranks_are_places_in_the_whole_order(spark):
    rng = random.Random(2)
    rows = [(rng.choice([None, 1.5, -2.0, 7.25]), f"k{k:04d}", "x") for k in range(1500)]
    frame = spark.createDataFrame(rows, "score double, name string, rank string").drop("rank").repartition(5)
    got = with_ranks(frame, [F.col("score").desc(), F.col("name")], first=10).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert {r["name"]: r["rank"] for r in got} == {r[1]: 10 + k for k, r in enumerate(want)}
    assert with_ranks(frame.limit(0), [F.col("name")]).count() == 0


def _tables(spark, small):
    return fx.voice(spark, small), fx.sms(spark, small), fx.web(spark, small)


def test_vectors_hold_what_the_wide_matrix_holds(spark, small):
    voice, sms, wa = _tables(spark, small)
    users = fx.roster(spark, small)
    labels = users.filter("label is not null")
    values = assemble.feature_values(voice, sms, wa, labels, 1, 0, 100)
    numeric = space.numeric_matrix(voice, sms, wa, users)
    fitted = space.fit_space(values, space.numeric_names(numeric))
    vectors = space.feature_vectors(voice, sms, wa, users, fitted)
    assert isinstance(vectors.schema["features"].dataType, VectorUDT)
    size = space.space_size(fitted)
    rows = {r["uid"]: r["features"] for r in vectors.collect()}
    assert len(rows) == users.count() and all(v.size == size for v in rows.values())
    slots = {(r["source"], r["dim"], r["key"], r["slice"]): r["slot"] for r in fitted.collect()}
    assert sorted(slots.values()) == list(range(size))
    for r in numeric.collect():
        vector = rows[r["uid"]].toArray()
        assert all(vector[slots["all", "numeric", name, "all"]] == float(r[name]) for name in space.numeric_names(numeric))
    calls = voice.where("uid = 'u0003' and tel_in_and_out = 1 and tel_opp_len = 7").count()
    assert calls == rows["u0003"].toArray()[slots["voice", "len", "7", "in"]]


def test_an_extended_space_keeps_its_slots(spark):
    values = spark.createDataFrame([("voice", "day", "3"), ("wa", "bad", "b")], "source string, dim string, key string")
    first = space.fit_space(values, ["x", "y"])
    more = values.unionByName(spark.createDataFrame([("wa", "bad", "a"), ("voice", "day", "1")], values.schema))
    second = {tuple(r) for r in space.fit_space(more, ["x", "y"], first).collect()}
    old = {tuple(r) for r in first.collect()}
    assert len(old) == 2 + 3 + 1 and old < second
    assert sorted(r[0] for r in second) == list(range(len(old) + 3 + 1))


def test_a_round_with_very_many_values(spark):
    """20,000 short numbers make 20,000 slots; the wide form would stop at 5,000."""

    def text(df, name):
        path = scratch_path(spark, name)
        sources.write_tab_text(df, path)
        return path

    voice = spark.range(20_000).selectExpr(
        "concat('u', cast(5000 + id % 7 as string)) as uid",
        "lpad(cast(id as string), 5, '0') as tel_opp_num",
        "'139' as tel_opp_head",
        "5 as tel_opp_len",
        "1080000 as tel_start_time",
        "1080100 as tel_end_time",
        "1 as tel_call_type",
        "1 as tel_in_and_out",
    )
    sms = spark.sql("select 'u5000' as uid, '10086000' as num, '100' as head, 8 as len, '01080000' as t, 1 as io")
    wa = spark.sql("select 'u5001' as uid, 'app' as name, 1 as n, 2 as s, 3 as up, 4 as down, 1 as type, 2 as day")
    labels = spark.sql("select * from values ('u5000', 1), ('u5001', 0), ('u5002', 0) as t(uid, label)")
    inputs = rounds.RoundInputs([text(voice, "v")], [text(sms, "s")], [text(wa, "w")], text(labels, "l"), 5000, 10)
    train, score = rounds.round_matrix(spark, inputs)
    assert train.columns == ["uid", "label", "features"] and score.columns == ["uid", "features"]
    vectors = {r["uid"]: r["features"] for r in train.collect() + score.collect()}
    assert set(vectors) == {f"u{k}" for k in range(5000, 5010)}
    assert all(v.size > 20_000 for v in vectors.values()) and vectors["u5009"].numNonzeros() == 0
    short = [v.numNonzeros() for v in vectors.values()]
    assert sum(short) >= 20_000


def test_submission_file_stands_in_rank_order(spark):
    rows = [(f"u{k:03d}", float(k * 37 % 101), k % 2) for k in range(300)]
    frame = spark.createDataFrame(rows, "uid string, blend double, label int").repartition(6)
    path = scratch_path(spark, "ordered")
    sources.write_submission(frame, path)
    files = sorted(f for f in spark.read.text(path).select("_metadata.file_name").distinct().toPandas()["file_name"])
    lines = [r["value"] for f in files for r in spark.read.text(f"{path}/{f}").coalesce(1).collect()]
    want = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert lines == [f"{uid},{label}" for uid, _, label in want]
