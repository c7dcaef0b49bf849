"""Text files in and out."""

from dialgauge import sources
from dialgauge.session import scratch_path, scratch_root


def write(spark, name, lines):
    path = scratch_path(spark, name)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


def test_voice_keeps_leading_zeros(spark):
    path = write(spark, "voice", ["u1\t00861\t000\t5\t1080000\t1080100\t1\t1", "u2\t77\t\t2\t45235959\t45235959\t3\t0"])
    got = {r.uid: r for r in sources.read_voice(spark, path).collect()}
    assert (got["u1"].tel_opp_num, got["u1"].tel_opp_head, got["u1"].tel_start_time) == ("00861", "000", 1080000)
    assert got["u2"].tel_opp_head is None


def test_sms_time_is_text(spark):
    path = write(spark, "sms", ["u1\t10086\t100\t5\t01080000\t1"])
    row = sources.read_sms(spark, [path, path]).collect()
    assert len(row) == 2 and row[0].smg_start_time == "01080000"


def test_web_names(spark):
    lines = ["u1\t中国电信网上营业厅\t1\t2\t3\t4\t0\t1", "u1\tnull\t1\t2\t3\t4\t1\t45", 'u1\t"a ""b"""\t1\t2\t3\t4\t1\t45']
    path = write(spark, "wa", lines)
    assert [r.wa_name for r in sources.read_wa(spark, path).collect()] == ["中国电信网上营业厅", None, 'a "b"']
    assert sources.read_wa(spark, path, missing=[]).collect()[1].wa_name == "null"


def test_round_trip_of_special_texts(spark):
    rows = [("u1", 'say "hi"\\', 1, 2, 3, 4, 0, 1), ("u2", None, 1, 2, 3, 4, 1, 2), ("u3", "a,b", 1, 2, 3, 4, 1, 2)]
    from dialgauge import schemas

    df = spark.createDataFrame(rows, schemas.WEB)
    path = scratch_path(spark, "trip")
    sources.write_tab_text(df, path)
    assert sorted(map(tuple, sources.read_wa(spark, path).collect())) == sorted(rows)


def test_roster_and_labels(spark):
    assert [r.uid for r in sources.test_roster(spark, 5000, 3).orderBy("uid").collect()] == ["u5000", "u5001", "u5002"]
    labels = sources.read_labels(spark, write(spark, "labels", ["u1\t1", "u2\t0"]))
    predicted = sources.read_predictions(spark, write(spark, "pred", ["u2,1", "u3,1"]))
    both = sources.union_pseudo_labels(labels, predicted)
    assert sorted(map(tuple, both.collect())) == [("u1", 1), ("u2", 0), ("u3", 1)]


def test_submission_order(spark):
    import glob

    scored = spark.createDataFrame([(f"u{i}", i / 100, int(i > 50)) for i in range(100)], "uid string, blend double, label int")
    path = scratch_path(spark, "submission")
    sources.write_submission(scored.repartition(4), path)
    lines = [line.strip() for f in sorted(glob.glob(f"{path}/part-*")) for line in open(f)]
    assert lines == [f"u{i},{int(i > 50)}" for i in reversed(range(100))]


def test_rounds_keep_duplicates(spark):
    a = spark.createDataFrame([("u1", 1)], "uid string, n int")
    b = a.select("n", "uid")
    assert sources.union_rounds(a, b, a).count() == 3


def test_scratch_is_the_sessions(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    import pytest

    conf = SimpleNamespace(get=lambda key, default=None: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://somewhere:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(SimpleNamespace(conf=conf, sparkContext=context))
