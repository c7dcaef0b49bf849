"""Session settings the library is tuned for, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings that suit the wide per-user aggregates. All of them can be overridden by the caller.
RUNTIME_SETTINGS = {
    # DDHHMMSS values are wall-clock numbers; a fixed zone keeps derived days stable.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "dialgauge", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above. On a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def sorted_aggregates(spark: SparkSession) -> Iterator[None]:
    """Aggregates that gather values run over sorted rows inside this block: one group is in memory at a time.

    The hash form holds up to 128 groups before it sorts what is left. Where rows are sorted already it is slower, too.
    """
    name = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only where the session names none and runs in one process (local tests) a fresh local folder is taken, and
    the session is told about it so that every later call uses the same one. On a cluster the executors could not
    see such a folder, so a session without a shared one is refused.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"master {master}: set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="run-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
