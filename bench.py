"""Seconds per headline query: one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``. Every query runs to a
sink that drops its rows, after one run that is not counted (class loading, code generation); the
first run is reported as ``cold``. Building the plan, with the jobs it needs, is part of the time.
"""

from __future__ import annotations

import json
import os
import time

from dialgauge.catalog.queries import QUERIES
from dialgauge.session import build_session

HEADLINE = [
    "voice_feature_matrix",
    "sms_feature_matrix",
    "wa_feature_matrix",
    "full_feature_matrix",
    "voice_in_out",
    "voice_daily_count_stats",
    "voice_len_stats",
    "voice_distinct",
    "voice_hot_number_counts",
    "sms_opp_len_class_ratio",
    "sms_daily_spread",
    "wa_skewed_name_counts",
    "wa_flow_amount_stats",
    "wa_daily_visit_stats",
    "wa_speed_stats",
    "combined_score",
]


def seconds(spark, run) -> float:
    spark.catalog.clearCache()  # event rows that an earlier run has placed by user do not count
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "dialgauge-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in names:
        cold[name] = round(seconds(spark, lambda: QUERIES[name](spark, sf_dir)), 3)
        warm[name] = round(seconds(spark, lambda: QUERIES[name](spark, sf_dir)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
