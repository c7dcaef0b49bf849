"""Comparison of a Spark result with a DuckDB result, as bags of rows over sorted columns."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _row_key(row):
    return tuple((x is None, str(x)) for x in row)


def _plain(x):
    if isinstance(x, float):
        return x + 0.0 if x else 0.0
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


def difference(spark_df, con, sql: str) -> str | None:
    """What differs first, or None."""
    left_names = sorted(spark_df.columns)
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    if sorted(names) != left_names:
        return f"columns differ: {sorted(set(names) ^ set(left_names))[:10]}"
    order = [names.index(c) for c in left_names]
    right = sorted(
        (tuple(_plain(r[i]) for i in order) for r in result.fetchall()), key=_row_key
    )
    left = sorted((tuple(_plain(r[c]) for c in left_names) for r in spark_df.collect()), key=_row_key)
    if len(left) != len(right):
        return f"{len(left)} rows against {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            bad = [(c, x, y) for c, x, y in zip(left_names, a, b) if x != y]
            return f"{bad[:5]} in {a[:3]}"
    return None
