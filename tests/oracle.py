"""Runs a query's SQL with DuckDB over the same tables and compares rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def rows_of(sql: str, sf_dir: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), [tuple(r[i] for i in order) for r in got.fetchall()]


def shown(v) -> str:
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if v is None:
        return ""
    return str(v)


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of(sql, sf_dir)
    assert sorted(df.columns) == names, (sorted(df.columns), names)
    got = sorted(tuple(map(shown, r)) for r in df.select(names).collect())
    want = sorted(tuple(map(shown, r)) for r in want)
    assert len(got) == len(want), (len(got), len(want))
    differ = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not differ, (len(differ), names, differ[:4])
