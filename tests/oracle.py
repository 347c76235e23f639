"""Comparison of a query's rows with those of its SQL in DuckDB."""

import datetime
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def differences(df, sql: str, folder: str) -> list:
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    want = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(names)]) for r in df.collect())
    return [(g, w) for g, w in zip(got, want, strict=False) if g != w][:3] + ([(len(got), len(want))] if len(got) != len(want) else [])
