"""Rows of a query and of its SQL, in comparable form."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else v


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def sql_rows(sql: str, sf_dir: str, columns: list[str]) -> list[tuple]:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(columns)
    order = [names.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
