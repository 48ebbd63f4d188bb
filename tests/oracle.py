"""Run registered queries against their SQL oracles in DuckDB."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.12g}")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def _key(row):
    return tuple((v is not None, str(type(v)), str(v)) for v in row)


SPARK_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
               "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def compare(con, df, sql: str) -> str:
    """'' when rows, names, types and values agree, else what differs."""
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    types = dict(zip(names, (str(c[1]) for c in result.description)))
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    order = sorted(names)
    wrong = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
             if SPARK_TYPES.get(f.dataType.simpleString()) != types[f.name]}
    expected = [dict(zip(names, r)) for r in result.fetchall()]
    want = sorted((tuple(_cell(r[c]) for c in order) for r in expected), key=_key)
    got = sorted((tuple(_cell(r[c]) for c in order) for r in df.select(*[f"`{c}`" for c in order]).collect()), key=_key)
    if len(want) != len(got):
        return f"rows {len(got)} vs {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"value {dict(zip(order, a))} vs {dict(zip(order, b))}"
    return f"types {wrong}" if wrong else ("no rows" if not got else "")
