"""Run a query in Spark and its check in DuckDB and compare names, kinds and values."""

from __future__ import annotations

import math

import duckdb
import pandas as pd

from hazegrid.plans.views import BASE


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_norm(x) for x in v)
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ("null",)
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return ("b", bool(v))
    if hasattr(v, "isoformat"):
        return ("t", pd.Timestamp(v).isoformat())
    if isinstance(v, str):
        return ("s", v)
    if type(v).__name__ == "Decimal":
        return ("decimal", str(v))
    f = float(v)
    return ("n", 0.0 if f == 0 else f)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, con) -> tuple[bool, str]:
    cur = con.execute(sql)
    dn = [d[0] for d in cur.description]
    dtypes = {d[0]: str(d[1]).upper() for d in cur.description}
    drows = cur.fetchall()
    sn = df.columns
    if sorted(sn) != sorted(dn):
        return False, f"columns {sorted(sn)} != {sorted(dn)}"
    kinds = {}
    for f in df.schema.fields:
        s, d = f.dataType.simpleString(), dtypes[f.name]
        ks = ("f" if s in ("double", "float") else "i" if s in ("int", "bigint", "smallint", "tinyint")
              else "dec" if s.startswith("decimal") else s[:4])
        kd = ("f" if d in ("DOUBLE", "FLOAT") else "i" if d in ("INTEGER", "BIGINT", "SMALLINT", "TINYINT")
              else "huge" if d == "HUGEINT" else "dec" if d.startswith("DECIMAL") else
              {"VARC": "stri", "NULL": "void"}.get(d[:4], d[:4].lower()))
        if ks != kd:
            kinds[f.name] = (s, d)
    a, b = _rows(sn, [tuple(r) for r in df.collect()]), _rows(dn, drows)
    if len(a) != len(b):
        return False, f"rows spark={len(a)} duck={len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)}/{len(a)} rows differ, e.g. spark={bad[0][0]}\n      duck={bad[0][1]} cols={sorted(sn)}"
    if kinds:
        return False, f"types {kinds}"
    return True, f"{len(a)} rows"
