"""Command line: check registered queries, e.g. ``python tests/check.py [-d DIR] [-m family] [name ...]``."""

from __future__ import annotations

import argparse
import importlib
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from hazegrid import session  # noqa: E402
from hazegrid.plans import load  # noqa: E402
from tests.harness import compare, duck  # noqa: E402

if __name__ == "__main__":
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("-m", action="append", help="family module, e.g. joins")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    if a.m:
        for m in a.m:
            importlib.import_module(f"hazegrid.plans.{m}_q")
        reg = importlib.import_module("hazegrid.plans.registry")
    else:
        reg = load()
    spark = session.build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                          "spark.driver.memory": "6g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = duck(a.d), []
    for n in a.names or list(reg.QUERIES):
        t0 = time.time()
        try:
            df = reg.QUERIES[n](spark, a.d)
            if n in reg.ORACLES:
                ok, msg = compare(df, reg.ORACLES[n], con)
            else:
                rows = df.collect()
                ok, msg = len(rows) > 0, f"rows only: {len(rows)} {rows[0] if rows else ''}"[:200]
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:700]}"
            if len(a.names) == 1:
                traceback.print_exc()
        print(("ok   " if ok else "FAIL ") + f"{n} {time.time() - t0:.1f}s {msg}", flush=True)
        if not ok:
            bad.append(n)
    print(f"{len(bad)} failed: {' '.join(bad)}")
