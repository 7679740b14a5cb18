"""Run registered queries next to their SQL and report differences.

usage: python tools/check.py [-d DIR] [prefix ...]
"""

import argparse
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from tidemark.plans import load_all, runner  # noqa: E402
from tidemark.plans.registry import TABLES  # noqa: E402
from tidemark.session import get_spark  # noqa: E402


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return repr(v)
    if isinstance(v, int) and not isinstance(v, bool):
        return repr(v)
    return str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(norm(x) for x in r) for r in pdf.astype(object).itertuples(index=False))


def kinds(pdf):
    return {c: ("num" if pdf[c].dtype.kind in "iuf" else pdf[c].dtype.kind) for c in sorted(pdf.columns)}


def compare(got, want):
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    dt = [c for c in got.columns if str(got[c].dtype) != str(want[c].dtype) and len(got)]
    note = " dtypes " + ", ".join(f"{c}:{got[c].dtype}/{want[c].dtype}" for c in dt) if dt else ""
    a, b = rows(got), rows(want)
    if a == b:
        return "" + note if note else ""
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ of {len(a)}; e.g.\n     {bad[0][0]}\n     {bad[0][1]}" + note


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("prefix", nargs="*")
    args = ap.parse_args()
    spark = get_spark("check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{args.d}/{t}.parquet')")
    bad = 0
    for name, q in load_all().items():
        if args.prefix and not any(name == p or name.startswith(p + "_") or (p.endswith("*") and name.startswith(p[:-1])) for p in args.prefix):
            continue
        t0 = time.time()
        try:
            got = runner(q)(spark, args.d).toPandas()
            t1 = time.time()
            if q.sql is None:
                print(f"rows {name:34s} {t1 - t0:6.2f}s n={len(got)}", flush=True)
                continue
            want = con.execute(q.sql).df()
            msg = compare(got, want)
        except Exception as e:  # noqa: BLE001
            t1 = time.time()
            msg = f"{type(e).__name__}: {str(e)[:900]}"
        ok = "OK  " if not msg or msg.startswith(" dtypes") else "FAIL"
        bad += ok == "FAIL"
        n = len(got) if "got" in dir() else -1
        print(f"{ok} {name:34s} {t1 - t0:6.2f}s n={n} {msg}", flush=True)
    print("failed:", bad)


main()
