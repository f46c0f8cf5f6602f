"""Run registered queries beside their SQL twins and report differences.

usage: python tools/check.py [sf] [name-prefix ...]
"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import duckdb  # noqa: E402

from tremolite.plans import catalog  # noqa: E402
from tremolite.session import build_session  # noqa: E402

from compare import TABLES, rows_of  # noqa: E402


def main():
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].replace(".", "").isdigit() else "0.01"
    base = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{base}/{t}.parquet'")
    bad, slow = [], []
    for name, fn in catalog.QUERIES.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            df = fn(spark, base)
            got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
        except Exception as e:  # report and go on
            bad.append(name)
            print(f"ERR  {name}: {str(e)[:700]}", flush=True)
            continue
        t1 = time.time()
        note = ""
        if name in catalog.ORACLES:
            try:
                cur = con.execute(catalog.ORACLES[name])
                want, wcols = rows_of([d[0] for d in cur.description], cur.fetchall())
            except Exception as e:
                bad.append(name)
                print(f"SQLE {name}: {str(e)[:700]}", flush=True)
                continue
            if cols != wcols:
                note = f"DIFF columns {cols} vs {wcols}"
            elif got != want:
                diff = [(a, b) for a, b in zip(got, want) if a != b]
                note = f"DIFF rows {len(got)} vs {len(want)}, {len(diff)} differ, first {diff[:2]}"
        else:
            note = "rows-only"
        if note.startswith("DIFF"):
            bad.append(name)
        t2 = time.time()
        if t1 - t0 > 5 or t2 - t1 > 5:
            slow.append((name, round(t1 - t0, 1), round(t2 - t1, 1)))
        print(f"{'BAD ' if note.startswith('DIFF') else 'ok  '} {name} rows={len(got)} {t1 - t0:.1f}s/{t2 - t1:.1f}s {note}", flush=True)
    print("BAD:", bad, "\nSLOW:", slow)


main()
