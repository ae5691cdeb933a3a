"""Run registered queries next to their SQL: ``python -m checks.compare [scale] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb

from titlesieve.session import build_session

from .entries import ENTRIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def canonical(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)):
            return repr(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


def main(scale: str = "sf0.01", *names: str) -> int:
    folder = f"/root/testdata/{scale}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    bad = 0
    for name in names or ENTRIES:
        e = ENTRIES[name]
        start = time.time()
        try:
            df = e.run(spark, folder)
            columns = sorted(df.columns)
            got = canonical([tuple(r) for r in df.select(*columns).collect()])
            took = time.time() - start
            if e.oracle is None:
                print(f"rows  {name:28s} {len(got):8d} {took:6.1f}s", flush=True)
                continue
            start = time.time()
            res = con.execute(e.oracle)
            have = [d[0] for d in res.description]
            rows = res.fetchall()
            sql_took = time.time() - start
            if sorted(have) != columns:
                raise AssertionError(f"columns {columns} against {sorted(have)}")
            order = [have.index(c) for c in columns]
            want = canonical([tuple(r[i] for i in order) for r in rows])
            same = got == want
            bad += not same
            print(f"{'ok' if same else 'DIFF':5s} {name:28s} {len(got):8d} {took:6.1f}s sql {sql_took:5.1f}s", flush=True)
            if not same:
                a, b = set(got), set(want)
                print("   only spark:", sorted(a - b)[:3], "\n   only sql:  ", sorted(b - a)[:3], len(want), columns)
        except Exception as ex:
            bad += 1
            print(f"FAIL  {name}: {type(ex).__name__} {str(ex)[:600]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
