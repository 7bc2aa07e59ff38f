"""Runs queries against their twins: python -m checks.compare [sf_dir] [name prefixes ...]"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

from checks.catalog import QUERIES
from checks.oracles import ORACLES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return int(v) if isinstance(v, Decimal) and v == int(v) else v

    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def connect(d: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def main() -> None:
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(d)
    bad = 0
    for name, query in QUERIES.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t = time.time()
        try:
            df = query(spark, d)
            got = canonical([tuple(r) for r in df.collect()], df.columns)
            ts = time.time() - t
            if name not in ORACLES:
                print(f"{name:28s} rows {len(got[1])} (no twin) {ts:.1f}s", flush=True)
                continue
            t = time.time()
            cur = con.execute(ORACLES[name])
            want = canonical(cur.fetchall(), [c[0] for c in cur.description])
            ok = got == want
            bad += not ok
            print(f"{name:28s} {'ok ' if ok else 'DIFF'} {len(got[1])}/{len(want[1])} spark {ts:.1f}s duckdb {time.time() - t:.1f}s", flush=True)
            if not ok:
                print("   columns", got[0], want[0])
                a, b = set(got[1]), set(want[1])
                print("   only spark ", str(sorted(a - b, key=repr)[:2])[:400], len(a - b))
                print("   only duckdb", str(sorted(b - a, key=repr)[:2])[:400], len(b - a), flush=True)
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} FAILED {str(exc)[:600]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
