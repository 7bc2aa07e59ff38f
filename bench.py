"""Headline queries: python bench.py prints one JSON line. BENCH_SF_DIR and BENCH_CPUS set the data and cores."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "e3_html_elements", "e8_pick_content", "e15_extract_content", "m12_clean_markdown", "m21_build_corpus",
    "r19_eligibility_audit", "r17_representation", "j1_resolve_route", "j6_alternate_index", "c2_upsert_entries",
    "j9_pages_to_refresh",
)


def main() -> None:
    from checks.catalog import QUERIES

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats + 1):  # the first run warms up
            start = time.perf_counter()
            QUERIES[name](spark, d).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(statistics.median(runs[1:]), 3)
    pages = spark.read.parquet(f"{d}/pages.parquet").count()
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(d.rstrip("/")), "pages_per_sec": round(pages / times["m21_build_corpus"], 1),
    }))


if __name__ == "__main__":
    main()
