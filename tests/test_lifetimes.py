"""Lifetimes of keys, versions in buckets, entries that hold nothing, and the store at the time of a request."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks import catalog, views
from pagemill.config import Settings, Site
from pagemill.operators import store as K
from pagemill.plans.refresh import entries_at_request_time, refresh_store, upsert_store
from pagemill.sources.versions import bucket_of, current_version, manifest, read_version, replace_buckets, write_version
from pagemill.streaming.jobs import due_pages

D = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def entries(spark, *rows):
    """(cache_key, hours of stored_at, hours of ttl, markdown)"""
    return spark.createDataFrame(
        [(k, i, "en", m, at(h), int(ttl * 3600), "ok" if m else "no_content") for i, (k, h, ttl, m) in enumerate(rows)],
        "cache_key string, page_id long, language string, markdown string, stored_at timestamp, ttl_s int, status string",
    )


def due(spark, arrivals, stored, ttl=24):
    df = spark.createDataFrame([(k, at(h)) for k, h in arrivals], "cache_key string, captured_at timestamp")
    got = K.due_times(df, stored, ttl * 3600).collect()
    return {r.cache_key: [None if x is None else (x - T0).total_seconds() / 3600 for x in r.due] for r in got}


def test_due_times(spark):
    stored = entries(spark, ("live", 0, 100, "x"), ("expired", 0, 10, "x"), ("expired", 0, 5, "x"), ("nothing", 0, 9, None))
    arrivals = [("new", 3), ("new", 3), ("new", 26.9), ("new", 27), ("new", 60), ("new", 50), ("live", 99), ("live", -5), ("expired", 9), ("expired", 10),
                ("expired", 12), ("nothing", 8), ("untimed", None), ("live", None), ("new", None)]
    want = {"new": [3, 27, 60], "expired": [10], "untimed": [None]}
    assert due(spark, arrivals, stored) == want
    assert due(spark, [], stored) == {}
    assert due(spark, [("a", 5), ("a", 1)], None) == {"a": [1]}


def test_due_times_against_a_plain_scan(spark):
    r = random.Random(2)
    arrivals = [(f"k{r.randrange(8)}", r.randrange(400)) for _ in range(300)]
    stored = {f"k{i}": r.randrange(100) for i in range(4)}
    want = {}
    for key in {k for k, _ in arrivals}:
        until = stored[key] + 7 if key in stored else -1
        for h in sorted(h for k, h in arrivals if k == key):
            if h >= until:
                want.setdefault(key, []).append(h)
                until = h + 24
    assert due(spark, arrivals, entries(spark, *((k, h, 7, "x") for k, h in stored.items()))) == want


def test_contents_of_one_page_keep_apart(spark):
    """One page captured with two contents in a batch, one of them twice: two conversions, three entries."""
    from pagemill.plans.corpus import build_corpus

    text = "This sentence is long enough to count as the content of a page, number"
    rows = [(1, "u", f"<main><p>{text} {n}</p></main>", at(h)) for n, h in ((1, 0), (1, 0), (1, 30), (2, 5))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, captured_at timestamp")
    cfg = Settings(include_canonical=False)
    made = build_corpus(due_pages(df, None, cfg), cfg, F.explode("due"), Site(), co_located=True, carry=("due",), by_key=True)
    assert sorted((r.page_id, r.markdown[-1], r.stored_at) for r in made.collect()) == [(1, "1", at(0)), (1, "1", at(30)), (1, "2", at(5))]


def files(root):
    return {os.path.join(p, f): os.stat(os.path.join(p, f)).st_mtime_ns for p, _, names in os.walk(root) for f in names if f.startswith("part-")}


def test_upsert_writes_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "store")
    old = entries(spark, *((f"k{i}", 0, 24, f"old {i}") for i in range(40)))
    assert write_version(spark, old, root, buckets=8) == 1 and set(manifest(spark, root)) == set(range(8))
    before = files(root)
    new = entries(spark, ("k3", 5, 24, "new"), ("k40", 5, 24, "new"))
    assert upsert_store(spark, root, new) == 2 == current_version(spark, root)
    touched = {r.b for r in new.select(bucket_of(F.col("cache_key"), 8).alias("b")).collect()}
    assert {b: v for b, v in manifest(spark, root).items() if b in touched} == dict.fromkeys(touched, 2)
    assert all(v == 1 for b, v in manifest(spark, root).items() if b not in touched)
    assert {k: v for k, v in files(root).items() if k in before} == before
    got = {r.cache_key: r.markdown for r in read_version(spark, root).collect()}
    assert got == {f"k{i}": f"old {i}" for i in range(40)} | {"k3": "new", "k40": "new"}
    assert read_version(spark, root, 1).count() == 40
    with pytest.raises(ValueError):
        replace_buckets(spark, root, old, touched)
    assert current_version(spark, root) == 2
    assert replace_buckets(spark, root, old, set()) == 2
    # an emptied bucket, and then an empty store
    assert replace_buckets(spark, root, old.where("false"), touched) == 3
    assert all(manifest(spark, root)[b] is None for b in touched)
    assert write_version(spark, K.clear_all(old), root) == 4 and read_version(spark, root).count() == 0
    with pytest.raises(ValueError):
        write_version(spark, old, root, buckets=9)


def test_a_lost_write_is_not_read(spark, tmp_path):
    root = str(tmp_path / "store")
    write_version(spark, entries(spark, ("a", 0, 1, "x")), root)
    os.makedirs(f"{root}/manifest/v=2")
    os.makedirs(f"{root}/data/v=2/bucket=0")
    assert current_version(spark, root) == 1 and read_version(spark, root).count() == 1
    assert write_version(spark, entries(spark, ("b", 0, 1, "y")), root) == 2
    assert [r.cache_key for r in read_version(spark, root).collect()] == ["b"]


def test_refresh_leaves_other_buckets_and_known_failures_alone(spark, tmp_path):
    root, cfg = str(tmp_path / "store"), Settings()
    pages, none = views.short_pages(spark, D), views.changes(spark, D).where("false")
    write_version(spark, K.clear_all(views.store(spark, D)), root, buckets=16)
    assert refresh_store(spark, root, pages, none, cfg, F.lit(at(0))) == 2
    made = read_version(spark, root)
    assert {r.status: r["count"] for r in made.groupBy("status").count().collect()} == {"ok": 50, "no_content": 8}
    before = files(root)
    assert refresh_store(spark, root, pages, none, cfg, F.lit(at(1))) == 2 and files(root) == before
    one = pages.withColumn("html", F.when(F.col("page_id") == 5, F.concat("html", F.lit("<i></i>"))).otherwise(F.col("html")))
    assert refresh_store(spark, root, one, none, cfg, F.lit(at(2))) == 3
    assert sum(v == 3 for v in manifest(spark, root).values()) == 1
    # lifetimes end for what holds something; an emptied store is made again whole
    assert refresh_store(spark, root, one, none, cfg, F.lit(at(30))) == 4
    assert read_version(spark, root).where(F.col("stored_at") == F.lit(at(30))).groupBy("status").count().collect()[0].status == "ok"
    change = spark.createDataFrame([(1, "settings", 0, at(40))], "change_id long, kind string, post_id long, ts timestamp")
    refresh_store(spark, root, one, change, cfg, F.lit(at(41)))
    assert {r.stored_at for r in read_version(spark, root).select("stored_at").distinct().collect()} == {at(41)}


def test_next_change_against_a_plain_search(spark):
    r = random.Random(4)
    times = [r.randrange(0, 2000) / 4 for _ in range(200)] + [10.0] * 5
    changes = [r.randrange(0, 1700) / 4 for _ in range(12)] + [10.0]
    df = K.next_changes(
        spark.createDataFrame([(at(x),) for x in times] + [(None,)], "at timestamp"),
        spark.createDataFrame([(at(x),) for x in changes] + [(None,)], "ts timestamp"),
    )
    want = {at(x): min((at(c) for c in changes if c >= x), default=None) for x in times}
    got = df.collect()
    assert len(got) == len(want) and {r.at: r.next for r in got} == want
    assert K.next_changes(df.select("at"), df.select(F.col("next").alias("ts")).where("false")).where("next is not null").count() == 0


def test_entry_at_request_time_against_a_plain_search(spark):
    r = random.Random(6)
    spans = [(r.randrange(4), r.randrange(0, 900), r.choice([0, 1, 30, 70, None])) for _ in range(60)]
    spans = [(p, s, None if k is None else s + k) for p, s, k in spans] + [(0, 100, 120), (0, 100, 101), (None, 5, 900)]
    asked = [(i, r.choice([0, 0, 0, 0, 1, 2, 3, 9]), r.randrange(0, 1000)) for i in range(400)] + [(900, None, 4), (901, 0, None), (902, 0, 100)]
    requests = spark.createDataFrame([(i, p, at(h), "x") for i, p, h in asked], "request_id long, post_id long, ts timestamp, `odd.name` string")
    table = spark.createDataFrame([(p, at(s), at(u)) for p, s, u in spans], "post_id long, since timestamp, until timestamp")

    def has(post, hour):
        # a null end counts as not stored, as in a running last value that passes over nulls
        known = [(s, u) for p, s, u in spans if p == post and post is not None and hour is not None and s <= hour and u is not None]
        return bool(known) and max(known)[1] > hour

    got = entries_at_request_time(requests, table)
    assert got.columns == [*requests.columns, "has_entry"]
    assert {x.request_id: x.has_entry for x in got.collect()} == {i: has(p, h) for i, p, h in asked}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_requests_see_the_store_of_their_time(spark):
    got = {r.has_entry: r["count"] for r in catalog.representation_at(spark, D).groupBy("has_entry").count().collect()}
    assert got[True] > 50 and got[False] > 50
