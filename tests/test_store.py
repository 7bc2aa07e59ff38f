"""Keys, lifetime, invalidation, upsert, refresh, versions, streams and plans."""

import re

from pyspark.sql import functions as F

from checks import catalog, views
from pagemill.config import Settings, Site
from pagemill.operators import store as K
from pagemill.plans.corpus import build_corpus, keyed_pages
from pagemill.plans.refresh import missing_pages, refresh_corpus
from pagemill.sources import tables as IO
from pagemill.sources.versions import current_version, read_version, write_version

D = "/root/testdata/sf0.001"


def now():
    return F.lit("2024-01-20").cast("timestamp")


def entries(spark, *rows):
    return spark.createDataFrame(rows, "cache_key string, page_id long, markdown string, at string, ttl_s int").select(
        "cache_key", "page_id", F.lit("en").alias("language"), "markdown", F.col("at").cast("timestamp").alias("stored_at"), "ttl_s", F.lit("ok").alias("status"))


def test_live_and_stale(spark):
    df = entries(spark, ("a", 1, "x", "2024-01-19 12:00:00", 86400), ("b", 2, "", "2024-01-19 12:00:00", 86400), ("c", 3, "x", "2024-01-19 00:00:00", 86400), ("d", 4, None, "2024-01-19 12:00:00", 86400))
    assert [r.cache_key for r in K.live_entries(df, Settings(), now()).collect()] == ["a"]
    assert K.live_entries(df, Settings(caching_enabled=False), now()).count() == 0
    assert K.clear_all(df).count() == 0 and K.clear_all(df).schema == df.schema
    change = spark.createDataFrame([(1, "2024-01-19 12:00:00", "settings", 0), (2, "2024-02-01", "settings", 0)], "change_id long, at string, kind string, post_id long").withColumn("ts", F.col("at").cast("timestamp"))
    assert {r.cache_key for r in K.stale_entries(df, change, now()).collect()} == {"a", "b", "c", "d"}
    assert K.stale_entries(df, change.where("change_id = 2"), now()).count() == 0


def test_invalidation_filter(spark):
    posts = spark.createDataFrame([(1, "page"), (2, "secret"), (0, "page")], "post_id long, post_type string")
    types = spark.createDataFrame([("page", True), ("secret", False)], "name string, viewable boolean")
    change = spark.createDataFrame([(1, "post_saved", 1), (2, "post_saved", 2), (3, "post_deleted", 0), (4, "theme", None), (5, "other", 1), (6, "post_saved", -1)], "change_id long, kind string, post_id long")
    assert sorted(r.change_id for r in K.invalidating_changes(change, posts, types).collect()) == [1, 4]


def test_upsert(spark):
    old = entries(spark, ("a", 1, "old", "2024-01-01", 60), ("b", 2, "old", "2024-01-05", 60), ("c", 3, "old", "2024-01-03", 60))
    new = entries(spark, ("a", 1, "new", "2024-01-02", 60), ("a", 1, "newer", "2024-01-04", 60), ("b", 2, "new", "2024-01-02", 60), ("c", 3, "tie", "2024-01-03", 60), ("d", 4, "new", "2024-01-02", 60))
    got = {r.cache_key: r.markdown for r in K.upsert_entries(old, new).collect()}
    assert got == {"a": "newer", "b": "old", "c": "tie", "d": "new"} and K.upsert_entries(old, new).count() == 4


def test_key_sees_every_setting(spark):
    df = spark.createDataFrame([(1, "u", "h")], "page_id long, url string, html string")
    base = Settings()
    others = [base.with_(content_selectors="main"), base.with_(excluded_selectors=".x"), base.with_(include_h1=False), base.with_(include_canonical=False), base.with_(include_excerpt=False),
              base.with_(include_featured_image=True), base.with_(featured_image_position="prepend")]
    keys = [keyed_pages(df, c, Site()).first().cache_key for c in [base, *others, base.with_(cache_ttl=99)]]
    assert len(set(keys[:-1])) == 8 and keys[-1] == keys[0] and re.fullmatch("md_[0-9a-f]{32}", keys[0])
    assert keyed_pages(df, base, Site(version="2")).first().cache_key != keys[0]


def test_refresh_converts_only_misses(spark):
    live = K.serveable(views.store(spark, D), catalog.invalidating(spark, D), Settings(), views.as_of())
    todo = missing_pages(views.pages(spark, D), live, Settings(), views.SITE)
    assert todo.count() == 50 - live.where("cache_key like 'md_%'").count()
    done = refresh_corpus(views.pages(spark, D), views.store(spark, D), catalog.invalidating(spark, D), Settings(), views.as_of(), views.SITE)
    assert done._jdf.queryExecution().optimizedPlan().toString().count("Generate posexplode") == 1
    assert done.count() == done.select("cache_key").distinct().count()


def test_captures(spark):
    df = spark.createDataFrame([("a", 0, "inner"), ("a", 1, "outer"), ("b", 0, "x"), ("b", 1, " \n"), ("c", 0, "")], "url string, capture_no int, html string")
    assert {r.url: r.html for r in IO.last_nonblank_capture(df).collect()} == {"a": "outer", "b": "x"}


def test_versions_and_results(spark, tmp_path):
    root = str(tmp_path / "store")
    assert current_version(spark, root) == 0
    one = entries(spark, ("a", 1, "x", "2024-01-01", 60))
    assert write_version(spark, one, root) == 1
    both = K.upsert_entries(read_version(spark, root).select(*one.columns), entries(spark, ("b", 2, "y", "2024-01-01", 60)))
    assert write_version(spark, both, root) == 2 and read_version(spark, root).count() == 2 and read_version(spark, root, 1).count() == 1
    made = build_corpus(views.short_pages(spark, D), Settings(), now())
    out = str(tmp_path / "out")
    IO.write_results(made, out, compact=True)
    assert IO.read_corpus(spark, out).count() == 50 and IO.read_quarantine(spark, out).count() == 8


def test_bad_pages_do_not_meet_each_other(spark):
    """A page that breaks off in a tag, comment or script leaves its neighbours alone."""
    long = "This sentence is long enough to count as the content of a page."
    texts = [f"<main><p>{long}<a href='x", f"<main><p>{long}<!-- ", f"<main><p>{long}<script>", f"<main><p>{long}</p></main>"]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string")
    got = {r.page_id: r.markdown for r in build_corpus(df, Settings(include_canonical=False), now()).collect()}
    assert got[1] == got[2] == got[3] == long and got[0].startswith(long)


def test_page_job_shuffles_once_and_stays_in_the_jvm(spark):
    df = build_corpus(views.pages(spark, D), Settings(), now())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange \w", plan)) == 1 and plan.count("FileScan") == 1
    assert "Python" not in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_bucketed_pages_need_no_shuffle(spark):
    IO.write_bucketed_pages(views.pages(spark, D), "bucketed_pages", 8)
    df = build_corpus(IO.read_bucketed_pages(spark, "bucketed_pages"), Settings(), now(), co_located=True)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.count() == 50


def test_no_query_collects_or_crosses(spark):
    for name in ("r19_eligibility_audit", "r17_representation", "j1_resolve_route", "j9_pages_to_refresh", "c2_upsert_entries", "j8_stale_entries"):
        plan = catalog.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan and "Python" not in plan, name


def test_streams_equal_batch(spark):
    batch = build_corpus(views.pages(spark, D), Settings(), now(), views.SITE)
    want = {r.page_id: r.m for r in batch.select("page_id", F.md5("markdown").alias("m")).collect()}
    got = [(r.page_id, r.markdown_md5) for r in catalog.t1_convert_stream(spark, D).collect()]
    assert len(got) > 100 and dict(got) == want and set(got) == set(want.items())  # keys come back after their lifetime
    decided = {r.request_id: r.reason for r in catalog.decided(spark, D).collect()}
    assert {r.request_id: r.reason for r in catalog.t2_classify_stream(spark, D).collect()} == decided
