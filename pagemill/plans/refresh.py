"""Incremental refresh and what a request is answered with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DAY_SECONDS, Settings, Site
from ..operators.posts import with_post_facts
from ..operators.requests import classify_requests, decide
from ..operators.store import kept_entries, pages_to_refresh, serveable, span_of, upsert_entries, valid_spans
from ..operators.tokens import tasks_for
from ..sources.versions import bucket_of, buckets_of, current_version, manifest, read_version, replace_buckets
from .corpus import CORPUS_COLUMNS, build_corpus, keyed_pages, page_columns


def missing_pages(pages: DataFrame, live: DataFrame, cfg: Settings, site: Site = Site()) -> DataFrame:
    """Pages to convert, found by key before any page is tokenised. Only (page_id, key) pairs take part
    in the anti join; the page text is then filtered by id. Of pages with one key the highest page_id is made."""
    todo = pages_to_refresh(keyed_pages(pages, cfg, site), live).groupBy("cache_key").agg(F.max("page_id").alias("page_id"))
    return pages.join(todo.select("page_id"), "page_id", "left_semi")


def refresh_corpus(
    pages: DataFrame,
    corpus: DataFrame,
    invalidating: DataFrame,
    cfg: Settings,
    as_of: Column,
    site: Site = Site(),
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """The store after a refresh at as_of: live entries stay, misses are converted and added.

    What is made has no live entry under its key, so the two are put together as they are; nothing is evaluated twice.
    """
    live = serveable(corpus, invalidating, cfg, as_of).select(*CORPUS_COLUMNS)
    made = build_corpus(missing_pages(pages, live, cfg, site), cfg, as_of, site, descriptions)
    return live.unionByName(made.where(F.col("status") == "ok").select(*CORPUS_COLUMNS))


def refresh_store(
    spark: SparkSession,
    root: str,
    pages: DataFrame,
    invalidating: DataFrame,
    cfg: Settings,
    as_of: Column,
    site: Site = Site(),
    descriptions: DataFrame | None = None,
) -> int:
    """The same over a store of versions (C6), as its next version: only buckets that change are read whole and written.

    A bucket changes where a page of it is converted or an entry of it may no longer be given out. Keys that gave
    nothing are entries too, with their status (S6): they have no lifetime, as the same content gives nothing again,
    and go only when their key changes or the store is emptied. So pages behind them are not parsed again (J9).
    """
    number = current_version(spark, root)
    stored = read_version(spark, root, number)
    n = len(manifest(spark, root, number))
    known = kept_entries(stored, invalidating, cfg, as_of)
    todo = missing_pages(pages, known, cfg, site)
    gone = stored.select("cache_key").join(known.select("cache_key"), "cache_key", "left_anti")
    key = page_columns(cfg, site)["cache_key"]
    sizes = todo.groupBy(bucket_of(key, n).alias("b")).agg(F.sum(F.octet_length("html")).alias("n")).collect()  # a row a bucket
    touched = {r.b for r in sizes} | buckets_of(gone, n)
    here = kept_entries(read_version(spark, root, number, touched), invalidating, cfg, as_of)
    made = build_corpus(todo, cfg, as_of, site, descriptions, partitions=tasks_for(spark, sum(r.n or 0 for r in sizes)))
    return replace_buckets(spark, root, here.select(*CORPUS_COLUMNS).unionByName(made.select(*CORPUS_COLUMNS)), touched)


def upsert_store(spark: SparkSession, root: str, new: DataFrame) -> int:
    """The newest entry of each key over the store and `new` (C2), as the store's next version; buckets without a key of
    `new` are neither read nor written."""
    touched = buckets_of(new, len(manifest(spark, root)))
    old = read_version(spark, root, only=touched)
    return replace_buckets(spark, root, upsert_entries(old.select(*CORPUS_COLUMNS), new.select(*CORPUS_COLUMNS)), touched)


def representation(decided: DataFrame, cfg: Settings) -> DataFrame:
    """Adds plan: stored_markdown, fresh_markdown, html_with_link or html (R17). Needs has_entry, true
    where the request's post has a live entry: now (facts_with_entries) or when it came (entries_at_request_time)."""
    markdown = F.lit(cfg.enabled) & F.col("md_method").isNotNull() & F.col("eligible")
    stored = F.lit(cfg.caching_enabled) & F.coalesce("has_entry", F.lit(False))
    return decided.withColumn(
        "plan",
        F.when(markdown & stored, "stored_markdown")
        .when(markdown, "fresh_markdown")
        .when(F.col("eligible_link"), "html_with_link")
        .otherwise("html"),
    )


def facts_with_entries(facts: DataFrame, keyed: DataFrame, live: DataFrame) -> DataFrame:
    """Post facts plus has_entry: a live entry exists under the post's current key. Done per post, so
    that requests join once."""
    stored = keyed.join(live.select("cache_key"), "cache_key", "left_semi").select(
        F.col("page_id").alias("post_id"), F.lit(True).alias("has_entry")
    )
    return facts.join(stored, "post_id", "left")


def spans_of_posts(entries: DataFrame, keyed: DataFrame, invalidating: DataFrame) -> DataFrame:
    """post_id, since, until of every entry under a post's current key, from all entries ever stored."""
    own = keyed.select("cache_key", F.col("page_id").alias("post_id")).distinct()
    spans = valid_spans(entries, invalidating).select("cache_key", F.col("stored_at").alias("since"), F.col("valid_until").alias("until"))
    return spans.join(own, "cache_key").select("post_id", "since", "until")


def entries_at_request_time(requests: DataFrame, spans: DataFrame, seconds: int = DAY_SECONDS) -> DataFrame:
    """`requests` (post_id, ts and any other columns) with has_entry: whether the entry last stored for the post before or
    at the time of the request was valid then. Of entries stored at one time the one that lasts longest counts.

    An as-of join: requests and entries of a post stand in one order, with a running "valid until". The order is cut into
    stretches of time, each begun by what the stretches before it left, so the requests of a hot post are spread over
    as many tasks as it has stretches. A request without post or time has no entry.
    """
    columns = requests.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns))
    whole = F.col("post_id").isNotNull() & F.col("ts").isNotNull()
    asked = requests.where(whole).select("post_id", F.col("ts").alias("at"), row.alias("request")).withColumn("stretch", span_of(F.col("at"), seconds))
    known = spans.where("post_id is not null and since is not null").withColumn("stretch", span_of(F.col("since"), seconds))

    left = known.groupBy("post_id", "stretch").agg(F.max_by("until", F.struct("since", "until")).alias("until"))
    needed = asked.select("post_id", "stretch").distinct().withColumn("until", F.lit(None).cast("timestamp"))
    stretches = left.unionByName(needed).groupBy("post_id", "stretch").agg(F.max("until").alias("until"))
    before = Window.partitionBy("post_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = stretches.select("post_id", "stretch", F.last("until", ignorenulls=True).over(before).alias("until")).where("until is not null")

    none = F.lit(None).cast(asked.schema["request"].dataType)
    start, no_time = F.lit(0), F.lit(None).cast("timestamp")
    events = (
        asked.select("post_id", "stretch", "at", F.lit(2).alias("kind"), no_time.alias("until"), "request")
        .unionByName(known.select("post_id", "stretch", F.col("since").alias("at"), F.lit(1).alias("kind"), "until", none.alias("request")))
        .unionByName(carried.select("post_id", "stretch", no_time.alias("at"), start.alias("kind"), "until", none.alias("request")))
    )
    order = Window.partitionBy("post_id", "stretch").orderBy(F.asc_nulls_first("at"), "kind", "until").rowsBetween(Window.unboundedPreceding, 0)
    seen = events.withColumn("valid_until", F.last("until", ignorenulls=True).over(order)).where("kind = 2")
    has_entry = F.coalesce(F.col("valid_until") > F.col("at"), F.lit(False))
    return seen.select("request.*", has_entry.alias("has_entry")).unionByName(requests.where(~whole).withColumn("has_entry", F.lit(False)))


def decide_requests(requests: DataFrame, facts: DataFrame, cfg: Settings, salt: int = 1, site: Site = Site()) -> DataFrame:
    """Classification, post facts, decision: the whole request job up to R16."""
    return decide(with_post_facts(classify_requests(requests, cfg, site), facts, salt), cfg)
