"""The keyed corpus: keys, lifetime, invalidation, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DAY_SECONDS, Settings

KEY_PREFIX = "md_"
_SEP = "\x01"
# What empties the store. Post events count only for real posts of viewable types.
POST_CHANGES = ("post_saved", "post_deleted")
SITE_CHANGES = ("theme", "settings", "permalinks", "field_values", "field_groups")


def cache_key(canonical: Column, post_id: Column, modified: Column, language: Column, cfg: Settings, version: str) -> Column:
    """Key over everything that shapes a page's Markdown (C1). The image position is part of it."""
    flags = (cfg.include_h1, cfg.include_canonical, cfg.include_excerpt, cfg.include_featured_image)
    fixed = [version, cfg.content_selectors, cfg.excluded_selectors, *(str(int(f)) for f in flags), cfg.featured_image_position]
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (canonical, post_id, modified, language)]
    return F.concat(F.lit(KEY_PREFIX), F.md5(F.concat_ws(_SEP, *parts, *[F.lit(v) for v in fixed])))


def expires_at() -> Column:
    return F.col("stored_at") + F.make_interval(secs=F.col("ttl_s"))


def due_times(arrivals: DataFrame, stored: DataFrame | None, ttl_s: int) -> DataFrame:
    """cache_key, due: of each key's arrivals (cache_key, captured_at) the times at which it is to be converted.

    That is the first one not before the expiry of what is stored, and then, each time, the first one a lifetime or more
    after the last. Arrivals within a lifetime, or earlier than what is stored, need nothing: a key stands for its
    content. An arrival without a time counts where its key has no other and nothing stored. What is gathered for a key
    are the distinct times of its arrivals, made distinct within tasks first; a stream bounds them by its trigger.
    """
    times = arrivals.select("cache_key", "captured_at").distinct().groupBy("cache_key").agg(
        F.sort_array(F.collect_list("captured_at")).alias("times")
    )
    until = F.lit(None).cast("timestamp")
    if stored is not None:
        times = times.join(stored.groupBy("cache_key").agg(F.max(expires_at()).alias("until")), "cache_key", "left")
        until = F.col("until")
    state = "struct<until:timestamp,due:array<timestamp>>"
    begin = F.struct(until.alias("until"), F.array().alias("due")).cast(state)

    def step(s: Column, t: Column) -> Column:
        taken = F.struct((t + F.make_interval(secs=F.lit(ttl_s))).alias("until"), F.concat(s["due"], F.array(t)).alias("due")).cast(state)
        return F.when(s["until"].isNull() | (t >= s["until"]), taken).otherwise(s)

    due = F.aggregate("times", begin, step)["due"]
    untimed = F.array(F.lit(None).cast("timestamp"))
    due = F.when((F.size("times") == 0) & until.isNull(), untimed).otherwise(due)
    return times.select("cache_key", due.alias("due")).where(F.size("due") > 0)


def live_entries(corpus: DataFrame, cfg: Settings, as_of: Column) -> DataFrame:
    """Entries that may be served at as_of: not empty, not expired, caching on."""
    return corpus.where(F.lit(cfg.caching_enabled) & (F.coalesce("markdown", F.lit("")) != "") & (expires_at() > as_of))


def clear_all(corpus: DataFrame) -> DataFrame:
    """The empty store of the same shape (C4)."""
    return corpus.where(F.lit(False))


def invalidating_changes(changes: DataFrame, posts: DataFrame, post_types: DataFrame) -> DataFrame:
    """Changes that empty the store: site changes, and changes of posts of viewable types."""
    is_post = F.col("kind").isin(*POST_CHANGES)
    viewable = posts.join(
        post_types.where(F.col("viewable")).select(F.col("name").alias("post_type")), "post_type", "left_semi"
    ).select("post_id")
    by_post = changes.where(is_post & (F.col("post_id") > 0)).join(viewable, "post_id", "left_semi")
    return by_post.unionByName(changes.where(F.col("kind").isin(*SITE_CHANGES)))


def mark_stale(corpus: DataFrame, invalidating: DataFrame, as_of: Column) -> DataFrame:
    """Adds stale: the store was emptied at or after the entry was stored.

    All entries fall at once, so one timestamp decides; it is a scalar subquery, not a join.
    """
    emptied = invalidating.where(F.col("ts") <= as_of).agg(F.max("ts").alias("ts")).scalar()
    return corpus.withColumn("stale", F.coalesce(F.col("stored_at") <= emptied, F.lit(False)))


def stale_entries(corpus: DataFrame, invalidating: DataFrame, as_of: Column) -> DataFrame:
    return mark_stale(corpus, invalidating, as_of).where(F.col("stale")).drop("stale")


def serveable(corpus: DataFrame, invalidating: DataFrame, cfg: Settings, as_of: Column) -> DataFrame:
    """Live and not stale."""
    return mark_stale(live_entries(corpus, cfg, as_of), invalidating, as_of).where(~F.col("stale")).drop("stale")


def kept_entries(corpus: DataFrame, invalidating: DataFrame, cfg: Settings, as_of: Column) -> DataFrame:
    """What a refresh need not make again: serveable entries, and those that say that their key gave nothing (any status
    but ok). These have no lifetime, but fall with all others when the store is emptied (S6)."""
    nothing = F.col("status") != "ok"
    live = F.lit(cfg.caching_enabled) & (nothing | ((F.coalesce("markdown", F.lit("")) != "") & (expires_at() > as_of)))
    return mark_stale(corpus.where(live), invalidating, as_of).where(~F.col("stale")).drop("stale")


def pages_to_refresh(keyed: DataFrame, live: DataFrame) -> DataFrame:
    """Pages whose current key has no live entry (J9). Both sides are narrow: no page text moves."""
    return keyed.join(live.select("cache_key"), "cache_key", "left_anti")


def upsert_entries(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest entry per key over both tables (C2); at equal times the new table wins, then the higher
    page_id. Keys of old are unique.

    One full outer join on the key; each side is evaluated once, and old rows are not regrouped.
    """
    rank = F.struct("stored_at", "page_id")
    columns = [c for c in old.columns if c != "cache_key"]
    entry = F.struct(*columns)
    newest = new.groupBy("cache_key").agg(F.max_by(entry, rank).alias("added"))
    joined = old.select("cache_key", entry.alias("stored")).join(newest, "cache_key", "full_outer")
    stays = F.col("added").isNull() | (F.col("stored.stored_at") > F.col("added.stored_at"))
    row = F.when(F.col("stored").isNotNull() & stays, F.col("stored")).otherwise(F.col("added"))
    return joined.select("cache_key", row.alias("row")).select("cache_key", "row.*").select(*old.columns)


def span_of(ts: Column, seconds: int) -> Column:
    """Number of the stretch of `seconds` that a time falls into."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def next_changes(times: DataFrame, changes: DataFrame, seconds: int = DAY_SECONDS) -> DataFrame:
    """at, next: for each time in `times` (at) the first change (ts) at or after it, null without one.

    An as-of join in stretches of time, so that no task sees the whole history: times and changes of a stretch stand in
    one order, and what a stretch does not hold comes from the first change of a later one. Times are made distinct
    first, as a job stores all its entries at one time. The one global order is over stretches, a row each.
    """
    asked = times.select("at").where("at is not null").distinct().select("at", F.lit(None).cast("timestamp").alias("change"))
    rows = asked.unionByName(changes.where("ts is not null").select(F.col("ts").alias("at"), F.col("ts").alias("change")).distinct())
    rows = rows.withColumn("stretch", span_of(F.col("at"), seconds))
    # from the last to the first; at one time the change comes before those who ask
    back = Window.partitionBy("stretch").orderBy(F.desc("at"), F.desc_nulls_last("change")).rowsBetween(Window.unboundedPreceding, 0)
    within = rows.withColumn("own", F.min("change").over(back)).where("change is null").select("at", "stretch", "own")
    firsts = rows.groupBy("stretch").agg(F.min("change").alias("first"))
    beyond = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = firsts.select("stretch", F.min("first").over(beyond).alias("later"))
    return within.join(later, "stretch").select("at", F.coalesce("own", "later").alias("next"))


def valid_spans(entries: DataFrame, invalidating: DataFrame, seconds: int = DAY_SECONDS) -> DataFrame:
    """`entries` with valid_until, the time from which each may no longer be given out: its expiry or the change that
    empties the store, whichever comes first, and its own time where it holds nothing (J8 over all times)."""
    changes = next_changes(entries.select(F.col("stored_at").alias("at")), invalidating, seconds)
    joined = entries.join(changes.withColumnRenamed("at", "stored_at"), "stored_at", "left")
    ends = F.least(expires_at(), F.col("next"))  # least() passes over nulls
    empty = F.coalesce("markdown", F.lit("")) == ""
    return joined.withColumn("valid_until", F.when(empty, F.col("stored_at")).otherwise(ends)).select(*entries.columns, "valid_until")
