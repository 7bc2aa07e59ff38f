"""Streaming forms (T1-T3). Each runs the batch functions; only the windowed counts keep state, bounded by a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import Settings, Site
from ..operators.store import due_times
from ..operators.tokens import page_tasks
from ..plans.corpus import build_corpus, page_columns
from ..plans.refresh import decide_requests


def due_pages(pages: DataFrame, stored: DataFrame | None, cfg: Settings, site: Site = Site()) -> DataFrame:
    """One row for each key in `pages` that is due, with the times at which it is (see due_times). Keys and times alone
    decide; page texts are moved once, to where their key is. page_id is the key here, as one page may come with
    several contents; source_id is the page's own."""
    keyed = pages.withColumn("cache_key", page_columns(cfg, site)["cache_key"])
    due = due_times(keyed, stored, cfg.ttl_seconds)
    copies = keyed.join(due, "cache_key").repartition(page_tasks(pages), "cache_key")
    # rows of one key are equal in all that is converted
    columns = ["url", "html", *([site.language_column] if site.language_column else [])]
    one = copies.groupBy("cache_key").agg(F.first(F.struct("page_id", *columns)).alias("page"), F.first("due").alias("due"))
    return one.select(
        "cache_key", F.col("cache_key").alias("page_id"), F.col("page.page_id").alias("source_id"), *(f"page.{c}" for c in columns), "due"
    )


def convert_stream(
    pages: DataFrame,
    cfg: Settings,
    sink: Callable[[DataFrame, int], None],
    stored: Callable[[int], DataFrame | None],
    checkpoint: str,
    site: Site = Site(),
) -> DataStreamWriter:
    """Converts pages (page_id, url, html, captured_at) as they arrive, in whatever order.

    Windows over positions are batch-only, so the conversion runs in foreachBatch with the same
    function as the batch job. A key is converted once until its lifetime is over, and then again; captures
    of a batch that lie further apart than that each give an entry, from one conversion. Lifetimes are read from the
    stored entries (cache_key, stored_at, ttl_s), not from a watermark, so a backfill of old pages loses nothing and
    no state is kept. A replayed batch has the same number: the sink should use it to overwrite its own earlier
    attempt, and stored(number) must leave that out.
    """

    def convert(batch: DataFrame, number: int) -> None:
        due = due_pages(batch, stored(number), cfg, site)
        sink(build_corpus(due, cfg, F.explode("due"), site, co_located=True, carry=("due",), by_key=True), number)

    return (
        pages.writeStream.option("checkpointLocation", checkpoint)
        .outputMode("append")
        .foreachBatch(convert)
        .trigger(availableNow=True)
    )


def classify_stream(requests: DataFrame, facts: DataFrame, cfg: Settings, salt: int = 1) -> DataFrame:
    """Per-request decision; the post facts are a static side (T2), best read from a table that write_facts()
    made, as a plan over posts and metadata would run again in every batch. A stream is not re-planned at run time:
    where hot posts are known to need it, salt spreads them, at the cost of repeating the facts as often."""
    return decide_requests(requests, facts, cfg, salt)


def decide_batches(
    requests: DataFrame,
    facts: Callable[[], DataFrame],
    cfg: Settings,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    salt: int = 1,
    site: Site = Site(),
) -> DataStreamWriter:
    """Per-request decision by facts that change under a running stream (T2): each micro-batch asks facts() for the ones
    that are current at its start and keeps to them, for example the newest version of a folder that write_facts() fills
    (current_facts). A batch is planned when it runs, so Spark also sees its sizes and splits hot posts. A replayed
    batch has the same number; the sink should overwrite its earlier attempt."""

    def decide_batch(batch: DataFrame, number: int) -> None:
        sink(decide_requests(batch, facts(), cfg, salt, site), number)

    return requests.writeStream.option("checkpointLocation", checkpoint).foreachBatch(decide_batch).trigger(availableNow=True)


def eligibility_by_window(decided: DataFrame, delay: str = "10 minutes", length: str = "1 hour") -> DataFrame:
    """Reasons per hour (T3). State: one count per open window and reason."""
    reason = F.coalesce("reason", F.lit("eligible"))
    return (
        decided.withWatermark("ts", delay)
        .groupBy(F.window("ts", length).alias("w"), reason.alias("reason"))
        .agg(F.count("*").alias("requests"))
        .select(F.col("w.start").alias("window_start"), "reason", "requests")
    )


def latest_windows(batches: DataFrame) -> DataFrame:
    """Counts written in update mode, one folder a batch (`batch`): the last one of each window and reason."""
    last = F.max_by("requests", "batch").alias("requests")
    return batches.groupBy("window_start", "reason").agg(last)
