"""Pages -> Markdown corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings, Site
from ..operators.cleanup import clean_markdown
from ..operators.content import content_events, content_rows, fragment_rows
from ..operators.frontmatter import front_matter, lead_image, page_language, page_title
from ..operators.render import render_events
from ..operators.store import cache_key

CORPUS_COLUMNS = ("cache_key", "page_id", "language", "markdown", "stored_at", "ttl_s", "status")


def page_columns(cfg: Settings, site: Site) -> dict[str, Column]:
    """What is known of a page before it is parsed. The content's md5 stands in for a modified time. The language is the
    caller's where the site names a column for it, '' where that is null."""
    html = F.coalesce(F.col("html"), F.lit(""))
    language = F.coalesce(F.col(site.language_column), F.lit("")) if site.language_column else page_language(html)
    return {
        "url": F.coalesce(F.col("url"), F.lit("")),
        "title": page_title(html),
        "language": language,
        "cache_key": cache_key(F.col("url"), F.col("page_id"), F.md5(html), language, cfg, site.version),
    }


def keyed_pages(pages: DataFrame, cfg: Settings, site: Site) -> DataFrame:
    """page_id and current cache_key of every page."""
    return pages.select("page_id", page_columns(cfg, site)["cache_key"].alias("cache_key"))


def outcome(has_content: Column, markdown: Column) -> Column:
    """ok, no_content or empty_markdown."""
    blank = F.btrim(F.coalesce(markdown, F.lit("")), F.lit(" \t\n\r\0\x0b")) == ""
    return F.when(~has_content, "no_content").when(blank, "empty_markdown").otherwise("ok")


def convert_content(contents: DataFrame, cfg: Settings, partitions: int | None = None) -> DataFrame:
    """page_id, html (extracted content), title, canonical_url, description -> page_id, markdown (M18). partitions: as
    in build_corpus; with those that extract_content was given, contents are not moved again."""
    info = F.struct("title", "canonical_url", "description")
    made = render_events(content_events(fragment_rows(contents, info, with_tags=True, partitions=partitions)), info=True)
    made = clean_markdown(made, F.lit(cfg.include_h1) & (F.col("info.title") != ""))
    page = front_matter(F.col("markdown"), F.col("info.title"), F.col("info.canonical_url"), F.col("info.description"), lead_image(F.col("content")), cfg)
    return made.select("page_id", page.alias("markdown"))


def build_corpus(
    pages: DataFrame,
    cfg: Settings,
    stored_at: Column,
    site: Site = Site(),
    descriptions: DataFrame | None = None,
    co_located: bool = False,
    carry: tuple[str, ...] = (),
    partitions: int | None = None,
    by_key: bool = False,
) -> DataFrame:
    """The whole page path: one scan, one shuffle by page_id, no join but the one for descriptions.

    stored_at may use page columns named in carry, also to give several rows for a page. partitions: tasks that pages
    are dealt to; it changes no result. by_key: pages bring cache_key and source_id; page_id, of any type, only tells
    rows apart, and source_id is the id that goes into keys and results. So several contents of one page fit in a job.

    What is known of a page rides along on its first segment, so nothing is joined back, and a page
    without content still gives a row, with its status. Columns: those of the corpus plus url, title.
    """
    known = page_columns(cfg, site)
    if by_key:
        known["cache_key"] = F.col("cache_key")
        carry = (*carry, "source_id")
    own_id = "source_id" if by_key else "page_id"
    info = F.struct(*[c.alias(n) for n, c in known.items()], *carry)
    rows = content_rows(pages, cfg, info, with_tags=cfg.include_featured_image, co_located=co_located, partitions=partitions)
    made = render_events(content_events(rows), info=True).select(
        "page_id", "info.*", "markdown", "has_content", *(["content"] if cfg.include_featured_image else [])
    )
    if descriptions is not None and cfg.include_excerpt:
        made = made.join(descriptions.select(F.col("page_id").alias(own_id), "description"), own_id, "left")
    else:
        made = made.withColumn("description", F.lit(""))
    made = clean_markdown(made, F.lit(cfg.include_h1) & (F.col("title") != ""))
    image = lead_image(F.col("content")) if cfg.include_featured_image else F.lit("")
    page = front_matter(F.col("markdown"), F.col("title"), F.col("url"), F.col("description"), image, cfg)
    done = made.withColumn("markdown", page).withColumn("status", outcome(F.col("has_content"), F.col("markdown")))
    return done.select(
        "cache_key",
        F.col(own_id).alias("page_id"),
        "language",
        F.when(F.col("status") == "ok", F.col("markdown")).alias("markdown"),
        stored_at.alias("stored_at"),
        F.lit(cfg.ttl_seconds).alias("ttl_s"),
        "status",
        "url",
        "title",
    )
