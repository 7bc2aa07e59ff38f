"""Canonical and alternate addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Site
from ..functions.urls import markdown_url
from .requests import flag


def canonical_url(site: Site) -> Column:
    """Permalink of a single page, home for the front page, the posts page, else the request path
    under home, '' when there is none (J4)."""
    home = site.home.rstrip("/")
    path = F.btrim(F.col("path"), F.lit("/"))
    return (
        F.when(flag("singular"), F.coalesce("permalink", F.lit("")))
        .when(flag("front_page"), f"{home}/")
        .when(flag("home"), site.posts_page_url or f"{home}/")
        .when(path != "", F.concat(F.lit(f"{home}/"), path, F.lit("/")))
        .otherwise("")
    )


def link_header(url: Column) -> Column:
    return F.when(url != "", F.concat(F.lit("Link: <"), url, F.lit('>; rel="alternate"; type="text/markdown"'))).otherwise("")


def link_tag(url: Column) -> Column:
    safe = F.replace(F.replace(url, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
    return F.when(url != "", F.concat(F.lit('<link rel="alternate" type="text/markdown" href="'), safe, F.lit('" />'))).otherwise("")


def alternate_index(pages: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """page_id, markdown_url, link_header, link_tag; an override may replace the address."""
    urls = pages.select("page_id", markdown_url(F.col("url")).alias("_url"))
    if overrides is None:
        out = urls.withColumnRenamed("_url", "markdown_url")
    else:
        given = overrides.groupBy("page_id").agg(F.max("url").alias("_given"))
        # an override replaces an address, it does not make one where the page has none
        out = urls.join(given, "page_id", "left").select(
            "page_id", F.when(F.col("_url") == "", "").otherwise(F.coalesce("_given", "_url")).alias("markdown_url")
        )
    url = F.col("markdown_url")
    return out.withColumns({"link_header": link_header(url), "link_tag": link_tag(url)})
