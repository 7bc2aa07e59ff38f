"""Which content a '.md' address stands for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Site
from .posts import lookup_join


def route_index(posts: DataFrame, post_types: DataFrame) -> DataFrame:
    """One row per (host, path): the page with that path, and the content of any type with that URL.

    Paths repeat, so the smallest id is taken per key, before the join, which cannot fan out then.
    """
    variables = post_types.select(F.col("name").alias("post_type"), "query_var")
    path = F.btrim(F.col("url_path"), F.lit("/"))
    keyed = posts.join(variables, "post_type", "left").withColumn("resolved", path)
    post = F.struct("post_id", "post_type", "post_name", F.coalesce("query_var", F.lit("")).alias("query_var"))
    return keyed.groupBy("host", "resolved").agg(
        F.min(F.when(F.col("post_type") == "page", F.col("post_id"))).alias("page_match"), F.min(post).alias("url_match")
    )


def resolve_route(routed: DataFrame, index: DataFrame, site: Site, salt: int = 1) -> DataFrame:
    """Requests with a md_path -> target columns. Front-page requests take no part in the join, so
    their one key cannot become a hot spot."""
    path = F.btrim(F.col("md_path"), F.lit("/"))
    wanted = routed.where(F.col("md_path").isNotNull()).withColumn("_path", path)
    front_id = site.page_on_front if site.show_on_front == "page" and site.page_on_front > 0 else None
    none = F.lit(None)

    front = wanted.where(F.col("_path") == "").select(
        "request_id", "host", F.lit("").alias("resolved"),
        F.lit("front_page").alias("target_kind"),
        F.lit(front_id).cast("bigint").alias("target_id"),
        none.cast("string").alias("target_type"), none.cast("string").alias("target_name"), none.cast("string").alias("target_var"),
    )

    # the last segment loses one '.md' more, in any case; an empty last segment disappears
    last = F.regexp_replace(F.substring_index("_path", "/", -1), r"(?i)\.md$", "")
    parent = F.regexp_extract("_path", r"^(.*)/[^/]*$", 1)
    resolved = F.when(last == "", parent).when(parent == "", last).otherwise(F.concat(parent, F.lit("/"), last))
    rest = lookup_join(
        wanted.where(F.col("_path") != "").select("request_id", "host", resolved.alias("resolved")), index, ["host", "resolved"], salt
    )
    by_page, by_url = F.col("page_match").isNotNull(), F.col("url_match").isNotNull()
    post_type = F.col("url_match.post_type")
    own_var = F.when(F.col("url_match.query_var") == "", post_type).otherwise(F.col("url_match.query_var"))
    base = F.substring_index(F.rtrim(F.col("resolved"), F.lit("/")), "/", -1)
    as_page = by_page | (by_url & (post_type == "page"))
    as_post = by_url & ~as_page
    return rest.select(
        "request_id", "host", "resolved",
        F.when(F.col("resolved") == "", "blank").when(as_page, "page").when(as_post, "post").otherwise("name").alias("target_kind"),
        F.coalesce("page_match", "url_match.post_id").alias("target_id"),
        F.when(as_page, "page").when(as_post, post_type).alias("target_type"),
        F.when(as_page, F.col("resolved")).when(as_post, F.col("url_match.post_name")).otherwise(base).alias("target_name"),
        F.when(as_post & (post_type != "post") & (own_var != "post_type"), own_var).alias("target_var"),
    ).unionByName(front)


def page_paths(pages: DataFrame, keep: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """post_id and path of each of `pages` (post_id, parent_id, slug): the slugs from its topmost parent down to itself,
    joined by '/'. A parent that is null, 0, or not in `pages` counts as none. Pages on a circle of parents, and those
    below one, have no path: null.

    Pointer jumping: each round a page takes over what its pointer knows, so the number of levels a path spans doubles
    and a tree of a thousand levels takes ten rounds. A round in which no path is finished leaves circles only. keep
    writes the rows of a round to a folder of their own and reads them again, so a plan never grows and a lost executor
    costs one round.
    """
    known = pages.groupBy("post_id").agg(F.min(F.struct("parent_id", "slug")).alias("p")).select("post_id", "p.parent_id", "p.slug")
    parents = known.select(F.col("post_id").alias("parent_id"), F.lit(True).alias("there"))
    rows = known.join(parents, "parent_id", "left").select(
        "post_id", F.when(F.col("there") & (F.col("parent_id") != 0), F.col("parent_id")).alias("up"), F.coalesce("slug", F.lit("")).alias("path")
    )
    number, rows = 0, keep(rows, 0)
    left = rows.where("up is not null").count()
    while left:
        number += 1
        above = rows.select(F.col("post_id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        open_ = rows.where("up is not null").join(above, "up").select(
            "post_id", F.col("next").alias("up"), F.concat("head", F.lit("/"), "path").alias("path")
        )
        rows = keep(rows.where("up is null").unionByName(open_), number)
        before, left = left, rows.where("up is not null").count()
        if left == before:
            break
    return rows.select("post_id", F.when(F.col("up").isNull(), F.col("path")).alias("path"))


def with_page_paths(posts: DataFrame, paths: DataFrame) -> DataFrame:
    """`posts` with the path of its parents as url_path where the post is a page that has one; for route_index()."""
    own = paths.where("path is not null").select("post_id", F.concat(F.lit("/"), "path", F.lit("/")).alias("_path"))
    joined = posts.join(own, "post_id", "left")
    path = F.when(F.col("post_type") == "page", F.coalesce("_path", "url_path")).otherwise(F.col("url_path"))
    return joined.withColumn("url_path", path).drop("_path")
