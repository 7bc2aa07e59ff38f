"""Facts about posts, put together once on the post side, so that requests join a single table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

NOINDEX_KEY = "robots_noindex"
DESCRIPTION_KEY = "meta_description"


def post_meta_wide(meta: DataFrame, noindex_key: str = NOINDEX_KEY, description_key: str = DESCRIPTION_KEY) -> DataFrame:
    """Key/value metadata -> one row per post with the two values in use."""
    key, value = F.col("meta_key"), F.col("meta_value")
    return (
        meta.where(key.isin(noindex_key, description_key))
        .groupBy("post_id")
        .agg(F.max(F.when(key == noindex_key, value)).alias("noindex_value"), F.max(F.when(key == description_key, value)).alias("description"))
    )


def is_noindex(meta_wide: DataFrame) -> DataFrame:
    """post_id, noindex (R11): what the SEO flag says where there is one (column seo_noindex, either way), else true
    where the metadata value is '1'."""
    value = F.coalesce(F.col("noindex_value") == "1", F.lit(False))
    seo = F.col("seo_noindex").cast("boolean") if "seo_noindex" in meta_wide.columns else F.lit(None).cast("boolean")
    return meta_wide.select("post_id", F.coalesce(seo, value).alias("noindex"))


def viewable_types(post_types: DataFrame) -> DataFrame:
    """Viewable types by label, upper and lower case alike (L1): name, label and place, from 1, in that order. A place
    outlives a join, which an order of rows does not. Types are few, a row for each kind of content."""
    order = Window.orderBy(F.lower("label"), "name")
    return post_types.where(F.col("viewable")).select("name", "label", F.row_number().over(order).alias("place")).orderBy("place")


def post_facts(posts: DataFrame, post_types: DataFrame, meta_wide: DataFrame) -> DataFrame:
    """post_id, post_type, post_status, viewable, noindex, permalink."""
    types = post_types.select(F.col("name").alias("post_type"), "viewable")
    return (
        posts.join(types, "post_type", "left")
        .join(is_noindex(meta_wide), "post_id", "left")
        .select(
            "post_id", "post_type", "post_status", "permalink",
            F.coalesce("viewable", F.lit(False)).alias("viewable"),
            F.coalesce("noindex", F.lit(False)).alias("noindex"),
        )
    )


def lookup_join(rows: DataFrame, facts: DataFrame, keys: list[str], salt: int = 1) -> DataFrame:
    """Left join of many rows to one fact row per key.

    No broadcast is forced: Spark broadcasts facts when their measured size is under its threshold,
    and splits skewed partitions of a sort-merge join at run time. For keys known to be very hot, and
    for streams, where there is no run-time re-planning, salt > 1 spreads each key over that many
    tasks and repeats the (narrow) fact rows as often.
    """
    if salt <= 1:
        return rows.join(facts, keys, "left")
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(salt)).cast("int"))
    repeated = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return spread.join(repeated, [*keys, "_salt"], "left").drop("_salt")


def with_post_facts(requests: DataFrame, facts: DataFrame, salt: int = 1) -> DataFrame:
    return lookup_join(requests, facts, ["post_id"], salt)
