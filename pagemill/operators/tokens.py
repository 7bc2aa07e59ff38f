"""Pages -> segments: one row per piece of markup with the text that follows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions import text as T


#: Bytes of HTML that a task of the page job gets, about. They grow about tenfold in segments, and some twenty sorts of a
#: task hold the segments once each. Far less would not pay: a task also has seconds of its own, as its many generated
#: classes don't all fit in Spark's cache for them.
TASK_BYTES = 10 << 20


def tasks_for(spark: SparkSession, size: int) -> int:
    """Tasks for `size` bytes of HTML: each one's share stays the same however large the table is. Small tables get a task
    for each core, at most spark.sql.shuffle.partitions. Never just as many as these: Spark would drop an exchange like
    that of a join right before it as needless, and then put the join's partitions together by their shuffled bytes."""
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(usual, spark.sparkContext.defaultParallelism), -(-size // TASK_BYTES))
    return tasks + (tasks == usual)


def page_tasks(pages: DataFrame) -> int:
    """tasks_for() what html holds in all: one sum over that column, which runs at once."""
    return tasks_for(pages.sparkSession, pages.agg(F.sum(F.octet_length("html")).alias("n")).first().n or 0)


def by_page(pages: DataFrame, co_located: bool = False, partitions: int | None = None) -> DataFrame:
    """The one shuffle of the page job, done on whole page rows, before they multiply into segments.

    Everything later is partitioned by page_id and needs no exchange. Pass co_located=True when the
    input already arrives that way (a table bucketed by page_id). The number of partitions is given
    outright, by default as page_tasks(): a page grows about tenfold in segments, which sizing by
    shuffled bytes would not see. It is parallelism only; give it where pages are costly to compute.
    """
    if co_located:
        return pages
    return pages.repartition(partitions or page_tasks(pages), "page_id")


def html_tokens(
    pages: DataFrame, co_located: bool = False, page_info: Column | None = None, partitions: int | None = None
) -> DataFrame:
    """Forgiving HTML scan.

    Columns: page_id, pos, kind (open, close, void, raw, comment, text),
    name, tag (the markup as written), txt (text up to the next markup). With page_info, that
    column rides on the first segment of each page only.
    """
    html = M.whole_document(F.coalesce(F.col("html"), F.lit("")))
    info = F.lit(None).cast("string") if page_info is None else page_info
    exploded = (
        by_page(pages, co_located, partitions)
        .select("page_id", html.alias("doc"), info.alias("info"))
        .select(
            "page_id",
            "info",
            F.regexp_extract_all("doc", F.lit(M.SEGMENT_RE), F.lit(1)).alias("tags"),
            F.regexp_extract_all("doc", F.lit(M.SEGMENT_RE), F.lit(2)).alias("texts"),
        )
        .select("page_id", "info", F.posexplode(F.arrays_zip("tags", "texts")).alias("pos", "seg"))
    )
    tag, after = F.col("seg.tags"), F.col("seg.texts")
    name = M.tag_name(tag)
    stray = M.is_stray(tag, name)
    rows = exploded.select(
        "page_id",
        "pos",
        F.when(F.col("pos") == 0, F.col("info")).alias("info"),
        F.when(stray, "").otherwise(tag).alias("tag"),
        F.when(stray, F.concat(tag, after)).otherwise(after).alias("txt"),
        F.when(stray, "").otherwise(name).alias("name"),
    )
    out = rows.withColumn("kind", M.tag_kind(F.col("tag"), F.col("name")))
    return out if page_info is not None else out.drop("info")


def token_attrs(tokens: DataFrame) -> DataFrame:
    """Attribute map of every start tag."""
    is_start = F.col("kind").isin("open", "void", "raw")
    return tokens.withColumn("attrs", F.when(is_start, M.attributes(F.col("tag"))))


def text_features(tokens: DataFrame) -> DataFrame:
    """Per segment, what the length rule needs, so that no text is compared later.

    Text counts decoded, and the body of a raw element counts too. nb = bytes that are not blank,
    wc = words, opens/ends_word = whether the text touches its neighbours without a blank.
    """
    is_raw = F.col("kind") == "raw"
    after = T.one_blank(T.decode_entities(F.col("txt")))
    body = T.one_blank(M.raw_body(F.col("tag"), F.col("name")))
    full = F.col("_full")
    blanks = F.octet_length(full) - F.col("nb")
    edges = full.startswith(" ").cast("int") + full.endswith(" ").cast("int")
    filled = full != ""
    return (
        tokens.withColumn("_after", after)
        .withColumn(
            "_full", F.when(is_raw, T.one_blank(F.concat(body, F.col("_after")))).otherwise(F.col("_after"))
        )
        .withColumn("nb", F.octet_length(F.replace(full, F.lit(" "), F.lit(""))).cast("bigint"))
        .withColumns(
            {
                "wc": F.when(F.col("nb") > 0, blanks + 1 - edges).otherwise(0).cast("bigint"),
                "opens_word": F.when(filled, ~full.startswith(" ")),
                "ends_word": F.when(filled, ~full.endswith(" ")),
                "has_text": ~F.col("_after").isin("", " "),
            }
        )
        .drop("_full", "_after")
    )
