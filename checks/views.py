"""Inputs derived from the given tables: posts, metadata, requests, changes, store, dressed pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import Settings, Site
from pagemill.functions.urls import url_host
from pagemill.plans.corpus import page_columns

SITE = Site(home="https://example.com", page_on_front=7)
SITE_BY_COLUMN = Site(home="https://example.com", page_on_front=7, language_column="spoken")


def as_of() -> Column:
    return F.lit("2024-01-20 00:00:00").cast("timestamp")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def rpath(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def posts(spark: SparkSession, d: str) -> DataFrame:
    page_id = F.col("page_id")
    return pages(spark, d).select(
        page_id.alias("post_id"),
        url_host(F.col("url")).alias("host"),
        rpath(F.col("url")).alias("url_path"),
        F.when(page_id % 5 == 2, "case_study").when((page_id % 5).isin(1, 4), "post").otherwise("page").alias("post_type"),
        F.when(page_id % 11 == 7, "draft").when(page_id % 11 == 8, "private").when(page_id % 11 == 9, "future")
        .when(page_id % 11 == 10, "pending").otherwise("publish").alias("post_status"),
        F.concat(F.lit("post-"), page_id.cast("string")).alias("post_name"),
        F.when(page_id % 4 == 0, F.concat(F.lit(" <b>About</b> "), page_id.cast("string"), F.lit(" "))).alias("excerpt"),
        F.col("html").alias("post_content"),
        F.col("url").alias("permalink"),
    )


def post_meta(spark: SparkSession, d: str) -> DataFrame:
    base = pages(spark, d).select("page_id")
    noindex = base.select(
        F.col("page_id").alias("post_id"), F.lit("robots_noindex").alias("meta_key"),
        F.when(F.col("page_id") % 10 == 3, "1").otherwise("0").alias("meta_value"),
    )
    about = base.where("page_id % 3 = 0").select(
        F.col("page_id").alias("post_id"), F.lit("meta_description").alias("meta_key"),
        F.concat(F.lit("About page "), F.col("page_id").cast("string")).alias("meta_value"),
    )
    return noindex.unionAll(about)


def post_types(spark: SparkSession, viewable_case: bool = False) -> DataFrame:
    rows = [("page", "Page", True, ""), ("post", "Post", True, ""), ("case_study", "case Study", viewable_case, "case_study")]
    return spark.createDataFrame(rows, "name string, label string, viewable boolean, query_var string")


def requests(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d).select("page_id", "url")
    n = pages(spark, d).agg(F.count("*")).scalar()
    ev = events(spark, d).withColumn("page_id", F.col("event_id") % n)
    return _request_columns(ev.join(p, "page_id"))


def stream_requests(stream: DataFrame, page_table: DataFrame, n: int) -> DataFrame:
    return _request_columns(stream.withColumn("page_id", F.col("event_id") % n).join(page_table.select("page_id", "url"), "page_id"))


def _request_columns(joined: DataFrame) -> DataFrame:
    e, path = F.col("event_id"), rpath(F.col("url"))
    k, v = e % 13, e % 17
    return joined.select(
        e.alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("page_id").alias("post_id"), url_host(F.col("url")).alias("host"),
        F.when(e % 6 == 0, "text/markdown").when(e % 6 == 1, "text/html, Text/Markdown;q=0").when(e % 6 == 2, "").otherwise("text/html").alias("accept"),
        F.when(k == 0, "/.md").when(k == 1, "/sitemap-1.xml").when(k == 2, "/robots.txt").when(k == 3, "/wp-login.php")
        .when(k == 4, F.concat(path, F.lit(".md"))).when(k == 5, F.concat(path, F.lit(".MD/")))
        .when(k == 6, F.concat(path, F.lit("?format=Markdown"))).when(k == 7, F.concat(path, F.lit("?a=1&output=markdown")))
        .otherwise(path).alias("uri"),
        F.when(v == 0, "404").when(v == 1, "search").when(v == 2, "archive").when(v == 3, "feed").when(v == 4, "preview")
        .when(v == 5, "admin").when(v == 6, "front_page").when(v == 7, "home").otherwise("singular").alias("view"),
        (F.col("user_id") % 7 == 0).alias("logged_in"), (F.col("user_id") % 14 == 0).alias("is_manager"),
        (e % 19 == 0).alias("password_required"),
    )


def changes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).where("event_type = 'error'").select(
        e.alias("change_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(e % 4 == 0, "settings").when(e % 4 == 1, "post_deleted").otherwise("post_saved").alias("kind"),
        (F.col("user_id") - 3).alias("post_id"),
    )


def store(spark: SparkSession, d: str, cfg: Settings = Settings()) -> DataFrame:
    """A store over three quarters of the pages, some with an outdated key, some empty."""
    page_id = F.col("page_id")
    known = page_columns(cfg, SITE)
    return pages(spark, d).where("page_id % 4 <> 3").select(
        F.when(page_id % 6 == 5, F.concat(F.lit("old_"), known["cache_key"])).otherwise(known["cache_key"]).alias("cache_key"),
        "page_id",
        known["language"].alias("language"),
        F.when(page_id % 13 == 0, "").otherwise(F.concat(F.lit("# Page "), page_id.cast("string"))).alias("markdown"),
        F.timestamp_add("DAY", (page_id % 29).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp")).alias("stored_at"),
        (86400 * (1 + page_id % 5)).cast("int").alias("ttl_s"),
        F.lit("ok").alias("status"),
    )


def store_history(spark: SparkSession, d: str) -> DataFrame:
    """All entries ever stored: those of the store, and half of them again five days and six hours later for half a day,
    some of these empty."""
    old, page_id = store(spark, d), F.col("page_id")
    again = old.where("page_id % 2 = 0").withColumns({
        "stored_at": F.timestamp_add("HOUR", F.lit(126), F.col("stored_at")), "ttl_s": F.lit(43200),
        "markdown": F.when(page_id % 10 == 4, "").otherwise("again"),
    })
    return old.unionByName(again)


def sunday_changes(spark: SparkSession, d: str) -> DataFrame:
    """What changed in the maintenance hour, on Sundays from two to three; at any time changes follow each other so
    closely that the store would hardly ever hold anything."""
    return changes(spark, d).where((F.dayofweek("ts") == 1) & (F.hour("ts") == 2))


def newer_entries(spark: SparkSession, d: str) -> DataFrame:
    """A third of the store's entries made anew, half of them later and half earlier than what is stored."""
    page_id = F.col("page_id")
    return store(spark, d).where("page_id % 3 = 0").withColumns({
        "markdown": F.concat(F.lit("new "), page_id.cast("string")),
        "stored_at": F.when(page_id % 2 == 0, as_of()).otherwise(F.lit("2023-12-01").cast("timestamp")),
    })


def low_key() -> Column:
    """Whether the hash in a key is in the first half of all."""
    return F.substring(F.regexp_replace("cache_key", "^(old_)?md_", ""), 1, 1).isin(*"01234567")


def dressed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with what the given ones lack: hidden parts, handlers, script links, images, empties, lists."""
    even = F.col("page_id") % 2 == 0
    html = F.replace(
        F.col("html"), F.lit('<div class="ad">'),
        F.when(even, '<div class="ad" style="color:red;DISPLAY:none">').otherwise('<div style="display:  none" Data-X="1" onclick="f()" onload="g()">'),
    )
    html = F.replace(
        html, F.lit("<article>"),
        F.when(even, '<article><style-guide>Kept</style-guide><script>if (a < b) "</p>"</script x><img src="/i.png?a=1&amp;b=2" alt=" A "><img alt="none" src=" "><p><img src="/lost.png"></p><ol><li>One<li>Two <i>x </i><ul><li>In</ul></ol>')
        .otherwise('<article class=" post  entry-content "><p style="display: none">Hidden</p><div><span> </span></div><a href=" JavaScript:x()">S</a><p><a href="/k"></a></p>'
                   '<blockquote><p>Quoted &lt;b&gt;</p></blockquote><pre>a <b>c </b> <a href="/q">l</a><i> d</i>\n  b</pre><hr><p aria-hidden="true">Off</p>'),
    )
    return pages(spark, d).withColumn("html", html)


def titled_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages with other titles in a comment, a script and a graphic before their own."""
    decoys = "<!-- <title>Old</title> --><script>'<title>Js</title>'</script><svg><title>Icon</title></svg>"
    return pages(spark, d).withColumn("html", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(decoys), F.col("html"))).otherwise(F.col("html")))


def short_pages(spark: SparkSession, d: str) -> DataFrame:
    """All pages and, beside every seventh of them, one with too little text."""
    p = pages(spark, d)
    short = F.lit("<html lang=\"en\"><body><main>Short</main></body></html>")
    more = p.where("page_id % 7 = 0").select((-1 - F.col("page_id")).alias("page_id"), F.concat("url", F.lit("?short")).alias("url"), short.alias("html"))
    return p.select("page_id", "url", "html").unionAll(more)


def loose_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages of which every second has no html tag, every third holds custom elements and an end tag with an
    attribute, and every fourth ends inside a tag or a comment."""
    page_id = F.col("page_id")
    html = F.when(page_id % 2 == 0, F.replace("html", F.lit("<html"), F.lit("<section"))).otherwise(F.col("html"))
    odd = '<article><style-guide>Kept</style-guide><noscript-box a="1"/><script>if (a < b) "</p>"</SCRIPT\n x><iframe src="i"></iframe ><scripts>Kept</scripts>'
    html = F.when(page_id % 3 == 0, F.replace(html, F.lit("<article>"), F.lit(odd))).otherwise(html)
    tail = F.when(page_id % 8 == 1, "Tail <a href=\"x\" <b id=1 ").when(page_id % 8 == 5, "Tail <! a <!doc").otherwise("")
    return pages(spark, d).withColumn("html", F.concat(html, tail))


def captures(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    k = F.col("k")
    html = (
        F.when(k == 0, F.col("html"))
        .when(k == 1, F.when(F.col("page_id") % 3 == 0, " \n\t ").otherwise(F.concat(F.col("html"), F.lit("<!-- later -->"))))
        .otherwise(F.when(F.col("page_id") % 2 == 0, "").otherwise("\r\n"))
    )
    return p.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(
        "url", (F.col("page_id") * 3 + k).alias("capture_no"), html.alias("html")
    )


def page_tree_rows(spark: SparkSession, d: str) -> DataFrame:
    """Posts as (post_id, parent_id, slug): trees of up to ten levels, as a post's parent has about half its number, some
    whose parent is missing, and circles of two below which others hang."""
    page_id = F.col("page_id")
    circle = page_id > 1
    parent = F.when(circle & (page_id % 41 == 0), page_id + 1).when(circle & (page_id % 41 == 1), page_id - 1).when(page_id % 17 == 0, -page_id).otherwise(F.floor(page_id / 2))
    return pages(spark, d).select(page_id.alias("post_id"), parent.cast("bigint").alias("parent_id"), F.concat(F.lit("p"), page_id.cast("string")).alias("slug"))


def rough_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Texts with every flaw the clean-up repairs."""
    flaws = "\n[  a b ](  /x )\n![](u)\n![pic]( )\n![ ](u)\n!  \n##  \n[ ](y)\n   ## H\n\t[q](r)  [s](t)  \nTwice\n Twice \n# Top\n\n\n# Next\r\nEnd\rof &amp;lt; it "
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", F.concat(F.lit("# "), F.col("text"), F.lit(flaws), F.col("text")).alias("md"))


#: The batches of arrivals: which part of the pages by page_id % 4 (4: all), the day, and the hours at which each is captured.
ARRIVALS = ((2, "2024-01-10", (0, 0, 12, 30)), (3, "2024-01-20", (0,)), (1, "2024-01-21", (0, 24, 47, 48)), (0, "2024-01-11", (5, 5)), (4, "2024-01-21", (6, 40)))


def arrivals(spark: SparkSession, d: str) -> list[DataFrame]:
    """One frame for each batch; an hour given twice is a copy."""
    out = []
    for part, day, hours in ARRIVALS:
        rows = pages(spark, d).where((F.col("page_id") % 4 == part) | F.lit(part == 4))
        at = F.explode(F.array(*(F.timestamp_add("HOUR", F.lit(h), F.lit(day).cast("timestamp")) for h in hours)))
        out.append(rows.select("page_id", "url", "html", at.alias("captured_at")))
    return out
