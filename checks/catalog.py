"""Every registered query: one per operator of the inventory, over the whole given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.functions import markup as M
from pagemill.functions import text as T
from pagemill.functions.urls import markdown_url
from pagemill.operators import cleanup as C
from pagemill.operators import content as E
from pagemill.operators import frontmatter as FM
from pagemill.operators import links as L
from pagemill.operators import posts as P
from pagemill.operators import render as R
from pagemill.operators import requests as Q
from pagemill.operators import routes as J
from pagemill.operators import selectors as S
from pagemill.operators import store as K
from pagemill.operators.elements import html_elements
from pagemill.operators.tokens import html_tokens, page_tasks, token_attrs
from pagemill.plans import corpus as PC
from pagemill.plans import refresh as PR
from pagemill.sources import tables as IO
from pagemill.sources import versions as IV
from pagemill.streaming import jobs as ST

from . import views as V

CFG = Settings()
BODY = Settings(content_selectors="body", excluded_selectors=".ad, div.skip")
SELECTORS = 'article, .ad, .ad x, #top, [lang="en"], div.x, main p, [href="/The"], H1, h1, my-tag, li'
Query = Callable[[SparkSession, str], DataFrame]


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def md5(c: Column | str) -> Column:
    return F.md5(F.col(c) if isinstance(c, str) else c)


def scratch(spark: SparkSession) -> str:
    """A new folder in a place that driver and executors share: the one named in spark.checkpoint.dir, else the warehouse."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared}/scratch-{uuid.uuid4().hex}"


def facts(spark: SparkSession, d: str) -> DataFrame:
    return P.post_facts(V.posts(spark, d), V.post_types(spark), P.post_meta_wide(V.post_meta(spark, d)))


def decided(spark: SparkSession, d: str, cfg: Settings = CFG) -> DataFrame:
    return PR.decide_requests(IO.read_requests(V.requests(spark, d)), facts(spark, d), cfg)


def classified(spark: SparkSession, d: str) -> DataFrame:
    return Q.classify_requests(IO.read_requests(V.requests(spark, d)), CFG)


def invalidating(spark: SparkSession, d: str) -> DataFrame:
    return K.invalidating_changes(V.changes(spark, d), V.posts(spark, d), V.post_types(spark))


def descriptions(spark: SparkSession, d: str) -> DataFrame:
    return FM.descriptions(V.posts(spark, d), P.post_meta_wide(V.post_meta(spark, d)))


def corpus(spark: SparkSession, d: str, cfg: Settings = CFG) -> DataFrame:
    return PC.build_corpus(V.pages(spark, d), cfg, V.as_of(), V.SITE, descriptions(spark, d))


def corpus_digest(df: DataFrame) -> DataFrame:
    return df.select("page_id", "language", "status", md5("markdown").alias("markdown_md5"), F.octet_length("markdown").alias("bytes"))


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("kind").isin("open", "void")).select("page_id", "pos", "name")


def s5_write_corpus(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    IO.write_results(PC.build_corpus(V.short_pages(spark, d), CFG, V.as_of(), V.SITE), path, compact=True)
    return IO.read_corpus(spark, path).select("page_id", "language", md5("markdown").alias("markdown_md5"))


def s6_quarantine(spark: SparkSession, d: str) -> DataFrame:
    made = PC.build_corpus(V.short_pages(spark, d), CFG, V.as_of(), V.SITE)
    return IO.quarantine(made).select("page_id", "url", "status")


def e5_compile_selectors(spark: SparkSession, d: str) -> DataFrame:
    """What each selector text became, and how many elements of the pages answer to it."""
    texts = [x.strip() for x in SELECTORS.split(",")]
    hits = S.match_selectors(token_attrs(html_tokens(V.pages(spark, d))).where("attrs is not null"), texts).groupBy("rank").agg(F.count("*").alias("n"))
    return S.compiled_table(spark, texts).join(hits, "rank", "left").select(
        "rank", "selector", "kind", "key", "value", F.coalesce("n", F.lit(0)).alias("elements")
    )


def e9_drop_excluded(spark: SparkSession, d: str) -> DataFrame:
    tree = E.page_tree(V.dressed_pages(spark, d), BODY)
    return kept(E.drop_subtrees(E.within_content(tree), F.col("excluded")))


def e10_drop_hidden(spark: SparkSession, d: str) -> DataFrame:
    tree = E.page_tree(V.dressed_pages(spark, d), BODY)
    return kept(E.drop_subtrees(E.within_content(tree), F.col("hidden") & F.col("clean")))


def e11_sanitize_attrs(spark: SparkSession, d: str) -> DataFrame:
    starts = token_attrs(html_tokens(V.dressed_pages(spark, d))).where(F.col("attrs").isNotNull() & (F.size("attrs") > 0))
    return starts.select("page_id", "pos", M.start_tag(F.col("name"), M.sanitize_attrs(F.col("attrs"))).alias("start_tag"))


def e12_drop_empty(spark: SparkSession, d: str) -> DataFrame:
    tree = E.page_tree(V.dressed_pages(spark, d), CFG)
    rows = E.mark_blank(E.clean_targets(E.drop_excluded_and_hidden(E.within_content(tree))))
    return kept(E.drop_subtrees(rows, E.is_empty()))


def content_of(df: DataFrame, cfg: Settings = CFG) -> DataFrame:
    return E.extract_content(df, cfg).select("page_id", md5("content").alias("content_md5"), F.octet_length("content").alias("bytes"))


def m1_render(spark: SparkSession, d: str) -> DataFrame:
    made = R.render_events(E.content_events(E.content_rows(V.dressed_pages(spark, d), CFG)))
    return made.select("page_id", md5(F.coalesce("markdown", F.lit(""))).alias("markdown_md5"))


def m16_lead_image(spark: SparkSession, d: str) -> DataFrame:
    content = E.extract_content(V.dressed_pages(spark, d), CFG)
    return content.select("page_id", FM.lead_image(F.col("content")).alias("image"))


def m17_front_matter(spark: SparkSession, d: str) -> DataFrame:
    about = V.pages(spark, d).join(descriptions(spark, d), "page_id", "left")
    cfg = CFG.with_(include_featured_image=True, featured_image_position="prepend")
    image = F.when(F.col("page_id") % 2 == 0, "![A](/i.png)").otherwise("")
    page = FM.front_matter(F.lit("Body"), FM.page_title(F.col("html")), F.col("url"), F.col("description"), image, cfg)
    return about.select("page_id", page.alias("markdown"))


def m18_convert(spark: SparkSession, d: str) -> DataFrame:
    dressed = V.dressed_pages(spark, d)
    tasks = page_tasks(dressed)
    content = E.extract_content(dressed, CFG, partitions=tasks).withColumnRenamed("content", "html")
    known = V.pages(spark, d).select("page_id", FM.page_title(F.col("html")).alias("title"), F.col("url").alias("canonical_url"), F.lit("").alias("description"))
    return PC.convert_content(content.join(known, "page_id"), CFG, tasks).select("page_id", md5("markdown").alias("markdown_md5"))


def cleanup_step(step: Callable[[Column], Column]) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return V.rough_markdown(spark, d).select("doc_id", md5(step(F.col("md"))).alias("md_md5"))

    return query


def m12_clean(spark: SparkSession, d: str) -> DataFrame:
    done = C.clean_markdown(V.rough_markdown(spark, d), F.col("doc_id") % 2 == 0, "md")
    return done.select("doc_id", md5("md").alias("md_md5"))


def r8_special_paths(spark: SparkSession, d: str) -> DataFrame:
    page_name = F.when(F.col("request_id") % 23 == 0, "wp-login.php")
    return classified(spark, d).select(
        "request_id", Q.is_sitemap().alias("is_sitemap"), Q.is_robots().alias("is_robots"), Q.is_auth(page_name).alias("is_auth")
    )


def r9_type_allowed(spark: SparkSession, d: str) -> DataFrame:
    cfg = CFG.with_(post_types=("page", "case_study"))
    return facts(spark, d).select("post_id", Q.type_allowed(cfg).alias("allowed"))


def r13_conditional(spark: SparkSession, d: str) -> DataFrame:
    return decided(spark, d).select("request_id", "cond_reason")


def representation(spark: SparkSession, d: str) -> DataFrame:
    live = K.live_entries(V.store(spark, d), CFG, V.as_of())
    known = PR.facts_with_entries(facts(spark, d), PC.keyed_pages(V.pages(spark, d), CFG, V.SITE), live)
    made = PR.representation(PR.decide_requests(IO.read_requests(V.requests(spark, d)), known, CFG), CFG)
    return made.groupBy("plan").agg(F.count("*").alias("requests"))


def representation_at(spark: SparkSession, d: str) -> DataFrame:
    """What each request was answered with, by the store as it was at its time."""
    emptying = K.invalidating_changes(V.sunday_changes(spark, d), V.posts(spark, d), V.post_types(spark))
    spans = PR.spans_of_posts(V.store_history(spark, d), PC.keyed_pages(V.pages(spark, d), CFG, V.SITE), emptying)
    made = PR.representation(PR.entries_at_request_time(decided(spark, d), spans), CFG)
    return made.select("request_id", "has_entry", "plan")


def valid_spans(spark: SparkSession, d: str) -> DataFrame:
    spans = K.valid_spans(V.store_history(spark, d), invalidating(spark, d))
    return spans.select("cache_key", "page_id", stamp("stored_at").alias("stored_at"), F.unix_micros("valid_until").alias("valid_until_us"))


def routes(spark: SparkSession, d: str) -> DataFrame:
    index = J.route_index(V.posts(spark, d), V.post_types(spark, viewable_case=True))
    return J.resolve_route(classified(spark, d), index, V.SITE, salt=4)


def page_paths(spark: SparkSession, d: str) -> DataFrame:
    """The path of every page by its parents."""
    root = scratch(spark)

    def keep(rows: DataFrame, number: int) -> DataFrame:
        rows.write.parquet(f"{root}/round={number}")
        return spark.read.schema(rows.schema).parquet(f"{root}/round={number}")

    return J.page_paths(V.page_tree_rows(spark, d), keep)


def e6_selector_index(spark: SparkSession, d: str) -> DataFrame:
    """Every link target of the pages as a selector, and how many elements answer to it."""
    starts = token_attrs(html_tokens(V.pages(spark, d))).where("attrs is not null")
    targets = starts.select(F.col("attrs")["href"].alias("value")).where("value is not null").distinct()
    table = targets.select(F.lit(0).alias("rank"), F.concat(F.lit('[href="'), "value", F.lit('"]')).alias("selector"), F.lit("attr").alias("kind"), F.lit("href").alias("key"), "value")
    return S.match_selector_table(starts, table).groupBy("selector", "name").agg(F.count("*").alias("elements"))


def j4_canonical(spark: SparkSession, d: str) -> DataFrame:
    known = P.with_post_facts(classified(spark, d), facts(spark, d))
    return known.select("request_id", L.canonical_url(V.SITE).alias("canonical_url"))


def j7_overrides(spark: SparkSession, d: str) -> DataFrame:
    given = V.pages(spark, d).where("page_id % 9 = 0").select("page_id", F.concat(F.lit("https://cdn.example.net/"), F.col("page_id").cast("string"), F.lit(".md")).alias("url"))
    return L.alternate_index(V.pages(spark, d), given).select("page_id", "markdown_url")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    done = K.upsert_entries(V.store(spark, d), V.newer_entries(spark, d))
    return done.select("cache_key", "page_id", "markdown", stamp("stored_at").alias("stored_at"))


def j8_stale(spark: SparkSession, d: str) -> DataFrame:
    return K.mark_stale(V.store(spark, d), invalidating(spark, d), V.as_of()).select("cache_key", "page_id", "stale")


def j9_refresh(spark: SparkSession, d: str) -> DataFrame:
    live = K.serveable(V.store(spark, d), invalidating(spark, d), CFG, V.as_of())
    return K.pages_to_refresh(PC.keyed_pages(V.pages(spark, d), CFG, V.SITE), live).select("page_id", "cache_key")


def c6_refresh(spark: SparkSession, d: str) -> DataFrame:
    root = scratch(spark)
    IV.write_version(spark, V.store(spark, d), root)
    PR.refresh_store(spark, root, V.pages(spark, d), invalidating(spark, d), CFG, V.as_of(), V.SITE)
    return IV.read_version(spark, root).select("cache_key", "page_id", "language", md5("markdown").alias("markdown_md5"), stamp("stored_at").alias("stored_at"))


def c2_upsert_store(spark: SparkSession, d: str) -> DataFrame:
    """Entries whose first half is upserted in a store of many buckets: what each bucket's folder is, beside its rows."""
    root = scratch(spark)
    IV.write_version(spark, V.store(spark, d), root, buckets=64)
    PR.upsert_store(spark, root, V.newer_entries(spark, d).where(V.low_key()))
    written = spark.createDataFrame(list(IV.manifest(spark, root).items()), "bucket int, written int")
    rows = IV.read_version(spark, root).select("cache_key", "page_id", "markdown", stamp("stored_at").alias("stored_at"), IV.bucket_of(F.col("cache_key"), 64).alias("bucket"))
    return rows.join(written, "bucket").select("cache_key", "page_id", "markdown", "stored_at")


def s6_refresh_twice(spark: SparkSession, d: str) -> DataFrame:
    """A store refreshed, refreshed again, and refreshed after some pages have changed: by refresh and status, the entries
    that were made by it."""
    root = scratch(spark)
    IV.write_version(spark, K.clear_all(V.store(spark, d)), root)
    before, out = V.short_pages(spark, d), None
    changed = before.withColumn("html", F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("<!-- new -->"))).otherwise(F.col("html")))
    none = V.changes(spark, d).where("false")
    for turn, pages in enumerate((before, before, changed), 1):
        at = F.timestamp_add("HOUR", F.lit(turn), V.as_of())
        number = PR.refresh_store(spark, root, pages, none, CFG, at, V.SITE)
        made = IV.read_version(spark, root, number).where(F.col("stored_at") == at).groupBy("status").agg(F.count("*").alias("made"))
        counted = made.select(F.lit(turn).alias("refresh"), "status", "made")
        out = counted if out is None else out.unionByName(counted)
    return out


def c4_clear_all(spark: SparkSession, d: str) -> DataFrame:
    """A store is written as a version and cleared by an empty one: the first stays, the current one is empty."""
    root = scratch(spark)
    IV.write_version(spark, V.store(spark, d), root)
    IV.write_version(spark, K.clear_all(IV.read_version(spark, root)), root)
    states = (("before", V.store(spark, d)), ("current", IV.read_version(spark, root)), ("first version", IV.read_version(spark, root, 1)))
    counts = [
        df.agg(F.count("*").alias("entries"), F.count_distinct("cache_key").alias("keys")).select(F.lit(name).alias("state"), "entries", "keys")
        for name, df in states
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def _drain(writer) -> None:
    query = writer.start()
    query.awaitTermination()


def t1_convert_stream(spark: SparkSession, d: str) -> DataFrame:
    """Arrivals in five appends, each drained as a batch: days that go up and far back, copies, captures within a lifetime
    and beyond it in one batch and over batches."""
    inbox, out, state = scratch(spark), scratch(spark), scratch(spark)

    def sink(made: DataFrame, number: int) -> None:
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def stored(number: int) -> DataFrame | None:
        return spark.read.parquet(out).where(F.col("batch") < number) if number else None

    for arrived in V.arrivals(spark, d):
        arrived.write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(arrived.schema).parquet(inbox)
        _drain(ST.convert_stream(stream, CFG, sink, stored, state, V.SITE))
    return spark.read.parquet(out).select("page_id", "status", md5("markdown").alias("markdown_md5"), stamp("stored_at").alias("stored_at"))


def t2_facts_that_change(spark: SparkSession, d: str) -> DataFrame:
    """Requests in two appends; before the second the facts have a new version, in which every third post is a draft."""
    inbox, out, state, root = scratch(spark), scratch(spark), scratch(spark), scratch(spark)
    first = facts(spark, d)
    later = first.withColumn("post_status", F.when(F.col("post_id") % 3 == 0, "draft").otherwise(F.col("post_status")))
    asked = IO.read_requests(V.requests(spark, d))

    def sink(batch: DataFrame, number: int) -> None:
        batch.select("request_id", "reason", "eligible").write.mode("overwrite").parquet(f"{out}/batch={number}")

    for turn, known in enumerate((first, later)):
        IO.write_facts(known, f"{root}/v={turn + 1}")
        asked.where((F.dayofmonth("ts") > 15) == F.lit(turn == 1)).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(asked.schema).parquet(inbox)
        _drain(ST.decide_batches(stream, lambda: IO.current_facts(spark, root, first.schema), CFG, sink, state))
    return spark.read.parquet(out).select("request_id", "reason", "eligible")


def _request_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = V.events(spark, d).schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")
    n = V.pages(spark, d).count()
    asked = IO.read_requests(V.stream_requests(stream, V.pages(spark, d), n))
    return ST.classify_stream(asked, IO.write_facts(facts(spark, d), scratch(spark)), CFG)


def t2_classify_stream(spark: SparkSession, d: str) -> DataFrame:
    out, state = scratch(spark), scratch(spark)
    rows = _request_stream(spark, d).select("request_id", "md_method", "reason", "eligible", "eligible_link")
    _drain(rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True))
    return spark.read.parquet(out)


def t3_window_audit(spark: SparkSession, d: str) -> DataFrame:
    out, state = scratch(spark), scratch(spark)
    counts = ST.eligibility_by_window(_request_stream(spark, d))

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    _drain(counts.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", state).trigger(availableNow=True))
    return ST.latest_windows(spark.read.parquet(out)).withColumn("window_start", stamp("window_start"))


QUERIES: dict[str, Query] = {
    "s1_read_pages": lambda s, d: IO.read_pages(s, f"{d}/pages.parquet").select("page_id", "url", F.octet_length("html").alias("bytes"), md5("html").alias("html_md5")),
    "s2_last_nonblank_capture": lambda s, d: IO.last_nonblank_capture(V.captures(s, d)).select("url", md5("html").alias("html_md5")),
    "s3_read_requests": lambda s, d: IO.read_requests(
        V.requests(s, d).withColumns({"accept": F.when(F.col("accept") != "", F.concat(F.lit(" <i>"), "accept", F.lit("</i>\t"))), "uri": F.concat("uri", F.lit(" "))})
    ).select("request_id", "accept", "uri"),
    "s4_post_meta_wide": lambda s, d: P.post_meta_wide(V.post_meta(s, d)),
    "s5_write_corpus": s5_write_corpus,
    "s6_quarantine": s6_quarantine,
    "s6_refresh_twice": s6_refresh_twice,
    "e1_wrap_fragment": lambda s, d: V.loose_pages(s, d).select("page_id", md5(M.wrap_fragment(F.col("html"))).alias("html_md5")),
    "e2_html_tokens": lambda s, d: html_tokens(V.loose_pages(s, d)).select("page_id", "pos", "kind", "name", md5("tag").alias("tag_md5"), md5("txt").alias("txt_md5")),
    "e3_html_elements": lambda s, d: html_elements(html_tokens(V.dressed_pages(s, d))).select("page_id", "pos", "pend", "name"),
    "e4_token_attrs": lambda s, d: token_attrs(html_tokens(V.dressed_pages(s, d))).select("page_id", "pos", F.explode("attrs").alias("key", "value")),
    "e5_compile_selectors": e5_compile_selectors,
    "e6_match_selectors": lambda s, d: S.match_selectors(token_attrs(html_tokens(V.pages(s, d))).where("attrs is not null"), [x.strip() for x in SELECTORS.split(",")]),
    "e6_selector_index": e6_selector_index,
    "e7_meaningful_documents": lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", E.meaningful_text(F.concat(F.lit(" \n\u00a0"), F.col("text"))).alias("meaningful")),
    "e7_meaningful_text": lambda s, d: html_elements(html_tokens(V.pages(s, d))).where("text_len is not null").select("page_id", "pos", "name", "text_len", (F.col("text_len") >= 50).alias("meaningful")),
    "e8_pick_content": lambda s, d: E.pick_content(E.page_tree(V.short_pages(s, d), CFG)),
    "e9_drop_excluded": e9_drop_excluded,
    "e10_drop_hidden": e10_drop_hidden,
    "e11_sanitize_attrs": e11_sanitize_attrs,
    "e12_drop_empty_elements": e12_drop_empty,
    "e13_drop_srcless_images": lambda s, d: kept(E.content_rows(V.dressed_pages(s, d), CFG)),
    "e14_inner_html": lambda s, d: content_of(V.dressed_pages(s, d), BODY),
    "e15_extract_content": lambda s, d: content_of(V.pages(s, d)),
    "e16_selector_coverage": lambda s, d: E.selector_coverage(E.page_tree(V.short_pages(s, d), CFG), CFG),
    "m1_render_markdown": m1_render,
    "m2_decode_entities": lambda s, d: V.pages(s, d).select("page_id", md5(T.decode_entities(F.col("html"))).alias("html_md5")),
    "m3_demote_h1": cleanup_step(C.demote_h1),
    "m4_tidy_links": cleanup_step(C.tidy_links),
    "m5_drop_empty_images": cleanup_step(C.drop_empty_images),
    "m6_drop_empty_headings": cleanup_step(C.drop_empty_headings),
    "m7_drop_empty_links": cleanup_step(C.drop_empty_links),
    "m8_dedent_and_rstrip": cleanup_step(C.dedent_and_rstrip),
    "m9_drop_blank_lines": cleanup_step(C.drop_blank_lines),
    "m10_dedupe_adjacent_lines": cleanup_step(C.dedupe_adjacent_lines),
    "m11_reflow": cleanup_step(C.reflow),
    "m12_clean_markdown": m12_clean,
    "m13_page_language": lambda s, d: V.titled_pages(s, d).select("page_id", FM.page_language(F.concat(F.lit("<!-- <html lang='xx'> --><script>'<html lang=yy>'</script>"), "html")).alias("language")),
    "m13_page_title": lambda s, d: V.titled_pages(s, d).select("page_id", FM.page_title(F.col("html")).alias("title")),
    "m14_excerpt": lambda s, d: V.posts(s, d).select("post_id", FM.excerpt(F.col("excerpt"), F.col("post_content")).alias("excerpt")),
    "m15_meta_description": lambda s, d: descriptions(s, d),
    "m16_lead_image": m16_lead_image,
    "m17_front_matter": m17_front_matter,
    "m18_convert": m18_convert,
    "m19_conversion_outcome": lambda s, d: PC.build_corpus(V.short_pages(s, d), CFG, V.as_of(), V.SITE).groupBy("status").agg(F.count("*").alias("pages")),
    "m21_build_corpus": lambda s, d: corpus_digest(corpus(s, d)),
    "r1_request_path": lambda s, d: classified(s, d).select("request_id", "path"),
    "r2_wants_md_accept": lambda s, d: classified(s, d).select("request_id", "wants_accept"),
    "r3_wants_md_url": lambda s, d: classified(s, d).select("request_id", "wants_url"),
    "r4_wants_md_query": lambda s, d: classified(s, d).select("request_id", "wants_query"),
    "r5_md_rewrite_path": lambda s, d: classified(s, d).select("request_id", "md_path"),
    "r6_md_method": lambda s, d: classified(s, d).select("request_id", "md_method"),
    "r7_is_explicit": lambda s, d: classified(s, d).select("request_id", "is_explicit"),
    "r8_special_paths": r8_special_paths,
    "r9_type_allowed": r9_type_allowed,
    "r10_hard_exclusion": lambda s, d: decided(s, d).select("request_id", "hard_reason"),
    "r11_is_noindex": lambda s, d: P.is_noindex(P.post_meta_wide(V.post_meta(s, d)).withColumn(
        "seo_noindex", F.when(F.col("post_id") % 6 == 0, True).when(F.col("post_id") % 6 == 1, False))),
    "r12_supported_view": lambda s, d: decided(s, d, CFG.with_(allow_search=True)).select("request_id", "supported_view"),
    "r13_conditional_exclusion": r13_conditional,
    "r14_eligible": lambda s, d: decided(s, d).select("request_id", "eligible"),
    "r15_eligible_alternate": lambda s, d: decided(s, d, CFG.with_(disable_logged_in=False)).select("request_id", "eligible_alternate"),
    "r16_eligible_link": lambda s, d: decided(s, d).select("request_id", "eligible_link"),
    "r17_representation": representation,
    "r17_representation_at": representation_at,
    "r19_eligibility_audit": lambda s, d: Q.eligibility_audit(decided(s, d)),
    "j1_resolve_route": lambda s, d: routes(s, d).select("request_id", "resolved", "target_kind", "target_id"),
    "j1_page_paths": page_paths,
    "j2_resolve_front_page": lambda s, d: routes(s, d).where("target_kind = 'front_page'").select("request_id", "target_id"),
    "j3_route_target": lambda s, d: routes(s, d).select("request_id", "target_type", "target_name", "target_var"),
    "j4_canonical_url": j4_canonical,
    "j5_markdown_url": lambda s, d: V.pages(s, d).select("page_id", markdown_url(F.col("url")).alias("markdown_url")),
    "j6_alternate_index": lambda s, d: L.alternate_index(V.pages(s, d)),
    "j7_alternate_overrides": j7_overrides,
    "j8_stale_entries": j8_stale,
    "j8_valid_spans": valid_spans,
    "j9_pages_to_refresh": j9_refresh,
    "l1_viewable_types": lambda s, d: V.posts(s, d).groupBy("post_type").agg(F.count("*").alias("posts")).join(
        P.viewable_types(V.post_types(s, viewable_case=True)).withColumnRenamed("name", "post_type"), "post_type"),
    "c1_cache_key": lambda s, d: PC.keyed_pages(V.pages(s, d), CFG, V.SITE),
    "c1_given_language": lambda s, d: V.pages(s, d).withColumn("spoken", F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("xx-"), (F.col("page_id") % 3).cast("string")))).select(
        "page_id", *(PC.page_columns(CFG, V.SITE_BY_COLUMN)[c].alias(c) for c in ("cache_key", "language"))),
    "c2_upsert_entries": upserted,
    "c2_upsert_store": c2_upsert_store,
    "c3_live_entries": lambda s, d: K.live_entries(V.store(s, d), CFG, V.as_of()).select("cache_key", "page_id"),
    "c4_clear_all": c4_clear_all,
    "c5_invalidation_filter": lambda s, d: invalidating(s, d).select("change_id", "kind", "post_id"),
    "c6_refresh_corpus": c6_refresh,
    "t1_convert_stream": t1_convert_stream,
    "t2_classify_stream": t2_classify_stream,
    "t2_facts_that_change": t2_facts_that_change,
    "t3_eligibility_by_window": t3_window_audit,
}
