"""Requests, routes, links, settings."""

from pyspark.sql import functions as F

from pagemill.config import Settings, Site, excluded_selector_list, sanitize_settings
from pagemill.functions.urls import markdown_url, request_path
from pagemill.operators.links import alternate_index, canonical_url
from pagemill.operators.requests import classify_requests, decide, eligibility_audit
from pagemill.operators.posts import is_noindex
from pagemill.operators.routes import resolve_route, route_index
from pagemill.plans.refresh import representation
from pagemill.sources.tables import read_requests

COLUMNS = "request_id long, accept string, uri string, view string, logged_in boolean, is_manager boolean, password_required boolean, post_type string, post_status string, viewable boolean, noindex boolean, permalink string, host string, has_entry boolean"


def requests(spark, *rows):
    base = dict(accept=None, uri="/about/", view="singular", logged_in=False, is_manager=False, password_required=False, post_type="page",
                post_status="publish", viewable=True, noindex=False, permalink="https://example.com/about/", host="e", has_entry=False)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple({**base, "request_id": i, **r}[n] for n in names) for i, r in enumerate(rows)], COLUMNS)


def decided(spark, cfg, *rows):
    return [r for r in decide(classify_requests(read_requests(requests(spark, *rows)), cfg), cfg).orderBy("request_id").collect()]


def test_ways_to_ask(spark):
    rows = [dict(accept="text/html, Text/Markdown;q=0"), dict(uri="/about.md"), dict(uri="/.md"), dict(uri="/a.MD/?x"), dict(uri="/a?x=1&format=html&format=Mark%64own#f"),
            dict(uri="/a?output= <b>markdown</b>"), dict(uri="/a?md_path=b"), dict(uri="/a?xformat=markdown"), dict(uri="https://h/x/y.md?q"), dict()]
    got = decided(spark, Settings(), *rows)
    assert [r.md_method for r in got] == ["accept", "url", "url", "url", "query", "query", "rewrite", None, "url", None]
    assert [r.md_path for r in got] == [None, "about", "", None, None, None, "b", None, "x/y", None]
    assert [r.is_explicit for r in got] == [False, True, True, True, True, True, True, False, True, False]
    off = decided(spark, Settings(enabled=False, md_urls_enabled=False, query_param_enabled=False), *rows)
    assert [r.md_method for r in off] == [None] * 6 + ["rewrite"] + [None] * 3


def test_reasons(spark):
    rows = [dict(view="admin"), dict(view="feed"), dict(uri="/Sitemap_2.XML"), dict(uri="//robots.txt"), dict(uri="/x/wp-login.php"), dict(view="404"), dict(view="search"),
            dict(view="archive"), dict(password_required=True), dict(post_status="draft"), dict(post_type="case_study"), dict(viewable=False), dict(post_status=None, post_type=None, viewable=None),
            dict(logged_in=True), dict(logged_in=True, is_manager=True), dict(logged_in=True, is_manager=True, uri="/about.md"), dict(noindex=True), dict(view="other"), dict(view="home"), dict(view="cron")]
    got = decided(spark, Settings(), *rows)
    assert [r.reason for r in got] == ["admin", "feed", "sitemap", "robots", "auth", "404", "search", "archive", "password", "status", "post_type", "post_type", None,
                                       "logged_in", "logged_in", None, "noindex", "view", None, "cron"]
    assert [r.eligible_link for r in got[12:19]] == [True, True, True, True, False, False, True]
    loose = decided(spark, Settings(allow_404=True, allow_search=True, allow_archives=True, disable_logged_in=False, disable_noindex=False), *rows)
    assert [r.reason for r in loose[5:8]] == [None] * 3 and [r.reason for r in loose[13:17]] == [None] * 4
    assert not any(r.eligible_link for r in decided(spark, Settings(link_headers_enabled=False, head_alternate_link=False), *rows))


def test_representation_and_audit(spark):
    cfg = Settings()
    rows = [dict(uri="/a.md", has_entry=True), dict(uri="/a.md"), dict(has_entry=True), dict(view="admin", uri="/a.md")]
    made = decide(classify_requests(read_requests(requests(spark, *rows)), cfg), cfg)
    assert [r.plan for r in representation(made, cfg).orderBy("request_id").collect()] == ["stored_markdown", "fresh_markdown", "html_with_link", "html"]
    assert [r.plan for r in representation(made, cfg.with_(caching_enabled=False)).orderBy("request_id").collect()][0] == "fresh_markdown"
    audit = {(r.method, r.reason): r.requests for r in eligibility_audit(made).collect()}
    assert audit[(None, None)] == 4 and audit[("url", "eligible")] == 2 and audit[(None, "admin")] == 1


def test_routes(spark):
    posts = spark.createDataFrame([(5, "e", "/about/", "page", "about"), (6, "e", "/about", "post", "about-2"), (31, "e", "/boats/heron/", "case_study", "heron"), (9, "e", "/news/x", "post", "x"), (10, "e", "/p/q", "page", "q")],
                                  "post_id long, host string, url_path string, post_type string, post_name string")
    types = spark.createDataFrame([("page", ""), ("post", ""), ("case_study", "case_study")], "name string, query_var string")
    paths = ["", "about", "boats/heron", "news/x/", "nowhere/at/all", "a/.md", "p/q.MD", ".md", "/"]
    req = spark.createDataFrame([(i, "e", p) for i, p in enumerate(paths)] + [(99, "e", None)], "request_id long, host string, md_path string")
    site = Site(page_on_front=77)
    for salt in (1, 4):
        got = {r.request_id: r for r in resolve_route(req, route_index(posts, types), site, salt).collect()}
        assert [got[i].target_kind for i in range(9)] == ["front_page", "page", "post", "post", "name", "name", "page", "blank", "front_page"]
        assert [got[i].target_id for i in range(9)] == [77, 5, 31, 9, None, None, 10, None, 77]
        assert (got[2].target_type, got[2].target_name, got[2].target_var) == ("case_study", "heron", "case_study")
        assert (got[1].target_name, got[3].target_name, got[3].target_var, got[4].target_name, got[5].target_name) == ("about", "x", None, "all", "a")
        assert 99 not in got
    assert resolve_route(req, route_index(posts, types), Site(), 1).where("request_id = 0").first().target_id is None


def test_links(spark):
    urls = ["https://example.com/", "https://example.com/about/", "http://u:p@h.com:8080/a//?q=1&r=2#f", "//h.com/x", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = [r for r in alternate_index(df).orderBy("page_id").collect()]
    assert [r.markdown_url for r in got] == ["https://example.com/.md", "https://example.com/about.md", "http://h.com:8080/a.md?q=1&r=2", "https://h.com/x.md", ""]
    assert got[0].link_header == 'Link: <https://example.com/.md>; rel="alternate"; type="text/markdown"' and got[4].link_header == ""
    over = spark.createDataFrame([(0, "https://cdn/0"), (4, "https://cdn/4")], "page_id long, url string")
    assert [r.markdown_url for r in alternate_index(df, over).orderBy("page_id").collect()] == ["https://cdn/0", *[r.markdown_url for r in got[1:]]]
    rows = requests(spark, dict(), dict(view="front_page"), dict(view="home"), dict(view="archive", uri="/tag/x/?p"), dict(view="404", uri="/"))
    made = classify_requests(read_requests(rows), Settings()).orderBy("request_id").select(canonical_url(Site(posts_page_url="https://example.com/blog/")).alias("c"))
    assert [r.c for r in made.collect()] == ["https://example.com/about/", "https://example.com/", "https://example.com/blog/", "https://example.com/tag/x/", ""]


def test_settings():
    got = sanitize_settings({"enabled": "1", "cache_ttl": "-5", "post_types": " Page, nope ,case_study,page", "content_selectors": " <b>main</b> ", "featured_image_position": "x", "allow_404": "0"}, ["page", "post", "case_study"])
    assert got.enabled and not got.caching_enabled and not got.allow_404
    assert (got.cache_ttl, got.post_types, got.content_selectors, got.featured_image_position) == (60, ("page", "case_study"), "main", "append")
    assert sanitize_settings(None, ["page"]).post_types == ("post", "page")
    assert excluded_selector_list(Settings(excluded_selectors="nav, .x,,0,.x"))[-1] == ".x"
    assert len(excluded_selector_list(Settings(excluded_selectors="nav, .x,,0,.x"))) == 15


def test_request_path(spark):
    df = spark.createDataFrame([("/a b?x#y",), ("HTTPS://h/p?q",), ("",), ("?q",)], "uri string")
    assert [r.p for r in df.select(request_path(F.col("uri")).alias("p")).collect()] == ["/a b", "/p", "", ""]
    assert df.select(markdown_url(F.lit("").cast("string")).alias("u")).first().u == ""


def test_site_variable_page_name_and_seo_flag(spark):
    row = requests(spark, dict(uri="/x?way=/a/b"), dict(uri="/y")).withColumn("page_name", F.when(F.col("uri") == "/y", "wp-login.php"))
    made = classify_requests(read_requests(row), Settings(), Site(path_variable="way"))
    assert {r.uri: r.md_path for r in made.collect()} == {"/x?way=/a/b": "/a/b", "/y": None}
    assert {r.uri: r.hard_reason for r in decide(made, Settings()).collect()}["/y"] == "auth"
    meta = spark.createDataFrame([(1, "1", False), (2, "0", True), (3, "1", None), (4, None, None)], "post_id long, noindex_value string, seo_noindex boolean")
    assert [r.noindex for r in is_noindex(meta).orderBy("post_id").collect()] == [False, True, True, False]
