"""Extraction: picking, cutting, cleaning."""

import time

import pytest
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.operators.content import extract_content, pick_content, page_tree
from pagemill.operators.elements import html_elements
from pagemill.operators.selectors import compile_selector, match_selectors
from pagemill.operators.tokens import html_tokens, token_attrs

LONG = "This sentence is long enough to count as the content of a page."


def frame(spark, texts):
    return spark.createDataFrame([(i, "https://e.com/", t) for i, t in enumerate(texts)], "page_id long, url string, html string")


def extract(spark, texts, cfg=Settings()):
    rows = extract_content(frame(spark, texts), cfg).collect()
    found = {r.page_id: r.content for r in rows}
    assert len(rows) == len(texts)
    return [found[i] for i in range(len(texts))]


def test_main_wins_article_follows_short_gives_nothing(spark):
    shell = "<!DOCTYPE html><html><body>{}</body></html>"
    main, article, short = extract(spark, [
        shell.format(f"<nav><a href='/x'>Lighthouse tours, boat hire and a calendar of all the tides</a></nav><main><h3>Harbour</h3><p>{LONG}</p></main><footer>Rights</footer>"),
        shell.format(f"<div>lead</div><article><h4>Tides</h4><p>{LONG}</p></article>"),
        shell.format("<main>Ebb</main>"),
    ])
    assert main == f"<h3>Harbour</h3><p>{LONG}</p>"
    assert article == f"<h4>Tides</h4><p>{LONG}</p>"
    assert short == ""


def test_custom_elements_and_loose_end_tags_keep_the_rest(spark):
    got = extract(spark, [
        f"<main><p>{LONG}</p><style-guide>x</style-guide><p>TAIL</p></main>",
        f"<main><p>{LONG}</p><script>1</script data-a='>'><iframe-box></iframe-box><p>TAIL</p></main>",
        f"<main><p>{LONG}</p><noscript>n</noscript ><scripted>y</scripted><p>TAIL</p></main>",
    ])
    assert all("<p>TAIL</p>" in g for g in got) and "style-guide" in got[0] and "scripted" in got[2]


@pytest.mark.parametrize("unit", ["<a ", "<!", "</ ", "<p =", "<script "])
def test_unclosed_markup_takes_time_in_proportion(spark, unit):
    def seconds(n):
        rows = frame(spark, [unit * n])
        begin = time.perf_counter()
        html_tokens(rows).agg(F.sum(F.length("txt"))).collect()
        return time.perf_counter() - begin

    seconds(1000)
    assert seconds(40_000) < 4 * seconds(20_000) + 1.5


def test_length_rule_counts_collapsed_decoded_bytes(spark):
    def content(text):
        return f"<html><body><main>{text}</main></body></html>"

    got = extract(spark, [
        content("a" * 49), content("a" * 50), content("é" * 24), content("é" * 25), content("a" * 45 + "&amp;" * 4), content("a" * 45 + "&amp;" * 5),
        content("  " + "a" * 24 + " \n  " + "a" * 25 + "&nbsp;"), content("  " + "a" * 24 + " \n  " + "a" * 24 + "&nbsp;"),
        content("<nav>" + "n" * 60 + "</nav><p>x</p>"), content("<script>" + "n" * 60 + "</script><p>x</p>"),
        "<html><body>ab<main>" + "a" * 49 + "</main>cd</body></html>", "<html><body>ab<main>" + "a" * 50 + "</main>cd</body></html>",
    ])
    kept = [bool(g) for g in got]
    assert kept[:8] == [False, True, False, True, False, True, True, False]
    assert got[8] == "<p>x</p>" and got[9] == "<p>x</p>"
    assert got[10] == "ab<main>" + "a" * 49 + "</main>cd"  # 53 bytes of body text
    assert got[11] == "a" * 50


def test_exclusions_keep_the_content_node_itself(spark):
    got = extract(spark, [
        f"<main><nav>menu<header>x</header></nav><p>{LONG}</p><div class='cookies x'>c</div><p aria-hidden=\"true\">off</p>tail</main>",
        f"<html><body><aside><p>{LONG}</p></aside></body></html>",
    ])
    assert got[0] == f"<p>{LONG}</p>tail"
    assert got[1] == ""
    assert extract(spark, [f"<aside><p>{LONG}</p></aside>"], Settings(content_selectors="aside"))[0] == f"<p>{LONG}</p>"


def test_hidden_and_attributes(spark):
    got = extract(spark, [
        f'<main><p style="DISPLAY: none">a</p><p style="x;display:none">b</p><p style="display:  none">c</p><a href=" JavaScript:x" data-x="1" onclick="f()" onload="g()">l</a>{LONG}</main>',
        f'<main style="display:none"><p style="display:none" onclick="f()">a</p>{LONG}</main>',
    ])
    assert got[0] == f'<p>c</p><a onload="g()">l</a>{LONG}'
    assert got[1] == f'<p style="display:none" onclick="f()">a</p>{LONG}'


def test_empty_elements_and_images(spark):
    got = extract(spark, [
        f'<main><p><img src="a.png"></p><div><span> <p></p></span></div><a href="/x"></a><p><a href="/y"></a></p><a href=" "></a><img src=" "><img src="b.png"><ul></ul>{LONG}</main>'
    ])
    assert got[0] == f'<a href="/x"></a><img src="b.png"><ul></ul>{LONG}'


def test_nothing_left_of_a_page_with_only_cut_parts(spark):
    assert extract(spark, [f"<main><nav>{LONG}</nav></main>", "", "plain " + LONG]) == ["", "", "plain " + LONG]


def test_missing_end_tags(spark):
    ends = html_elements(html_tokens(frame(spark, ["<ul><li>a<li>b<ul><li>c</ul><li>d</ul><p><b>x<p>y<table><tr><td>1<td>2<tr><td>3</table><div><section>z</div>w"])))
    got = {r.pos: (r.name, r.pend) for r in ends.collect()}
    names = [got[k] for k in sorted(got)]
    # positions: doctype 0, html 1, body 2, then one per tag
    assert names == [
        ("html", 25), ("body", 24), ("ul", 10), ("li", 5), ("li", 9), ("ul", 8), ("li", 8), ("li", 10), ("p", 13), ("b", 13),
        ("p", 14), ("table", 20), ("tr", 18), ("td", 17), ("td", 18), ("tr", 20), ("td", 20), ("div", 23), ("section", 23),
    ]


@pytest.mark.parametrize("text,kind", [("#a", "id"), (".a b", "class"), ('[role="main"]', "attr"), ("h1", "tag"), ("div.x", None), ("main p", None),
                                       ("[hidden]", None), ("my-tag", None), ("", None), ("[role=main]", None), ('#a"b', None)])
def test_selector_forms(text, kind):
    made = compile_selector(text)
    assert (made.kind if made else None) == kind


def test_selector_matches(spark):
    page = '<html><body><div class=" x  a \n b y" id="top"><H1 Role="main">t</H1></div></body></html>'
    starts = token_attrs(html_tokens(frame(spark, [page]))).where("attrs is not null")
    got = {(r.selector, r.name) for r in match_selectors(starts, [".a b", ".a", "#top", '[role="main"]', "H1", "h1", "."]).collect()}
    assert got == {(".a b", "div"), (".a", "div"), ("#top", "div"), ('[role="main"]', "h1"), ("h1", "h1"), (".", "html"), (".", "body"), (".", "h1")}


def test_first_selector_beats_document_order(spark):
    page = f"<article>{LONG}</article><div id='content'>{LONG}</div><main>x</main>"
    tree = page_tree(frame(spark, [page]), Settings(content_selectors="main, #content, article"))
    assert [(r["rank"]) for r in pick_content(tree).collect()] == [1]


def test_tokens_rejoin_to_the_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    joined = html_tokens(pages).groupBy("page_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("pos", F.concat("tag", "txt").alias("s")))).getField("s"), "").alias("s"))
    assert joined.join(pages, "page_id").where("s <> html").count() == 0


def test_odd_markup(spark):
    toks = html_tokens(frame(spark, ['<html><body a < b <a title="x>y" href=q/>t</a><!-- open <p>x'])).orderBy("pos").collect()
    assert toks[-1].kind == "comment" and toks[-1].tag.startswith("<!-- open")
    got = extract(spark, [f"<p>1 < 2 & 3 {LONG}<br/><script>if (a</b) x()"])
    assert got[0] == f"<p>1 < 2 & 3 {LONG}<br></p>"


def stack_machine(tokens):
    """Brute force: ends of elements by an explicit stack, for pages with proper box nesting."""
    from pagemill.functions import markup as M

    level = {t: lv for lv, tags in M.ITEM_LEVELS.items() for t in tags}
    stack, ends = [], {}

    def pop_to(i, pos):
        while len(stack) > i:
            ends[stack.pop()[1]] = pos

    for t in tokens:
        name, pos = t.name, t.pos
        if t.kind not in ("open", "close"):
            continue
        box = name in M.BOX_TAGS
        floor = max([i for i, (n, _) in enumerate(stack) if n in M.BOX_TAGS], default=-1)
        if box or name == "p" or name in level:
            for i, (n, _) in enumerate(stack):
                if i > floor and n == "p":
                    pop_to(i, pos)
                    break
        if name in level:
            for i, (n, _) in enumerate(stack):
                if i > floor and level.get(n, 0) >= level[name]:
                    pop_to(i, pos)
                    break
        if t.kind == "open":
            stack.append((name, pos))
        elif name != "p" and name not in level:
            hits = [i for i, (n, _) in enumerate(stack) if n == name and (box or i > floor)]
            if hits:
                pop_to(hits[-1], pos)
    pop_to(0, tokens[-1].pos + 1)
    return ends


def test_ends_equal_a_stack_machine(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    tokens = html_tokens(pages)
    by_page = {}
    for t in tokens.orderBy("page_id", "pos").collect():
        by_page.setdefault(t.page_id, []).append(t)
    got = {}
    for r in html_elements(tokens).where("kind = 'open'").collect():
        got.setdefault(r.page_id, {})[r.pos] = r.pend
    assert got == {p: stack_machine(ts) for p, ts in by_page.items()}
