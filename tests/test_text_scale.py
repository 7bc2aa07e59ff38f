"""Patterns and tables that must not grow faster than their text, selectors by index, paths by parents, changing facts."""

import os
import random
import re
import time
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from pagemill.config import Settings, Site
from pagemill.functions.text import decode_entities
from pagemill.operators import cleanup as C
from pagemill.operators import posts as P
from pagemill.operators import render as R
from pagemill.operators import routes as J
from pagemill.operators import selectors as S
from pagemill.operators.content import meaningful_text
from pagemill.operators.frontmatter import page_language
from pagemill.plans.corpus import keyed_pages, page_columns
from pagemill.sources.tables import current_facts, write_facts


def values(spark, step, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", step(F.col("t")).alias("x")).orderBy("i").collect()]


N = 400_000


@pytest.mark.parametrize("name,step,text", [
    ("blanks", R.settle_emphasis, " " * N + "x"),
    ("marks", R.settle_emphasis, R.BOLD_ON * N + "x"),
    ("closing marks", R.settle_emphasis, (" " * 50 + R.BOLD_OFF) * (N // 51)),
    ("open images", C.drop_empty_images, "![" * (N // 2)),
    ("images without end", C.drop_empty_images, "![](" * (N // 4)),
    ("images of blanks", C.drop_empty_images, "![ " * (N // 3)),
    ("rare entities", decode_entities, "&zwnj;&Zeta;&nvinfin;" * 33_000),
    ("unknown entities", decode_entities, "&zzzz;&A;&AA;" * 33_000),
])
def test_long_texts_take_time_in_proportion(spark, name, step, text):
    values(spark, step, text[:1000])
    start = time.perf_counter()
    values(spark, step, text)
    assert time.perf_counter() - start < 6, name


def test_emphasis_and_images_keep_their_meaning(spark):
    """Against the plain patterns, which try every place, on short random texts."""
    on, off = R.BOLD_ON + R.ITALIC_ON, R.BOLD_OFF + R.ITALIC_OFF

    def emphasis(t):
        t = re.sub(rf"([{on}]+)(\s+)", r"\2\1", t)
        t = re.sub(rf"(\s+)([{off}]+)", r"\2\1", t)
        return re.sub(f"[{R.ITALIC_ON}{R.ITALIC_OFF}]", "*", re.sub(f"[{R.BOLD_ON}{R.BOLD_OFF}]", "**", t))

    def images(t):
        t = re.sub(r"!\[[^\]]*\]\(\s*\)", "", t)
        t = re.sub(r"!\[\s*\]\([^)]+\)", "", t)
        return re.sub(r"(?m)^!\s*$", "", t)

    r = random.Random(8)
    texts = ["".join(r.choice(on + off + " \tab") for _ in range(r.randrange(14))) for _ in range(1500)]
    assert values(spark, R.settle_emphasis, *texts) == [emphasis(t) for t in texts]
    texts = ["".join(r.choice(["!", "[", "]", "(", ")", " ", "x", "![", "](", "$1"]) for _ in range(r.randrange(14))) for _ in range(3000)]
    assert values(spark, C.drop_empty_images, *texts) == [images(t) for t in texts]


def test_every_named_entity(spark):
    names = sorted(k for k in html5 if k.endswith(";"))
    got = values(spark, decode_entities, *(f"<&{k}>" for k in names))
    assert [(k, g) for k, g in zip(names, got, strict=True) if g != f"<{html5[k]}>"] == []
    assert values(spark, decode_entities, "&a;&zz;&A;&Zz9;&lt;&bogus;") == ["&a;&zz;&A;&Zz9;<&bogus;"]


def elements(spark, rows):
    return spark.createDataFrame([(1, i, n, a) for i, (n, a) in enumerate(rows)], "page_id long, pos int, name string, attrs map<string,string>")


def test_selector_index_against_each_test(spark):
    r = random.Random(1)
    words = ["a", "b", "ad", "x-y", ""]
    rows = []
    for _ in range(150):
        attrs = {}
        if r.random() < 0.8:
            attrs["class"] = r.choice(["", " ", "\t"]).join(r.choice(words) + " " for _ in range(r.randrange(4)))
        if r.random() < 0.5:
            attrs["id"] = r.choice(words)
        if r.random() < 0.5:
            attrs[r.choice(["href", "role", "data-x"])] = r.choice(words)
        rows.append((r.choice(["p", "div", "a"]), r.choice([attrs, attrs, None])))
    texts = [".a", ".a b", ".b a ad", ". a", ".a  b", ".", "#a", "#", "#x-y", '[href="a"]', '[role="ad"]', '[id="b"]', '[class="a "]', "p", "P", "div", "a", "div.x", "", ".a"]
    df = elements(spark, rows)
    got = {(x.pos, x.rank, x.selector) for x in S.match_selectors(df, texts).collect()}
    assert S.match_selectors(df, texts).count() == len(got)
    want = set()
    for rank, s in S.compile_selectors(texts):
        hits = df.where(S.selector_test(s, F.col("name"), F.col("attrs"))).select("pos").collect()
        want |= {(x.pos, rank, texts[rank]) for x in hits}
    assert got == want and len(want) > 200
    assert S.match_selectors(df, ["div.x"]).count() == 0 == S.match_selectors(df, []).count()


def test_many_selectors_have_the_plan_of_few(spark):
    df = elements(spark, [("p", {"class": "c7 c4999", "id": "z"})] * 3)

    def shape(n):
        plan = S.match_selectors(df, [f".c{i}" for i in range(n)])._jdf.queryExecution().optimizedPlan()
        return [line.strip(" :+-").split(" ")[0] for line in plan.toString().splitlines()]

    assert shape(5) == shape(5000)
    assert S.match_selectors(df, [f".c{i}" for i in range(5000)]).count() == 6


def keep_in(spark, folder):
    def keep(rows, number):
        rows.write.parquet(f"{folder}/{number}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{number}")

    return keep


def test_page_paths(spark, tmp_path):
    rows = [(1, None, "a"), (2, 1, "b"), (3, 2, "c"), (4, 3, "d"), (5, 0, "e"), (6, 99, "lost"), (7, 8, "x"), (8, 7, "y"), (9, 8, "under"), (10, 10, "self"), (11, 4, None)]
    rows += [(100 + i, 99 + i if i else None, f"s{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "post_id long, parent_id long, slug string")
    got = {r.post_id: r.path for r in J.page_paths(df, keep_in(spark, tmp_path / "paths")).collect()}
    slugs, parents = {i: s or "" for i, _, s in rows}, {i: p for i, p, _ in rows}

    def plain(i):
        parts, seen = [], set()
        while i in slugs and i != 0:
            if i in seen:
                return None
            seen.add(i)
            parts.append(slugs[i])
            i = parents[i]
        return "/".join(reversed(parts))

    assert got == {i: plain(i) for i in slugs}
    assert got[4] == "a/b/c/d" and got[9] is None and got[139].count("/") == 39
    assert J.page_paths(df.where("false"), keep_in(spark, tmp_path / "none")).count() == 0


def test_routes_by_parents(spark, tmp_path):
    posts = spark.createDataFrame(
        [(1, "h", "/old/", "page", "about"), (2, "h", "/team", "page", "team"), (3, "h", "/team", "post", "team")],
        "post_id long, host string, url_path string, post_type string, post_name string",
    )
    tree = spark.createDataFrame([(1, None, "about"), (2, 1, "team"), (3, 1, "ignored")], "post_id long, parent_id long, slug string")
    placed = J.with_page_paths(posts, J.page_paths(tree, keep_in(spark, tmp_path / "p")))
    types = spark.createDataFrame([("page", ""), ("post", "")], "name string, query_var string")
    asked = spark.createDataFrame([(1, "h", "/about/team.md"), (2, "h", "/team.md"), (3, "h", "/old.md")], "request_id long, host string, md_path string")
    got = {r.request_id: (r.target_kind, r.target_id) for r in J.resolve_route(asked, J.route_index(placed, types), Site()).collect()}
    assert got == {1: ("page", 2), 2: ("post", 3), 3: ("name", None)}


def test_given_language_and_commented_head(spark):
    html = "<!-- <html lang='xx'> --><script>'<html lang=yy>'</script><html lang=DE-at><body>x</body></html>"
    df = spark.createDataFrame([(1, "u", html, "fr"), (2, "u", html, None)], "page_id long, url string, html string, spoken string")
    assert [r.x for r in df.select(page_language(F.col("html")).alias("x")).collect()] == ["de-at"] * 2
    site = Site(language_column="spoken")
    assert [r.language for r in df.select(page_columns(Settings(), site)["language"].alias("language")).collect()] == ["fr", ""]
    own, given = (keyed_pages(df, Settings(), s).collect() for s in (Site(), site))
    assert all(a.cache_key != b.cache_key for a, b in zip(own, given, strict=True))


def test_order_of_types_and_meaningful_text(spark):
    types = spark.createDataFrame([("a", "Zebra", True), ("b", "apple", True), ("c", "Apple", True), ("d", "Moon", False)], "name string, label string, viewable boolean")
    assert [tuple(r) for r in P.viewable_types(types).collect()] == [("b", "apple", 1), ("c", "Apple", 2), ("a", "Zebra", 3)]
    assert values(spark, meaningful_text, "x" * 49, "x" * 50, "é" * 25, "é" * 24, "  a" * 25, "  " + "x" * 49 + " ") == [False, True, True, False, False, False]


def test_current_facts(spark, tmp_path):
    root = str(tmp_path / "facts")
    df = spark.createDataFrame([(1, "a")], "post_id long, post_type string")
    with pytest.raises(ValueError):
        current_facts(spark, root, df.schema)
    write_facts(df, f"{root}/v=1")
    os.makedirs(f"{root}/v=2")  # lost on the way
    assert [tuple(r) for r in current_facts(spark, root, df.schema).collect()] == [(1, "a")]
