"""Rendering, clean-up and front matter."""

import re
import time

import pytest
from pyspark.sql import functions as F

from pagemill.config import Settings
from pagemill.functions import text as T
from pagemill.functions.text import decode_entities
from pagemill.operators import cleanup as C
from pagemill.operators import frontmatter as FM
from pagemill.operators.frontmatter import excerpt, front_matter, lead_image, meta_description
from pagemill.plans.corpus import build_corpus, convert_content

PLAIN = Settings(include_h1=False, include_canonical=False, include_excerpt=False)


def convert(spark, html, cfg=PLAIN, title="The harbour", url="https://harbour.example/about/", description="Boats and tides."):
    df = spark.createDataFrame([(1, html, title, url, description)], "page_id long, html string, title string, canonical_url string, description string")
    return convert_content(df, cfg).first().markdown


def one(spark, text, step):
    return spark.createDataFrame([(text,)], "md string").select(step(F.col("md")).alias("x")).first().x


def test_headings_lists_links(spark):
    html = '<h3>Tides</h3>\n<p>Two a day:</p>\n<ol>\n<li>Ebb</li>\n<li>Flood</li>\n</ol>\n<p>See the <a href="https://harbour.example/table">table</a>!</p>'
    assert convert(spark, html) == "### Tides\nTwo a day:\n1. Ebb\n2. Flood\nSee the [table](https://harbour.example/table)!"


def test_front_matter_and_demotion(spark):
    got = convert(spark, "<h1>Low water</h1><p>Mind the mud.</p>", Settings())
    assert got == "# The harbour\n\nSource: https://harbour.example/about/\n\nBoats and tides.\n\n## Low water\nMind the mud."
    assert convert(spark, "<h1>Slack</h1><p>Wait.</p>", Settings(), title="").startswith("Source: ")
    assert "\n# Slack" in convert(spark, "<p>x</p><h1>Slack</h1>", Settings(), title="")


def test_empty_headings_entities_links_duplicates(spark):
    assert convert(spark, "<h5> </h5><p>Gulls</p>") == "Gulls"
    assert convert(spark, '<p>Salt &amp; wind</p><p><a href="https://e.com/r"> Row home </a></p>') == "Salt & wind\n[Row home](https://e.com/r)"
    assert convert(spark, "<p>Wave</p><p>Wave</p>\n<p>Foam</p><p>Wave</p>") == "Wave\nFoam\nWave"


def test_marks_and_titles_where_they_do_not_count(spark):
    assert convert(spark, "<pre>a <b>bold</b> <a href='/k'>l</a> <i>i</i></pre>") == "```\na bold l i\n```"
    page = "<!-- <title>Old</title> --><script>'<title>Js</title>'</script><html><head><title> New &amp; true</title></head></html>"
    assert one(spark, page, FM.page_title) == "New & true"
    assert one(spark, "&#00000065; &#x0000041; &#0; &#99999999999999999999999; &#x110000;", T.decode_entities) == "A A &#0; &#99999999999999999999999; &#x110000;"
    for code in ("zh-Hant", "zh-CN", "de"):
        assert one(spark, f"<html lang='{code}'>", FM.page_language) == code.lower()


@pytest.mark.parametrize("unit", [" ", "[", "[a", "![", "](", "[x](", "\t\n "])
def test_clean_up_takes_time_in_proportion(spark, unit):
    for step in (C.tidy_links, C.dedent_and_rstrip):
        begin = time.perf_counter()
        one(spark, unit * (400_000 // len(unit)), step)
        assert time.perf_counter() - begin < 6


@pytest.mark.parametrize("text", ["[ a ]( /x )", "[](y)[ ]( ) [b] (c)", "[x [ a ]( b ) ]( c )", "a](b) [ c ](d", "[]([b]( c ))", "[ [ n ]( m )", "![ i ]( j )"])
def test_links_are_tidied_as_the_fixed_pattern_does(spark, text):
    want = re.sub(r"\[\s*([^\]]+?)\s*\]\(\s*([^)]+?)\s*\)", r"[\1](\2)", text)
    assert one(spark, text, C.tidy_links) == want


def test_nesting(spark):
    html = ("<ol><li>One<ul><li>In</li></ul></li><li><p>Two</p></li></ol><ol><li>Again</li></ol><blockquote><p>Q <b>bold </b>x</p><p>R</p></blockquote>"
            "<pre><code>a\n  b</code></pre><p><i></i>x<br>y <code>c</code> <span>s</span></p><hr><img src='i.png' alt='A'><script>no()</script><!-- no -->")
    assert convert(spark, html) == "1. One\n  - In\n2. Two\n1. Again\n> Q **bold** x\n> R\n```\na\n  b\n```\nx\ny `c` s\n---\n![A](i.png)"


def test_unclosed_bold_before_a_paragraph(spark):
    assert convert(spark, "<p><b>Lead.<br><p>Next</p>") == "**Lead.**\nNext"


def test_entities(spark):
    def dec(t):
        return one(spark, t, decode_entities)

    assert dec("&amp;lt; &lt;b&gt; &quot;&apos;") == "&lt; <b> \"'"
    assert dec("&eacute;&#8364;&#x41;&#x1F600;&hellip; &amp &am; &nosuch; &#0; &#xD800;") == "é€A😀… &amp &am; &nosuch; &#0; &#xD800;"
    assert dec("no entity & none") == "no entity & none"
    assert dec("&copy; &middot;&nbsp;x") == "© · x"


def test_clean_up_steps(spark):
    assert one(spark, "# a\n## b\n# c # d", C.demote_h1) == "## a\n## b\n## c # d"
    assert one(spark, "[ a  b ]( /x )", C.tidy_links) == "[a  b](/x)"
    assert one(spark, "![alt]( ) ![](u) ok\n!  \n!x", C.drop_empty_images) == "  ok\n\n!x"
    assert one(spark, "## \n# a\n###", C.drop_empty_headings).split() == ["#", "a"]
    assert one(spark, "[ ](u)[a](u)[]()", C.drop_empty_links) == "[a](u)"
    assert one(spark, "  ## h \t\n\t[a](u)  \n  text ", C.dedent_and_rstrip) == "## h\n[a](u)\n  text"
    assert one(spark, "a\r\n\r\nb\r \t\rc\n", C.drop_blank_lines) == "a\nb\nc"
    assert one(spark, "a\n a\na\n\n\nb\na", C.dedupe_adjacent_lines) == "a\n\n\nb\na"
    assert one(spark, "[a](x) [b](y)\n# H\n#\n# I", C.reflow) == "[a](x)\n[b](y)\n\n# H\n#\n# I"


def test_clean_up_leaves_blank_lines_only_before_headings(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("md", F.concat("text", F.lit("\n\n# x\n\ny\n")))
    lines = C.clean_markdown(docs, F.lit(False), "md").select(F.split("md", "\n").alias("l"))
    pairs = lines.select(F.posexplode("l").alias("i", "x"), "l").where("trim(x) = ''").where("not (get(l, i + 1) rlike '^#{1,6} ')")
    assert pairs.count() == 0


def test_excerpt_and_description(spark):
    words = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(None, f"<p>{words}</p>", None, None), (" <b>Own</b> ", "x", " ", " meta "), ("", None, " seo ", "meta"), (None, "<script>s</script>a\n b", None, None)],
                               "own string, content string, seo string, meta string")
    got = df.select(excerpt(F.col("own"), F.col("content")).alias("e"), meta_description(F.col("seo"), F.col("meta")).alias("d")).collect()
    assert [r.e for r in got] == [" ".join(words.split()[:55]), "Own", "", "a b"]
    assert [r.d for r in got] == ["", "meta", "seo", ""]


def test_lead_image_and_positions(spark):
    assert one(spark, "<p>x</p><IMG class=\"a\" src='/i 1.png' alt=\" A \"><img src='b'>", lead_image) == "![A](/i1.png)"
    assert one(spark, "<p>no image</p>", lead_image) == ""
    cfg = Settings(include_featured_image=True)
    df = spark.createDataFrame([("B",)], "b string")

    def head(c, canonical):
        return df.select(front_matter(F.col("b"), F.lit("T"), F.lit(canonical), F.lit("D &amp; d"), F.lit("![A](i)"), c).alias("m")).first().m

    assert head(cfg, "") == "# T\n\nD & d\n\n![A](i)\n\nB"
    assert head(cfg.with_(featured_image_position="prepend"), "u") == "![A](i)\n\n# T\n\nSource: u\n\nD & d\n\nB"
    assert head(PLAIN, "u") == "B"


def test_build_corpus_gives_every_page_a_status(spark):
    long = "This sentence is long enough to count as the content of a page."
    df = spark.createDataFrame([(1, "https://e.com/a", f"<html lang='EN-gb'><head><title> A &amp; B </title></head><body><main><img src='i.png'><p>{long}</p></main></body></html>"), (2, "u", "<p>short</p>"), (3, "u", None)],
                               "page_id long, url string, html string")
    cfg = Settings(include_featured_image=True)
    got = {r.page_id: r for r in build_corpus(df, cfg, F.lit("2024-01-20").cast("timestamp")).collect()}
    assert got[1].markdown == f"# A & B\n\nSource: https://e.com/a\n\n![](i.png)\n\n{long}"
    assert (got[1].language, got[1].status, got[2].status, got[3].status) == ("en-gb", "ok", "no_content", "no_content")
    assert got[2].markdown is None and got[1].ttl_s == 86400
