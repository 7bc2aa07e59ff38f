"""HTML vocabulary: the segment pattern, tag classes and attribute parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import decode_entities, let, trim

# HTML tag classes.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
)
RAW_TAGS = ("script", "style", "noscript", "iframe")
BOX_TAGS = (
    "address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dir", "div",
    "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "main", "menu", "nav", "ol", "pre", "search", "section",
    "select", "summary", "table", "title", "ul",
)
# Children whose end tag may be left out. An item ends at the next start or end of its own level
# or of a lower-numbered one: a cell ends with its row, a row with its row group.
ITEM_LEVELS = {
    1: ("caption", "colgroup", "dd", "dt", "li", "optgroup", "tbody", "tfoot", "thead"),
    2: ("option", "tr"),
    3: ("td", "th"),
}
HEADING_TAGS = ("h1", "h2", "h3", "h4", "h5", "h6")
EMPTY_DROP_TAGS = ("p", "div", "span", "a", "li", *HEADING_TAGS)

# A name ends at a blank, a slash or the end of the tag: <style-guide> is not a style element. End tags may
# carry blanks and attributes.
RAW_RE = "|".join(rf"<{t}(?=[\s/>]).*?(?:</{t}(?=[\s/>])[^>]*>|\z)" for t in RAW_TAGS)
# One piece of markup and the text after it. Quantifiers are possessive, so matching does not recurse however
# long the page is. What is never closed (a comment, a raw element, a declaration, a tag) takes the rest of the
# page as one piece, so no later piece scans that far again and matching is linear.
SEGMENT_RE = (
    rf"(?is)(<!--.*?(?:-->|\z)|{RAW_RE}"
    r"""|</?[a-z][^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*'|)[^>=]*+)*+>|</?[a-z].*+|<[!?/][^>]*+(?:>|\z)|<|\A)([^<]*)"""
)

_ATTR_RE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?"""


def wrap_fragment(html: Column) -> Column:
    """A text without an html tag is put into a document shell."""
    shell = F.concat(F.lit("<!DOCTYPE html><html><body>"), html, F.lit("</body></html>"))
    return F.when(html.rlike("(?i)<html"), html).otherwise(shell)


def whole_document(html: Column) -> Column:
    """wrap_fragment, and a document that leaves its body tag out gets one: after the head, else
    after the html tag."""
    after_head = F.regexp_replace(html, r"(?is)\A(.*?</head\s*>)", "$1<body>")
    after_html = F.regexp_replace(html, r"(?is)\A(.*?<html\b[^>]*>)", "$1<body>")
    return (
        F.when(~html.rlike("(?i)<html"), wrap_fragment(html))
        .when(html.rlike("(?i)<body"), html)
        .when(html.rlike(r"(?i)</head\s*>"), after_head)
        .otherwise(after_html)
    )


def tag_name(tag: Column) -> Column:
    return F.lower(F.regexp_extract(tag, r"^</?([A-Za-z][^\s/>]*)", 1))


def tag_kind(tag: Column, name: Column) -> Column:
    closing = tag.startswith("</")
    self_closed = tag.endswith("/>") & tag.rlike(r"""(?:[\s"']|^<[^\s=]*)/>$""")
    return (
        F.when((tag == "") | (tag == "<"), "text")
        .when(name == "", "comment")
        .when(closing, "close")
        .when(name.isin(*RAW_TAGS), "raw")
        .when(name.isin(*VOID_TAGS) | self_closed, "void")
        .otherwise("open")
    )


def is_stray(tag: Column, name: Column) -> Column:
    """A lone '<', or a tag that the page ends in the middle of: both count as text."""
    return (tag == "<") | ((name != "") & ~name.isin(*RAW_TAGS) & ~tag.endswith(">"))


def attributes(tag: Column) -> Column:
    """Attributes of a start tag as a map: lower-case names, decoded values, first duplicate wins."""
    start = F.regexp_extract(tag, r"""(?s)^<[^>=]*+(?:=\s*+(?:"[^"]*"|'[^']*'|)[^>=]*+)*+>""", 0)
    tail = F.regexp_replace(start, r"(?s)^<[^\s/>]+|/?>$", "")
    found = F.arrays_zip(
        F.regexp_extract_all(F.lower(tail), F.lit(_ATTR_RE), F.lit(1)), F.regexp_extract_all(tail, F.lit(_ATTR_RE), F.lit(2))
    )

    def unquote(v: Column) -> Column:
        bare = F.when(v.rlike("^[\"']"), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
        return F.when(v.contains("&"), decode_entities(bare)).otherwise(bare)

    pairs = F.transform(found, lambda p: F.struct(p["0"].alias("key"), unquote(p["1"]).alias("value")))
    first = let(
        pairs, lambda all_: F.filter(all_, lambda p, i: F.array_position(all_.getField("key"), p["key"]) == i + 1)
    )
    has_any = tag.rlike(r"^<[A-Za-z][^\s/>]*[\s/]+[^\s/>]")
    return F.when(has_any, F.map_from_entries(first)).otherwise(
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    )


def raw_body(tag: Column, name: Column) -> Column:
    """Text inside a raw element; noscript and iframe hold markup, whose tags are not text."""
    body = F.regexp_replace(tag, r"(?s)^<[^>]*>|</[A-Za-z]+(?:[\s/][^>]*)?>$", "")
    return F.when(name.isin("script", "style"), body).otherwise(F.regexp_replace(body, r"<[^>]*>", ""))


def attr(attrs: Column, key: str) -> Column:
    return F.try_element_at(attrs, F.lit(key))


def is_hidden(attrs: Column) -> Column:
    """Exactly two spellings of display none count."""
    style = F.lower(F.coalesce(attr(attrs, "style"), F.lit("")))
    return F.contains(style, F.lit("display:none")) | F.contains(style, F.lit("display: none"))


def is_script_href(attrs: Column) -> Column:
    return F.lower(trim(F.coalesce(attr(attrs, "href"), F.lit("")))).startswith("javascript:")


def sanitize_attrs(attrs: Column) -> Column:
    """Drops script targets, onclick, style and data-*; other handlers stay."""
    script = is_script_href(attrs)
    return F.map_filter(
        attrs,
        lambda k, v: ~((k == "href") & script) & ~k.isin("onclick", "style") & ~k.startswith("data-"),
    )


def start_tag(name: Column, attrs: Column) -> Column:
    """Writes a start tag back from its name and attributes."""
    parts = F.transform(
        F.map_entries(attrs),
        lambda e: F.concat(
            F.lit(" "), e["key"], F.lit('="'),
            F.replace(F.replace(e["value"], F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'),
        ),
    )
    return F.concat(F.lit("<"), name, F.array_join(parts, ""), F.lit(">"))
