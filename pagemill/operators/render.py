"""Content events -> Markdown (M1): every event becomes a short piece, the pieces are joined in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markup as M
from ..functions import text as T
from .content import content_events, fragment_rows, html_piece, in_order
from .elements import BEFORE_HERE, UP_TO_HERE

# Control characters cannot occur in HTML text. They stand for emphasis marks until the pieces are
# joined, so that blanks at the inner edge of an emphasis can be moved outside it.
BOLD_ON, BOLD_OFF, ITALIC_ON, ITALIC_OFF = "\x02", "\x03", "\x04", "\x05"
_CONTROL = "\x01\x02\x03\x04\x05\x06\x07\x08"

ORDER = ("pos", "phase", "tie")
LISTS = ("ul", "ol")
CELLS = ("td", "th")
BLOCKS = (*[t for t in M.BOX_TAGS], "p", *[t for tags in M.ITEM_LEVELS.values() for t in tags if t not in CELLS])


def _text(value: str | None = None) -> Column:
    return F.lit(value).cast("string")


def add_context(events: DataFrame) -> DataFrame:
    """List depth and number, quote and preformatted depth, and where in a line each event stands."""
    asc = Window.partitionBy("page_id").orderBy(*ORDER)
    what, name = F.col("what"), F.col("name")
    step = F.when(what == "open", 1).when(what == "close", -1).otherwise(0)

    def depth_of(*tags: str) -> Column:
        return F.sum(F.when(name.isin(*tags), step).otherwise(0)).over(asc.rowsBetween(*UP_TO_HERE))

    block = name.isin(*BLOCKS)
    marks = name.isin("li", *M.HEADING_TAGS)
    visible_inline = (name.isin("b", "strong", "i", "em", "code") & F.col("filled")) | (
        (name == "a") & F.col("value").isNotNull()
    )
    # solid events change the place in the line; a plain block start only does if no marker came first
    solid = (
        F.when(what == "text", F.when(F.col("filled"), "in"))
        .when(what == "open", F.when(marks, "mark").when((name == "pre") | visible_inline, "in"))
        .when(what == "close", F.when(block, "line").when(name.isin(*CELLS) | visible_inline, "in"))
        .when(what == "void", F.when(name.isin("br", "hr"), "line").when(name == "img", "in"))
    )
    plain = F.when((what == "open") & block & ~marks & (name != "pre"), "line")
    before = asc.rowsBetween(*BEFORE_HERE)
    located = events.withColumns({"_solid": solid, "_any": F.coalesce(solid, plain)}).withColumns(
        {
            "list_depth": depth_of(*LISTS),
            "quotes": depth_of("blockquote"),
            "pre": depth_of("pre"),
            "_s": F.last("_solid", ignorenulls=True).over(before),
            "_a": F.last("_any", ignorenulls=True).over(before),
        }
    )
    place = (
        F.when(F.col("_s") == "mark", "mark").when(F.coalesce(F.col("_a"), F.lit("line")) == "line", "line").otherwise("in")
    )
    located = located.withColumn("place", place).drop("_solid", "_any", "_s", "_a")

    # items are numbered within their list: lists of one depth follow each other, so a running count
    # less its value at the last list start is the number
    same = Window.partitionBy("page_id", "list_depth").orderBy(*ORDER).rowsBetween(*UP_TO_HERE)
    list_start = (what == "open") & name.isin(*LISTS)
    return (
        located.withColumn("_items", F.sum(F.when((what == "open") & (name == "li"), 1).otherwise(0)).over(same))
        .withColumn("_list", F.last(F.when(list_start, F.struct("name", "_items")), ignorenulls=True).over(same))
        .withColumn("item_no", F.when(F.col("_list.name") == "ol", F.col("_items") - F.col("_list._items")))
        .drop("_items", "_list")
    )


def markdown_piece() -> Column:
    what, name, place = F.col("what"), F.col("name"), F.col("place")
    prefix = F.repeat(F.lit("> "), F.col("quotes").cast("int"))
    lead = F.when(place == "line", prefix).otherwise("")
    new_line = F.concat(F.lit("\n"), prefix)
    in_pre = F.col("pre") > 0

    raw = F.translate(F.col("value"), _CONTROL, "")
    flat = T.one_blank(raw)
    flowing = (
        F.when(~F.col("filled"), F.when(place == "in", flat).otherwise(""))
        .when(place == "in", flat)
        .otherwise(F.concat(lead, F.ltrim(flat)))
    )
    verbatim = F.when(F.col("quotes") > 0, F.regexp_replace(raw, "\n", F.concat(F.lit("\n"), prefix))).otherwise(raw)
    text = F.when(in_pre, verbatim).otherwise(flowing)

    hashes = F.concat(F.repeat(F.lit("#"), F.substring(name, F.lit(2), F.lit(1)).try_cast("int")), F.lit(" "))
    indent = F.repeat(F.lit("  "), F.greatest(F.col("list_depth") - 1, F.lit(0)).cast("int"))
    bullet = F.coalesce(F.concat(F.col("item_no").cast("string"), F.lit(". ")), F.lit("- "))
    filled = F.col("filled")

    # inside pre the text stands as it is: no emphasis, code or link marks
    def wrap(mark: str) -> Column:
        return F.when(filled & ~in_pre, F.concat(lead, F.lit(mark))).otherwise("")

    start = (
        F.when(name == "li", F.concat(new_line, indent, bullet))
        .when(name.isin(*M.HEADING_TAGS), F.concat(F.when(place == "mark", "").otherwise(new_line), hashes))
        .when(name == "pre", F.concat(new_line, F.lit("```\n"), prefix))
        .when(name.isin(*BLOCKS), F.when(place == "mark", "").otherwise("\n"))
        .when(name.isin("b", "strong"), wrap(BOLD_ON))
        .when(name.isin("i", "em"), wrap(ITALIC_ON))
        .when(name == "code", wrap("`"))
        .when((name == "a") & F.col("value").isNotNull() & ~in_pre, F.concat(lead, F.lit("[")))
    )
    stop = (
        F.when(name == "pre", F.concat(new_line, F.lit("```\n")))
        .when(name.isin(*BLOCKS), "\n")
        .when(name.isin(*CELLS), " ")
        .when(name.isin("b", "strong") & filled & ~in_pre, BOLD_OFF)
        .when(name.isin("i", "em") & filled & ~in_pre, ITALIC_OFF)
        .when((name == "code") & filled & ~in_pre, "`")
        .when((name == "a") & F.col("value").isNotNull() & ~in_pre, F.concat(F.lit("]("), F.col("value"), F.lit(")")))
    )
    single = (
        F.when(name == "br", "\n")
        .when(name == "hr", F.concat(new_line, F.lit("---\n")))
        .when(name == "img", F.concat(lead, F.col("value")))
    )
    piece = F.when(what == "text", text).when(what == "open", start).when(what == "close", stop).when(what == "void", single)
    return F.coalesce(piece, F.lit(""))


def settle_emphasis(md: Column) -> Column:
    """Blanks at the inner edge of an emphasis go outside it, then the marks are written."""
    on, off = BOLD_ON + ITALIC_ON, BOLD_OFF + ITALIC_OFF
    # a run is tried once, from its beginning
    md = F.regexp_replace(md, rf"(?<![{on}])([{on}]++)(\s++)", "$2$1")
    md = F.regexp_replace(md, rf"(?<!\s)(\s++)([{off}]++)", "$2$1")
    md = F.regexp_replace(md, f"[{BOLD_ON}{BOLD_OFF}]", "**")
    return F.translate(md, ITALIC_ON + ITALIC_OFF, "**")


def render_events(events: DataFrame, info: bool = False) -> DataFrame:
    """page_id, markdown (before clean-up), has_content; with info also the page's own columns, and
    content (HTML) when the events carry tags."""
    aggs = [
        settle_emphasis(in_order(F.col("piece"))).alias("markdown"),
        F.coalesce(F.bool_or(F.col("what").isin("open", "void") | ((F.col("what") == "text") & T.not_blank(F.col("value")))), F.lit(False)).alias("has_content"),
    ]
    if "tag" in events.columns:
        aggs.append(T.trim(in_order(html_piece())).alias("content"))
    if info:
        aggs.append(F.max("info").alias("info"))
    return add_context(events).withColumn("piece", markdown_piece()).groupBy("page_id").agg(*aggs)


def render_markdown(fragments: DataFrame) -> DataFrame:
    """Turns content HTML (page_id, html) into Markdown, before clean-up (M1)."""
    return render_events(content_events(fragment_rows(fragments))).select("page_id", "markdown")
