"""Element tree -> cleaned main content (E7-E16), without another shuffle.

A subtree is cut with one running maximum: a position lies inside a doomed element exactly when some
doomed element that started at or before it ends after it. No interval join, no self join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import MIN_CONTENT_BYTES, Settings, content_selector_list, excluded_selector_list
from ..functions import markup as M
from ..functions import text as T
from .elements import UP_TO_HERE, close_elements, text_totals
from .selectors import any_match, compile_selectors, first_rank
from .tokens import html_tokens, text_features, token_attrs


def meaningful_text(c: Column) -> Column:
    """At least 50 bytes once white space is collapsed and trimmed."""
    return F.octet_length(T.trim(T.one_blank(c))) >= MIN_CONTENT_BYTES


def page_tree(
    pages: DataFrame, cfg: Settings, page_info: Column | None = None, with_tags: bool = False, co_located: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """Segments with ends, text lengths and what the settings say about each element.

    Attribute maps are read once here and dropped, so they do not travel through the sorts.
    """
    info = F.lit("") if page_info is None else page_info
    tokens = token_attrs(html_tokens(pages, co_located, info, partitions))
    name, attrs = F.col("name"), F.col("attrs")
    wanted = compile_selectors(content_selector_list(cfg))
    body_rank = len(content_selector_list(cfg))
    is_start = F.col("kind").isin("open", "void", "raw")
    empty = F.lit("")
    image = F.concat(
        F.lit("!["), F.coalesce(M.attr(attrs, "alt"), empty), F.lit("]("), F.coalesce(M.attr(attrs, "src"), empty), F.lit(")")
    )
    flags = {
        "rank": F.when(
            F.col("kind") == "open",
            F.coalesce(first_rank(wanted, name, attrs), F.when(name == "body", body_rank)),
        ),
        "excluded": is_start & any_match(compile_selectors(excluded_selector_list(cfg)), name, attrs),
        "hidden": is_start & M.is_hidden(attrs),
        # the link target, or the whole image; bare says that there is none
        "target": F.when(name == "a", M.attr(attrs, "href")).when(name == "img", image),
        "bare": is_start & ~T.not_blank(F.when(name == "a", M.attr(attrs, "href")).otherwise(M.attr(attrs, "src"))),
        "script_href": is_start & M.is_script_href(attrs),
    }
    if with_tags:
        flags["tag_plain"] = F.when(is_start, M.start_tag(name, attrs)).when(F.col("kind") == "comment", F.col("tag"))
        flags["tag_clean"] = F.when(is_start, M.start_tag(name, M.sanitize_attrs(attrs))).otherwise(flags["tag_plain"])
    return close_elements(text_totals(text_features(tokens.withColumns(flags)).drop("tag", "attrs")))


def _candidate() -> Column:
    fits = F.col("rank").isNotNull() & (F.col("text_len") >= MIN_CONTENT_BYTES)
    return F.when(fits, F.struct("rank", "pos", "pend", "hidden"))


def pick_content(tree: DataFrame) -> DataFrame:
    """The content element of each page: first selector, in list order, with an element, in document
    order, of enough text; else the body. No row for a page that has none (E8)."""
    return (
        tree.groupBy("page_id")
        .agg(F.min(_candidate()).alias("best"))
        .where(F.col("best").isNotNull())
        .select("page_id", F.col("best.rank").alias("rank"), F.col("best.pos").alias("pstart"), F.col("best.pend").alias("pend"))
    )


def selector_coverage(tree: DataFrame, cfg: Settings) -> DataFrame:
    """Pages per winning selector; 'none' where nothing qualified."""
    names = content_selector_list(cfg) + ["body (fallback)"]
    label = F.lit("none")
    for i, text in enumerate(names):
        label = F.when(F.col("rank") == i, text).otherwise(label)
    best = tree.groupBy("page_id").agg(F.min(_candidate()).alias("best")).select(F.col("best.rank").alias("rank"))
    return best.groupBy(label.alias("selector")).agg(F.count("*").alias("pages"))


def within_content(tree: DataFrame, any_length: bool = False) -> DataFrame:
    """Keeps the segments of the content element, and one carrier row per page for page_info.

    The content element itself becomes kind 'root': its tag is not part of the result, the text right
    after it is. With any_length, the body is taken whatever its text.
    """
    best = F.when(F.col("name") == "body", F.struct("rank", "pos", "pend", "hidden")) if any_length else _candidate()
    best = F.when(F.col("kind") == "open", best)
    root = F.min(best).over(Window.partitionBy("page_id"))
    pos = F.col("pos")
    inside = (pos >= F.col("root.pos")) & (pos < F.col("root.pend"))
    carrier = ~F.coalesce(F.col("inside"), F.lit(False))
    # ends are known by now, so an end tag without text behind it has nothing more to say
    useful = F.col("kind").isin("open", "void", "raw") | (F.col("txt") != "")
    if "tag_plain" in tree.columns:
        useful = useful | (F.col("kind") == "comment")
    return (
        tree.withColumn("root", root)
        .withColumn("inside", inside)
        .where((F.col("inside") & useful) | F.col("info").isNotNull())
        .withColumns(
            {
                "kind": F.when(carrier, "carrier").when(pos == F.col("root.pos"), "root").otherwise(F.col("kind")),
                "txt": F.when(carrier, "").otherwise(F.col("txt")),
                "has_text": F.col("has_text") & ~carrier,
                "clean": ~F.coalesce(F.col("root.hidden"), F.lit(False)),
            }
        )
        .drop("root", "inside", "rank", "text_len")
    )


def drop_subtrees(rows: DataFrame, doomed: Column) -> DataFrame:
    """Cuts doomed elements with everything in them; the text behind a doomed void element stays."""
    asc = Window.partitionBy("page_id").orderBy("pos").rowsBetween(*UP_TO_HERE)
    is_open, is_leaf = F.col("kind") == "open", F.col("kind").isin("void", "raw")
    cover = F.max(F.when(is_open & doomed, F.col("pend"))).over(asc)
    covered = F.coalesce(cover > F.col("pos"), F.lit(False))
    return (
        rows.withColumn("covered", covered)
        .where(~F.col("covered") | F.col("info").isNotNull())
        .withColumns(
            {
                # a carrier row survives even when its content does not
                "txt": F.when(F.col("covered"), "").otherwise(F.col("txt")),
                "has_text": F.col("has_text") & ~F.col("covered"),
                "kind": F.when(F.col("covered"), "carrier").when(is_leaf & doomed, "gone").otherwise(F.col("kind")),
            }
        )
        .drop("covered")
    )


def drop_excluded_and_hidden(rows: DataFrame) -> DataFrame:
    """E9 and E10 in one pass. Below a hidden content element nothing is sanitised."""
    return drop_subtrees(rows, F.col("excluded") | (F.col("hidden") & F.col("clean")) | (F.col("kind") == "raw"))


def mark_blank(rows: DataFrame) -> DataFrame:
    """blank = no visible text inside: the next text at or after the start is not before the end."""
    desc = Window.partitionBy("page_id").orderBy(F.col("pos").desc()).rowsBetween(*UP_TO_HERE)
    next_text = F.min(F.when(F.col("has_text"), F.col("pos"))).over(desc)
    return rows.withColumn("next_text", next_text).withColumn(
        "blank", F.coalesce(F.col("next_text") >= F.col("pend"), F.lit(True))
    ).drop("next_text")


def clean_targets(rows: DataFrame) -> DataFrame:
    """The link target after E11: a script target is dropped."""
    dropped = F.col("script_href") & F.col("clean")
    return rows.withColumns({"target": F.when(~dropped, F.col("target")), "bare": F.col("bare") | dropped}).drop(
        "script_href", "excluded", "hidden"
    )


def is_empty() -> Column:
    """No text inside, and not a link that leads somewhere."""
    return F.col("name").isin(*M.EMPTY_DROP_TAGS) & F.col("blank") & ((F.col("name") != "a") | F.col("bare"))


def drop_empty_elements(rows: DataFrame) -> DataFrame:
    """E12 and E13. One pass gives what repeating to a fixpoint gives: removing an element without text
    never makes another one empty."""
    return drop_subtrees(rows, is_empty() | ((F.col("name") == "img") & F.col("bare")))


def content_rows(
    pages: DataFrame, cfg: Settings, page_info: Column | None = None, with_tags: bool = False, co_located: bool = False,
    partitions: int | None = None,
) -> DataFrame:
    """What is left of each page, as segments in document order."""
    tree = page_tree(pages, cfg, page_info, with_tags, co_located, partitions)
    return drop_empty_elements(mark_blank(clean_targets(drop_excluded_and_hidden(within_content(tree)))))


def fragment_rows(
    fragments: DataFrame, page_info: Column | None = None, with_tags: bool = False, partitions: int | None = None
) -> DataFrame:
    """Segments of texts that are already content: nothing is picked or cut but raw elements."""
    tree = page_tree(fragments, Settings(excluded_selectors=""), page_info, with_tags, partitions=partitions)
    rows = within_content(tree, any_length=True)
    return mark_blank(clean_targets(drop_subtrees(rows, F.col("kind") == "raw")))


def content_events(rows: DataFrame) -> DataFrame:
    """Start, end and text events in an order that puts every end where the element ends, whether or
    not the page had an end tag. Order: pos, then ends (innermost first), starts, text."""
    html = "tag_plain" in rows.columns

    def event(pos: Column, phase: int, tie: Column, what: str) -> Column:
        return F.struct(pos.alias("pos"), F.lit(phase).alias("phase"), tie.alias("tie"), F.lit(what).alias("what"))

    pos, zero, kind = F.col("pos"), F.lit(0), F.col("kind")
    # a plain array, nulls filtered after the explode: unlike array functions, this is compiled
    leaf = F.when(kind == "void", event(pos, 1, zero, "void"))
    events = F.array(
        F.when(F.col("info").isNotNull(), event(F.lit(-1), 0, zero, "info")),
        F.when(kind == "open", event(pos, 1, zero, "open")).otherwise(
            leaf.when(kind == "comment", event(pos, 1, zero, "comment")) if html else leaf
        ),
        F.when(kind == "open", event(F.col("pend"), 0, -pos, "close")),
        F.when(F.col("txt") != "", event(pos, 2, zero, "text")),
    )
    what, name = F.col("e.what"), F.col("name")
    is_text, is_tag = what == "text", what.isin("open", "close", "void")
    # value: the text, the link target or the whole image; filled: there is visible text in it
    keep = [
        F.when(is_tag, name).alias("name"),
        F.when(is_text, F.col("txt")).otherwise(F.col("target")).alias("value"),
        F.when(is_text, F.col("has_text")).otherwise(~F.col("blank")).alias("filled"),
        F.when(what == "info", F.col("info")).alias("info"),
    ]
    if html:
        tag = F.when(F.col("clean"), F.col("tag_clean")).otherwise(F.col("tag_plain"))
        keep.append(F.when(what.isin("open", "void", "comment"), tag).alias("tag"))
    return rows.withColumn("e", F.explode(events)).where(F.col("e").isNotNull()).select("page_id", "e.pos", "e.phase", "e.tie", "e.what", *keep)


def in_order(piece: Column) -> Column:
    """Aggregate: all non-empty pieces of a page, in event order, as one text."""
    filled = F.when(piece != "", F.struct("pos", "phase", "tie", piece.alias("piece")))
    return F.array_join(F.sort_array(F.collect_list(filled)).getField("piece"), "")


def html_piece() -> Column:
    what = F.col("what")
    return (
        F.when(what == "text", F.col("value"))
        .when(what == "close", F.concat(F.lit("</"), F.col("name"), F.lit(">")))
        .when(what == "info", F.lit(""))
        .otherwise(F.col("tag"))
    )


def inner_html(events: DataFrame) -> DataFrame:
    """Content written back as HTML, trimmed (E14); '' for a page without content."""
    return events.groupBy("page_id").agg(T.trim(in_order(html_piece())).alias("content"))


def extract_content(pages: DataFrame, cfg: Settings, co_located: bool = False, partitions: int | None = None) -> DataFrame:
    """page_id, content: the cleaned main content of each page as HTML, '' where there is none."""
    return inner_html(content_events(content_rows(pages, cfg, with_tags=True, co_located=co_located, partitions=partitions)))
