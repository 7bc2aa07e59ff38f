"""Segments -> element tree in interval form (E3): each start tag gets the position where it ends.

Rules for tags that are left out:
  * a box (div, article, ul, h1 ...) ends at its own end tag, found per name by running balance; if
    it has none, at the end of the box around it;
  * an item (li, td, tr ...) ends at the next item of its level, or with the box around it;
  * a paragraph ends at the next paragraph, item or box boundary;
  * an inline element ends at its own end tag, but never outside the paragraph, item or box it is in.

All windows are partitioned by page_id first, so the page shuffle serves every one of them; what
changes is only the order inside a partition. Frames look backward or, in descending order, forward:
both are single running passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import markup as M

UP_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
BEFORE_HERE = (Window.unboundedPreceding, -1)


def _last(value: Column) -> Column:
    return F.last(value, ignorenulls=True)


def _item_level(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for level, tags in M.ITEM_LEVELS.items():
        out = F.when(name.isin(*tags), level).otherwise(out)
    return out


# A position and the text size before it, packed into one bigint: comparing two of them compares the
# positions, and 8 bytes per value keep the many sorted rows narrow. Size = bytes that are not blank
# plus words, both below 2^31 as a text cell is.
def _pack(pos: Column, size: Column) -> Column:
    return F.shiftleft(pos.cast("bigint"), 32).bitwiseOR(size)


def _pos_of(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def _size_of(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit(2**32 - 1))


def text_totals(features: DataFrame) -> DataFrame:
    """Adds here and page_end (packed position and text size before it) and straddles (a word runs
    across this position without a blank)."""
    asc = Window.partitionBy("page_id").orderBy("pos")
    desc = Window.partitionBy("page_id").orderBy(F.col("pos").desc())
    whole = Window.partitionBy("page_id")
    joined = F.coalesce(F.col("open_before") & F.col("opens_word"), F.lit(False))
    return (
        features.withColumn("opens_next", _last(F.col("opens_word")).over(desc.rowsBetween(*UP_TO_HERE)))
        .withColumn("open_before", _last(F.col("ends_word")).over(asc.rowsBetween(*BEFORE_HERE)))
        .withColumn("starts", F.col("wc") - joined.cast("bigint"))
        .withColumn("size", F.col("nb") + F.col("starts"))
        .withColumns(
            {
                "here": _pack(F.col("pos"), F.coalesce(F.sum("size").over(asc.rowsBetween(*BEFORE_HERE)), F.lit(0))),
                "straddles": F.coalesce(F.col("open_before") & F.col("opens_next"), F.lit(False)),
                "page_end": _pack(F.max("pos").over(whole) + 1, F.sum("size").over(whole)),
            }
        )
        .drop("opens_next", "open_before", "opens_word", "ends_word", "nb", "wc", "starts", "size")
    )


def close_elements(rows: DataFrame) -> DataFrame:
    """Adds pend (where the element ends) and text_len (bytes of its text, blanks collapsed).

    Needs page_id, pos, kind, name and the columns of text_totals. Other columns pass through.
    """
    kind, name = F.col("kind"), F.col("name")
    opening, closing = kind == "open", kind == "close"
    edge = opening | closing

    marked = rows.withColumns(
        {
            "level": F.when(edge, _item_level(name)),
            "is_box": edge & name.isin(*M.BOX_TAGS),
            "is_p": edge & (name == "p"),
        }
    ).withColumn("pair_name", F.when(edge & F.col("level").isNull() & ~F.col("is_p"), name))

    by_name = Window.partitionBy("page_id", "pair_name").orderBy("pos")
    step = F.when(opening, 1).when(closing, -1).otherwise(0)
    paired = marked.withColumn("balance", F.sum(step).over(by_name.rowsBetween(*UP_TO_HERE))).withColumn(
        "depth_of_name", F.when(closing, F.col("balance") + 1).otherwise(F.col("balance"))
    )
    by_depth = Window.partitionBy("page_id", "pair_name", "depth_of_name").orderBy("pos")
    named = F.col("pair_name").isNotNull()
    paired = paired.withColumns(
        {"after": F.lead(F.struct("kind", "here")).over(by_depth), "prior": F.lag("kind").over(by_depth)}
    ).withColumns(
        {
            "own_end": F.when(named & opening & (F.col("after.kind") == "close"), F.col("after.here")),
            "ends_one": named & closing & F.coalesce(F.col("prior") == "open", F.lit(False)),
        }
    ).drop("after", "prior", "balance", "depth_of_name", "pair_name")

    # box depth counts matched pairs only, so one missing end tag does not shift the rest of the page
    asc = Window.partitionBy("page_id").orderBy("pos")
    full_box = F.col("is_box") & opening & F.col("own_end").isNotNull()
    box_end = F.col("is_box") & F.col("ends_one")
    depth = F.sum(F.when(full_box, 1).when(box_end, -1).otherwise(0)).over(asc.rowsBetween(*UP_TO_HERE))
    deep = paired.withColumn(
        "depth", depth + F.when(full_box, -1).when(box_end, 1).otherwise(0)
    )  # depth around the tag itself: outside for a start, inside for an end

    later = Window.partitionBy("page_id", "depth").orderBy(F.col("pos").desc()).rowsBetween(*BEFORE_HERE)
    item = F.col("level").isNotNull()
    boundary = F.col("is_p") | item | (F.col("is_box") & opening) | box_end
    nexts = {
        "next_box_end": _last(F.when(box_end, F.col("here"))).over(later),
        "next_block": _last(F.when(boundary, F.col("here"))).over(later),
    }
    for lv in M.ITEM_LEVELS:
        nexts[f"next_item{lv}"] = _last(F.when(F.col("level") <= lv, F.col("here"))).over(later)
    deep = deep.withColumns(nexts)

    page_end = F.col("page_end")
    any_item = F.col(f"next_item{max(M.ITEM_LEVELS)}")
    item_end = F.lit(None)
    for lv in M.ITEM_LEVELS:
        item_end = F.when(F.col("level") == lv, F.least(F.col(f"next_item{lv}"), F.col("next_box_end"), page_end)).otherwise(item_end)
    end = (
        F.when(F.col("is_p"), F.least(F.col("next_block"), page_end))
        .when(item, item_end)
        .when(F.col("is_box"), F.coalesce(F.col("own_end"), F.least(F.col("next_box_end"), page_end)))
        .otherwise(F.least(F.col("own_end"), any_item, F.col("next_box_end"), page_end))
    )
    ended = deep.withColumn("end", F.when(opening, end))

    # an inline element inside an open paragraph ends with it
    p_end = _last(F.when(F.col("is_p") & opening, F.col("end"))).over(asc.rowsBetween(*BEFORE_HERE))
    inline = opening & ~F.col("is_p") & ~F.col("is_box") & ~item
    ended = ended.withColumn("p_end", p_end).withColumn(
        "end",
        F.when(inline & (_pos_of(F.col("p_end")) > F.col("pos")), F.least(F.col("end"), F.col("p_end"))).otherwise(F.col("end")),
    )
    inside = _size_of(F.col("end")) - _size_of(F.col("here"))
    length = F.when(inside > 0, inside + F.col("straddles").cast("bigint") - 1).otherwise(0)
    return ended.withColumns(
        {
            "pend": F.when(opening, _pos_of(F.col("end"))).when(kind.isin("void", "raw"), F.col("pos")),
            "text_len": F.when(opening, length),
        }
    ).drop(
        "here", "level", "is_box", "is_p", "own_end", "ends_one", "depth", "next_box_end", "next_block",
        "next_item1", "next_item2", "next_item3", "end", "p_end", "straddles", "page_end",
    )


def html_elements(tokens: DataFrame) -> DataFrame:
    """Element table: page_id, pos (start), pend (end), name, kind, attrs, text_len."""
    from .tokens import text_features, token_attrs

    tree = close_elements(text_totals(text_features(token_attrs(tokens))))
    return tree.where(F.col("pend").isNotNull()).select("page_id", "pos", "pend", "name", "kind", "attrs", "text_len")
