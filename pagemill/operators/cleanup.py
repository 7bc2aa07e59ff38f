"""Markdown clean-up (M2-M12): one projection of built-in text functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decode_entities, let, trim

_LINE_BREAK = r"\r\n|\n|\r"


def demote_h1(md: Column) -> Column:
    """Top headings go one level down (M3)."""
    return F.regexp_replace(md, r"(?dm)^# ", "## ")


# Text without brackets, then the first '[' up to the next ']' and, if it follows, what stands in parentheses. What is
# never closed takes the rest, so no text is looked at twice, however many brackets it holds.
_BRACKETS = r"[^\[\]]*+(?:\[(?:\]|[^\]]++(?:\](?:\([^)]*+(?:\)|\z))?|\z))|\]|\z)"
_LINK = r"(?s)\A([^\[\]]*+)\[([^\]]++)\]\(([^)]++)\)\z"
_SPACE = " \t\n\x0b\f\r"


def tidy_links(md: Column) -> Column:
    """Blanks just inside link text and target go (M4). Of a text or target of blanks the last one stays."""

    def bare(value: Column) -> Column:
        return let(F.btrim(value, F.lit(_SPACE)), lambda x: F.when(x == "", F.right(value, F.lit(1))).otherwise(x))

    def tidy(piece: Column) -> Column:
        before, text, target = (F.regexp_extract(piece, _LINK, k) for k in (1, 2, 3))
        link = F.concat(before, F.lit("["), bare(text), F.lit("]("), bare(target), F.lit(")"))
        return F.when(piece.endswith(")") & piece.rlike(_LINK), link).otherwise(piece)

    pieces = F.regexp_extract_all(md, F.lit(_BRACKETS), F.lit(0))
    return F.when(md.contains("]("), F.array_join(F.transform(pieces, tidy), "")).otherwise(md)


def drop_empty_images(md: Column) -> Column:
    """Images without target, then without alternative text, then lines of a lone '!' (M5)."""
    # what begins like an image and is none is passed over whole, as no image can begin within it
    md = F.regexp_replace(md, r"!\[[^\]]*+\]\(\s*+\)|(!\[[^\]]*+)", "$1")
    md = F.regexp_replace(md, r"!\[\s*+\]\([^)]++\)|(!\[\s*+\]\([^)]*+)", "$1")
    return F.regexp_replace(md, r"(?dm)^!\s*$", "")


def drop_empty_headings(md: Column) -> Column:
    return F.regexp_replace(md, r"(?dm)^#+\s*$", "")


def drop_empty_links(md: Column) -> Column:
    return F.regexp_replace(md, r"\[\s*\]\([^)]*\)", "")


def dedent_and_rstrip(md: Column) -> Column:
    """No indent before headings and links, no blanks at line ends (M8)."""
    md = F.regexp_replace(md, r"(?dm)^[ \t]+(#+\s)", "$1")
    md = F.regexp_replace(md, r"(?dm)^[ \t]+(\[)", "$1")
    # a run of blanks is tried once, from its beginning
    return F.regexp_replace(md, r"(?dm)(?<![ \t])[ \t]++$", "")


def filled_lines(md: Column) -> Column:
    return F.filter(F.split(md, _LINE_BREAK, -1), lambda line: trim(line) != "")


def drop_blank_lines(md: Column) -> Column:
    return F.array_join(filled_lines(md), "\n")


def _without_repeats(lines: Column) -> Column:
    return let(
        F.transform(lines, lambda line: F.struct(line.alias("line"), trim(line).alias("key"))),
        lambda all_: F.filter(
            all_, lambda x, i: F.coalesce((x["key"] == "") | (x["key"] != F.get(all_, i - 1)["key"]), F.lit(True))
        ).getField("line"),
    )


def dedupe_adjacent_lines(md: Column) -> Column:
    """A line that equals the one before, trimmed, goes; blank lines are left alone."""
    return F.array_join(_without_repeats(F.split(md, _LINE_BREAK, -1)), "\n")


def reflow(md: Column) -> Column:
    """A link after a closing bracket starts a line, a heading gets a blank line before it."""
    md = F.regexp_replace(md, r"\)\s+\[", ")\n[")
    md = F.regexp_replace(md, r"([^\n#])\n(#{1,6} )", "$1\n\n$2")
    return trim(F.regexp_replace(md, r"\n{3,}", "\n\n"))


def clean_markdown(df: DataFrame, demote: Column, col: str = "markdown") -> DataFrame:
    """All steps in their fixed order, on a column of df (M12). demote says whether the page shows its
    title.

    Steps that read their input more than once get a column of their own: nested in one expression,
    each would multiply the work of all before it.
    """
    def step(value: Column) -> None:
        nonlocal df
        df = df.withColumn(col, value)

    md = F.col(col)
    step(decode_entities(md))
    step(F.when(demote, demote_h1(md)).otherwise(md))
    step(filled_lines(dedent_and_rstrip(drop_empty_links(drop_empty_headings(drop_empty_images(tidy_links(md)))))))
    step(reflow(F.array_join(_without_repeats(md), "\n")))
    return df
