"""Column helpers for text: trimming, tag stripping, entity decoding. All stay in the JVM."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters an ASCII trim removes.
TRIM_CHARS = " \t\n\r\0\x0b"
# White space in the Unicode sense, spelled out because that is faster than (?U)\s.
SPACE_CLASS = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# A run of white space that is not already one blank, so that plain prose causes no replacements. The
# look-ahead rules most letters out with three comparisons before the full class is tried.
_MAYBE_SPACE = r"(?=[\t-\r\x{85}-\x{a0}\x{1680}-\x{3000}])"
UNEVEN_SPACE = rf" [{SPACE_CLASS}]+|{_MAYBE_SPACE}[{SPACE_CLASS}]+"

ENTITY_RE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
# Names that need no table.
EVERYDAY_ENTITIES = (
    ("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", "\u00a0"), ("copy", "\u00a9"),
    ("middot", "\u00b7"), ("amp", "&"),
)
_OTHER_ENTITY_RE = (
    r"&(?!(?:" + "|".join(n for n, _ in EVERYDAY_ENTITIES) + r");)(?:#[0-9]+;|#[xX][0-9a-fA-F]+;|[A-Za-z][A-Za-z0-9]*;)"
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once. An expression that a lambda takes from outside is computed
    again for every element; the parameter of an enclosing lambda is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIM_CHARS))


def not_blank(c: Column) -> Column:
    """True where the text has more than ASCII blanks; null counts as blank."""
    return F.coalesce(trim(c) != "", F.lit(False))


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, r"<[^>]*>", "")


def strip_markup(c: Column) -> Column:
    """Tags go, and script/style go with their body."""
    return strip_tags(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", ""))


def clean_value(c: Column) -> Column:
    """A request value: missing becomes '', tags are stripped, blanks trimmed."""
    return trim(strip_tags(F.coalesce(c, F.lit(""))))


def one_blank(c: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(c, UNEVEN_SPACE, " ")


# Code of the first character of names less 65 is the row, that of the second less 47 (0: none) the column of the table.
_ROWS, _COLUMNS = ord("z") - 64, ord("z") - 46


def _rare_entity(name: Column) -> Column:
    """What a named entity stands for, null for an unknown name.

    The names come from the Python standard library. A map is searched from its beginning, so they are dealt to some
    small ones by their first two characters, and the place of a name's map in the table is computed. The table is
    folded to one literal at planning time.
    """
    table: list[dict[str, str]] = [{} for _ in range(_ROWS * _COLUMNS)]
    for key, value in html5.items():
        if key.endswith(";"):
            second = ord(key[1]) - 47 if len(key) > 2 else 0
            table[(ord(key[0]) - 65) * _COLUMNS + second][key[:-1]] = value
    maps = F.from_json(F.lit(json.dumps(table)), "array<map<string,string>>")
    second = F.greatest(F.ascii(F.substring(name, 2, 1)) - 47, F.lit(0))
    return F.try_element_at(F.get(maps, (F.ascii(name) - 65) * _COLUMNS + second), name)


def _code_point(code: Column) -> Column:
    # chr() only covers one byte, so build UTF-8 by hand from the code point
    utf32 = F.lpad(F.hex(code), 8, "0")
    return F.decode(F.unhex(utf32), "UTF-32")


def _one_entity(e: Column) -> Column:
    name = F.substring(e, F.lit(2), F.length(e) - 2)
    digits = F.lower(F.substring(name, F.lit(2), F.length(name)))
    is_hex = digits.startswith("x")
    # leading zeros, however many, say nothing; more than 18 digits are no code point
    plain = F.ltrim(F.ltrim(digits, F.lit("x")), F.lit("0"))
    code = F.when(F.length(plain) > 18, F.lit(-1).cast("bigint")).when(
        is_hex, F.conv(plain, 16, 10).try_cast("bigint")
    ).otherwise(F.coalesce(plain.try_cast("bigint"), F.lit(0).cast("bigint")))
    allowed = (
        code.between(32, 126)
        | code.isin(9, 10, 12)
        | code.between(160, 0xD7FF)
        | code.between(0xE000, 0x10FFFF)
    )
    # The everyday names are looked up first, the rest in the full table.
    return (
        F.when(e == "&amp;", "&")
        .when(e == "&quot;", '"')
        .when(e == "&lt;", "<")
        .when(e == "&gt;", ">")
        .when(e == "&nbsp;", " ")
        .when(e == "&apos;", "'")
        .when(name.startswith("#"), F.when(allowed, _code_point(code)).otherwise(e))
        .otherwise(F.coalesce(_rare_entity(name), e))
    )


def decode_entities(c: Column) -> Column:
    """HTML5 named and numeric entities, once; only those closed by ';' count (M2)."""
    # the text between entities, each piece with the entity after it
    pieces = F.arrays_zip(F.split(c, ENTITY_RE, -1), F.regexp_extract_all(c, F.lit(ENTITY_RE), F.lit(0)))
    joined = F.array_join(
        F.transform(pieces, lambda z: F.concat(z["0"], F.coalesce(_one_entity(z["1"]), F.lit("")))), ""
    )
    # Plain replacement is enough, and much faster, where only everyday names occur; & comes last.
    plain = c
    for name, value in EVERYDAY_ENTITIES:
        plain = F.replace(plain, F.lit(f"&{name};"), F.lit(value))
    return F.when(~c.contains("&"), c).when(~c.rlike(_OTHER_ENTITY_RE), plain).otherwise(joined)


def first_words(c: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(trim(c), r"\s+"), 1, n), " ")
