"""Selector lists -> column predicates (E5, E6, U1). Selectors are job settings, so they are literals."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup as M
from ..functions.text import trim

_NAME = re.compile(r"[A-Za-z_][\w.\-]*")
# What parts the tokens of a class attribute.
CLASS_SPACE = r"[ \t\r\n]+"


@dataclass(frozen=True)
class Selector:
    kind: str  # id, class, attr or tag
    key: str
    value: str


def compile_selector(text: str) -> Selector | None:
    """Four forms select something: #id, .class, [attr="value"] and a bare tag. Others give None."""
    text = text.strip(" \t\n\r\0\x0b")
    if text[:1] in ("#", "."):
        # a double quote would break out of the value, and such a selector finds nothing
        if '"' in text:
            return None
        return Selector("id" if text[0] == "#" else "class", "", text[1:])
    found = re.fullmatch(r'\[([^=]+)="([^"]+)"\]', text)
    if found:
        key = found.group(1).strip()
        return Selector("attr", key, found.group(2)) if _NAME.fullmatch(key) else None
    if re.fullmatch(r"[A-Za-z][A-Za-z0-9]*", text):
        return Selector("tag", text, "")
    return None


def compile_selectors(texts: list[str]) -> list[tuple[int, Selector]]:
    """Ranked selectors; the rank is the place in the given list, so skipped ones leave gaps."""
    ranked = ((i, compile_selector(t)) for i, t in enumerate(texts))
    return [(i, s) for i, s in ranked if s is not None]


def compiled_table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """rank, selector, kind, key, value of every given text; kind is null for those that select nothing (E5)."""
    rows = [(i, t, *((c.kind, c.key, c.value) if (c := compile_selector(t)) else (None, None, None))) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "rank int, selector string, kind string, key string, value string")


def selector_test(s: Selector, name: Column, attrs: Column) -> Column:
    if s.kind == "tag":
        return name == s.key
    if s.kind == "id":
        return F.coalesce(M.attr(attrs, "id") == s.value, F.lit(False))
    if s.kind == "attr":
        return F.coalesce(M.attr(attrs, s.key) == s.value, F.lit(False))
    classes = F.regexp_replace(F.coalesce(M.attr(attrs, "class"), F.lit("")), CLASS_SPACE, " ")
    return F.contains(F.concat(F.lit(" "), trim(classes), F.lit(" ")), F.lit(f" {s.value} "))


def first_rank(selectors: list[tuple[int, Selector]], name: Column, attrs: Column) -> Column:
    """Rank of the first selector an element answers to, or null."""
    out = F.lit(None).cast("int")
    for rank, s in reversed(selectors):
        out = F.when(selector_test(s, name, attrs), rank).otherwise(out)
    return out


def any_match(selectors: list[tuple[int, Selector]], name: Column, attrs: Column) -> Column:
    out = F.lit(False)
    tags = [s.key for _, s in selectors if s.kind == "tag"]
    if tags:
        out = name.isin(*tags)
    for _, s in selectors:
        if s.kind != "tag":
            out = out | selector_test(s, name, attrs)
    return out


def element_features(elements: DataFrame) -> DataFrame:
    """page_id, pos, name and kind, key, value of all that a selector may ask of an element, every one once: its tag, its
    id, each of its attributes and each of its class tokens (one empty token where it has none), these with the whole
    row of tokens beside them."""
    attrs, none = F.col("attrs"), F.lit("")

    def feature(kind: str, key: Column, value: Column, tokens: Column = F.lit("")) -> Column:
        return F.struct(F.lit(kind).alias("kind"), key.alias("key"), value.alias("value"), tokens.alias("tokens"))

    classes = trim(F.regexp_replace(F.coalesce(M.attr(attrs, "class"), none), CLASS_SPACE, " "))
    ids = F.filter(F.array(M.attr(attrs, "id")), lambda v: v.isNotNull())
    pairs = F.coalesce(F.map_entries(attrs), F.map_entries(F.create_map().cast("map<string,string>")))
    features = F.concat(
        F.array(feature("tag", F.col("name"), none)),
        F.transform(ids, lambda v: feature("id", none, v)),
        F.transform(pairs, lambda e: feature("attr", e["key"], e["value"])),
        F.transform(F.array_distinct(F.split(classes, " ")), lambda v: feature("class", none, v, classes)),
    )
    return elements.select("page_id", "pos", "name", F.explode(features).alias("f")).select("page_id", "pos", "name", "f.*")


def match_selector_table(elements: DataFrame, table: DataFrame) -> DataFrame:
    """Every (element, selector) pair that matches (E6), for selectors as rows (rank, selector, kind, key, value), as
    compiled_table() gives them: one equi-join of what elements have with what selectors ask, so the plan is the same
    for five selectors and for five thousand. Spark broadcasts the table while it is small.

    A class of several words meets elements on its first one; the words must follow each other in the row of tokens.
    """
    asked = table.where("kind is not null").withColumn("phrase", F.col("value"))
    asked = asked.withColumn("value", F.when(F.col("kind") == "class", F.substring_index("value", " ", 1)).otherwise(F.col("value")))
    blank = F.lit(" ")
    whole = F.contains(F.concat(blank, F.col("tokens"), blank), F.concat(blank, F.col("phrase"), blank))
    met = element_features(elements).join(asked, ["kind", "key", "value"]).where((F.col("kind") != "class") | whole)
    return met.select("page_id", "pos", "name", "rank", "selector")


def match_selectors(elements: DataFrame, texts: list[str]) -> DataFrame:
    """The same for a list of texts; the rank is the place in it. The list is the caller's own and goes to every task, so
    elements are not moved: left to itself, Spark takes a table of a few rows, in few of many partitions, for one
    that is better sorted, and then all elements with it."""
    return match_selector_table(elements, F.broadcast(compiled_table(elements.sparkSession, texts)))
