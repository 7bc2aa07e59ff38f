"""Removal of repeated passages, line by line.

Three consecutive lines that hold a word form a window; windows overlap, and blank lines between belong to them. A
window that also begins at an earlier place, in any document or in its own, is a repeat, and every line that a repeat
covers is removed. Places are ordered by doc_id (null first), then text, then line. The first place of a window is found with
partial sums before the exchange, so a passage in a third of all rows is no hot group; the join back to windows is an
ordinary inner join, which Spark deals anew where a key is frequent.

Rows equal in doc_id and text are one document: all of them get the same result. A null text stays null; texts with
fewer than three lines with a word stay as they are; a text that is all repeats becomes empty. Other columns, of
whatever name, are kept. An empty table gives an empty result. Windows are told apart by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

BLANKS = " \t\n\x0b\x0c\r"


def windows(text: Column) -> Column:
    """Structs of two hashes and the first and last line of each window, lines counted from 0."""

    def of(lines: Column) -> Column:
        numbered = F.transform(lines, lambda x, i: F.struct(x.alias("line"), i.alias("i")))
        full = F.filter(numbered, lambda x: F.btrim(x.line, F.lit(BLANKS)) != "")

        def build(f: Column) -> Column:
            def window(x: Column, k: Column) -> Column:
                parts = (x.line, F.get(f, k + 1).line, F.get(f, k + 2).line)
                return F.struct(
                    F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2"),
                    x.i.alias("a"), F.get(f, k + 2).i.alias("b"),
                )

            return F.when(F.size(f) >= 3, F.transform(F.slice(f, F.lit(1), F.size(f) - 2), window))

        return let(full, build)

    return let(F.split(text, "\n"), of)


def repeated_windows(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, and the lines a..b of every window that is not the first of its kind."""
    w = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(windows(F.col("text"))).alias("w")).select(
        "doc_id", "text_hash", "w.*"
    )
    place = F.struct("doc_id", "text_hash", "a")
    firsts = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first != last")
    return w.join(firsts.drop("last"), ["h1", "h2"]).where(~place.eqNullSafe(F.col("first"))).select("doc_id", "text_hash", "a", "b")


def without(lines: Column, spans: Column) -> Column:
    """`lines` but for those in `spans`, structs a..b in ascending order, overlapping or not."""

    def after(span: Column, i: Column) -> Column:
        end = F.coalesce(F.get(spans, i + 1).a, F.size(lines))
        return F.slice(lines, span.b + 2, F.greatest(F.lit(0), end - span.b - 1))

    head = F.slice(lines, F.lit(1), F.get(spans, F.lit(0)).a)
    return F.flatten(F.concat(F.array(head), F.transform(spans, after)))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """`row` (all columns of `documents`, as a struct), text without repeats, n_lines and n_removed."""
    spans = (
        repeated_windows(documents.select("doc_id", "text"))
        .groupBy(F.col("doc_id").alias("k1"), F.col("text_hash").alias("k2"))
        .agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))
    )
    rows = documents.select(F.struct(*(documents[f"`{c}`"].alias(c) for c in documents.columns)).alias("row"))
    joined = rows.join(spans, F.col("row.doc_id").eqNullSafe(F.col("k1")) & (F.xxhash64("row.text") == F.col("k2")), "left")
    text = F.col("row.text")

    def cut(lines: Column) -> Column:
        def build(s: Column) -> Column:
            return let(without(lines, s), lambda kept: F.struct(
                F.array_join(kept, "\n").alias("text"), F.size(lines).alias("n_lines"),
                (F.size(lines) - F.size(kept)).alias("n_removed"),
            ))

        same = F.struct(text.alias("text"), F.size(lines).alias("n_lines"), F.lit(0).alias("n_removed"))
        return F.when(F.col("spans").isNull(), same).otherwise(let(F.col("spans"), build))

    none = F.struct(text.alias("text"), F.lit(0).alias("n_lines"), F.lit(0).alias("n_removed"))
    out = F.when(text.isNull(), none).otherwise(let(F.split(text, "\n"), cut))
    return joined.select("row", out.alias("out")).select("row", "out.text", F.col("out.n_lines").cast("long").alias("n_lines"), F.col("out.n_removed").cast("long").alias("n_removed"))


#: The same in plain SQL, on the lines themselves.
SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM d),
f AS (SELECT doc_id, text, i AS a, line AS x, lead(line) OVER w AS y, lead(line, 2) OVER w AS z, lead(i, 2) OVER w AS b
      FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '' WINDOW w AS (PARTITION BY doc_id, text ORDER BY i)),
r AS (SELECT doc_id, text, a, b FROM (
        SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id NULLS FIRST, text, a) AS n FROM f WHERE b IS NOT NULL) WHERE n > 1),
c AS (SELECT DISTINCT doc_id, text, unnest(range(a, b + 1)) AS i FROM r),
k AS (SELECT l.doc_id, l.text, coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '') AS kept,
             count(*) AS n_lines, count(c.i) AS n_removed
      FROM l LEFT JOIN c ON l.doc_id IS NOT DISTINCT FROM c.doc_id AND l.text = c.text AND l.i = c.i GROUP BY 1, 2)
SELECT documents.doc_id, kept AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN k ON documents.doc_id IS NOT DISTINCT FROM k.doc_id AND documents.text = k.text
"""
