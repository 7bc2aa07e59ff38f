"""Phrases whose words stand together more often than their parts would, by suffix subtrees of bounded depth.

Texts are split into pieces at punctuation and line ends and pieces into words. Every place of a piece begins a suffix,
cut off after three words; the suffixes of all places, as paths of a tree, hold every phrase of up to three words. The
tree is never built whole. It is partitioned from the top, as in ERA: words are counted, and what begins with one word
goes to one group, a hash of that word. A word that begins more suffixes than half a group may hold is dealt by its
first two words instead, and a pair that still begins too many by all three. So the number of groups follows from the
number of words and a group fits its budget, however frequent a word or a pair is. Each group builds its own subtree
and gives the totals of leaves and inner nodes that are frequent enough; nodes whose children are dealt out are added up.

The words of a document are visited three times (words, pairs behind frequent words, suffixes); only counts move.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, map_batches, parallelism, pieces

# What splits a text into pieces; A to Z become a to z in the same pass. Bytes of other characters stay.
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_PIECES = bytes.maketrans(SEPARATORS + _UPPER, b"\n" * len(SEPARATORS) + _LOWER)
#: Different entries that a task counts before it hands them on: bounds memory, not results.
HELD = 250_000
#: At most so many groups, so that the prefixes dealt out, two for a group at most, stay a list the driver can hold.
MOST_GROUPS = 1_000_000

SUFFIXES = "grp long, lang string, heads binary, tails binary, counts binary"
NODES = "lang string, words int, phrase binary, f long"


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of each piece of a text in UTF-8, lower case; split() of bytes knows blanks and tabs only here."""
    for piece in text.translate(_PIECES).split(b"\n"):
        words = piece.split()
        if words:
            yield words


def texts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Language and text of each row of (lang, text)."""
    for batch in pieces(batches, "text"):
        yield from zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True)


def languages_and_texts(documents: DataFrame) -> DataFrame:
    return documents.where("text is not null").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def count_words(documents: DataFrame) -> DataFrame:
    """lang, word (UTF-8) and how often it occurs."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[bytes]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())],
                    ["lang", "word", "f"],
                )
            counts.clear()

        for lang, text in texts(batches):
            found = counts.setdefault(lang, Counter())
            found.update(text.translate(_PIECES).split())  # a line end parts words too
            if len(found) > HELD:
                yield from rows()
        yield from rows()

    rows = map_batches(languages_and_texts(documents), work, "lang string, word binary, f long")
    return rows.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def frequent_pairs(documents: DataFrame, heavy: dict[str, frozenset[bytes]], least: int, total: int) -> DataFrame:
    """lang, w1, w2 of pairs that begin with a word in `heavy` and occur more than `least` times, and perhaps some of
    those above a half of that.

    A task leaves out pairs that are rare among the words it counted. What is left out of a pair adds up to a quarter of
    `least` at most, however the table is cut, as the shares of all tasks add up to one.
    """
    if not heavy:
        return documents.sparkSession.createDataFrame([], "lang string, w1 binary, w2 binary")
    share = least / (4 * total)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter[tuple[bytes, bytes]]] = {}
        seen = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, found in counts.items():
                often = [(p, n) for p, n in found.items() if n > share * seen]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(often), pa.string()), *(pa.array([p[i] for p, _ in often], pa.binary()) for i in (0, 1)),
                     pa.array([n for _, n in often], pa.int64())],
                    ["lang", "w1", "w2", "f"],
                )
            counts.clear()

        for lang, text in texts(batches):
            found, first = counts.setdefault(lang, Counter()), heavy.get(lang, frozenset())
            for words in words_of(text):
                seen += len(words)
                found.update(compress(zip(words, words[1:]), map(first.__contains__, words)))
            if len(found) > HELD:
                yield from rows()
                seen = 0
        yield from rows()

    rows = map_batches(languages_and_texts(documents), work, "lang string, w1 binary, w2 binary, f long")
    return rows.groupBy("lang", "w1", "w2").agg(F.sum("f").alias("f")).where(F.col("f") > least * 3 // 4).drop("f")


def suffixes(documents: DataFrame, heavy: dict[str, frozenset[bytes]], pairs: dict[str, frozenset[tuple[bytes, bytes]]], groups: int) -> DataFrame:
    """The cut suffixes of all places, counted within a task and packed by group and language.

    heads: lines "w1 w2", or "w1" where the piece ends; tails: lines "w3", or empty ones; counts: 32-bit integers; all
    compressed.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def rows(lang: str, found: Counter) -> Iterator[pa.RecordBatch]:
            name, often, dealt = lang.encode() + b"\n", heavy.get(lang, frozenset()), pairs.get(lang, frozenset())
            of_word: dict[bytes, tuple[list, list, list]] = {}
            packed: dict[int, tuple[list, list, list]] = {}

            def slot(prefix: bytes) -> tuple[list, list, list]:
                return packed.setdefault(zlib.crc32(name + prefix) % groups, ([], [], []))

            for path, n in found.items():
                at = of_word.get(path[0])
                if at is None:
                    if path[0] not in often:
                        at = of_word[path[0]] = slot(path[0])
                    else:
                        at = slot(b" ".join(path if path[:2] in dealt else path[:2]))
                at[0].append(b"%b %b" % path[:2] if len(path) > 1 else path[0])
                at[1].append(path[2] if len(path) > 2 else b"")
                at[2].append(n)
            found.clear()
            lines = lambda x: zlib.compress(b"\n".join([*x, b""]), 1)
            done = [(g, lines(h), lines(t), zlib.compress(np.array(n, "<i4").tobytes(), 1)) for g, (h, t, n) in packed.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in done], pa.int64()), pa.array([lang] * len(done), pa.string()),
                 *(pa.array([x[i] for x in done], pa.binary()) for i in (1, 2, 3))],
                ["grp", "lang", "heads", "tails", "counts"],
            )

        counts: dict[str, Counter] = {}
        for lang, text in texts(batches):
            found = counts.setdefault(lang, Counter())
            for w in words_of(text):
                found.update(zip(w, w[1:], w[2:]))
                found[tuple(w[-2:])] += 1
                if len(w) > 1:
                    found[(w[-1],)] += 1
            if len(found) > HELD:
                yield from rows(lang, found)
        for lang, found in counts.items():
            yield from rows(lang, found)

    return map_batches(languages_and_texts(documents), work, SUFFIXES)


def lines_of(blocks: list[bytes]) -> pa.Array:
    """The lines of compressed blocks as they are, each with its line end."""
    import numpy as np

    data = b"".join(map(zlib.decompress, blocks))
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10) + 1
    offsets = np.concatenate(([0], ends)).astype("<i8")
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def subtree(heads: list[bytes], tails: list[bytes], counts: list[bytes], least: int) -> tuple[pa.Table, pa.Table]:
    """Totals (f) of the leaves of three words, `least` or more, and of all inner nodes of two words; columns head, tail
    and f, lines with their ends.

    Leaves are added up by path. An inner node's total is that of the leaves below it and of the suffixes that end there.
    """
    import numpy as np

    n = np.concatenate([np.frombuffer(zlib.decompress(block), "<i4") for block in counts]).astype(np.int64)
    paths = pa.table({"head": lines_of(heads), "tail": lines_of(tails), "f": n})
    paths = paths.filter(pc.match_substring(paths.column("head"), " "))
    leaves = paths.group_by(["head", "tail"]).aggregate([("f", "sum")]).rename_columns(["head", "tail", "f"])
    inner = leaves.group_by("head").aggregate([("f", "sum")]).rename_columns(["head", "f"])
    whole = pc.greater(pc.binary_length(leaves.column("tail")), 1)
    return leaves.filter(pc.and_(whole, pc.greater_equal(leaves.column("f"), least))), inner


def frequent_nodes(packed: DataFrame, pairs: dict[str, frozenset[tuple[bytes, bytes]]], least: int) -> DataFrame:
    """lang, words (2 or 3), phrase and its count f, `least` or more, from the subtrees of the groups in `packed`."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes(lang: str, *blocks: list[bytes]) -> Iterator[pa.RecordBatch]:
            leaves, inner = subtree(*blocks, least)
            dealt = pa.array([b" ".join(p) + b"\n" for p in pairs.get(lang, ())], pa.large_binary())
            # a pair dealt out by its third word has a part of its total in each of several groups
            inner = inner.filter(pc.or_(pc.greater_equal(inner.column("f"), least), pc.is_in(inner.column("head"), value_set=dealt)))
            threes = [(3, h[:-1] + b" " + t[:-1], n) for h, t, n in zip(*(c.to_pylist() for c in leaves.columns), strict=True)]
            found = threes + [(2, h[:-1], n) for h, n in zip(*(c.to_pylist() for c in inner.columns), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int32()),
                 pa.array([x[1] for x in found], pa.binary()), pa.array([x[2] for x in found], pa.int64())],
                ["lang", "words", "phrase", "f"],
            )

        now, held = None, ([], [], [])
        for batch in batches:
            for g, lang, *blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (g, lang):
                    if now:
                        yield from nodes(now[1], *held)
                    now, held = (g, lang), ([], [], [])
                for column, block in zip(held, blocks, strict=True):
                    column.append(block)
        if now:
            yield from nodes(now[1], *held)

    spark = packed.sparkSession
    dealt = packed.repartition(parallelism(spark), "grp").sortWithinPartitions("grp", "lang")
    rows = map_batches(dealt, work, NODES)
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def exact(c: Column) -> Column:
    return c.cast("decimal(13,0)")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1,000,000 a a / (left right)), exact for counts of up to thirteen digits."""
    million = F.lit(1_000_000).cast("decimal(7,0)")
    a, left, right = exact(a), exact(left), exact(right)
    return F.call_function("div", a * a * million, left * right)


def phrase_counts(documents: DataFrame, least: int = 10, budget: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f) of all words, and (lang, words, phrase, f) of phrases of two and three words with f of `least` or
    more; words and phrases in UTF-8. `budget` is how many suffixes a group may hold, of which there are MOST_GROUPS at
    most; it says how finely work is dealt out, results don't depend on it."""
    words = checkpointed(count_words(documents))
    total = words.agg(F.sum("f")).first()[0] or 0
    budget = max(budget, 2 * total // MOST_GROUPS)
    groups = 1 + 2 * total // budget
    heavy = grouped(words.where(F.col("f") > budget // 2), "word")
    pairs = grouped(frequent_pairs(documents, heavy, budget // 2, total), "w1", "w2")
    return words, checkpointed(frequent_nodes(suffixes(documents, heavy, pairs, groups), pairs, least))


def grouped(rows: DataFrame, *columns: str) -> dict[str, frozenset]:
    """The prefixes in `rows` by language; as each is more than half a group's budget, two for a group at most."""
    found: dict[str, set] = {}
    for row in rows.select("lang", *columns).collect():
        values = tuple(bytes(v) for v in row[1:])
        found.setdefault(row[0], set()).add(values if len(values) > 1 else values[0])
    return {lang: frozenset(x) for lang, x in found.items()}


def collocations(documents: DataFrame, least: int = 10, first: int = 2000, cover: int = 50, budget: int = 1 << 20) -> DataFrame:
    """The `first` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases are two or three words that stand together within a piece `least` times or more (a). A cut after the first
    word, or the second, gives parts with counts l and r and a score floor(1,000,000 a a / (l r)); the cut with the
    lowest score counts, the earlier one at ties. A phrase is dropped if a longer one that holds its words, itself
    dropped or not, occurs `cover` percent as often or more. n is the number of all words of the language. Phrases are
    ordered by score and a, both descending, then by the bytes of the phrase.

    Null texts hold no word; a null lang counts as "und" and is one with rows named so. Rows count one by one, repeated
    or not, whatever their doc_id. Other columns don't matter; an empty table gives an empty result.
    """
    words, nodes = phrase_counts(documents, least, budget)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    word = words.where(F.col("f") >= least).select("lang", F.col("word").cast("string").alias("w"), "f")
    named = nodes.select("lang", "words", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"))
    blank = F.lit(" ")

    twos = named.where("words = 2").select(
        "lang", "phrase", "a", F.substring_index("phrase", " ", 1).alias("w1"), F.substring_index("phrase", " ", -1).alias("w2")
    )
    twos = twos.join(word.toDF("lang", "w1", "f1"), ["lang", "w1"]).join(word.toDF("lang", "w2", "f2"), ["lang", "w2"])
    twos = checkpointed(twos.select("lang", "phrase", "a", "f1", "f2"))
    threes = named.where("words = 3").select(
        "lang", "phrase", "a", F.substring_index("phrase", " ", 2).alias("head"), F.substring_index("phrase", " ", -2).alias("tail")
    )
    heads = twos.select("lang", F.col("phrase").alias("head"), F.col("a").alias("f12"), "f1")
    tails = twos.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("f23"), F.col("f2").alias("f3"))
    cut1, cut2 = score(F.col("a"), F.col("f1"), F.col("f23")), score(F.col("a"), F.col("f12"), F.col("f3"))
    cuts = threes.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).select(
        "lang", "phrase", "a", "head", "tail",
        F.least(F.struct(cut1.alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")),
                F.struct(cut2.alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r"))).alias("cut"),
    )
    cuts = checkpointed(cuts)
    longer = cuts.select("lang", F.explode(F.array("head", "tail")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    alone = twos.join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < cover * F.col("a"), F.lit(True)))
    both = alone.select(
        "lang", "phrase", "a", F.col("f1").alias("l"), F.col("f2").alias("r"), score(F.col("a"), F.col("f1"), F.col("f2")).alias("score")
    ).unionByName(cuts.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # the first of each of 64 parts of a language, then the first of those: no task sorts a whole language
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(F.desc("score"), F.desc("a"), "phrase")
    ahead = both.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= first)
    top = ahead.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return top.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


#: The same in plain SQL, phrase by phrase.
SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)),
f AS (SELECT lang, k, array_to_string(ws[i : i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, ws, unnest(range(1, k)) AS cut FROM c),
scored AS (SELECT cuts.lang, cuts.k, cuts.phrase, a, cut, lf.f AS l, rf.f AS r,
                  (1000000::HUGEINT * a * a // (lf.f::HUGEINT * rf.f))::BIGINT AS score
           FROM cuts JOIN f lf ON lf.lang = cuts.lang AND lf.phrase = array_to_string(ws[1 : cut], ' ')
                     JOIN f rf ON rf.lang = cuts.lang AND rf.phrase = array_to_string(ws[cut + 1 : cuts.k], ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, unnest([array_to_string(ws[1 : 2], ' '), array_to_string(ws[2 : 3], ' ')]) AS phrase, a FROM c WHERE k = 3),
covered AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
stay AS (SELECT best.* FROM best LEFT JOIN covered USING (lang, phrase) WHERE best.k = 3 OR most IS NULL OR 100 * most < 50 * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM stay)
SELECT r.lang, rank, phrase, a, l, r.r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
