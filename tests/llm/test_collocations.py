import random
import re
from collections import Counter

import pytest

from pagemill.llm.collocations import collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, first, cover):
    """rows: (lang, text). Counts every phrase of one to three words by a plain scan."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        count = f.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                count.update(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        found = []
        candidates = {p: a for p, a in count.items() if " " in p and a >= least}
        for p, a in candidates.items():
            words = p.split(" ")
            if len(words) == 2 and any(
                100 * b >= cover * a for q, b in candidates.items() if q.count(" ") == 2 and (q.startswith(p + " ") or q.endswith(" " + p))
            ):
                continue
            cuts = []
            for k in range(1, len(words)):
                left, right = count[" ".join(words[:k])], count[" ".join(words[k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            found.append((p, a, left, right, n[lang], score))
        found.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, i + 1, *x) for i, x in enumerate(found[:first])]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(
        [(i, lang, t, "a", 1) for i, (lang, t) in enumerate(rows)], "doc_id long, lang string, text string, phrase string, score int"
    )


def got(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert all(kind == "bigint" for name, kind in df.dtypes if name not in ("lang", "phrase"))
    return sorted(tuple(r) for r in df.collect())


def mixed():
    r = random.Random(5)
    words = ["the", "of", "NEW", "york", "é", "Ünder", "x\x00y", "\U0001f600", "a\x1cb"]
    rows = [(r.choice(["en", "de", None, "und"]), "".join(r.choice(words) + r.choice([" ", "\t", "  ", ", ", "\n", ". "]) for _ in range(40))) for _ in range(40)]
    return rows + [("en", None), ("fr", None), (None, ""), ("xx", " .,;\n\t"), ("en", "New York, " * 3000), ("en", "la " * 20_000), ("en", "w" * 100_000)]


@pytest.mark.parametrize("budget", [16, 1 << 20])  # the small one deals out words and pairs by what follows them
def test_against_plain_counts(spark, budget):
    rows = mixed()
    assert got(collocations(table(spark, rows), 4, 30, 50, budget)) == brute(rows, 4, 30, 50)


def test_ties_repeated_rows_and_cover(spark):
    rows = [("en", "a b c")] * 10 + [("en", "a b")] * 10 + [("en", "c d")] * 21 + [("en", "c d e")] * 10 + [("de", "b a")] * 9
    want = brute(rows, 10, 5, 50)
    assert got(collocations(table(spark, rows), 10, 5, 50)) == want
    assert {x[2] for x in want} == {"a b c", "c d", "c d e"}  # a longer phrase covers "a b" and "b c", none covers "c d"


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    from pagemill.llm.collocations import score

    a, left, right = 4_000_000_000_007, 5_000_000_000_001, 6_000_000_000_003
    row = spark.range(1).select(score(F.lit(a), F.lit(left), F.lit(right)).alias("s")).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_empty(spark):
    assert got(collocations(table(spark, []))) == []
