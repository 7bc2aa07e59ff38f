import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pagemill.llm.packing import pack
from pagemill.llm.simhash import keep_one

from .conftest import ODD
from .test_linededup import brute as lines_left
from .test_simhash import plain_components, plain_fingerprint
from .test_suffixdedup import brute as bytes_left

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, docs, sf).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.orderBy("doc_id").collect()]


def test_columns_and_order(stages, spark, sf):
    assert len(corpus_pipeline.STAGES) == 5
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes
    for before, after in stages[:3]:
        assert after.where("n_chars != char_length(text)").isEmpty()


def test_quality_keeps_what_the_query_keeps(stages, spark, sf):
    from pagemill.llm.catalog import op1_quality_rules

    assert {i for i, _ in rows_of(stages[0][1])} == {r.doc_id for r in op1_quality_rules(spark, sf).where("kept").collect()}


def test_line_dedup_stage(stages):
    before, after = map(rows_of, stages[1])
    want = lines_left(before)
    assert after == [(i, want[i, t]) for i, t in before]


def test_simhash_stage(stages):
    before, after = map(rows_of, stages[2])
    label = plain_components([plain_fingerprint(t) for _, t in before], 2)
    assert after == [r for k, r in enumerate(before) if label[k] == k]


def test_suffix_stage(stages):
    before, after = map(rows_of, stages[3])
    want = bytes_left(before)
    assert after == [(i, want[i, t][3].decode(errors="replace")) for i, t in before]


def check_packing(rows, pieces, length=1024):
    """Every id in one piece, sequences gapless and full but for the last."""
    want = {}
    for i, t in rows:
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 0]
        want.setdefault(i, []).append(b"".join(x.to_bytes(4, "little") for x in ids))
    filled = Counter()
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == filled[p.sequence_id] and p.length > 0
        filled[p.sequence_id] += p.length
    assert sorted(filled) == list(range(len(filled)))
    assert all(n == length for s, n in filled.items() if s + 1 < len(filled)) and all(n <= length for n in filled.values())
    assert sum(filled.values()) == sum(len(x) // 4 for xs in want.values() for x in xs)
    for p in pieces:
        fits = [x for x in want[p.doc_id] if len(x) == 4 * p.doc_tokens]
        assert any(zlib.crc32(x[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32 for x in fits)
        n = filled[p.sequence_id]
        assert p.padded_length == (n if n & (n - 1) == 0 else length)


def test_packing_stage(stages):
    check_packing(rows_of(stages[4][0]), stages[4][1].collect())


def test_packing_odd_rows(make):
    check_packing(ODD, pack(make(ODD), public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert pack(make([]), public_tokenizers.path("byte_bpe_50k.json")).collect() == []


def test_run_is_all_stages(stages, spark, sf):
    got = corpus_pipeline.run(spark, sf)
    total = F.sum("length").alias("n"), F.countDistinct("doc_id").alias("d")
    assert got.agg(*total).collect() == stages[4][1].agg(*total).collect()


def test_odd_rows_through_all_stages(make, spark, sf):
    good = "A plain line of words that goes on for a while, number {0} of them.\n" * 1
    rows = [(i, "".join(good.format(f"{i} {k * 7919 % 1000}") for k in range(12))) for i in range(5)]
    for given in ([], ODD, rows + rows + [(None, rows[0][1])]):
        docs = make(given)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        assert docs.count() == 0 if not given else docs.count() >= 0


def test_keep_one_of_repeated_rows(make):
    rows = [(3, "b c d e"), (3, "b c d e"), (2, "q r s t u"), (2, "v w x y z"), (None, "b c d e"), (None, "l m n o"), (None, "l m n o"), (7, None), (8, "")]
    got = sorted((str(r.doc_id), str(r.text)) for r in keep_one(make(rows)).collect())
    assert got == sorted([("3", "b c d e"), ("2", "q r s t u"), ("2", "v w x y z"), ("None", "l m n o"), ("7", "None")])


def test_words_survive(stages):
    """Removing repeats never makes up text."""
    first = {w for _, t in rows_of(stages[0][0]) for w in re.findall(r"\w+", t)}
    assert len({w for _, t in rows_of(stages[1][1]) for w in re.findall(r"\w+", t)} - first) == 0


def test_columns_with_dots_and_clashing_names(spark):
    """Names that look like fields, or like columns the operators make themselves, go through all stages unharmed."""
    import corpus_pipeline

    words = " ".join(f"word{i} and more." for i in range(60))
    rows = [(i, f"{words}\nline {i} one\nline {i} two\nline {i} three", "en", "s", 5, i, "x", "y", 7) for i in range(12)]
    names = "doc_id long, text string, lang string, source string, n_chars long, `a.b` long, `row` string, `k1` string, fp int"
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "")
        assert kept.columns == docs.columns, name
        assert all(r["a.b"] == r.doc_id and r["row"] == "x" and r.fp == 7 for r in kept.collect()), name
