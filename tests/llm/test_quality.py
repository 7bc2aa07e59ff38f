import collections
import re

import duckdb
import pytest

from pagemill.llm.catalog import op1_quality_rules
from pagemill.llm.quality import estimate, judge, keep_good

from .conftest import ODD


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = collections.Counter(windows)
    covered = {j for i, w in enumerate(windows) if n[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
    }


def check(rows):
    for r in rows:
        want = brute(r["text"])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_counts_on_all_documents(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    check([r.asDict() for r in op1_quality_rules(spark, sf).join(texts, "doc_id").collect()])


def test_odd_rows(make):
    rows = judge(make(ODD)).collect()
    assert len(rows) == len(ODD)
    assert sorted(str(brute(t)["n_repeat_words"]) for _, t in ODD) == sorted(str(r.n_repeat_words) for r in rows)
    assert judge(make([])).collect() == []
    assert keep_good(make([])).collect() == []
    assert keep_good(make(ODD)).columns == make(ODD).columns


def test_verdict_follows_labels(spark):
    d = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in op1_quality_rules(spark, d).where("not base_failed").collect()}
    labels = dict(duckdb.sql(f"select doc_id, quality from '{d}/labels.parquet'").fetchall())
    good = [kept[i] for i, q in labels.items() if q and i in kept]
    bad = [kept[i] for i, q in labels.items() if not q and i in kept]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.3 * len(bad)


def test_same_rows_kept_by_both_forms(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet")
    assert {r.doc_id for r in keep_good(texts).collect()} == {r.doc_id for r in judge(texts).where("kept").collect()}


def test_no_python_on_the_main_path(spark, sf):
    plan = op1_quality_rules(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_estimate_learns_which_rules_to_trust():
    """A rule that votes at random gets a weight near zero."""
    good, bad = (None, 1, None, None, 1, None, 1, 1), (0, 0, None, None, 1, None, None, 1)
    model = estimate({good: 900, bad: 100})
    assert model.bad[0] < -2 and model.bad[1] < -2 and abs(model.good[4]) < 0.2
    assert estimate({}).prior == pytest.approx(0)
