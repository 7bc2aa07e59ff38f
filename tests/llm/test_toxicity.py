import random
import zlib

import duckdb

from pagemill.llm.catalog import op5_toxicity
from pagemill.llm.toxicity import Scorer, fit, locate, score, sentences, train

from .conftest import ODD

PLAIN = "the river runs by a green hill and nobody minds it at all today".split()


def sample(n, seed):
    """Texts of plain sentences; those with label 1 hold one rude word in one sentence."""
    rng, out = random.Random(seed), []
    for k in range(n):
        parts = [[rng.choice(PLAIN) for _ in range(8)] for _ in range(rng.randrange(1, 12))]
        if k % 4 == 0:
            rng.choice(parts).insert(3, rng.choice(["Blockhead", "nitwit!"]))
        out.append((". ".join(map(" ".join, parts)) + ".", int(k % 4 == 0)))
    return out


def test_learns_sentences_from_document_labels(make, spark):
    scorer = train(*map(list, zip(*sample(800, 1), strict=True)))
    held = sample(400, 2)
    right = [(scorer.document(t) >= 0.3) == bool(y) for t, y in held]
    assert sum(right) >= 0.98 * len(right)
    found = locate(make(list(enumerate(t for t, _ in held))), scorer).collect()
    assert {r.doc_id for r in found} == {i for i, (_, y) in enumerate(held) if y}
    for r in found:
        assert held[r.doc_id][0][r.begin : r.end] == r.sentence and ("Blockhead" in r.sentence or "nitwit" in r.sentence)


def test_held_out_accuracy_and_columns(spark, sf):
    d = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op5_toxicity(spark, d).collect()}
    labels = dict(duckdb.sql(f"select doc_id, toxic from '{d}/labels.parquet'").fetchall())
    assert len(got) == duckdb.sql(f"select count(*) from '{d}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    pos = [got[i].score for i, t in labels.items() if t and got[i].held_out]
    neg = [got[i].score for i, t in labels.items() if not t and got[i].held_out]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.95
    assert sum(x >= 0.3 for x in pos) > 0.8 * len(pos) and sum(x >= 0.3 for x in neg) < 0.02 * len(neg)


def test_length_alone_raises_no_score(spark):
    """Clean held-out texts joined to long ones stay clean; a toxic text within such a long one is still found."""
    d = "/root/testdata/sf0.1"
    texts = duckdb.sql(f"select doc_id, text, toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) where text is not null").fetchall()
    scorer = fit(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    held = [(t, y, scorer.document(t)) for i, t, y in texts if zlib.crc32(str(i).encode()) % 4 == 2]
    clean = [t for t, y, s in held if not y and s < 0.3]
    toxic = [t for t, y, _ in held if y and max(map(scorer.sentence, sentences(t))) >= 0.3]
    for size in (60_000, 200_000, 1_000_000):
        flagged = found = 0
        for seed in range(20):
            rng, parts = random.Random(seed), []
            while sum(map(len, parts)) < size:
                parts.append(rng.choice(clean))
            flagged += scorer.document("\n".join(parts)) >= 0.3
            parts.insert(rng.randrange(len(parts)), rng.choice(toxic))
            found += scorer.document("\n".join(parts)) >= 0.3
        assert flagged <= 1 and found == 20, (size, flagged, found)
    plain = Scorer(-8.35, {"rude": 12.0})
    assert plain.document("all is well. " * 100_000) == plain.document("all is well.")
    assert plain.document("all is well. " * 100_000 + "a rude word.") > 0.9


def test_long_texts_are_learned_from(make, spark):
    """A word that stands in long texts only."""
    texts = [(i, f"{t} {'all is well. ' * 6000}{'rascal.' if y else ''}", y) for i, (t, y) in enumerate(sample(80, 4))]
    texts = [(i, t.replace("Blockhead", "").replace("nitwit!", ""), y) for i, t, y in texts]
    assert all(len(t) > 60_000 for _, t, _ in texts)
    scorer = fit(make([(i, t) for i, t, _ in texts]), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    assert scorer.document("you rascal.") >= 0.3 > scorer.document("all is well. " * 50_000)


def test_fit_is_train_on_whole_texts(make, spark):
    texts = [(i, t, y) for i, (t, y) in enumerate(sample(200, 3)) if zlib.crc32(str(i).encode()) % 4 != 2]
    texts.append(texts[0])
    one = fit(make([(i, t) for i, t, _ in texts]), spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int"))
    two = train([t for _, t, _ in texts], [y for *_, y in texts])
    assert set(one.weights) == set(two.weights) and abs(one.bias - two.bias) < 1e-6


def test_held_out_labels_are_not_used(spark, make):
    texts = make([(i, t) for i, (t, _) in enumerate(sample(200, 3))])
    labels = [(i, y, zlib.crc32(str(i).encode()) % 4 == 2) for i, (_, y) in enumerate(sample(200, 3))]
    one = fit(texts, spark.createDataFrame([(i, y) for i, y, _ in labels], "doc_id long, toxic int"))
    two = fit(texts, spark.createDataFrame([(i, 1 - y if out else y) for i, y, out in labels], "doc_id long, toxic int"))
    assert one == two and one.weights


def test_odd_rows(make, spark):
    got = score(make(ODD), Scorer(-3.0, {"rude": 9.0})).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert score(make([]), Scorer(0.0, {})).collect() == []
    nothing = fit(make([]), spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.document("any text") == 0.5 and nothing.document(None) == 0.5
    tied = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    assert 0 < fit(make(ODD), tied).document("two words") < 1
