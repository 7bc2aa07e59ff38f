"""Toxicity by multiple-instance learning: document labels train a scorer of sentences.

A sentence's probability is logistic in its words; a document's is the noisy-or of its sentences with a leak. The leak,
the chance of a sentence without any weighted feature, counts once for a document, and a sentence counts for what it has
above that. So sentences that say nothing change no score, however many there are. The small amounts that clean
sentences add by mistake would still add up in long texts: a document has the score of its strongest sentence, and more
only where the sum is three standard deviations above what so many clean sentences of the sample add up to. Labels are of documents, so the
gradient of the document's likelihood decides which sentences are to blame, and the trained scorer then finds the
offending sentences.

Features of a word are the word itself, without marks at its ends and in lower case, and its first four and five
characters. Nothing else about a document enters a score. The model is fitted on a bounded number of labelled rows,
whole texts of any length, and has a bounded number of weights, so it goes out with the tasks; every whole document is
scored. Texts of the sample stay in the tasks: what reaches the driver is how many texts hold each feature, of the best
features only, and then each text as its distinct sets of weighted features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces

if TYPE_CHECKING:
    import numpy as np

#: Words remembered by a Python worker before it starts anew: bounds memory, not results.
REMEMBERED = 300_000
#: A feature gets a weight if texts with it have label 1 more often than this chance explains. Weights of features that
#: stand in toxic texts by accident are small, but in a text of thousands of sentences they add up.
CHANCE = 1e-6
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
_MARKS = re.compile(r"^[\W_]+|[\W_]+$")


def sentences(text: str) -> list[str]:
    """Pieces that end at a full stop, exclamation or question mark or line end; a text without any is one empty piece."""
    return _SENTENCE.findall(text) or [""]


def word_features(word: str) -> tuple[str, ...]:
    word = _MARKS.sub("", word.lower())
    return (word, *(f"{word[:n]}~" for n in (4, 5) if len(word) >= n)) if word else ()


@dataclass
class Scorer:
    """Log odds of a sentence: bias plus the weights of its distinct words' features."""

    bias: float
    weights: dict[str, float]
    usual: float = 0.0  # mean and mean square, over the sentences of texts with label 0, of what a sentence adds
    spread: float = 0.0
    _words: dict[str, float] = field(default_factory=dict, repr=False)

    def sentence(self, text: str) -> float:
        from math import exp

        known, total = self._words, self.bias
        for w in set(text.split()):
            x = known.get(w)
            if x is None:
                if len(known) > REMEMBERED:
                    known.clear()
                x = known[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
            total += x
        return 1 / (1 + exp(-max(-60.0, min(60.0, total))))

    def document(self, text: str | None) -> float:
        from math import exp, log1p, sqrt

        leak = 1 / (1 + exp(-max(-60.0, min(60.0, self.bias))))
        n, strongest, total = 0, 0.0, 0.0
        for n, s in enumerate(sentences(text or ""), 1):
            p = self.sentence(s)
            if p > leak:
                speaks = log1p(-leak) - log1p(-min(p, 1 - 1e-12))
                strongest, total = max(strongest, speaks), total + speaks
        total -= n * self.usual + 3 * sqrt(n * self.spread)
        return 1 - (1 - leak) * exp(-max(strongest, total))


def text_features(text: str | None) -> set[str]:
    return {f for w in {w for s in sentences(text or "") for w in s.split()} for f in word_features(w)}


def bag(text: str | None, number: dict[str, int], words: dict[str, tuple[int, ...]]) -> np.ndarray:
    """A text as its number of sentences and then [features, times, the features] for each distinct set of numbered features
    that its sentences hold; `words` is filled."""
    import numpy as np

    sets: Counter[tuple[int, ...]] = Counter()
    all_sentences = sentences(text or "")
    for s in all_sentences:
        held: list[int] = []
        for w in set(s.split()):
            if w not in words:
                if len(words) > REMEMBERED:
                    words.clear()
                words[w] = tuple(number[f] for f in word_features(w) if f in number)
            held.extend(words[w])
        if held:
            sets[tuple(sorted(held))] += 1
    return np.array([len(all_sentences)] + [x for held, times in sorted(sets.items()) for x in (len(held), times, *held)], np.int32)


def train(texts: list[str], labels: list[int], features: int = 4096, steps: int = 200, rate: float = 0.05, decay: float = 1e-4, seen: int = 3) -> Scorer:
    """Fits a Scorer by Adam on the mean log likelihood of the document labels.

    Weights are given to `features` features at most: those in `seen` texts or more that speak most for label 1, by the
    chi-square statistic of standing in a text or not, and do so by more than chance (CHANCE). Without both labels there is nothing to learn: every sentence
    then gets the smoothed share of label 1.
    """
    from math import log

    if len(set(labels)) < 2:
        return untrained(labels)
    n, n1 = Counter(), Counter()
    for text, y in zip(texts, labels, strict=True):
        of = text_features(text)
        n.update(of)
        if y:
            n1.update(of)
    total, share = len(labels), sum(labels) / len(labels)
    speaks = {f: (n1[f] - k * share) ** 2 / (k * share * (1 - k / (total + 1))) for f, k in n.items() if k >= seen and surprise(k, n1[f], share) >= -log(CHANCE)}
    names = sorted(speaks, key=lambda f: (-speaks[f], f))[:features]
    number, words = {f: i for i, f in enumerate(names)}, {}
    return fitted([bag(t, number, words) for t in texts], labels, names, steps, rate, decay)


def surprise(n: int, n1: int, share: float) -> float:
    """The chance that n1 or more of n texts have label 1 without a reason is exp(-surprise) at most (Chernoff's bound)."""
    from math import log

    if n1 <= n * share:
        return 0.0
    return n1 * log(n1 / (n * share)) + ((n - n1) * log((n - n1) / (n * (1 - share))) if n1 < n else 0.0)


def untrained(labels: list[int]) -> Scorer:
    from math import log

    share = (sum(labels) + 1) / (len(labels) + 2)
    return Scorer(log(share / (1 - share)), {})


def fitted(bags: list[np.ndarray], labels: list[int], names: list[str], steps: int = 200, rate: float = 0.05, decay: float = 1e-4) -> Scorer:
    """The weights of the named features, from each text's bag()."""
    import numpy as np

    sizes: list[int] = []
    times: list[int] = []
    doc_of: list[int] = []
    held: list[np.ndarray] = [np.array([], np.int32)]
    for d, b in enumerate(bags):
        k = 1
        while k < len(b):
            size = int(b[k])
            sizes.append(size)
            times.append(int(b[k + 1]))
            doc_of.append(d)
            held.append(b[k + 2 : k + 2 + size])
            k += 2 + size
    y, doc_of, times = np.array(labels, float), np.array(doc_of, np.int64), np.array(times, float)
    sentence, feature = np.repeat(np.arange(len(sizes)), sizes), np.concatenate(held)
    at = np.zeros(len(names) + 1)  # weights, bias last
    at[-1] = -5.0
    m, v = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):
        over = np.bincount(sentence, at[feature], len(doc_of))
        p = 1 / (1 + np.exp(-np.clip(at[-1] + over, -30, 30)))
        leak = 1 / (1 + np.exp(-np.clip(at[-1], -30, 30)))
        counts = times * (over >= 0)  # a sentence below the leak takes no part
        none_toxic = np.log1p(-leak) + np.bincount(doc_of, counts * (np.log1p(-p) - np.log1p(-leak)), len(y))
        any_toxic = np.clip(1 - np.exp(none_toxic), 1e-9, 1 - 1e-9)
        blame = np.where(y == 1, -(1 - any_toxic) / any_toxic, 1.0) / len(y)
        slope = counts * blame[doc_of]
        g = np.append(np.bincount(feature, (slope * p)[sentence], len(names)), (slope * (p - leak)).sum() + leak * blame.sum())
        g[:-1] += decay * at[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        at -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    over = np.bincount(sentence, at[feature], len(doc_of))
    p = 1 / (1 + np.exp(-np.clip(at[-1] + np.maximum(over, 0), -30, 30)))
    adds = (np.log1p(-1 / (1 + np.exp(-np.clip(at[-1], -30, 30)))) - np.log1p(-p))[y[doc_of] == 0]
    times, clean = times[y[doc_of] == 0], sum(int(b[0]) for b, label in zip(bags, y, strict=True) if label == 0)
    weights = {f: float(at[i]) for i, f in enumerate(names) if at[i] != 0}
    return Scorer(float(at[-1]), weights, float((times * adds).sum() / clean), float((times * adds * adds).sum() / clean))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, rows: int = 6000, features: int = 4096, seen: int = 3) -> Scorer:
    """Learns from `labels` (doc_id, toxic) that are not held out, at most `rows` of them, as train() does from whole texts.

    The rows are those with the smallest hash of doc_id, so which they are depends on nothing else. Null labels or ids
    are passed over. Of rows tied in doc_id each text counts.
    """
    from math import log

    import numpy as np

    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `chosen` and `wanted` have `rows` rows of a few numbers at most
    texts = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").join(F.broadcast(chosen), "doc_id")
    keys = texts.select("doc_id", "text_hash", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "text_hash").limit(rows).collect()
    copies = Counter((r.doc_id, r.text_hash) for r in keys)
    y_of = {(r.doc_id, r.text_hash): int(r.toxic) for r in keys}
    labelled = [y_of[k] for k, n in copies.items() for _ in range(n)]
    if len(set(labelled)) < 2:
        return untrained(labelled)
    wanted = documents.sparkSession.createDataFrame([(*k, n, y_of[k]) for k, n in copies.items()], "key long, hash long, copies int, toxic int")
    found = documents.select(F.col("doc_id").cast("long").alias("key"), F.xxhash64("text").alias("hash"), "text")
    sample = found.join(F.broadcast(wanted), ["key", "hash"]).select("key", "hash", "copies", "toxic", "text")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for row, text in zip(batch.select([0, 1, 2, 3]).to_pylist(), batch.column(4).to_pylist(), strict=True):
                of = pa.array([*text_features(text)], pa.string())
                columns = [of, *(pa.array(np.full(len(of), x, np.int64)) for x in row.values())]
                yield pa.RecordBatch.from_arrays(columns, ["feature", "key", "hash", "copies", "toxic"])

    each = map_batches(sample, held, "feature string, key long, hash long, copies long, toxic long")
    if max(copies.values()) > 1:
        each = each.distinct()  # repeated rows are in `copies` already
    counts = each.groupBy("feature").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.col("toxic")).alias("n1"))
    share, others = sum(labelled) / len(labelled), F.col("n") - F.col("n1")
    expected = F.col("n") * share
    speaks = (F.col("n1") - expected) * (F.col("n1") - expected) / (expected * (1 - F.col("n") / (len(labelled) + 1)))
    surprise = F.col("n1") * F.log(F.col("n1") / expected) + F.when(others > 0, others * F.log(others / (F.col("n") * (1 - share)))).otherwise(0.0)
    best = counts.where((F.col("n") >= seen) & (F.col("n1") > expected) & (surprise >= -log(CHANCE))).orderBy(speaks.desc(), "feature").limit(features)
    names = [r.feature for r in best.select("feature").collect()]
    number = {f: i for i, f in enumerate(names)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, tuple[int, ...]] = {}
        for batch in pieces(batches, "text"):
            out = [zlib.compress(bag(t, number, words).astype("<i4").tobytes()) for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["key", "hash", "bag"])

    got = {(r.key, r.hash): r.bag for r in map_batches(sample, bags, "key long, hash long, bag binary").dropDuplicates(["key", "hash"]).collect()}
    each_bag = [np.frombuffer(zlib.decompress(got[k]), "<i4") for k, n in copies.items() for _ in range(n)]
    return fitted(each_bag, labelled, names)


def score(documents: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= threshold) of each row of `documents` (doc_id, text).

    A null, empty or blank text is scored as one empty sentence. Repeated rows and tied ids give a row each, a null
    doc_id is not held out; other columns don't matter; an empty table gives an empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            scores = [scorer.document(t) for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    rows = documents.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return map_batches(rows, work, "doc_id long, held_out boolean, score double, predicted int")


def locate(documents: DataFrame, scorer: Scorer, threshold: float = 0.3) -> DataFrame:
    """The offending sentences: doc_id, begin and end in the text (characters), sentence and score >= threshold."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            out = [
                (i, m.start(), m.end(), m[0], s)
                for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for m in _SENTENCE.finditer(t or "") if (s := scorer.sentence(m[0])) >= threshold
            ]
            columns = [*zip(*out, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "begin", "end", "sentence", "score"])

    rows = documents.select(F.col("doc_id").cast("long"), "text")
    return map_batches(rows, work, "doc_id long, begin long, end long, sentence string, score double")
