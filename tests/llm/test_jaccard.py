import random

import pytest

from pagemill.llm import jaccard
from pagemill.llm.jaccard import Bands, Threshold, Words, components, keys, shingles, similar_documents

from .conftest import ODD


def plain_set(text):
    words = (text or "").encode().lower().split()
    n = min(3, len(words))
    return {b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def brute(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows, sorted, all pairs compared."""
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if find(i) != find(j) and linked(sets[i], sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def got(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    assert {kind for _, kind in df.dtypes} == {"bigint"}
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_copies(seed, n=260):
    """Texts of all sizes with a few words changed, cut off or added: pairs on both sides of the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[r.choice(vocabulary) for _ in range(k)] for k in (2, 3, 4, 8, 9, 10, 11, 12, 13, 20, 21, 30, 45, 46, 60, 90, 140, 141, 300, 700)]
    rows = []
    for i in range(n):
        words = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            at = r.randrange(len(words))
            words[at : at + r.choice([0, 1])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
            words = words or ["w0"]
        if r.random() < 0.3:
            words = words[: max(1, int(len(words) * r.uniform(0.85, 1)))]
        rows.append((i * 7 % n, " ".join(words)))
    return rows


@pytest.mark.parametrize("block", [2048, 3])  # with blocks of three rows every group is dealt out over many tiles
def test_against_all_pairs(make, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = near_copies(block)
    assert got(similar_documents(make(rows))) == brute(rows)


def test_shingles_weigh_on_blocks(make, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 300)
    rows = near_copies(9, 120)
    assert got(similar_documents(make(rows))) == brute(rows)


def test_odd_rows_and_empty_table(make):
    rows = [*ODD, (20, "ONE"), (21, "a b"), (22, "A  b"), (None, "only null"), (None, "ONLY null"), (30, "é É x y"), (31, "é É x Y")]
    assert got(similar_documents(make(rows))) == brute(rows)
    assert got(similar_documents(make([]))) == []


def test_linked_sets_share_a_key():
    """For sizes up to 300 and all ways to differ at the threshold: never a pair without a common key."""
    import numpy as np

    r, bands = np.random.default_rng(4), Bands(Threshold(9, 10))
    shared = 0
    for _ in range(4000):
        size = int(r.integers(9, 300))
        values = np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64))
        larger = int(r.integers(size, size * 10 // 9 + 1))
        # take away and add as much as the threshold allows
        common = -(-9 * (size + larger) // 19)
        if common > size:
            continue
        kept = r.permutation(values)[:common]
        other = np.unique(np.concatenate([kept, r.integers(0, 1 << 63, larger - common, dtype=np.uint64)]))
        if 19 * common >= 9 * (len(values) + len(other)) and len(np.setxor1d(values, other)):
            assert set(keys(values, bands)) & set(keys(other, bands)), (size, larger)
            shared += 1
    assert shared > 3000


def test_shingle_sets():
    for text in ("", None, " \n", "a", "A b", "a b c", "a b c a b c a b", "é\x85x ß y", "x" * 100_000):
        assert len(shingles(text, 3, Words())) == len(plain_set(text))


@pytest.mark.parametrize("edges", [
    [(i, i + 1) for i in range(60)], [(1, i) for i in range(2, 200)], [(i, 500) for i in range(100)],
    [(a, b) for a in range(5) for b in range(5)] + [(10, 11), (11, 12), (13, 14), (14, 10)], [],
])
def test_components(spark, edges):
    import hashlib

    name = lambda i: hashlib.md5(str(i).encode()).digest()  # noqa: E731  labels are hashes in use
    label = {i: i for e in edges for i in e}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in edges:
        label[find(a)] = find(b)
    least = {}
    for i in label:
        least[find(i)] = min(least.get(find(i), name(i)), name(i))
    want = {name(i): least[find(i)] for i in label if any(a != b and i in (a, b) for a, b in edges)}
    df = spark.createDataFrame([(name(a), name(b)) for a, b in edges], "a binary, b binary")
    assert {bytes(r.node): bytes(r.label) for r in components(df).collect()} == want
