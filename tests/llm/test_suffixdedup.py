import hashlib
import random

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import suffixdedup
from pagemill.llm.catalog import op8_suffix_array_dedup
from pagemill.llm.suffixdedup import strip_repeats
from pagemill.llm.suffixes import suffix_array

from .conftest import ODD


def brute(rows, length=50):
    """Expected (n_bytes, n_removed, n_spans, kept) of each distinct row, from a table of all strings."""
    first = {}
    rank = {r: (r[0] is not None, r[0] or 0) for r in rows}
    for r in set(rows):
        data = (r[1] or "").encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w not in first or rank[r] < first[w]:
                first[w] = rank[r]
    out = {}
    for r in set(rows):
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if first[data[i : i + length]] < rank[r]:
                gone[i : i + length] = b"\1" * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[r] = (len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone, strict=True) if not g))
    return out


def compare(make, rows, **how):
    got = strip_repeats(make(rows), **how).collect()
    want = brute(rows, how.get("length", 50))
    as_text = [(str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got]
    assert sorted(as_text) == sorted((str(i), *want[i, t]) for i, t in rows)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept).hexdigest() for r in got)


def test_all_documents(spark, sf, docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op8_suffix_array_dedup(spark, sf).collect()}
    want = {r[0]: (n, m, s, hashlib.sha256(k).hexdigest()) for r, (n, m, s, k) in brute(docs).items()}
    assert got == want
    assert sum(m for _, m, _, _ in want.values()) > 0


@pytest.mark.parametrize("seed", range(3))
def test_shared_passages(make, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(8, 40))) for _ in range(6)]
    rows = []
    for i in rng.sample(range(-40, 200), 60):
        parts = [" ".join(word() for _ in range(rng.randrange(0, 40))) for _ in range(3)]
        p = rng.choice(passages)
        a = rng.randrange(len(p))
        parts.insert(rng.randrange(4), p[a : a + rng.randrange(30, 200)])
        rows.append((i, "".join(parts)))
    rows += [(500 + i, rows[i][1]) for i in range(5)] + [(700, "é" * 300), (701, "xé" + "é" * 40), (702, "ab" * 400), (703, "b" + "ab" * 100)]
    compare(make, rows, targets=5)


def test_odd_rows(make):
    compare(make, ODD, targets=3)
    same = "the quick brown fox jumps over the lazy dog and runs away from all of it"
    compare(make, [(None, same), (1, same), (1, same + "!"), (1, same), (2, same), (3, None), (4, "")], targets=2)
    compare(make, [], targets=2)


def test_long_texts_in_pieces(make, monkeypatch):
    monkeypatch.setattr(suffixdedup, "CUT_BYTES", 97)
    texts = list(suffixdedup.blocks([b"x" * 1000, b"", b"y" * 30], 50))
    whole = {k: b"" for k in range(3)}
    for block in texts:
        for k, offset, piece in block:
            whole[k] = whole[k][:offset] + piece
    assert whole == {0: b"x" * 1000, 1: b"", 2: b"y" * 30}


def test_a_passage_in_many_documents(make):
    rng = random.Random(5)
    passage = "This line stands in every third document of the table, word for word, and it is long."
    rows = [(i, f"{rng.random()} {passage if i % 3 == 0 else ''} {rng.random()}") for i in range(600)]
    compare(make, rows, targets=4)


def boundary_rows(n):
    rng = random.Random(7)
    passage = "This line stands in every third document of the table, word for word, and it is long."
    return [(i, f"{rng.random()} {passage if i % 3 == 0 else ''} {rng.random()}") for i in range(n)]


def test_windows_of_hot_parts_are_dealt_one_by_one(make):
    rows = boundary_rows(600) + [(None, boundary_rows(1)[0][1]), (3, boundary_rows(4)[3][1] + "!")]
    hot, targets = suffixdedup.hot_slots(make(rows), 50, 20)
    assert hot and targets == 20
    assert not suffixdedup.hot_slots(make(rows), 50, 1)[0]
    texts = [(0, t.encode()) for _, t in rows]
    data, _, _, at, size, part = suffixdedup.cut(texts, 50, hot)
    groups = {}
    for a, n, p in zip(at.tolist(), size.tolist(), part.tolist(), strict=True):
        groups.setdefault(p, set()).add(data[a : a + n].tobytes())
    assert max(map(len, groups.values())) < 50
    assert sum(size - 49) == sum(max(0, len(t) - 49) for _, t in texts)
    compare(make, rows, targets=20)


def test_equal_pieces_enter_an_array_once(monkeypatch):
    entered = []
    in_array = suffixdedup._in_array
    monkeypatch.setattr(suffixdedup, "_in_array", lambda texts, *rest: (entered.append(sum(map(len, texts))), in_array(texts, *rest))[1])
    rng = random.Random(1)
    passage = bytes(rng.randrange(97, 123) for _ in range(60))
    keys = [bytes([130 + i] * 20) + passage for i in range(100)]
    ids = [7, 7, *range(8, 106)]
    got = {i: sorted(w.tolist()) for i, w in suffixdedup.shared_windows(keys, ids, 50)}
    assert sum(entered) < 200
    assert got == {i: [*range(20, 31)] for i in range(2, 100)}


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 3), max_size=60), st.binary(max_size=60)))
def test_suffix_array(data):
    assert suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])


def test_suffix_arrays_of_repetitive_texts():
    a, b = [1], [1, 0]
    for _ in range(9):
        a, b = b, b + a  # the Fibonacci word
    for data in (b, [2] * 300, [0, 1] * 150, [1, 0] * 150, list(range(100)) * 3, list(range(100, 0, -1))):
        assert suffix_array(data) == sorted(range(len(data)), key=lambda i: data[i:])


def test_spans_merge_within_a_document_only():
    rng = np.random.default_rng(3)
    docs, begins = rng.integers(0, 9, 400), rng.integers(0, 900, 400)
    ends = begins + rng.integers(1, 12, 400)
    covered = {(d, x) for d, b, e in zip(docs.tolist(), begins.tolist(), ends.tolist(), strict=True) for x in range(b, e)}
    d, b, e = suffixdedup._merged(docs, begins, ends)
    assert {(k, x) for k, y, z in zip(d.tolist(), b.tolist(), e.tolist(), strict=True) for x in range(y, z)} == covered
    assert all(d[i] < d[i + 1] or e[i] < b[i + 1] for i in range(len(d) - 1))
    assert not len(suffixdedup._merged(*(np.array([], np.int64),) * 3)[0])


def test_packed_columns_come_back():
    docs = np.array([0, 0, 2, 2, 70_000])
    starts, sizes = np.array([5, 1 << 30, 0, 3, 9]), np.array([50, 90, 1 << 20, 51, 50])
    got = suffixdedup.unpacked(zstandard.ZstdDecompressor(), suffixdedup.packed(zstandard.ZstdCompressor(), docs, starts, sizes))
    assert [x.tolist() for x in got] == [docs.tolist(), starts.tolist(), sizes.tolist()]
    ids = np.array([-(1 << 63), 7, 3, (1 << 63) - 1])
    assert suffixdedup.from_planes(np.frombuffer(suffixdedup.planes(ids), np.uint8), "<i8").tolist() == ids.tolist()
