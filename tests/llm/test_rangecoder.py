import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from pagemill.llm import rangecoder
from pagemill.llm.catalog import op3_token_files
from pagemill.llm.rangecoder import read_segment, write_and_read, write_segment

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def test_all_documents(spark, sf, docs):
    got = op3_token_files(spark, sf).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(docs)


def test_odd_rows(make, monkeypatch):
    def place(row):
        h = 42 if row[1] is None else xxhash.xxh64(row[1].encode(), seed=42).intdigest()
        return row[0] is not None, row[0] or 0, h - (1 << 64) if h >> 63 else h

    rows = sorted(ODD, key=place)
    got = write_and_read(make(ODD), PATH, 2).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(rows)
    assert write_and_read(make([]), PATH, 2).collect() == []


BLOCK_IDS = 1500


@pytest.fixture(autouse=True)
def short_blocks(monkeypatch):
    monkeypatch.setattr(rangecoder, "BLOCK_IDS", BLOCK_IDS)


@pytest.mark.parametrize("n,symbols", [(0, 3), (1, 1), (7, 1), (1200, 2), (BLOCK_IDS, 300), (3 * BLOCK_IDS + 17, 50_257)])
@pytest.mark.parametrize("kind", ["even", "skewed", "repeating"])
def test_round_trip(n, symbols, kind):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, symbols, n)
    if kind == "skewed":
        ids = np.minimum(rng.geometric(0.05, n) - 1, symbols - 1)
    if kind == "repeating":
        ids = np.resize(ids[:50], n)
    data = write_segment(ids.astype("<u4"), symbols)
    assert (read_segment(data) == ids).all()
    if kind == "repeating" and n > 1000:
        assert len(data) < n // 2


def test_blocks_are_independent_and_checked():
    ids = np.random.default_rng(0).integers(0, 1000, 4 * BLOCK_IDS).astype("<u4")
    data = write_segment(ids, 1000)
    heads = [struct.unpack_from("<4I", data, 12 + 16 * k) for k in range(4)]
    at = 12 + 16 * 4
    for k, (n, size, check, _) in enumerate(heads):
        (block,) = rangecoder.decode_blocks([data[at : at + size]], [n], 1000)
        assert (block == ids[k * BLOCK_IDS : (k + 1) * BLOCK_IDS]).all() and zlib.crc32(block.tobytes()) == check
        at += size
    for place in (at - 1, at // 2, 12 + 16 * 4):
        broken = bytearray(data)
        broken[place] ^= 16
        with pytest.raises(ValueError, match="block"):
            read_segment(bytes(broken))


def test_text_is_compressed_below_its_entropy_of_single_ids(docs, monkeypatch):
    ids = np.array([i for _, t in docs[:30] for i in LIBRARY.encode(t).ids], "<u4")
    share = np.bincount(ids)[np.unique(ids)] / len(ids)
    assert len(write_segment(ids, 50_257)) * 8 < 16 * len(ids)
    monkeypatch.setattr(rangecoder, "BLOCK_IDS", 16_000)
    repeated = np.tile(ids[:4000], 4)
    assert len(write_segment(repeated, 50_257)) * 8 < -(share * np.log2(share)).sum() * len(repeated)


def test_full_blocks_with_rare_ids_after_sure_guesses(monkeypatch):
    """Both guesses as sure as they get, and then ids that never stood before, early and late in whole blocks."""
    monkeypatch.undo()
    symbols, size = 50_257, rangecoder.BLOCK_IDS
    rng = np.random.default_rng(1)
    blocks = []
    for period, gap in ((2, 5), (3, 40), (7, 300), (500, 1000), (1, size // 2)):
        ids = np.resize(rng.integers(0, symbols, period), size)
        ids[::2][: size // 3] = 7  # one id follows many, many follow one
        places = np.arange(gap, size, gap)
        ids[places] = rng.permutation(symbols)[: len(places)] if len(places) <= symbols else rng.integers(0, symbols, len(places))
        blocks.append(ids)
    # order 1 is sure of 12 after 11, order 2 of 14 after 13 and 11; every twelfth time neither comes
    unit = np.array([10, 11, 12] * 10 + [13, 11, 14])
    ids = np.resize(unit, size)
    ids[12 * len(unit) - 1 :: 12 * len(unit)] = rng.permutation(np.arange(20_000, symbols))[: len(ids[12 * len(unit) - 1 :: 12 * len(unit)])]
    blocks.append(ids)
    blocks += [rng.permutation(symbols)[:size] if size <= symbols else rng.integers(0, symbols, size), np.arange(size) % symbols]
    ids = np.concatenate(blocks).astype("<u4")
    assert (read_segment(write_segment(ids, symbols)) == ids).all()


def test_too_many_symbols_are_refused():
    with pytest.raises(ValueError, match="symbols"):
        write_segment(np.zeros(5, "<u4"), 1 << 21)


def test_one_python_worker_for_a_task(make):
    plan = write_and_read(make([(1, "one two"), (2, None)]), PATH, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_ids_are_found_by_their_sums_in_wide_rows(monkeypatch):
    """Sums of as many symbols as fill rows up, one more and one less, after they were made anew; no
    table of counts beside them."""
    for symbols in (1, 4095, 4096, 4097, 50_257):
        model = rangecoder.Model(3, symbols)
        seen = np.random.default_rng(symbols).integers(0, symbols, (2 * rangecoder.EPOCH, 3))
        for ids in seen:
            model.predict(3)
            model.learn(3, ids.astype(np.int32))
        counts = np.stack([np.bincount(seen[:, lane], minlength=symbols) for lane in range(3)])
        assert (model.sums == np.cumsum(np.pad(counts * rangecoder.WEIGHT + 1, ((0, 0), (1, 0))), axis=1)).all()
        model.predict(3)
        for ids in (np.zeros(3, int), np.full(3, symbols - 1), seen[0], seen[-1]):
            none = np.zeros(3, bool)
            begin, width = (x.astype(np.int64) for x in model.interval(3, ids, none, none))
            assert (model.find(3, begin) == ids).all() and (model.find(3, begin + width - 1) == ids).all()
        assert not hasattr(model, "counts") and model.flat_sums.nbytes < 3 * 4 * (symbols + 4097)


def test_runs_of_a_block_are_coded_side_by_side(monkeypatch):
    """A full block, one of odd length and one too short for two runs take few steps and come back, with what they share."""
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    blocks = [np.minimum(rng.geometric(0.01, n) - 1, 50_256).astype("<u4") for n in (rangecoder.BLOCK_IDS, 9001, 700, 1, 0)]
    steps = []
    learn = rangecoder.Model.learn
    monkeypatch.setattr(rangecoder.Model, "learn", lambda self, n, ids: (steps.append(n), learn(self, n, ids)))
    payloads = rangecoder.encode_blocks(blocks, 50_257)
    assert sum(steps) == sum(map(len, blocks)) and len(steps) <= rangecoder.BLOCK_IDS // 12
    steps.clear()
    got = rangecoder.decode_blocks(payloads, [len(b) for b in blocks], 50_257)
    assert sum(steps) == sum(map(len, blocks)) and len(steps) <= rangecoder.BLOCK_IDS // 12
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(got, blocks, strict=True))
    # each block is read on its own, without those it was written beside
    for payload, block in zip(payloads, blocks, strict=True):
        assert (rangecoder.decode_blocks([payload], [len(block)], 50_257)[0] == block).all()
    # a copy at the distance of a run or of several is not new
    plain = rng.permutation(50_257)[: rangecoder.BLOCK_IDS // 4]
    other = rng.permutation(50_257)[: rangecoder.BLOCK_IDS]
    assert len(write_segment(np.tile(plain, 4).astype("<u4"), 50_257)) < 0.6 * len(write_segment(other.astype("<u4"), 50_257))
