import os
import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagemill.llm import vocab
from pagemill.llm.catalog import op9_packing
from pagemill.llm.packing import pack
from pagemill.llm.vocab import ChunkEncoder, chunks_of

from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def check(rows, pieces, length=1024):
    """Every id of every row in exactly one piece, sequences without gaps and full but for the last."""
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, []).append([*ids_of(text), 0])
    filled, of_doc = {}, {}
    for p in pieces:
        filled.setdefault(p.sequence_id, []).append((p.offset, p.length, p.padded_length))
        of_doc.setdefault(p.doc_id, []).append(p)
    total = sum(len(x) for many in want.values() for x in many)
    assert sorted(filled) == list(range(-(-total // length)))
    for k, parts in filled.items():
        at = 0
        for offset, n, padded in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at == min(length, total - k * length)
        assert padded == (at if at & (at - 1) == 0 else length)
    assert set(of_doc) == set(want)
    for doc_id, many in want.items():
        got = of_doc[doc_id]
        assert sorted(len(x) for x in many) == sorted(p.doc_tokens for p in got if p.start == 0)
        if len(many) == 1:
            at = 0
            for p in sorted(got, key=lambda p: p.start):
                ids = many[0][p.start : p.start + p.length]
                assert p.start == at and p.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
                at += p.length
            assert at == len(many[0])


def test_all_documents(spark, sf, docs):
    check(docs, op9_packing(spark, sf).collect())


def test_odd_rows(make):
    check(ODD, pack(make(ODD), PATH, 0).collect())
    assert pack(make([]), PATH, 0).collect() == []


@pytest.mark.parametrize("remembered", [3, 1 << 20])
def test_remembered_chunks_change_nothing(monkeypatch, docs, remembered):
    monkeypatch.setattr(vocab, "REMEMBERED", remembered)
    monkeypatch.setattr(vocab, "_loaded", {})
    encoder = ChunkEncoder.of(PATH, 4)
    odd = ["a, b. a,b a.b", "x?!", " x!", "1, 2;3: a1,", "é, ß! ́, ², _, -, ',", "it's, it's", "a  b, c", "tab\t, x", " , .", "a,\n.b", "\0 a, b", "", None, "a,,", "word.",
           "word", "word. word,  word.", " , a  b", "<|endoftext|>, <|endoftext|>."]
    for texts in (odd, [t for _, t in docs[:40]], odd, [" ".join(odd[:5])] * 3, odd[::-1]):
        assert encoder.encode(texts) == [struct.pack(f"<{len(ids_of(t))}I", *ids_of(t)) for t in texts]
    assert "".join(chunks_of("a b  c\nd")) == "a b  c\nd"


def test_a_task_has_one_thread_and_gives_its_memory_back(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    vocab.forget_all()
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = vocab.ChunkEncoder.of(path, 2)
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    before = first.encode(["some words", None])
    vocab.forget_all()
    again = vocab.ChunkEncoder.of(path, 2)
    assert again is not first and again.encode(["some words", None]) == before


def test_new_words_go_to_the_library_many_at_a_time():
    class Counting:
        texts = 0

        def get_vocab(self):
            return LIBRARY.get_vocab()

        def encode_batch_fast(self, texts, **options):
            self.texts += len(texts)
            return LIBRARY.encode_batch_fast(texts, **options)

    counting = Counting()
    words = [f" w{k}xé" for k in range(1000)] + ["first", "\nline", "a  b", " ", "", "　", " <|endoftext|>", "\n\n"]
    ids, begins, lengths = vocab._library_ids(counting)(words)
    assert [ids[a : a + n].tolist() for a, n in zip(begins, lengths, strict=True)] == [ids_of(w) for w in words]
    assert counting.texts < 50


def test_white_space_of_any_kind_beside_cuts():
    rnd = random.Random(5)
    signs = [*" \n\t'.,;:!?aéß1", "  ", " \n", "\xa0", " ", "　", "\x85", "\x1c", "’", " ", "×", "²", "日", "\U0001f600", "<|endoftext|>", " ", " ", " the", "́", " "]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 25))) for _ in range(3000)]
    encoder = ChunkEncoder.of(PATH, 2)
    column = pa.array([None, *texts, ""])
    want = [struct.pack(f"<{len(ids_of(t))}H", *ids_of(t)) for t in column.to_pylist()]
    assert encoder.encode(column) == want
    assert encoder.encode(column.slice(700, 900)) == want[700:1600]
