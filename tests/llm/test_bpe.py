import base64
import gc
import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import bpe
from pagemill.llm.catalog import op2_byte_bpe

from .conftest import ODD

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
with open(PATH, "rb") as lines:
    RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(PATH, PATTERN)


def ids(text):
    return LIBRARY.encode_ordinary(text or "")


def digests(text):
    packed = struct.pack(f"<{len(ids(text))}I", *ids(text))
    return len(ids(text)), hashlib.sha256(packed).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_all_documents(spark, sf, docs):
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in op2_byte_bpe(spark, sf).collect()}
    assert got == {i: digests(t) for i, t in docs}


def test_odd_rows(make):
    got = bpe.round_trip(make(ODD), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == sorted((str(i), *digests(t)) for i, t in ODD)
    assert bpe.round_trip(make([]), PATH, PATTERN).collect() == []
    texts = bpe.decode(bpe.encode(make(ODD), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((str(r.doc_id), r.text) for r in texts) == sorted((str(i), t or "") for i, t in ODD)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'the ingon12é.,|<>\x1c\x85　"), st.characters(codec="utf-8")), max_size=40))
def test_any_text(text):
    (packed,) = CODEC.encode([text])
    assert list(memoryview(packed).cast("I")) == ids(text)
    assert CODEC.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=40))
def test_any_bytes_merge_the_same(data):
    assert CODEC.transducer.encode(data) == CODEC.transducer.merge(data)


def test_few_states_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(bpe, "STATES", 20)
    monkeypatch.setattr(bpe, "PIECES", 20)
    small = bpe.Codec(PATH, PATTERN)
    texts = [t for _, t in docs[:15]] + ["x" * 3000]
    assert [list(memoryview(x).cast("I")) for x in small.encode(texts)] == [ids(t) for t in texts]


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_stream_decoding(data, step):
    """However the bytes are cut, the stream gives what decoding them at once gives, and only whole characters."""
    decoder = bpe.StreamDecoder([data[i : i + step] for i in range(0, len(data), step)] or [b""])
    pieces = list(decoder.stream(range(len(decoder.tokens))))
    assert all(p.decode() for p in pieces)
    try:
        assert b"".join(pieces) == data.decode().encode()
    except UnicodeDecodeError:
        assert "�" in b"".join(pieces).decode()


@pytest.mark.parametrize("text", ["aé☃\U0001f600z", "日本語 テスト"])
def test_characters_over_several_tokens(text):
    whole = bpe.StreamDecoder([bytes((b,)) for b in range(256)])
    assert [p.decode() for p in whole.stream(text.encode())] == list(text)


def test_words_are_remembered_once_and_garbage_is_collected_again():
    codec = bpe.Codec(PATH, PATTERN)
    text = "some words, of one piece each (and one of two)"
    assert list(memoryview(codec.encode([text])[0]).cast("I")) == ids(text)
    assert not {" some", " words", " one", " piece"} & set(codec._known) and gc.isenabled()


def test_states_are_small(docs):
    """A state holds numbers for its places and one string of bytes, no strings of tokens for each place."""
    codec = bpe.Codec(PATH, PATTERN)
    codec.encode([t for _, t in docs[:15]])
    for before, rest, places in codec.transducer._states:
        assert isinstance(before, int) and isinstance(rest, bytes) and all(isinstance(x, int) for p in places for x in p)
