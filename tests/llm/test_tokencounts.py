import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from pagemill.llm.catalog import op4_token_counts
from pagemill.llm.tokencounts import PrefixCounter, count_tokens

from .conftest import ODD

PATH = public_tokenizers.path("piece_bpe_32k.model")
COUNTER, LIBRARY = PrefixCounter(PATH), SentencePieceProcessor(model_file=PATH)


def test_all_documents(spark, sf, docs):
    got = {r.doc_id: r for r in op4_token_counts(spark, sf).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        n = len(LIBRARY.encode(text or ""))
        assert (got[doc_id].n_bytes, got[doc_id].n_tokens, got[doc_id].over_limit) == (len((text or "").encode()), n, n > 4096)


def test_odd_rows(make):
    got = count_tokens(make(ODD), PATH).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(LIBRARY.encode(t or ""))) for i, t in ODD)
    assert count_tokens(make([]), PATH).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab e\n\t▁▁<s>the ingÄ☃é0.,  "), max_size=40))
def test_any_text(text):
    assert COUNTER.count(text) == len(LIBRARY.encode(text))


def test_every_prefix(docs):
    rng = random.Random(0)
    for _, text in rng.sample(docs, 12):
        text = " ".join((text or "x").split())[:2000]
        table = COUNTER.prefix_table(text)
        assert len(table) == len(text) + 2
        for i in rng.sample(range(1, len(text) + 1), min(20, len(text))):
            assert table[i + 1] == len(LIBRARY.encode(text[:i]))


@pytest.mark.parametrize("budget", [0, 1, 5, 50, 10**9])
def test_truncation_is_the_longest_within_budget(docs, budget):
    text = " ".join(docs[0][1].split())[:600]
    kept = COUNTER.truncate(text, budget)
    assert text.startswith(kept) and len(LIBRARY.encode(kept)) <= budget
    assert all(len(LIBRARY.encode(text[:i])) > budget for i in range(len(kept) + 1, len(text) + 1))


def test_results_do_not_depend_on_what_is_remembered(docs, monkeypatch):
    monkeypatch.setattr("pagemill.llm.tokencounts.REMEMBERED", 50)
    small = PrefixCounter(PATH)
    assert [small.count(t) for _, t in docs[:20]] == [len(LIBRARY.encode(t)) for _, t in docs[:20]]
