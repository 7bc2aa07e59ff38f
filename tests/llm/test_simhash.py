import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm.catalog import op7_simhash_near_dedup
from pagemill.llm.simhash import components, links, near_duplicates

from .conftest import ODD


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance):
    """Smallest index reachable, by comparing all pairs."""
    label = list(range(len(prints)))
    changed = True
    near = [[j for j in range(len(prints)) if bin(prints[i] ^ prints[j]).count("1") <= distance] for i in range(len(prints))]
    while changed:
        new = [min(label[j] for j in n) for n in near]
        changed, label = new != label, new
    return label


def test_all_documents_against_all_pairs(spark, sf, docs):
    got = {r.doc_id: r for r in op7_simhash_near_dedup(spark, sf).collect()}
    prints = [plain_fingerprint(t) for _, t in docs]
    label = plain_components(prints, 2)
    assert len(got) == len(docs)
    for k, (doc_id, _) in enumerate(docs):
        assert got[doc_id].fingerprint == f"{prints[k]:016x}"
        assert got[doc_id].component_id == docs[label[k]][0]
    assert len(set(label)) < len(docs)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_keep_components(spark, distance):
    rng = np.random.default_rng(distance)
    prints = [int(x) for x in rng.integers(0, 1 << 63, 12)]
    for _ in range(60):
        p = prints[rng.integers(len(prints))]
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            p ^= 1 << int(b)
        prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = links(spark.createDataFrame([(p,) for p in signed], "fp long"), distance).collect()
    assert all(0 < bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= distance for r in found)
    label = {}
    def root(x):
        while label.get(x, x) != x:
            x = label[x]
        return x
    for r in found:
        label[root(r.a)] = root(r.b)
    want = plain_components(prints, distance)
    groups = {}
    for s, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(root(s))
    assert all(len(g) == 1 for g in groups.values()) and len({root(s) for s in signed}) == len(groups)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[1000 + i] for i in range(300)} == {1000}


def test_odd_rows(make):
    got = near_duplicates(make(ODD)).collect()
    assert len(got) == len(ODD)
    assert sorted(r.fingerprint for r in got) == sorted(f"{plain_fingerprint(t):016x}" for _, t in ODD)
    assert {r.doc_id for r in got if r.fingerprint == "0" * 16} == {1, 2, 3}
    assert {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert near_duplicates(make([])).collect() == []
    alone = near_duplicates(make([(None, "a b c d e")])).collect()
    assert [(r.doc_id, r.component_id) for r in alone] == [(None, None)]


def test_a_large_group_of_copies(make):
    rows = [(i, "the very same text for everyone here") for i in range(2000)] + [(9999, "something else entirely is here")]
    got = near_duplicates(make(rows)).groupBy("component_id").agg(F.count("*").alias("n")).collect()
    assert {r.component_id: r.n for r in got} == {0: 2000, 9999: 1}
