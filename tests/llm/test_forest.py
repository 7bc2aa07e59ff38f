import numpy as np
import pytest

from pagemill.llm.catalog import op10_nearest_neighbours
from pagemill.llm.forest import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def brute(rows, k, every):
    good = [(i, np.array(v, np.float64)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    out = {}
    for i, q in good:
        if i % every == 0:
            d = sorted({(float(np.sqrt(((q - v) ** 2).sum())), j) for j, v in good if j != i and len(v) == len(q)})
            out[i] = [(j, s) for s, j in d[:k]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, 1, "x") for i, v in rows], SCHEMA)


def test_whole_small_table_is_exact(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = lists(op10_nearest_neighbours(spark, sf)), brute(rows, 10, 100)
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in got for a, b in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize("n,group_rows", [(9_000, 8192), (16_000, 1000)])
def test_recall_of_the_forest(spark, n, group_rows):
    """Vectors in clusters, as many as do not fit one group: every query of the contract against all rows."""
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(40, 64))
    values = (centres[rng.integers(0, 40, n)] + 0.7 * rng.normal(size=(n, 64))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "vec_id long, embedding array<float>")
    got = lists(nearest(frame, every=100, group_rows=group_rows))
    assert set(got) == set(range(0, n, 100)) and all(len(x) == 10 for x in got.values())
    hits = 0
    exact = values.astype(np.float64)
    for q, x in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        d[q] = np.inf
        hits += len({j for j, _ in x} & set(np.lexsort((np.arange(n), d))[:10].tolist()))
        assert x == sorted(x, key=lambda y: (y[1], y[0]))
        assert np.allclose([s for _, s in x], d[[j for j, _ in x]], rtol=1e-12)
    assert hits >= 0.9 * 10 * len(got)


def test_the_ascent_goes_past_the_groups_digits(spark):
    """group_rows forces three digits for groups of 4,000 rows of 4 components; results are those of groups of one digit."""
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(4000, 4)).astype(np.float32).tolist(), 1)]
    want = brute(rows, 10, 100)
    rows = table(spark, rows).repartition(2)
    few, many = ({"trees": 2, "candidates": 700, "every": 100, "group_rows": g} for g in (40, 3999))
    got = lists(nearest(rows, **few))
    assert got == lists(nearest(rows, **many))
    hits = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert set(got) == set(want) and hits >= 0.9 * 10 * len(want)
    # no prefix holds so many rows: the ascent ends at all rows
    got = lists(nearest(rows, every=100, trees=2, candidates=10**6, group_rows=40))
    assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items()}


@pytest.mark.parametrize("group_rows", [5, 1000])
def test_odd_rows(spark, group_rows):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).astype(np.float32)) for i in range(1, 120)]
    rows += [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(200, 300)]  # copies
    rows += [(0, None), (500, None), (520, [0, 0, 0, 0]), (530, [1, None, 0, 0]), (540, [1, float("nan"), 0, 0]), (550, [float("inf"), 0, 0, 1]),
             (None, [1, 1, 1, 1]), (560, [1, 2]), (70, []), (300, [1.0, 2.0, 0.0, -1.0]), (300, [1.0, 2.0, 0.0, -1.0])]
    got, want = lists(nearest(table(spark, rows), k=5, every=10, trees=60, group_rows=group_rows)), brute(rows, 5, 10)
    assert {q: len(x) for q, x in got.items()} == {q: len(x) for q, x in want.items() if x}
    assert got[200] == want[200] == [(i, 0.0) for i in range(201, 206)]
    if group_rows == 1000:
        assert {q: [j for j, _ in x] for q, x in got.items()} == {q: [j for j, _ in x] for q, x in want.items() if x}


def test_empty(spark):
    assert nearest(table(spark, [])).collect() == []
    assert nearest(table(spark, [(100, [1.0, 2.0])])).collect() == []
