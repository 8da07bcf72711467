"""Vector searches against brute force, with every vector that takes no part."""

import math

import numpy as np
import pytest

from tessella.llm import exact_topk, neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def rows(n=400, d=16):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(n, d)).astype(np.float32)
    x[50:120] = x[50]  # ties
    x[130] = 0
    out = [(i, [float(v) for v in r], 1, "a") for i, r in enumerate(x)]
    out[7] = (7, None, 1, "a")
    out[8] = (8, [], 1, "a")
    out[9] = (9, [None] + [0.5] * (d - 1), 1, "a")
    out[10] = (10, [math.nan] * d, None, None)
    out[11] = (11, [math.inf] + [0.5] * (d - 1), 1, "a")
    return out + [(None, [0.1] * d, 1, "a")]


def usable(zero):
    return {r[0]: np.array(r[1], np.float64) for r in rows() if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and (zero or any(r[1]))}


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return out


@pytest.mark.parametrize("shard", [64, 16_384])
def test_exact_topk(spark, vectors, shard):
    got = by_query(exact_topk.exact_top_k(vectors, vectors.where("vec_id % 10 = 0"), 10, shard))
    own = {i: np.floor(x * 1024).astype(np.int64) for i, x in usable(True).items()}
    for q in (i for i in own if i % 10 == 0):
        want = sorted(((-int(own[q] @ v), i) for i, v in own.items() if i != q))[:10]
        assert got[q] == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert set(got) == {i for i in own if i % 10 == 0}


def test_exact_topk_of_large_components_repeated_ids_and_other_lengths(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) * 10.0 ** rng.integers(0, 5, size=(80, 1))
    x[:3] *= 4000
    ids = [*range(70), *range(10)]  # ten ids twice
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(500, [1e6] * 3), (510, [1.0] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = exact_topk.exact_top_k(table, table.where("vec_id % 10 = 0 and vec_id >= 10"), 10, 16)
    own = [(i, [int(np.floor(c * 1024)) for c in v]) for i, v in zip(ids, x.tolist())]
    for q, w in own[10:70:10]:
        want = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in own if i != q)[:10]
        assert [(s, i) for _, i, s in by_query(got)[q]] == [(-s, i) for s, i in want]
    assert set(by_query(got)) == {10, 20, 30, 40, 50, 60}
    assert max(abs(c) for _, v in own for c in v) > 2**31
    with pytest.raises(OverflowError):
        exact_topk.quantise(np.array([[1e300]]))
    with pytest.raises(OverflowError):
        exact_topk.products(np.full((1, 4), 2**40), np.full(4, 2**40))


def test_recall_at_the_default_factor(spark):
    """The search as the query runs it, over several shards, finds nine in ten or more."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) + 2 * rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)]
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(2)
    got = by_query(neighbours.nearest(table, table.where("vec_id % 20 = 0"), rows=700))
    hits = 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {i for _, i, _ in found})
    assert len(got) == 150 and hits / (150 * 20) >= 0.9


def test_all_candidates_if_fewer(spark):
    few = spark.createDataFrame(rows()[:5], SCHEMA)
    assert {q: len(v) for q, v in by_query(exact_topk.exact_top_k(few, few, 10)).items()} == {i: 4 for i in range(5)}
    assert {q: len(v) for q, v in by_query(neighbours.nearest(few, few, 20)).items()} == {i: 4 for i in range(5)}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_topk.exact_top_k(none, none).count() == 0 and neighbours.nearest(none, none).count() == 0


@pytest.mark.parametrize("shard", [100, 16_384])
def test_factor_one_is_exact(spark, vectors, shard):
    got = by_query(neighbours.nearest(vectors, vectors.where("vec_id % 10 = 0"), 20, factor=1.0, rows=shard))
    own = usable(False)
    for q in (i for i in own if i % 10 == 0):
        want = sorted(((-float((own[q] * v).sum()), i) for i, v in own.items() if i != q))[:20]
        assert [(r, i) for r, i, _ in got[q]] == [(k + 1, i) for k, (_, i) in enumerate(want)]


def test_tree_prunes_and_recalls():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 8))
    tree = neighbours.VantageTree(np.arange(4000), x, leaf=32)
    hits = 0
    for q, v, s in tree.search(x[:100], np.arange(100), 20):
        scores = x @ x[q[0]]
        scores[q[0]] = -np.inf
        hits += len(set(np.argsort(-scores)[:20]) & set(v))
    assert hits / 2000 >= 0.9


def test_every_block_meets_every_shard(spark, vectors, monkeypatch):
    """Many groups of small blocks give what one block gives, and no pair is a product of tables."""
    from tessella.llm import vectors as dealt

    want = by_query(exact_topk.exact_top_k(vectors, vectors, 10, 64))
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(dealt, "GROUP", 2)
    few = exact_topk.exact_top_k(vectors, vectors, 10, 64)
    assert by_query(few) == want and "CartesianProduct" not in few._jdf.queryExecution().toString()
