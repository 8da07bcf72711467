"""Approximate nearest neighbours by vantage-point trees (operator 10).

Nearness is the inner product, which is no metric. Within a shard, vectors are completed by
one more component to the largest norm of the shard, and a query by a zero; the Euclidean
distance between these falls as the inner product grows, and the triangle inequality holds.

A tree splits the vectors around a vantage point at the median distance until ``LEAF`` are
left. A query at distance d from the vantage point, whose k-th best so far is at distance
t, may skip the inner ball if d - mu > t / factor and the outer part if mu - d > t / factor:
``factor`` 1 is the triangle inequality and gives exact results; a larger one prunes more.
Queries go down a tree together, a whole block at each node, nearer parts first, and leaves
are scored by one matrix product. Equal vectors are one point of the tree with all its ids.

Scores are recomputed from the original vectors in double precision, component by
component, so equal vectors have equal scores; ties go to the smaller ``vec_id``. Defined
results: vectors that are null, empty or zero, or hold null or non-finite components, and
rows with a null id take no part, nor do vectors of another length than most. A query finds
no row of its own id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.vectors import dimensions, query_blocks, search, shards

K = 20
FACTOR = 1.6
LEAF = 256
SHARD_ROWS = 16_384
QUERY_BLOCK = 512


class VantageTree:
    """A vantage-point tree over the distinct vectors of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF, seed: int = 7) -> None:
        x = x + 0.0  # no negative zeros
        order = np.lexsort((ids,))
        ids, x = ids[order], x[order]
        rows = np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel()
        _, first, group = np.unique(rows, return_index=True, return_inverse=True)
        self.x = x[first]
        by_group = np.argsort(group, kind="stable")
        self.ids = ids[by_group]
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(first)))])
        self._complete()
        self.leaf = leaf
        rng = np.random.default_rng(seed)
        self.root = self._split(np.arange(len(self.x)), rng)

    def _complete(self) -> None:
        """The vectors, all completed to the largest norm."""
        norms = np.einsum("nd,nd->n", self.x, self.x)
        self.reach = float(norms.max())
        self.full = np.concatenate([self.x, np.sqrt(np.maximum(self.reach - norms, 0))[:, None]], axis=1)

    def __getstate__(self) -> dict:
        """Without what follows from the vectors, and these in single precision where that is exact."""
        small = self.x.astype(np.float32)
        x = small if (small == self.x).all() else self.x
        return {k: v for k, v in self.__dict__.items() if k not in ("full", "reach")} | {"x": x}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state | {"x": state["x"].astype(np.float64)})
        self._complete()

    def _split(self, points: np.ndarray, rng: np.random.Generator):
        if len(points) <= self.leaf:
            return points
        # the vantage point of some with the widest spread of distances
        some = rng.choice(points, size=min(8, len(points)), replace=False)
        sample = self.full[rng.choice(points, size=min(256, len(points)), replace=False)]
        spread = [np.linalg.norm(sample - self.full[p], axis=1).var() for p in some]
        vantage = int(some[int(np.argmax(spread))])
        d = np.linalg.norm(self.full[points] - self.full[vantage], axis=1)
        mu = float(np.median(d))
        inner = d <= mu
        if inner.all():
            return points
        return vantage, mu, self._split(points[inner], rng), self._split(points[~inner], rng)

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = FACTOR) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query ids, vector ids and scores of the k nearest found."""
        n = len(queries)
        lengths = np.einsum("nd,nd->n", queries, queries)
        best = np.full((n, k + 1), -np.inf)  # one more, as the query itself may be among them
        held = np.full((n, k + 1), -1, dtype=np.int64)
        full = np.concatenate([queries, np.zeros((n, 1))], axis=1)

        def radius(who: np.ndarray) -> np.ndarray:
            # distance of the worst of the best; the margin keeps ties at the boundary
            worst = best[who].min(axis=1)
            return np.sqrt(np.maximum(lengths[who] + self.reach - 2 * worst, 0)) * (1 + 1e-12) + 1e-12

        def visit(node, who: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                scores = queries[who] @ self.x[node].T
                both = np.concatenate([best[who], scores], axis=1)
                names = np.concatenate([held[who], np.broadcast_to(node, scores.shape)], axis=1)
                pick = np.argpartition(-both, k, axis=1)[:, : k + 1]
                best[who] = np.take_along_axis(both, pick, axis=1)
                held[who] = np.take_along_axis(names, pick, axis=1)
                return
            vantage, mu, inner, outer = node
            d = np.linalg.norm(full[who] - self.full[vantage], axis=1)
            near_in = d <= mu
            for first, second, pick in ((inner, outer, near_in), (outer, inner, ~near_in)):
                some = who[pick]
                if not len(some):
                    continue
                visit(first, some)
                gap = np.abs(d[pick] - mu)
                more = some[gap <= radius(some) / factor]
                if len(more):
                    visit(second, more)

        visit(self.root, np.arange(n))
        for i in range(n):
            points = held[i][held[i] >= 0]
            exact = (self.x[points] * queries[i]).sum(axis=1)
            order = np.argsort(-exact, kind="stable")
            ids, scores = [], []
            for p, s in zip(points[order].tolist(), exact[order].tolist()):
                mine = self.ids[self.bounds[p] : self.bounds[p + 1]][: k + 1]
                mine = mine[mine != own[i]][:k]
                ids.append(mine)
                scores.append(np.full(len(mine), s))
            ids, scores = np.concatenate(ids), np.concatenate(scores)
            top = np.lexsort((ids, -scores))[:k]
            yield np.full(len(top), own[i]), ids[top], scores[top]


def _build(ids: np.ndarray, x: np.ndarray) -> bytes:
    return pickle.dumps(VantageTree(ids, x), protocol=5)


def _finder(k: int, factor: float):
    def find(blob: bytes, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        q, v, s = zip(*pickle.loads(blob).search(queries, ids, k, factor))
        yield np.concatenate(q), np.concatenate(v), np.concatenate(s)

    return find


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, factor: float = FACTOR, rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k nearest found; exact with ``factor=1``."""
    dims = dimensions(vectors)
    index = shards(vectors, _build, dims, rows, zero=False)
    return search(index, query_blocks(queries, dims, QUERY_BLOCK, zero=False), dims, k, "double", _finder(k, factor))


def op10_vantage_point_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
