"""Exact top-k by bit-sliced indexes (operator 2).

A shard of the index holds, for every component, the bits of its quantised values as
bitmaps over the shard's rows (slices). A query's inner products are computed for all rows
at once, by bitmap arithmetic alone: the slices that the bits of the query's weights select
fall into columns of equal significance, which full adders compress until a single sum per
row is left, itself bit-sliced. Negative weights take complemented slices, which shifts all
sums of a query by the same amount. Then the top rows are selected from the most
significant slice downward: rows with the bit set, while there are no more than k of them,
are taken, the others stay candidates. The rows at the boundary, all of equal sum, are
resolved exactly, by the smallest ids; scores are computed from the integers themselves.

Defined results: vectors that are null or empty, or hold null or non-finite components, and
rows with a null id take no part, nor do vectors of another length than most. Equal vectors
are separate rows, ties go to the smaller ``vec_id``. Rows that repeat a ``vec_id`` are all
ranked against other queries, and none of them against a query of that id. Nothing is
clipped: selection is exact for quantised components of less than 2**62, beyond which, or if
a score to be returned is no 64-bit integer, the search fails with an ``OverflowError``.
Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.vectors import dimensions, query_blocks, search, shards

SCALE = 1024
K = 10
SHARD_ROWS = 16_384
QUERY_BLOCK = 128


def quantise(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    out = np.floor(x * scale)
    if out.size and np.abs(out).max() >= 2.0**62:
        raise OverflowError("quantised components of 2**62 or more")
    return out.astype(np.int64)


def products(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The inner products of rows of ``values`` with ``weights``, exactly."""
    if not values.size or float(np.abs(values).max()) * float(np.abs(weights).astype(float).sum()) < 2.0**62:
        return values.astype(np.int64) @ weights
    exact = [sum(a * b for a, b in zip(row, weights.tolist())) for row in values.tolist()]
    if not all(-(2**63) <= v < 2**63 for v in exact):
        raise OverflowError("a score of more than 64 bits")
    return np.array(exact, dtype=np.int64)


class BitSlices:
    """The bit-sliced index of one shard."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, slices: np.ndarray, lows: np.ndarray, widths: np.ndarray) -> None:
        self.ids, self.values, self.slices, self.lows, self.widths = ids, values, slices, lows, widths
        self.first = np.concatenate([[0], np.cumsum(widths)])

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, scale: int = SCALE) -> BitSlices:
        order = np.argsort(ids, kind="stable")
        ids, values = ids[order], quantise(x[order], scale)
        lows = values.min(axis=0)
        spans = values.max(axis=0) - lows
        widths = np.array([int(s).bit_length() for s in spans], dtype=np.int64)
        pad = -len(ids) % 64
        out = []
        for d in range(values.shape[1]):
            shifted = values[:, d] - lows[d]
            for b in range(widths[d]):
                bits = np.concatenate([(shifted >> b) & 1, np.zeros(pad, np.int64)]).astype(np.uint8)
                out.append(np.packbits(bits, bitorder="little").view(np.uint64))
        slices = np.stack(out) if out else np.zeros((0, (len(ids) + pad) // 64), np.uint64)
        return cls(ids, values, slices, lows, widths)

    def dumps(self) -> bytes:
        n, d = self.values.shape
        size = 4 if not self.values.size or np.abs(self.values).max() < 2**31 else 8
        head = struct.pack("<QQQQ", n, d, len(self.slices), size)
        return b"".join([head, self.ids.tobytes(), self.values.astype(f"<i{size}").tobytes(), self.lows.tobytes(), self.widths.tobytes(), self.slices.tobytes()])

    @classmethod
    def loads(cls, blob: bytes) -> BitSlices:
        n, d, s, size = struct.unpack_from("<QQQQ", blob)
        at = 32
        ids = np.frombuffer(blob, np.int64, n, at)
        values = np.frombuffer(blob, f"<i{size}", n * d, at + 8 * n).reshape(n, d)
        at += 8 * n + size * n * d
        lows, widths = np.frombuffer(blob, np.int64, d, at), np.frombuffer(blob, np.int64, d, at + 8 * d)
        slices = np.frombuffer(blob, np.uint64, -1, at + 16 * d).reshape(s, (n + 63) // 64)
        return cls(ids, values, slices, lows, widths)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """Slices, least significant first, of the inner products with ``weights``, up to an
        amount that is the same for all rows."""
        columns: dict[int, list[np.ndarray]] = defaultdict(list)
        ones = ~np.uint64(0)
        for d, w in enumerate(weights.tolist()):
            own = self.slices[self.first[d] : self.first[d + 1]]
            if w < 0:  # -v is (2**width - 1 - v) less a constant
                own, w = own ^ ones, -w
            p = 0
            while w:
                if w & 1:
                    for b in range(len(own)):
                        columns[p + b].append(own[b])
                w >>= 1
                p += 1
        out, p = [], 0
        while columns:
            column = columns.pop(p, [])
            while len(column) > 2:  # full adders: three slices become a sum and a carry
                a, b, c = column.pop(), column.pop(), column.pop()
                half = a ^ b
                column.insert(0, half ^ c)
                columns[p + 1].append((a & b) | (half & c))
            if len(column) == 2:
                a, b = column
                column = [a ^ b]
                columns[p + 1].append(a & b)
            out.append(column[0] if column else np.zeros(self.slices.shape[1], np.uint64))
            p += 1
        return out

    def top(self, weights: np.ndarray, k: int, without: int | None = None) -> np.ndarray:
        """The rows of the k largest inner products, ties to smaller ids."""
        n = len(self.ids)
        left = np.full((n + 63) // 64, ~np.uint64(0))
        if n % 64:
            left[-1] = (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1)
        if without is not None:
            lo, hi = np.searchsorted(self.ids, [without, without + 1])
            for row in range(lo, hi):
                left[row // 64] &= ~(np.uint64(1) << np.uint64(row % 64))
        taken = np.zeros_like(left)
        count = 0
        for bits in reversed(self.sums(weights)):
            upper = left & bits
            m = int(np.bitwise_count(upper).sum())
            if count + m >= k:
                left = upper
                if count + m == k:
                    break
            else:
                taken, count, left = taken | upper, count + m, left & ~bits

        def rows(bitmap: np.ndarray, most: int) -> np.ndarray:
            return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))[:most]

        # the boundary rows have equal sums; rows are in the order of their ids
        return np.concatenate([rows(taken, n), rows(left, k - count)])


def _build(ids: np.ndarray, x: np.ndarray) -> bytes:
    return BitSlices.build(ids, x).dumps()


def _finder(k: int):
    def find(blob: bytes, ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        index = BitSlices.loads(blob)
        q, v, s = [], [], []
        for own, weights in zip(ids.tolist(), quantise(queries)):
            rows = index.top(weights, k, own)
            q.append(np.full(len(rows), own))
            v.append(index.ids[rows])
            s.append(products(index.values[rows], weights))
        yield np.concatenate(q), np.concatenate(v), np.concatenate(s)

    return find


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = K, rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the k largest integer inner products."""
    dims = dimensions(vectors)
    index = shards(vectors, _build, dims, rows, zero=True)
    return search(index, query_blocks(queries, dims, QUERY_BLOCK, zero=True), dims, k, "long", _finder(k))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return exact_top_k(vectors, vectors.where("vec_id % 100 = 0"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
