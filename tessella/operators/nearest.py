"""W1, W2 of a stated query set against all rows: the most similar by bitset, in tiles.

A tile is a bounded part of the rows and a bounded part of the queries, dealt by their ids. A task scores one
tile at a time, a block of queries after another, and only the best of a tile leave it, so
neither the scores of a query nor those of a tile are ever sorted or shuffled whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import ranking
from tessella.runtime import cores

ROWS, QUERIES, SCORES = 1 << 16, 1 << 12, 1 << 20


def _bitsets(words: list[np.ndarray]) -> np.ndarray:
    """Two 32-bit words to each 64-bit one."""
    whole = [w.astype(np.uint64) for w in words]
    whole += [np.zeros_like(whole[0])] * (len(whole) % 2)
    return np.stack([a | b << np.uint64(32) for a, b in zip(whole[::2], whole[1::2])])


def _first(query: np.ndarray, score: np.ndarray, key: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each query by descending score and ascending key."""
    order = np.lexsort((key, -score, query))
    own = query[order]
    start = np.r_[True, own[1:] != own[:-1]] if len(own) else np.zeros(0, bool)
    place = np.arange(len(own))
    return order[place - np.maximum.accumulate(np.where(start, place, 0)) < k]


def _best(queries: pa.Table, rows: pa.Table, k: int, words: int, others: bool) -> pa.Table:
    groups = rows["by"].combine_chunks().dictionary_encode(null_encoding="encode")
    code = groups.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True]) if len(order) else np.zeros(1, int)
    ids = rows["vec_id"].to_numpy()[order]
    r = _bitsets([rows[f"w{w}"].to_numpy()[order] for w in range(words)])
    q_ids, q = queries["query_id"].to_numpy(), _bitsets([queries[f"w{w}"].to_numpy() for w in range(words)])
    r_bits, q_bits = (np.bitwise_count(x).sum(axis=0, dtype=np.int32) for x in (r, q))
    step = max(1, SCORES // max(1, len(ids)))
    out: list[tuple] = []
    for low in range(0, len(q_ids), step):
        own = slice(low, low + step)
        shared = sum(np.bitwise_count(a[own, None] & b[None, :]).astype(np.int32) for a, b in zip(q, r))
        either = q_bits[own, None] + r_bits[None, :] - shared
        score = np.full(shared.shape, -1.0)  # two empty bitsets: null, after all others
        np.divide(shared, either, out=score, where=either > 0)
        if others:
            score[q_ids[own, None] == ids[None, :]] = -2.0
        for a, b in zip(edges, edges[1:]):
            part = score[:, a:b]
            line = np.partition(part, b - a - k, axis=1)[:, b - a - k, None] if b - a > k else -1.0
            at, found = np.nonzero((part >= line) & (part > -2.0))
            best = _first(at, part[at, found], ids[a + found], k)
            at, found = at[best], a + found[best]
            out.append((q_ids[low + at], order[found], ids[found], r_bits[found], score[at, found]))
    query, place, vec, size, score = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0)] * 5
    return pa.table({
        "query_id": pa.array(query, pa.int64()), "by": rows["by"].take(pa.array(place.astype(np.int64))), "vec_id": pa.array(vec, pa.int64()),
        "size": pa.array(size, pa.float64()), "similarity": pa.array(score, pa.float64(), mask=score < 0),
    })


def most_similar(queries: DataFrame, rows: DataFrame, k: int, words: int, by: str | None = None, others: bool = False) -> DataFrame:
    """The ``k`` rows of the largest Tanimoto similarity for each query, and for each value of the integer column ``by``.

    ``queries(query_id, q_fp)``, ``rows(vec_id, fp)``; ties go to the smaller ``vec_id``, null
    similarities (two empty bitsets) come last, with ``others`` a query's own row takes no
    part. Result: ``query_id, by, vec_id, size, similarity, rank``; ``size`` counts the row's bits.
    """
    n_queries, n_rows = queries.count(), rows.count()
    spread = min(2 * cores(rows.sparkSession), n_queries * n_rows // (4 * SCORES))
    down, across = max(1, -(-n_rows // ROWS), spread), max(1, -(-n_queries // QUERIES))
    group = F.col(by).cast("long") if by else F.lit(None).cast("long")
    left = queries.select("query_id", *[F.col("q_fp")[w].alias(f"w{w}") for w in range(words)], F.pmod(F.xxhash64("query_id"), F.lit(across)).cast("long").alias("s_"))
    left = left.withColumn("t_", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("t_", F.col("t_").cast("long"))
    right = rows.select("vec_id", group.alias("by"), *[F.col("fp")[w].alias(f"w{w}") for w in range(words)], F.pmod(F.xxhash64("vec_id"), F.lit(down)).cast("long").alias("t_"))
    right = right.withColumn("s_", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("s_", F.col("s_").cast("long"))
    width = max(2 * cores(rows.sparkSession), down * across)
    sides = [side.repartition(width, "s_", "t_").groupBy("s_", "t_") for side in (left, right)]

    def tile(own: pa.Table, against: pa.Table) -> pa.Table:
        return _best(own, against, k, words, others)

    found = sides[0].cogroup(sides[1]).applyInArrow(tile, "query_id long, by long, vec_id long, size double, similarity double")
    return ranking.top_per(found, ["query_id", "by"] if by else ["query_id"], [F.desc("similarity"), F.asc("vec_id")], k)
