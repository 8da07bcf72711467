"""What the two vector searches share: usable vectors, shards in place, query blocks.

A shard is up to ``rows`` consecutive usable vectors of one input partition, so sharding
moves nothing. Queries are packed into blocks, blocks are dealt into groups, and every task
takes one shard and one group of blocks: the stated query set against all rows, in blocks.
Tasks are dealt as pairs of numbers; a task reads its shard once for all of its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.runtime import cores, materialize, shuffle_width

#: Tasks of a search for each core, as far as there are blocks of queries for them.
TASKS = 3
#: Blocks of queries that a task takes at most, but for the remainders of input partitions.
GROUP = 16


def usable(batch: pa.RecordBatch, dims: int | None = None, zero: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Ids and double components of the vectors that take part.

    Left out: null ids, null or empty vectors, null or non-finite components, vectors of
    another length than ``dims`` (by default the first usable one's), and with
    ``zero=False`` vectors without a component other than 0.
    """
    ids, column = batch.column("vec_id"), batch.column("embedding")
    ok = np.array(column.is_valid()) & np.array(ids.is_valid())
    lengths = np.asarray(column.value_lengths().fill_null(0))
    values = column.flatten()
    flat = values.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    lengths = np.where(np.array(column.is_valid()), lengths, 0)
    ok &= lengths > 0
    if dims is None and ok.any():
        dims = int(lengths[ok][0])
    ok &= lengths == (dims or -1)
    ends = np.cumsum(lengths)
    pick = np.flatnonzero(ok)
    if not len(pick):
        return np.zeros(0, np.int64), np.zeros((0, dims or 0))
    x = flat[(ends[pick] - dims)[:, None] + np.arange(dims)]
    good = np.isfinite(x).all(axis=1)
    if not zero:
        good &= (x != 0).any(axis=1)
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[pick][good], np.ascontiguousarray(x[good])


def shards(vectors: DataFrame, build: Callable[[np.ndarray, np.ndarray], bytes], dims: int, rows: int, zero: bool) -> DataFrame:
    """``shard long, blob binary``: ``build(ids, vectors)`` of every shard, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held_i: list[np.ndarray] = []
        held_x: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            blob = build(np.concatenate(held_i), np.concatenate(held_x))
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number]), pa.array([blob], pa.binary())], ["shard", "blob"])

        for batch in batches:
            ids, x = usable(batch, dims, zero)
            while len(ids):
                take = min(rows - size, len(ids))
                held_i.append(ids[:take])
                held_x.append(x[:take])
                ids, x, size = ids[take:], x[take:], size + take
                if size == rows:
                    yield out()
                    held_i, held_x, size, number = [], [], 0, number + 1
        if size:
            yield out()

    return materialize(vectors.select("vec_id", "embedding").mapInArrow(run, "shard long, blob binary"), "shards")


def dimensions(vectors: DataFrame) -> int:
    """The length of most vectors, the smallest on ties; 0 if there are none."""
    row = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return int(row.d) if row else 0


def query_blocks(queries: DataFrame, dims: int, size: int, zero: bool) -> DataFrame:
    """``block long, ids binary, queries binary``: up to ``size`` queries a row, written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, x = usable(batch, dims, zero)
            for at in range(0, len(ids), size):
                own = pa.array([ids[at : at + size].tobytes()], pa.binary()), pa.array([x[at : at + size].tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([number]), *own], ["block", "ids", "queries"])
                number += 1

    return materialize(queries.select("vec_id", "embedding").mapInArrow(run, "block long, ids binary, queries binary"), "queries")


def search(
    index: DataFrame, blocks: DataFrame, dims: int, k: int, kind: str, find: Callable[[bytes, np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]
) -> DataFrame:
    """The ``k`` best of every query over all shards, larger scores and smaller ids first.

    ``find(blob, ids, queries)`` yields query ids, vector ids and scores of at most the k
    best of one shard for each query. ``index`` and ``blocks`` are written tables. There are
    as many groups of blocks as keep ``TASKS`` tasks for each core, and no group has more
    than about ``GROUP`` blocks: the shards are copied once for each group, the blocks once
    for each shard, and no task holds more than one shard and one group.
    """
    arrow = pa.int64() if kind == "long" else pa.float64()
    spark = index.sparkSession

    def run(key: tuple, shard: pa.Table, own: pa.Table) -> pa.Table:
        parts = []
        if shard.num_rows:
            blob = shard.column("blob")[0].as_py()
            for ids, queries in zip(own.column("ids"), own.column("queries")):
                names = np.frombuffer(ids.as_buffer(), dtype=np.int64)
                x = np.frombuffer(queries.as_buffer(), dtype=np.float64).reshape(len(names), dims)
                parts += list(find(blob, names, x))
        q, v, s = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        return pa.table([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, arrow)], ["query_id", "vec_id", "score"])

    n_shards, n_blocks = index.count(), blocks.count()
    groups = max(1, min(n_blocks, max(-(-TASKS * cores(spark) // max(n_shards, 1)), -(-n_blocks // GROUP))))
    # numbers of a partition follow each other, and so do those of partitions
    place = F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit((1 << 32) - 1))
    dealt = blocks.withColumn("group", F.pmod(place, F.lit(groups)).cast("int"))
    copies = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    pairs = index.select(F.col("shard").alias("to_shard"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    wanted = pairs.join(dealt.select("group", "ids", "queries"), "group")
    # so wide that pairs seldom share a task; empty tasks cost little
    width = max(shuffle_width(spark), min(2 * n_shards * groups, 16 * cores(spark)))
    copies, wanted = copies.repartition(width, "shard", "group"), wanted.repartition(width, "to_shard", "group")
    found = copies.groupBy("shard", "group").cogroup(wanted.groupBy("to_shard", "group")).applyInArrow(run, f"query_id long, vec_id long, score {kind}")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
