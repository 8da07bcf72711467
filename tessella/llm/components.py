"""Connected components of an edge table, without moving the edges to one place."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.runtime import cores, discard, materialize

SCHEMA = "a long, b long"
#: A node of more than one in so many edge ends is joined where its edges lie.
SHARE = 1000
#: Edge ends of one task.
EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (smallest node, node) with the same components as the edges given."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            nxt = new[new]
            if np.array_equal(nxt, new):
                break
            new = nxt
        new = new[label]
        if np.array_equal(new, label):
            break
        label = new
    keep = label != np.arange(len(nodes))
    return nodes[label[keep]], nodes[keep]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        if batch.num_rows:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > 1 << 20:
                shrunk = forest(a, b)
                if len(shrunk[0]) > len(a) // 2:  # little to gain from holding more
                    yield pa.RecordBatch.from_arrays([pa.array(shrunk[0]), pa.array(shrunk[1])], ["a", "b"])
                    shrunk = (np.zeros(0, np.int64), np.zeros(0, np.int64))
                a, b = shrunk
    if len(a):
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)`` that is not its own root.

    Edges shrink to local forests inside each task, then large-star and small-star rounds
    alternate until nothing changes; each round is a table in the shared folder, and nodes of
    very many edges meet their neighbours where these lie. ``root`` is the smallest node of
    the component. A node without a row is its own root.
    """
    stars = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_local, SCHEMA), "cc")
    before = (stars.count(), 0, 0)
    while True:
        # dealt by the first node once, over as many tasks as there are edges for
        width = max(2 * cores(stars.sparkSession), -(-2 * before[0] // EDGES))
        ends = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # nodes of more than one in ``SHARE`` of all edge ends, so fewer than ``SHARE`` of them
        line = max(2 * before[0] // SHARE, 100)
        hubs = [r.a for r in ends.groupBy("a").count().where(F.col("count") > line).select("a").collect()]
        hub = F.col("a").isin(hubs) if hubs else F.lit(False)
        # large star: link larger neighbours to the smallest of the neighbourhood
        both = ends.where(~hub).repartition(width, "a")
        large = both.join(both.groupBy("a").agg(F.min("b").alias("m")), "a")
        if hubs:
            low = ends.where(hub).groupBy("a").agg(F.min("b").alias("m"))
            large = large.unionByName(ends.where(hub).join(F.broadcast(low), "a"))
        large = large.where("b > a").select(F.least("a", "m").alias("a"), "b").where("a <> b")
        # small star: link smaller neighbours and the node itself to the smallest; a node has
        # as many smaller neighbours as there were forests with it
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).repartition(width, "a")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("m").alias("a"), "b").unionByName(low.select(F.col("m").alias("a"), F.col("a").alias("b")))
        old, stars = stars, materialize(small.where("a <> b").repartition(width, "a", "b").distinct(), "cc")
        discard(old)
        state = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 31)), F.sum(F.xxhash64("b", "a") % (1 << 31))).first()
        if state == before:
            return stars.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = state
