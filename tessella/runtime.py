"""Session helpers: shared scratch tables, bounded broadcasts and group iteration."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tessella-"), "tessella.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    sc.addPyFile(path)
    sc._tessella_shipped = True


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where the setting is missing and driver and executors are one process (tests, a laptop)
    a local folder is made and recorded; on a cluster that is an error.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not _local(spark):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
        root = getattr(spark.sparkContext, "_tessella_scratch", None)
        if root is None:
            root = "file://" + tempfile.mkdtemp(prefix="tessella-")
            spark.sparkContext._tessella_scratch = root
    return root.rstrip("/")


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder, deleted when the session's JVM ends."""
    path = f"{scratch_root(spark)}/tessella/{label}-{uuid.uuid4().hex}"
    system, target = _files(spark, path)
    system.deleteOnExit(target)
    return path


def free(spark: SparkSession, path: str) -> None:
    """Delete an intermediate table that nothing reads any more."""
    system, target = _files(spark, path)
    system.delete(target, True)


def materialize(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, partitioned ``by`` some columns, and read it back:
    lineage is cut, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessella_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Free tables that :func:`materialize` made."""
    for table in tables:
        free(table.sparkSession, table._tessella_path)


def cores(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def shuffle_width(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))


def byte_width(df: DataFrame, per_task: int) -> int:
    """How many tasks of about ``per_task`` input bytes ``df`` makes by the planner's estimate,
    two for each core at least; twice the shuffle's width where there is no estimate."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:
        return 2 * shuffle_width(spark)
    return max(2 * cores(spark), -(-size // per_task))


class IdFilter:
    """A bitmap of hashed keys: a semi-join reducer with no false negatives.

    The bitmap has sixteen bits or more for each key, up to ``MOST`` keys, so what reaches
    the driver and is broadcast never exceeds ``16 * MOST / 4`` bytes. Beyond that there is
    no bitmap and everything passes, to the exact join that follows anyway.
    """

    MOST = 1 << 24

    def __init__(self, keys: DataFrame, *cols: str, most: int = MOST) -> None:
        n = keys.count()
        self.bits = None
        self.words = 1 << max(12, (n // 4).bit_length())
        if n > most:
            return
        h = F.xxhash64(*cols)
        slots = keys.select(
            F.pmod(h, F.lit(self.words)).cast("int").alias("w"),
            F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int")).alias("b"),
        )
        table = slots.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
        bits = np.zeros(self.words, dtype=np.int64)
        bits[table["w"].to_numpy()] = table["b"].to_numpy()
        self.bits = keys.sparkSession.sparkContext.broadcast(bits)

    def key(self, *cols: str) -> Column:
        """The column that :meth:`passes` takes."""
        return F.xxhash64(*cols)

    def passes(self, h: np.ndarray) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(h), dtype=bool)
        return (self.bits.value[np.mod(h, self.words)] >> np.mod(h >> 40, 64)) & 1 == 1


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], count: str, share: int = 1000) -> DataFrame:
    """Inner join with a table of unique keys whose column ``count`` tells how often each
    occurs in ``left``.

    Keys that hold more than one in ``share`` of all rows of ``left``, fewer than ``share``
    of them, are joined where the rows lie, by a broadcast of so many rows at most; only the
    others are shuffled by key. ``left`` is read twice.
    """
    most = right.agg(F.max(count), F.sum(count)).first()
    if not most[0] or most[0] <= max(most[1] // share, 1):
        return left.join(right, list(keys))
    line = F.lit(most[1] // share)
    hot = F.broadcast(right.where(F.col(count) > line))
    cold = left.join(hot.select(*keys), list(keys), "left_anti").join(right.where(F.col(count) <= line), list(keys))
    return cold.unionByName(left.join(hot, list(keys)))


def iter_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal integer keys, from batches already sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(c[a] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
