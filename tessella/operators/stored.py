"""A bitset index on disk, partitioned by the number of set bits.

A bitset that holds all bits of a query has at least as many, and one of a Tanimoto
similarity of t has between t and 1/t times as many, so a search reads only the partitions
that can have hits: the bounds are literals when the scan is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import bits
from tessella.operators import joins

WIDTH = 4


def write_index(rows: DataFrame, path: str, width: int = WIDTH) -> None:
    """Write ``rows`` (with a bitset ``fp``) in partitions of ``width`` bit counts each; null
    bitsets, which no search finds, are left out."""
    counted = rows.where("fp is not null").withColumn("bits", bits.popcount(F.col("fp")).cast("int"))
    counted.withColumn("bucket", F.floor(F.col("bits") / width).cast("int")).write.partitionBy("bucket").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _bounds(queries: DataFrame) -> tuple[int, int]:
    """The least and most bits of a stated query set; (0, -1) of none."""
    n = bits.popcount(F.col("q_fp"))
    low, high = queries.where("q_fp is not null").agg(F.min(n), F.max(n)).first()
    return (0, -1) if low is None else (int(low), int(high))


def supersets(index: DataFrame, queries: DataFrame, width: int = WIDTH, words: int | None = None) -> DataFrame:
    """Queries with the rows whose bitset holds all of theirs; give the number of ``words`` if all have it."""
    low, _ = _bounds(queries)
    near = index.where(F.col("bucket") >= low // width).drop("bucket")
    return joins.superset_join(queries, near, words=words, dealt=True).drop("bits")


def similar(index: DataFrame, queries: DataFrame, least: float, width: int = WIDTH, words: int | None = None) -> DataFrame:
    """Queries with the rows of a Tanimoto similarity of ``least`` (above 0) or more; ``words`` as in :func:`supersets`."""
    low, high = _bounds(queries)
    near = index.where(F.col("bucket").between(int(low * least) // width, int(high / least) // width)).drop("bucket")
    counted = queries.withColumn("q_bits", bits.popcount(F.col("q_fp")))
    fits = F.col("bits").between(F.floor(F.col("q_bits") * least), F.ceil(F.col("q_bits") / least))
    pairs = joins.in_blocks(counted, near, fits, sizes=joins.counts(queries, near)).withColumn("similarity", bits.tanimoto(F.col("q_fp"), F.col("fp"), words))
    return pairs.where(F.col("similarity") >= least).drop("bits", "q_bits")
