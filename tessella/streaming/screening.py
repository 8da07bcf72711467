"""Continuous screening and stateful event operators on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators import ranking, sampling
from tessella.runtime import scratch_path


def screen_batch(members: DataFrame, target: list[int], jobs: int, threshold: float, first_job: int = 0, seed: int = 0, found: DataFrame | None = None) -> DataFrame:
    """X12, one batch: sample, drop known assemblies, optimise, keep hits of ``threshold``.

    Jobs are numbers from ``first_job``; a job picks one member of every set of every
    reaction by hash. ``found(rxn_id, frag_ids)`` are assemblies that need no second look.
    """
    picked = sampling.random_assemblies(members.select("rxn_id", "set_idx", "frag_id"), jobs, seed=seed + first_job)
    rows = picked.groupBy("rxn_id", "attempt").agg(F.sort_array(F.collect_list(F.struct("set_idx", "frag_id"))).alias("f"))
    seeds = rows.select((F.col("attempt") + first_job).cast("long").alias("seed_id"), "rxn_id", F.transform("f", lambda x: x["frag_id"]).alias("frag_ids"))
    seeds = seeds.groupBy("rxn_id", "frag_ids").agg(F.min("seed_id").alias("seed_id"))
    if found is not None:
        seeds = seeds.join(found, ["rxn_id", "frag_ids"], "left_anti")
    best = sampling.beam_search(seeds.select("seed_id", "rxn_id", "frag_ids"), members, target, beam=2, rounds=3)
    hits = ranking.best_per(best, ["rxn_id", "frag_ids"], "score", "seed_id")
    return ranking.threshold(hits, "score", threshold)


def continuous_screening(spark: SparkSession, members: DataFrame, target: list[int], out: str, jobs_per_batch: int = 32, seconds: float = 60.0, max_batches: int | None = None, threshold: float = 0.0) -> int:
    """Screen in micro-batches until the deadline; hits are appended to ``out``.

    The rate source numbers the jobs, so a restarted batch draws the same jobs, and each
    batch replaces its own folder: a retry leaves one copy. Returns the batches finished.
    """
    done: list[int] = []

    def batch(frame: DataFrame, number: int) -> None:
        if time.monotonic() < deadline and (max_batches is None or len(done) < max_batches):
            hits = screen_batch(members, target, jobs_per_batch, threshold, first_job=number * jobs_per_batch)
            hits.write.mode("overwrite").parquet(f"{out}/batch={number}")
            done.append(number)

    deadline = time.monotonic() + seconds
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", scratch_path(spark, "stream")).start()
    while query.isActive and time.monotonic() < deadline and (max_batches is None or len(done) < max_batches):
        query.awaitTermination(0.2)
    query.stop()  # the batch under way ends, queued ones are dropped
    return len(done)


def drop_duplicates_stream(stream: DataFrame, keys: list[str], time_column: str, delay: str = "10 minutes") -> DataFrame:
    """U5 as a stream: exact within the watermark, with state that the delay bounds."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a finite stream to its end into a table in the shared folder."""
    spark = stream.sparkSession
    path, state = scratch_path(spark, "sink"), scratch_path(spark, "stream")

    def batch(frame: DataFrame, number: int) -> None:
        (transform(frame) if transform else frame).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.IntegerType())])).parquet(path)


def first_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """First time and number of every (user, type), by a streaming aggregation over files.

    Micro-batches emit what changed; the last state of a key is the one of its last batch.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(path.rpartition("/")[0] + "/{" + path.rpartition("/")[2] + "}")
    grouped = stream.groupBy("user_id", "event_type").agg(F.min("ts").alias("first_ts"), F.count("*").alias("n"))
    states = run_to_table(grouped, "update")
    last = states.groupBy("user_id", "event_type").agg(F.max_by(F.struct("first_ts", "n"), "batch").alias("s"))
    return last.select("user_id", "event_type", "s.first_ts", "s.n")


def windowed_counts(stream: DataFrame, delay: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event-time window and type, late rows beyond ``delay`` dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return stream.withWatermark("ts", delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
