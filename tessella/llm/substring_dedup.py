"""Substring deduplication with a log-structured fingerprint index (operator 6).

Every window of ``WINDOW`` consecutive words whose word sequence also starts anywhere
else is removed. Winnowing selects fingerprints: each window selects the smallest hash
among its ``GRAM``-word grams, so two equal windows always select the same fingerprint,
while only about one gram in eight is stored.

Every batch of texts adds one *sorted immutable run* to the index: a table bucketed by
fingerprint, with one sorted file in each bucket. A new batch is merge-joined with the runs
before it bucket by bucket: only the batch is shuffled, the history is read as it lies.
What comes out are the texts, of the batch and of the history, that share a fingerprint,
those of the history only if it was not known to be shared; old runs are not counted again.
When there are more than ``FAN_IN`` runs they are *compacted* into one with a single row
for each fingerprint. The texts found are *verified* on 128-bit hashes of whole windows,
and only those decide.

A passage that a large share of all texts holds is split: within each batch of rows of a
task, a repeated fingerprint (or window) is known to repeat, so its rows need no partner
elsewhere, and one row of them is enough to tell others.

Defined results: a null text has no words. Texts with fewer words than a window lose
nothing. Equal texts are judged once; all copies of a text of ``WINDOW`` words or more
lose every word. Repeated or null ``doc_id`` values are ordinary rows: work is keyed by
the text, by two 64-bit hashes of it. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.resident import release
from tessella.llm.words import Words, doc_blocks, gram_hashes, text_buffers, text_key
from tessella.runtime import IdFilter, discard, free, materialize, scratch_path, shuffle_width

WINDOW = 35
GRAM = 20
#: Batches that the query deals its table into, and runs that are kept before a compaction.
BATCHES = 4
FAN_IN = 2
HIT = "text long, fp long"
RUN = "fp long, text long, again boolean"


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive entries."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = pick(x[:-step], x[step:]) if len(x) > step else x[:0]
        done += step
    return x


class _Block:
    """Hashes of the words, grams and windows of some documents."""

    def __init__(self, raw: np.ndarray, offs: np.ndarray, window: int, gram: int) -> None:
        self.words = Words(raw, offs)
        self.first = self.words.hashes(0)
        self.grams = gram_hashes(self.first, gram)
        #: The fingerprint of the window that starts at each word, 0 across documents.
        self.marks = _slide(self.grams, window - gram + 1, np.minimum)
        for edge in self.words.bounds[1:-1]:
            self.marks[max(0, edge - window + 1) : edge] = 0

    def selected(self, width: int) -> np.ndarray:
        """Gram positions that some window selects, ties included."""
        if not len(self.marks):
            return np.zeros(0, dtype=np.int64)
        pad = np.zeros(width - 1, dtype=np.uint64)
        best = _slide(np.concatenate([pad, self.marks, pad]), width, np.maximum)
        return np.flatnonzero((best == self.grams) & (best > 0))

    def documents(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.words.bounds, positions, side="right") - 1


def _at_most_twice(doc: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Marks pairs so that none is kept more than twice: two tell that a fingerprint recurs."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    keep = np.ones(len(order), dtype=bool)
    keep[order[2:]] = (doc[2:] != doc[:-2]) | (value[2:] != value[:-2])
    return keep


def _fingerprints(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            raw, offs = text_buffers(batch.column("text"))
            counts, shas, values, sizes = [], [], [np.zeros(0, np.uint64)], []
            for lo, hi in doc_blocks(offs):
                block = _Block(raw, offs[lo : hi + 1], window, gram)
                words, at = block.words, block.selected(window - gram + 1)
                doc, own = block.documents(at), block.grams[at]
                keep = _at_most_twice(doc, own)
                values.append(own[keep])
                sizes.append(np.bincount(doc[keep], minlength=hi - lo))
                counts.append(np.diff(words.bounds))
                memory = words.data.tobytes()
                edges = words.offsets.tolist()
                shas += [hashlib.sha256(b" ".join(memory[a:b].split())).hexdigest() for a, b in zip(edges, edges[1:])]
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else [0]
            fps = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(shas, pa.string()), fps],
                ["doc_id", "t1", "t2", "n_words", "sha", "fps"],
            )

    return run


def _repeats(*values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries recur among these, and which is the first of its value."""
    order = np.lexsort(values)
    same = np.ones(max(0, len(order) - 1), dtype=bool)
    for v in values:
        same &= v[order][1:] == v[order][:-1]
    again, first = np.zeros(len(order), dtype=bool), np.ones(len(order), dtype=bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    first[order[1:][same]] = False
    return again, first


def _entries(hits: bool):
    """The rows ``text, fp`` of texts: with ``hits``, those whose fingerprint recurs among
    these rows of the task; else ``again`` as well, one row for each fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fps")
            own = fps.flatten().to_numpy()
            text = np.repeat(batch.column("text").to_numpy(), np.asarray(fps.value_lengths()))
            again, first = _repeats(own)
            if hits:
                yield pa.RecordBatch.from_arrays([pa.array(text[again]), pa.array(own[again])], ["text", "fp"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(own[first]), pa.array(text[first]), pa.array(again[first])], ["fp", "text", "again"])

    return run


def _windows(window: int, gram: int):
    """Verification hashes of the windows whose fingerprint is shared.

    ``again`` marks windows that recur among these rows of the task, ``first`` one of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["text", "pos", "h1", "h2"]
        kinds = (np.int64, np.int32, np.int64, np.int64)
        for batch in batches:
            raw, offs = text_buffers(batch.column("body"))
            hits = batch.column("hits")
            values, at = hits.values.to_numpy().view(np.uint64), hits.offsets.to_numpy()
            numbers = batch.column("text").to_numpy()
            held: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, k) for k in kinds)]
            for lo, hi in doc_blocks(offs):
                block = _Block(raw, offs[lo : hi + 1], window, gram)
                # a fingerprint shared for one document is shared for all
                wanted = np.unique(values[at[lo] : at[hi]])
                if not len(wanted) or not len(block.marks):
                    continue
                slot = np.minimum(np.searchsorted(wanted, block.marks), len(wanted) - 1)
                pos = np.flatnonzero((wanted[slot] == block.marks) & (block.marks > 0))
                h1 = gram_hashes(block.first, window, 0)[pos]
                h2 = gram_hashes(block.words.hashes(1), window, 1)[pos]
                doc = block.documents(pos)
                held.append((numbers[lo + doc], (pos - block.words.bounds[doc]).astype(np.int32), h1.view(np.int64), h2.view(np.int64)))
            columns = [np.concatenate(c) for c in zip(*held)]
            again, first = _repeats(columns[3], columns[2])
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(again), pa.array(first)], [*names, "again", "first"])

    return run


def _remove(window: int):
    """Cut the covered words out of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, starts = batch.column("body"), batch.column("starts")
            removed, kept = [], []
            for text, pos in zip(texts, starts):
                words = (text.as_py() or "").encode().split()
                cover = np.zeros(len(words) + 1, dtype=np.int32)
                at = pos.values.to_numpy()
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                gone = np.cumsum(cover[:-1]) > 0
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist()) if not g))
            yield pa.RecordBatch.from_arrays(
                [batch.column("text"), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())],
                ["text", "n_removed", "kept_text", "kept_sha256"],
            )

    return run


class FingerprintIndex:
    """Sorted immutable runs of historical fingerprints: ``fp, text, again``.

    ``again`` says that the fingerprint recurs, beside the row or in what was compacted into
    it. A run is a table bucketed by fingerprint, so every bucket of the history lies where
    the same bucket of a new batch comes to lie.
    """

    def __init__(self, spark: SparkSession, fan_in: int = FAN_IN) -> None:
        self.spark, self.fan_in = spark, fan_in
        self.buckets = shuffle_width(spark)
        #: The tables of the runs, oldest first, and where their files are.
        self.runs: dict[str, str] = {}

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows dealt by the hashing of the buckets."""
        return rows.repartition(self.buckets, "fp")

    def _write(self, rows: DataFrame) -> str:
        """A run of dealt rows: one sorted file in each bucket."""
        table, path = f"tessella_run_{uuid.uuid4().hex}", scratch_path(self.spark, "run")
        rows.select("fp", "text", "again").write.format("parquet").bucketBy(self.buckets, "fp").sortBy("fp").option("path", path).saveAsTable(table)
        self.runs[table] = path
        return table

    def add(self, texts: DataFrame) -> DataFrame:
        """Add the fingerprints of ``texts(text, fps)`` as a run.

        Returns ``text, fp``, rows possibly repeated, of all texts, of this batch or before,
        whose fingerprint is shared and was not returned with them before.
        """
        if len(self.runs) > self.fan_in:
            self.compact()
        table = self._write(self._dealt(texts.select("text", "fps").mapInArrow(_entries(False), RUN)))
        run = self.spark.table(table)
        hits = texts.select("text", "fps").mapInArrow(_entries(True), HIT)
        own = run.groupBy("fp").agg(F.count("*").alias("n"), F.max("again").alias("again"))
        shared = own.where("n > 1 or again").select("fp")
        if len(self.runs) > 1:
            met = None
            for past in list(self.runs)[:-1]:  # bucket by bucket: the history is not shuffled
                rows = self.spark.table(past).join(own.select("fp").hint("merge"), "fp", "left_semi")
                met = rows if met is None else met.unionByName(rows)
            met = materialize(met, "met")
            # of the history, only what was not known to be shared
            new = met.groupBy("fp").agg(F.count("*").alias("n"), F.max("again").alias("again"), F.min("text").alias("text")).where("n = 1 and not again")
            hits = hits.unionByName(new.select("text", "fp"))
            shared = shared.unionByName(met.select("fp"))
        hits = hits.unionByName(run.join(shared.hint("merge"), "fp", "left_semi").select("text", "fp"))
        return materialize(hits, "hits")

    def compact(self) -> None:
        """Merge all runs into one, with a single row for each fingerprint: the texts of a
        recurring one have been returned."""
        if len(self.runs) < 2:
            return
        # read as plain files: a union of bucketed tables does not bring equal buckets together
        rows = self.spark.read.schema(RUN).parquet(*self.runs.values())
        merged = self._dealt(rows).groupBy("fp").agg(F.min("text").alias("text"), (F.max("again") | (F.count("*") > 1)).alias("again"))
        old = list(self.runs)
        self._write(merged)
        self._drop(old)

    def _drop(self, tables: list[str]) -> None:
        """Forget tables and free their files."""
        for table in tables:
            self.spark.sql(f"DROP TABLE {table}")
            free(self.spark, self.runs.pop(table))

    def close(self) -> None:
        """Free all runs."""
        self._drop(list(self.runs))


def _batch(docs: DataFrame, window: int, gram: int) -> DataFrame:
    rows = docs.select("doc_id", "text", *text_key())
    return rows.mapInArrow(_fingerprints(window, gram), "doc_id long, t1 long, t2 long, n_words long, sha string, fps array<long>")


def substring_dedup(batches: list[DataFrame], window: int = WINDOW, gram: int = GRAM, deal: int = 1) -> DataFrame:
    """Judge all rows of all ``batches``, each added to the index as a run of its own.

    With ``deal``, every batch is dealt into so many by the texts' hashes. Returns ``doc_id,
    t1, t2, n_words, n_removed, kept_sha256`` and ``kept_text``, the words kept joined by
    single spaces, which is null where nothing was removed.
    """
    spark = batches[0].sparkSession
    docs = source = None
    for number, batch in enumerate(batches):
        rows = _batch(batch, window, gram).withColumn("batch", (F.lit(number * deal) + F.pmod("t1", F.lit(deal))).cast("int"))
        docs = rows if docs is None else docs.unionByName(rows)
        source = batch.select("text") if source is None else source.unionByName(batch.select("text"))
    docs = materialize(docs, "fps")
    texts = docs.groupBy("t1", "t2").agg(F.count("*").alias("copies"), F.first("n_words").alias("w"), F.min("batch").alias("batch"), F.first("fps").alias("fps"))
    texts = materialize(texts.withColumn("text", F.monotonically_increasing_id()), "texts", "batch")
    index = FingerprintIndex(spark)
    found = [index.add(texts.where(F.col("batch") == number)) for number in range(len(batches) * deal)]
    index.close()
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("text").agg(F.collect_set("fp").alias("hits")).join(texts.select("text", "t1", "t2"), "text")
    hits = materialize(hits, "candidates")
    discard(*found)
    wanted = IdFilter(hits, "t1", "t2")

    def chosen(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            yield b.filter(pa.array(wanted.passes(b.column("k").to_numpy()))).drop_columns(["k"])

    bodies = source.select(*text_key(), "text").withColumn("k", wanted.key("t1", "t2")).mapInArrow(chosen, "t1 long, t2 long, text string")
    bodies = bodies.groupBy("t1", "t2").agg(F.first("text").alias("body"))
    candidates = materialize(bodies.join(hits, ["t1", "t2"]).select("text", "body", "hits"), "bodies")
    discard(hits)
    spread = max(1, 4 * shuffle_width(spark) // 3)
    windows = candidates.repartition(spread).mapInArrow(_windows(window, gram), "text long, pos int, h1 long, h2 long, again boolean, first boolean")
    windows = materialize(windows, "windows")
    # windows that recur beside each other need no partner; one row of each tells the others
    repeated = windows.where("first").groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    met = windows.where("not again").join(repeated.hint("merge"), ["h1", "h2"], "left_semi").select("text", "pos")
    starts = met.unionByName(windows.where("again").select("text", "pos")).groupBy("text").agg(F.collect_list("pos").alias("starts"))
    cut = candidates.select("text", "body").join(starts, "text").mapInArrow(_remove(window), "text long, n_removed long, kept_text string, kept_sha256 string")
    cut = materialize(cut, "cut")
    discard(windows, candidates)
    # copies of a whole text need no look at windows: they lose everything
    empty = hashlib.sha256(b"").hexdigest()
    gone = (F.col("copies") > 1) & (F.col("w") >= window)
    judged = texts.select("t1", "t2", "text", "copies", "w").join(cut, "text", "left")
    judged = judged.where(gone | F.col("n_removed").isNotNull()).select(
        "t1", "t2",
        F.when(gone, F.col("w")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
        F.when(gone, F.lit(empty)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    out = docs.drop("fps", "batch").join(judged, ["t1", "t2"], "left")
    return out.select("doc_id", "t1", "t2", "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup([docs], deal=BATCHES).select("doc_id", "n_words", "n_removed", "kept_sha256")
