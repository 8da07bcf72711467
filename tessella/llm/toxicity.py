"""Toxicity by maximum-scoring segments (operator 7).

Every word has a log-odds score: how much likelier it is in toxic than in other labelled
text, with an informative Dirichlet prior (the word's rate in both together), for the word
or the longest prefix of it whose log-odds are significant. Other words score a little
below zero. A linear-time scan finds all maximal scoring segments, the passages of a text
that are toxic on balance; extreme-value theory (the score at which ``K n exp(-lambda S)``
such segments are expected by chance) makes the best segments of texts of different lengths
comparable, and a monotone calibration on learning rows turns that into a probability: toxic
labels of texts without any toxic word do not bend it for the others, as a curve's would.

Learning uses at most ``SAMPLE`` labelled documents, those whose ids hash lowest; the bound
is a parameter. Only their labels are broadcast, so the corpus is not shuffled. Defined
results: null and wordless texts have no segment and get what the calibration gives that;
without any usable label every score is 0. A
null or repeated label counts as absent or as one label (the largest). Extra columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.words import NOT_LETTER, Words, doc_blocks, text_buffers
from tessella.runtime import materialize

#: Labelled documents that learning uses at most.
SAMPLE = 20_000
PREFIXES = (4, 5, 6)
#: What every word without a score of its own costs.
DRIFT = 0.05
PRIOR = 10.0
#: Rows whose texts a worker copies at a time, and features that it holds before it combines them.
ROWS = 1000
HELD = 1 << 18


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(start, end, score)`` of a sequence, in linear time.

    Candidates are kept with the sums to their left and right ends; a new one is joined
    with the nearest that starts lower as long as that ends lower too. Runs of scores that
    are not positive only move the running sum.
    """
    positive = np.flatnonzero(scores > 0)
    if not len(positive):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[list] = []  # start, end, sum before start, sum at end, index of nearest lower start
    for p in positive.tolist():
        start, end, left, right = p, p + 1, float(sums[p]), float(sums[p + 1])
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append([start, end, left, right, j])
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right, _ in kept]


@dataclass
class ToxicityModel:
    """Scored features, extreme-value parameters and the calibration."""

    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    lam: float = 1.0
    k: float = 0.1
    calibration: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))

    def word_scores(self, words: Words) -> np.ndarray:
        """A score for each word: of the word, else of its longest scored prefix."""
        out = np.full(len(words), -DRIFT)
        if len(self.hashes) and len(words):
            whole, *cuts = words.hashes(0, PREFIXES)
            for h in (*cuts, whole):  # what is longer overrides
                slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                hit = self.hashes[slot] == h
                out[hit] = self.odds[slot[hit]] - DRIFT
        return out

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> float:
        """Minus the log of how many segments as good as the best are expected by chance."""
        best = max((s for _, _, s in segments), default=0.0)
        return float(np.clip(self.lam * best - np.log(max(self.k * max(n, 1), 1e-9)), -20, 40)) if best > 0 else -20.0

    def probability(self, evidence: float) -> float:
        return float(np.interp(evidence, *self.calibration))

    def texts(self, column: pa.Array) -> Iterator[tuple[float, list[tuple[int, int, float]], Words, int]]:
        """Evidence, segments, and the words with the document's place among them."""
        for at in range(0, len(column), ROWS):
            raw, offs = text_buffers(column.slice(at, ROWS))
            for lo, hi in doc_blocks(offs):
                words = Words(raw, offs[lo : hi + 1], lower=True, separator=NOT_LETTER)
                scores = self.word_scores(words)
                for i in range(hi - lo):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    segments = maximal_segments(scores[a:b])
                    yield self.evidence(segments, b - a), segments, words, i


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts every word and prefix occurs.

    A text counts once for a word, however often it repeats it. The row of hash 0 has, as
    ``other``, the number of words in texts that are not toxic.
    """
    held: list[np.ndarray] = []
    labels: list[np.ndarray] = []
    size = tokens = 0

    def flush() -> Iterator[pa.RecordBatch]:
        codes, inv = np.unique(np.concatenate(held), return_inverse=True)
        toxic = np.bincount(inv, weights=np.concatenate(labels), minlength=len(codes)).astype(np.int64)
        total = np.bincount(inv, minlength=len(codes))
        yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(toxic), pa.array(total - toxic)], ["h", "toxic", "other"])
        held.clear()
        labels.clear()

    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        raw, offs = text_buffers(batch.column("text"))
        y = batch.column("y").to_numpy()
        for lo, hi in doc_blocks(offs):
            words = Words(raw, offs[lo : hi + 1], lower=True, separator=NOT_LETTER)
            hashes = words.hashes(0, PREFIXES)
            for i in range(hi - lo):
                a, b = words.bounds[i], words.bounds[i + 1]
                own = np.unique(np.concatenate([h[a:b] for h in hashes]))
                own = own[own != 0]
                held.append(own)
                labels.append(np.full(len(own), float(y[lo + i] > 0)))
                size += len(own)
                tokens += int(b - a) if y[lo + i] <= 0 else 0
            if size > HELD:
                yield from flush()
                size = 0
    if held:
        yield from flush()
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([tokens], pa.int64())], ["h", "toxic", "other"])


def _null_parameters(odds: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """lambda and K of the chance distribution of the best segment's score.

    lambda is the positive root of E[exp(lambda X)] = 1 under the word shares of texts that
    are not toxic; K follows from the drift, as for scores that are rarely positive.
    """
    rest = max(1e-9, 1 - share.sum())
    scores = np.append(odds - DRIFT, -DRIFT)
    p = np.append(share, rest)
    low, high = 1e-3, 50.0
    for _ in range(80):
        mid = (low + high) / 2
        if np.sum(p * np.exp(np.clip(mid * scores, -700, 700))) > 1:
            high = mid
        else:
            low = mid
    return low, float(max(1e-6, share.sum()))


def _monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing share of ``y`` over ``x`` (pooled adjacent violators) as knots.

    ``x`` may repeat. Every pool counts half a case of either kind more, and is flat from its
    first to its last ``x``, with straight lines between pools.
    """
    values, inverse = np.unique(x, return_inverse=True)
    ones, all_ = np.bincount(inverse, weights=w * y), np.bincount(inverse, weights=w)
    pools: list[list[float]] = []  # first x, last x, ones, cases
    for v, one, n in zip(values.tolist(), ones.tolist(), all_.tolist()):
        pools.append([v, v, one, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, more, cases = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + more, pools[-1][3] + cases]
    share = np.maximum.accumulate([(one + 0.5) / (n + 1) for *_, one, n in pools])
    return np.array([[a, b] for a, b, *_ in pools]).ravel(), np.repeat(share, 2)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> ToxicityModel:
    """A model from at most ``sample`` labelled documents."""
    labels = labels.where(f"doc_id is not null and {label} is not null").groupBy("doc_id").agg(F.max(label).alias("y"))
    picked = labels.withColumn("r_", F.xxhash64("doc_id")).orderBy("r_").limit(sample).select("doc_id", F.col("y").cast("double").alias("y"))
    # no more than ``sample`` rows of two numbers
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(materialize(picked, "labels")), "doc_id")
    # copies of a text are one observation
    texts = materialize(texts.groupBy("text").agg(F.max("y").alias("y")), "labelled")
    n1, n0 = texts.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    if not n1 or not n0:
        return ToxicityModel()
    counts = texts.mapInArrow(_features, "h long, toxic long, other long").groupBy("h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    counts = materialize(counts, "features")
    tokens = counts.where("h = 0").first().other
    counts = counts.where("h <> 0")
    prior = F.lit(PRIOR) * (F.col("toxic") + F.col("other")) / F.lit(n1 + n0)
    y1, y0 = F.col("toxic") + prior, F.col("other") + prior

    def log_odds(y: Column, n: float) -> Column:
        return F.log(y / (F.lit(n + PRIOR + 1) - y))  # above zero for a word of every text

    scored = counts.select("h", "other", "toxic", (log_odds(y1, n1) - log_odds(y0, n0)).alias("d"))
    # log-likelihood ratio against no difference; so many features are tested that about
    # one in ten models has a single feature by chance
    both, p1 = F.col("toxic") + F.col("other"), n1 / (n1 + n0)

    def part(n: Column, share: float) -> Column:
        return F.when(n > 0, n * F.log(n / (both * share))).otherwise(0.0)

    ratio = 2 * (part(F.col("toxic"), p1) + part(F.col("other"), 1 - p1))
    strong = scored.where((F.col("d") > 0) & (ratio >= 2 * np.log(max(2, counts.count())) + 4))
    table = strong.select("h", "d", "other").toPandas()
    hashes = table["h"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    odds = np.minimum(table["d"].to_numpy(dtype=float)[order], 12.0)
    share = (table["other"].to_numpy(dtype=float)[order] + 0.05) / max(1, tokens)
    model = ToxicityModel(hashes[order], odds, *(_null_parameters(odds, np.minimum(share, 0.5 / max(1, len(share)))) if len(odds) else (1.0, 0.1)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([e for e, *_ in shared.value.texts(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(found * 4).astype(np.int32)), batch.column("y")], ["e", "y"])

    bins = texts.select("text", "y").mapInArrow(evidence, "e int, y double").groupBy("e", "y").count().toPandas()  # at most 482 rows
    if len(bins):
        model.calibration = _monotone(bins["e"].to_numpy() / 4, (bins["y"].to_numpy() > 0).astype(float), bins["count"].to_numpy(dtype=float))
    return model


def passages(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Every significant segment: ``doc_id, start_word, end_word, segment_score, passage``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text").to_pylist()
            rows = []
            for doc_id, text, (_, segments, words, i) in zip(ids, texts, shared.value.texts(batch.column("text"))):
                raw, base, first = (text or "").encode(), int(words.offsets[i]), int(words.bounds[i])
                for a, b, s in segments:
                    lo, hi = int(words.starts[first + a]) - base, int(words.ends[first + b - 1]) - base
                    rows.append((doc_id, a, b, s, raw[lo:hi].decode()))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start_word", "end_word", "segment_score", "passage"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start_word long, end_word long, segment_score double, passage string")


def score(docs: DataFrame, model: ToxicityModel, *keep: str) -> DataFrame:
    """``keep`` columns with ``score`` and ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            p = np.array([own.probability(e) for e, *_ in own.texts(batch.column("text_"))], dtype=np.float64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    rows = docs.select(*keep, F.col("text").alias("text_"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "score double", "predicted int"]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 5
    model = learn(docs, labels.where(remainder != 0))
    rows = docs.select("doc_id", F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), "text")
    return score(rows, model, "doc_id", "held_out")
