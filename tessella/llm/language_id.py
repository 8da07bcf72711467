"""Language identification by hyperdimensional profiles (operator 3).

Every letter has a random vector of +1 and -1. An n-gram is bound from its letters, each
permuted (rotated) by its place, by multiplication; a text, and a language, is the bundle
(sum) of the vectors of all its n-grams. A document gets the language whose prototype has
the largest cosine with it, after the mean of all prototypes, which holds what languages
have in common, is taken off.

Learning counts the n-grams of all training documents per language, in the tasks and then
by key, so only n-gram counts are shuffled and only prototypes (languages x dimensions)
reach the driver. Defined results: ``und`` with score 0 if the text is null or has no
letter, or if nothing could be learned; ties go to the language that sorts first. A null
``doc_id`` is not held out and is not learned from; a null ``lang`` is not learned from.
Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.resident import resident

DIMENSIONS = 1024
ORDER = 3
UNDETERMINED = "und"
_BITS = 21


class Space:
    """Letter and n-gram vectors; both are functions of the seed alone."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = 11, limit: int = 40_000) -> None:
        self.dimensions, self.order, self.seed, self.limit = dimensions, order, seed, limit
        self.letters: dict[int, np.ndarray] = {}
        self._forget()
        self.table = np.zeros(0x110000, dtype=np.uint64)
        for c in range(0x110000):
            if chr(c).isalpha():
                self.table[c] = c

    def _forget(self) -> None:
        self.slots: dict[int, int] = {}
        self.vectors = np.zeros((1024, self.dimensions), dtype=np.int8)

    def codes(self, text: str) -> np.ndarray:
        """Codes of all n-grams of a text; runs of other characters count as one space."""
        chars = self.table[np.frombuffer(text.lower().encode("utf-32-le"), dtype="<u4")]
        letter = chars != 0
        if not letter.any():
            return chars[:0]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        chars = np.concatenate([[np.uint64(0)], chars[keep], np.zeros(int(letter[-1]), np.uint64)])  # a space at either end
        n = len(chars) - self.order + 1
        code = np.zeros(max(n, 0), dtype=np.uint64)
        for k in range(self.order):
            code = (code << np.uint64(_BITS)) | chars[k : k + n]
        return code

    def _letter(self, c: int) -> np.ndarray:
        if c not in self.letters:
            self.letters[c] = np.random.default_rng([self.seed, c]).integers(0, 2, self.dimensions, dtype=np.int8) * 2 - 1
        return self.letters[c]

    def _vector(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, dtype=np.int8)
        for k in range(self.order):
            c = (code >> (_BITS * (self.order - 1 - k))) & ((1 << _BITS) - 1)
            out = out * np.roll(self._letter(c), self.order - 1 - k)
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the vectors of n-grams."""
        total = np.zeros(self.dimensions)
        for at in range(0, len(codes), 8192):
            part = codes[at : at + 8192].tolist()
            if len(self.slots) + len(part) > self.limit:
                self._forget()
            rows = list(map(self.slots.get, part))
            if None in rows:
                for i, code in enumerate(part):
                    if rows[i] is None:
                        rows[i] = self.slots[code] = len(self.slots)
                        if rows[i] == len(self.vectors):
                            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
                        self.vectors[rows[i]] = self._vector(code)
            total += counts[at : at + 8192].astype(np.float32) @ self.vectors[rows].astype(np.float32)
        return total


def space(dimensions: int = DIMENSIONS, order: int = ORDER) -> Space:
    """The vectors, kept in each worker."""
    return resident(("language", dimensions, order), lambda: Space(dimensions, order))


@dataclass
class Profiles:
    """The languages learned and their centred prototypes of unit length."""

    languages: list[str]
    prototypes: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of a text, and half of one plus the cosine."""
        if not text or not self.languages:
            return UNDETERMINED, 0.0
        own = space(self.prototypes.shape[1])
        codes = own.codes(text)
        if not len(codes):
            return UNDETERMINED, 0.0
        vector = own.bundle(*np.unique(codes, return_counts=True))
        cosines = self.prototypes @ vector / (np.linalg.norm(vector) or 1.0)
        best = int(np.argmax(np.round(cosines, 12)))  # equal up to the order of summation: a tie
        return self.languages[best], float(np.clip((1 + cosines[best]) / 2, 0, 1))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = space()
    held: dict[str, list[np.ndarray]] = defaultdict(list)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes.view(np.int64)), pa.array(counts)], ["lang", "code", "n"])
        held.clear()

    size = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            codes = own.codes(text)
            if len(codes):
                held[lang].append(codes)
                size += len(codes)
            if size > 4_000_000:
                yield from flush()
                size = 0
    yield from flush()


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    own = space()
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        codes, counts = batch.column("code").to_numpy().view(np.uint64), batch.column("n").to_numpy()
        for lang in set(langs.tolist()):
            pick = langs == lang
            sums[lang] = sums.get(lang, 0) + own.bundle(codes[pick], counts[pick])
    for lang, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], ["lang", "d", "v"])


def learn(docs: DataFrame) -> Profiles:
    """Profiles from all rows of ``docs(text, lang)`` with both."""
    rows = docs.select("lang", "text").where("lang is not null and text is not null")
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    sums = counts.mapInArrow(_bundle, "lang string, d int, v double").groupBy("lang", "d").agg(F.sum("v").alias("v"))
    table = sums.orderBy("lang", "d").toPandas()
    languages = sorted(table["lang"].unique().tolist())
    if not languages:
        return Profiles([], np.zeros((0, DIMENSIONS)))
    prototypes = np.stack([table.loc[table["lang"] == name, "v"].to_numpy() for name in languages])
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    if len(languages) > 1:
        prototypes -= prototypes.mean(axis=0)
        prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    return Profiles(languages, prototypes)


def remainder(divisor: int) -> Column:
    """crc32 of ``doc_id`` as text, modulo ``divisor``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def identify(docs: DataFrame, profiles: Profiles, *keep: str) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` of every row of ``docs``."""
    names = profiles.languages
    shared = docs.sparkSession.sparkContext.broadcast((names, profiles.prototypes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Profiles(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                found = [own.predict(t) for t in batch.column("text_").to_pylist()]
                columns = [batch.column(k) for k in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").alias("text_"))
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "lang_pred string", "score double"])
    return rows.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    profiles = learn(docs.where(remainder(3) != 1))
    rows = docs.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "text")
    return identify(rows, profiles, "doc_id", "held_out")
