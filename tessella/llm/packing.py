"""Best-fit packing of token sequences, improved by swap-based local search (operator 8).

Every document is encoded once and cut into pieces; only the lengths take part in packing,
and there are at most ``CAPACITY`` different ones. So the corpus is packed as a histogram:
bins of equal contents are one *pattern* with a number of bins. Best fit decreasing places
a whole class of equal lengths at a time, and leaves at most a few patterns for each class,
whatever the number of documents. A local search then empties underfull bins: it moves a
piece of the emptiest bins to fuller underfull ones, or exchanges one for one or two for
one, for as many bins of two patterns at once as there are. Every step raises the sum of
squared fills. The search ends when the lower bound is reached or no step is left.

Pieces are numbered within their length, by the tasks that cut them and then by offsets of
these tasks, and the patterns' places are dealt out by these numbers: no task holds more
than its share of the pieces, and only the histogram reaches the driver.

Defined results: a null or empty text is one piece that holds only the end id. Repeated
rows and null ids are pieces of their own. Extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.chunks import ChunkCache, rank_encoder
from tessella.llm.resident import resident
from tessella.runtime import materialize

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
CAPACITY = 2048
#: A bin with more free tokens than this share of its capacity is underfull.
UNDERFULL = 1 / 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: What a bin holds: lengths in descending order, each with its number.
Pattern = tuple[tuple[int, int], ...]


def fill_of(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def best_fit(counts: dict[int, int], capacity: int) -> Counter[Pattern]:
    """Bins of each pattern by best fit decreasing of ``counts[length]`` pieces.

    All pieces of a length go at once: a bin that the length fits best takes as many of
    them as it can before the next bin does.
    """
    rooms: dict[int, Counter[Pattern]] = {}
    held = 0  # bit r: some bin has r tokens free

    def put(pattern: Pattern, bins: int, room: int) -> None:
        nonlocal held
        rooms.setdefault(room, Counter())[pattern] += bins
        held |= 1 << room

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fitting = held >> length
            if fitting:
                room = length + (fitting & -fitting).bit_length() - 1
                pattern, bins = rooms[room].popitem()
                if not rooms[room]:
                    held ^= 1 << room
            else:
                room, pattern, bins = capacity, (), -(-left // (capacity // length))
            most = room // length
            full = min(bins, left // most)
            if full:
                put((*pattern, (length, most)), full, room - most * length)
                bins, left = bins - full, left - most * full
            if bins and left:  # fewer than one bin takes
                put((*pattern, (length, left)), 1, room - left * length)
                bins, left = bins - 1, 0
            if bins:
                put(pattern, bins, room)
    out: Counter[Pattern] = Counter()
    for some in rooms.values():
        out.update(some)
    out.pop((), None)
    return out


def changed(pattern: Pattern, more: tuple[int, ...], less: tuple[int, ...]) -> Pattern:
    """``pattern`` with some pieces added and some taken out."""
    held = Counter(dict(pattern))
    held.update(more)
    held.subtract(less)
    return tuple(sorted(((length, n) for length, n in held.items() if n), reverse=True))


def _gifts(pattern: Pattern) -> tuple[np.ndarray, list[tuple[int, ...]]]:
    """What a bin may give in an exchange, one piece or two, by ascending size."""
    gifts = {length: (length,) for length, _ in pattern}
    for k, (a, n) in enumerate(pattern):
        for b, _ in pattern[k if n > 1 else k + 1 :]:
            gifts.setdefault(a + b, (a, b))
    sizes = sorted(gifts)
    return np.array(sizes), [gifts[s] for s in sizes]


def _step(source: Pattern, targets: list[Pattern], fills: dict[Pattern, int], capacity: int):
    """The move, or else the exchange, that fills a fuller target most: ``(target, given,
    taken)``, or None."""
    own = fills[source]
    targets = [t for t in targets if own <= fills[t] < capacity]
    if not targets:
        return None
    free = capacity - np.array([fills[t] for t in targets])
    single = np.array(sorted(length for length, _ in source))
    at = np.searchsorted(single, free, side="right") - 1
    gain = np.where(at >= 0, single[np.maximum(at, 0)], 0)
    best = int(np.argmax(gain))
    if gain[best]:
        return targets[best], (int(gain[best]),), ()
    sizes, gifts = _gifts(source)
    which = np.repeat(np.arange(len(targets)), [len(t) for t in targets])
    back = np.array([length for t in targets for length, _ in t])
    at = np.searchsorted(sizes, back + free[which], side="right") - 1
    gain = np.where(at >= 0, sizes[np.maximum(at, 0)] - back, 0)
    best = int(np.argmax(gain))
    if gain[best] > 0:
        return targets[which[best]], gifts[at[best]], (int(back[best]),)
    return None


def local_search(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Empty underfull bins by moves and exchanges that raise the sum of squared fills."""
    bins = Counter(bins)
    fills = {p: fill_of(p) for p in bins}
    total, n = sum(fills[p] * m for p, m in bins.items()), sum(bins.values())
    least, slack = -(-total // capacity), int(capacity * UNDERFULL)
    log = list(bins)  # patterns in the order in which they arose
    seen: dict[Pattern, int] = {}  # so much of the log holds no step for this source

    def open_sources() -> list[Pattern]:
        return [p for p in bins if capacity - fills[p] > slack and seen.get(p, 0) < len(log)]

    while n > least and (sources := open_sources()):
        source = min(sources, key=lambda p: (fills[p], p))
        new = dict.fromkeys(log[seen.get(source, 0) :])
        targets = [p for p in new if p in bins and (p != source or bins[p] > 1)]
        step = _step(source, targets, fills, capacity)
        if step is None:
            seen[source] = len(log)
            continue
        target, given, taken = step
        m = bins[source] // 2 if target == source else min(bins[source], bins[target])
        for old, fresh in ((source, changed(source, taken, given)), (target, changed(target, given, taken))):
            bins[old] -= m
            if not bins[old]:
                del bins[old]
            if fresh:
                bins[fresh] += m
                fills.setdefault(fresh, fill_of(fresh))
                log.append(fresh)
            else:
                n -= m
    return bins


def pack(counts: dict[int, int], capacity: int = CAPACITY) -> Counter[Pattern]:
    """How many bins of each pattern hold ``counts[length]`` pieces of each length."""
    return local_search(best_fit(counts, capacity), capacity)


def places(bins: Counter[Pattern]) -> np.ndarray:
    """Rows ``length, first, base, bins, offset``, sorted: the pieces of a length from number
    ``first`` on go to the bins from ``base`` on in turn, from ``offset`` in each."""
    rows, used, base = [], Counter(), 0
    for pattern in sorted(bins):
        offset, m = 0, bins[pattern]
        for length, n in pattern:
            rows.append((length, used[length], base, m, offset))
            used[length] += n * m
            offset += length * n
        base += m
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def place(table: np.ndarray, lengths: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of the pieces of these lengths and numbers within their length."""
    first = np.searchsorted(table[:, 0], lengths, side="left")
    last = np.searchsorted(table[:, 0], lengths, side="right")
    while (last - first > 1).any():  # bisection among the rows of the length
        middle = (first + last) // 2
        up = (table[np.minimum(middle, len(table) - 1), 1] <= numbers) & (last - first > 1)
        first, last = np.where(up, middle, first), np.where(up | (last - first <= 1), last, middle)
    _, start, base, bins, offset = table[first].T
    return base + (numbers - start) % bins, offset + (numbers - start) // bins * lengths


def opened(path: str, pattern: str) -> ChunkCache:
    return resident(("packing", path, pattern), lambda: ChunkCache(rank_encoder(path, pattern), limit=600_000))


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Where the pieces of a document of ``n`` tokens start, and ``n``."""
    first = n % capacity or capacity
    return [0, *range(first, n + 1, capacity)]


def pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every document, with checksums of their ids."""
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = opened(path, pattern)
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, bounds in cache.texts(batch.column("text")):
                rows: list[tuple] = []
                bounds = bounds.tolist()
                for doc_id, lo, hi in zip(doc_ids[first:], bounds, bounds[1:]):
                    own = ids[lo:hi].tobytes() + end
                    edges = cut(hi - lo + 1, capacity)
                    rows += [(doc_id, k, a, b - a, zlib.crc32(own[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the pieces of each length within this task."""
    part, used = TaskContext.get().partitionId(), np.zeros(0, dtype=np.int64)
    for batch in batches:
        lengths = batch.column("length").to_numpy()
        if not len(lengths):
            continue
        own = np.bincount(lengths, minlength=len(used))
        used = np.concatenate([used, np.zeros(len(own) - len(used), np.int64)])
        order = np.argsort(lengths, kind="stable")
        numbers = np.empty(len(lengths), np.int64)
        numbers[order] = np.arange(len(lengths)) - (np.cumsum(own) - own)[lengths[order]]
        yield batch.append_column("part", pa.array(np.full(len(lengths), part, np.int32))).append_column("number", pa.array(numbers + used[lengths]))
        used = used + own


def pack_table(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``sequence_id`` and ``offset`` for the rows of ``parts``."""
    numbered = materialize(parts.select(*PIECES_COLUMNS).mapInArrow(_number, f"{PIECES}, part int, number long"), "pieces")
    tasks = materialize(numbered.groupBy("part", "length").agg(F.count("*").alias("n")), "classes")
    histogram = tasks.groupBy("length").agg(F.sum("n").alias("n")).collect()  # a row for each length
    table = numbered.sparkSession.sparkContext.broadcast(places(pack({r.length: r.n for r in histogram}, capacity)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column("first").to_numpy() + batch.column("number").to_numpy()
            bins, offsets = place(table.value, batch.column("length").to_numpy(), numbers)
            yield batch.select(PIECES_COLUMNS).append_column("sequence_id", pa.array(bins)).append_column("offset", pa.array(offsets))

    joined = numbered.join(firsts, ["part", "length"]).select(*PIECES_COLUMNS, "number", "first")
    return joined.mapInArrow(run, f"{PIECES}, sequence_id long, offset long")


PIECES_COLUMNS = ["doc_id", "piece", "start", "length", "ids_crc32"]


def best_fit_pack(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    return pack_table(pieces(docs, path, pattern, capacity, end_id), capacity)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return best_fit_pack(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
