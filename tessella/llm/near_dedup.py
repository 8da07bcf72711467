"""MinHash near-deduplication by a signature-coordinate inverted join (operator 1).

1. Every text becomes the set of its 5-word shingles and a signature of ``COORDS``
   MinHash coordinates. Equal sets are one node from here on.
2. Nodes are posted under their coordinate-value pairs. Two sets of similarity 0.85 agree
   in about 82 of 96 coordinates and in fewer than ``MATCHES`` = 64 with a probability of
   about 1e-6. Sets are sets of 64-bit hashes of shingles. *Prefix*: of the pairs that agree in 64 coordinates, each has one among its
   ``COORDS - MATCHES + 1`` rarest. *Skip*: values that no other node holds are never
   posted, and nodes with fewer than ``MATCHES`` shared values drop out altogether.
3. The nodes of a posting list bring their signatures and are posted again, under all
   coordinate-value pairs, within the task. A node's collisions are counted by merging its
   own lists: only the ``COORDS - MATCHES + 1`` shortest are merged, whoever is in none of
   them is skipped, and the longer lists are probed for the nodes met, fewer after each few
   lists, as those that can no longer reach ``MATCHES`` are skipped. A spanning forest of the
   pairs at or above the threshold is kept. Long lists are dealt out as pairs of blocks.
4. The components of these forests are clusters; all pairs of a cluster are confirmed on
   the full shingle sets, again in pairs of blocks by matrix products, and again only a
   spanning forest of the confirmed links leaves a task. No pair is ever emitted for a
   group of copies beyond what connects it. A link is only lost if its sets agree in fewer
   than ``matches`` coordinates, a parameter: 64 of 96 lose a pair at the threshold with a
   probability of about 1e-6, 48 with less than 1e-13, at more candidates to confirm.
5. The components of the confirmed links are the near-duplicate groups.

Defined results: null and wordless texts are empty sets, linked with nothing. Texts of one
to four words are one shingle. A null ``doc_id`` takes part in links; the component then
carries its smallest non-null id, null if it has none. Repeated rows are links like any
other. Extra columns are ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.components import connected_components, forest
from tessella.llm.resident import release
from tessella.llm.words import Words, doc_blocks, gram_hashes, mix, text_buffers, text_key
from tessella.runtime import IdFilter, discard, hot_join, iter_groups, materialize, shuffle_width

SHINGLE = 5
COORDS = 96
MATCHES = 64
#: Nodes of one block where a posting list or a cluster is dealt out in pairs of blocks.
POSTING_BLOCK = 2048
SET_BLOCK = 512

_rng = np.random.default_rng(0x51617)
_KEYS = _rng.integers(0, 2**32, size=(COORDS, 1), dtype=np.uint32)
_ODD = _rng.integers(0, 2**32, size=(COORDS, 1), dtype=np.uint32) | np.uint32(1)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    for lo, hi in doc_blocks(offs):
        words = Words(raw, offs[lo : hi + 1], lower=True)
        hashes = words.hashes()
        grams = gram_hashes(hashes, size)
        for a, b in zip(words.bounds.tolist(), words.bounds.tolist()[1:]):
            if b - a >= size:
                own = np.sort(grams[a : b - size + 1])
                first = np.empty(len(own), dtype=bool)
                first[0] = True
                np.not_equal(own[1:], own[:-1], out=first[1:])
                yield own[first]
            elif b > a:
                yield gram_hashes(hashes[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield hashes[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The MinHash coordinates of a non-empty set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = None
    for at in range(0, len(x), 2048):
        low = ((x[None, at : at + 2048] ^ _KEYS) * _ODD).min(axis=1)
        out = low if out is None else np.minimum(out, low)
    return out


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(shingles):
        return 0, 0
    a = mix(shingles).sum(dtype=np.uint64)
    b = mix(shingles ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        raw, offs = text_buffers(batch.column("text"))
        n = batch.num_rows
        sizes, k1, k2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        sigs = np.zeros((n, COORDS), np.uint32)
        for i, own in enumerate(shingle_sets(raw, offs)):
            if len(own):
                sizes[i] = len(own)
                k1[i], k2[i] = set_key(own)
                sigs[i] = signature(own)
        rows = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * COORDS, pa.int32()), pa.array(sigs.ravel().view(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t1"), batch.column("t2"), pa.array(sizes), pa.array(k1), pa.array(k2), rows], ["doc_id", "t1", "t2", "n", "k1", "k2", "sig"])


def _codes(nodes: DataFrame, coords: int) -> DataFrame:
    """One row for each coordinate-value pair: ``node, code``."""
    exploded = nodes.select("node", F.posexplode(F.slice("sig", 1, coords)).alias("c", "v"))
    code = F.col("c").cast("long").bitwiseOR(F.call_function("shiftleft", F.col("v").cast("long"), F.lit(8)))
    return exploded.select("node", code.alias("code"))


def _blocks(rows: DataFrame, group: str, size: str, block: int) -> DataFrame:
    """Deal each group out as pairs of blocks ``(group, i, j)`` of ``block`` rows or so."""
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("node"), n).cast("int")
    return (
        rows.withColumn("n_", n).withColumn("b_", own).withColumn("o_", F.explode(F.sequence(F.lit(0), F.col("n_") - 1)))
        .withColumn("i", F.least("b_", "o_")).withColumn("j", F.greatest("b_", "o_")).drop("n_", "b_", "o_")
    )


def _dealt(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    return rows.repartition(width, *keys).sortWithinPartitions(*keys)


def _gather(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    held_a, held_b, rows = [], [], 0
    for a, b in pairs:
        held_a.append(a)
        held_b.append(b)
        rows += len(a)
        if rows > 1 << 17:
            a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
            held_a, held_b, rows = [], [], 0
    if rows:
        a, b = forest(np.concatenate(held_a), np.concatenate(held_b))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


class PostingLists:
    """The nodes of one block, posted under every coordinate-value pair."""

    def __init__(self, sigs: np.ndarray) -> None:
        n = len(sigs)
        self.sigs = sigs
        self.order = np.argsort(sigs, axis=0, kind="stable").T.copy()
        values = np.take_along_axis(sigs.T, self.order, axis=1)
        new = np.ones(values.shape, dtype=bool)
        new[:, 1:] = values[:, 1:] != values[:, :-1]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0), axis=1)
        last = np.ones(values.shape, dtype=bool)
        last[:, :-1] = new[:, 1:]
        end = n - np.maximum.accumulate(np.where(last, n - 1 - np.arange(n), 0)[:, ::-1], axis=1)[:, ::-1]
        #: Where the list of each node's value starts and ends, by coordinate and node.
        self.lo, self.hi = np.empty_like(start), np.empty_like(end)
        np.put_along_axis(self.lo, self.order, start, axis=1)
        np.put_along_axis(self.hi, self.order, end, axis=1)

    def matches(self, at: int, left: np.ndarray, least: int) -> np.ndarray:
        """The nodes of ``left`` that collide with ``at`` in ``least`` coordinates or more."""
        lo, hi = self.lo[:, at], self.hi[:, at]
        by_length = np.argsort(hi - lo, kind="stable")
        merged = len(by_length) - least + 1
        met = np.concatenate([self.order[c, lo[c] : hi[c]] for c in by_length[:merged].tolist()])
        count = np.bincount(met, minlength=len(left))
        some = np.flatnonzero((count > 0) & left)
        count = count[some]
        for k in range(merged, len(by_length), 16):  # the long lists are probed, not merged
            enough = count + (len(by_length) - k) >= least
            some, count = some[enough], count[enough]
            if not len(some):
                break
            probe = by_length[k : k + 16]
            count = count + (self.sigs[some[:, None], probe] == self.sigs[at, probe]).sum(axis=1)
        return some[count >= least]


def matching_forest(nodes: np.ndarray, sigs: np.ndarray, matches: int = MATCHES) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs with ``matches`` colliding coordinates connect."""
    none = np.zeros(0, np.int64)
    if len(nodes) == 2:
        return (nodes[:1], nodes[1:]) if (sigs[0] == sigs[1]).sum() >= matches else (none, none)
    lists = PostingLists(sigs)
    left = np.ones(len(nodes), dtype=bool)
    a, b = [], []
    for start in range(len(nodes)):
        if not left[start]:
            continue
        left[start] = False
        stack = [start]
        while stack and left.any():
            at = stack.pop()
            found = lists.matches(at, left, matches)
            if len(found):
                left[found] = False
                stack.extend(found.tolist())
                a.append(np.full(len(found), nodes[at]))
                b.append(nodes[found])
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _match(matches: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for group in iter_groups(batches, ["code", "i", "j"]):
                if group.num_rows > 1:
                    sigs = group.column("sig").combine_chunks().flatten().to_numpy().reshape(group.num_rows, COORDS)
                    yield matching_forest(group.column("node").to_numpy(), sigs, matches)

        return _gather(pairs())

    return run


def confirmed_forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect what pairs with ``100 * |A & B| >= percent * |A | B|`` connect."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    if n == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    else:
        values, inv, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes)
        rare = np.flatnonzero((df >= 2) & (df < 32))
        often = np.flatnonzero(df >= 32)
        common = np.zeros((n, n), dtype=np.int64)
        for at in range(0, len(often), 4096):  # shingles of many sets: matrix products
            column = np.full(len(values), -1)
            column[often[at : at + 4096]] = np.arange(len(often[at : at + 4096]))
            c = column[inv]
            dense = np.zeros((n, len(often[at : at + 4096])), dtype=np.float32)
            dense[owner[c >= 0], c[c >= 0]] = 1
            common += (dense @ dense.T).astype(np.int64)
        # shingles of few sets: their pairs one by one
        pick = np.isin(inv, rare)
        order = np.argsort(inv[pick], kind="stable")
        own, key = owner[pick][order], inv[pick][order]
        upper = np.zeros((n, n), dtype=np.int64)
        for step in range(1, min(32, len(key))):
            same = key[step:] == key[:-step]
            if not same.any():
                break
            np.add.at(upper, (own[:-step][same], own[step:][same]), 1)
        common += upper + upper.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = 100 * common >= percent * union
    np.fill_diagonal(linked, False)
    a, b = np.nonzero(np.triu(linked, 1))
    return forest(nodes[a], nodes[b]) if len(a) else (nodes[:0], nodes[:0])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for group in iter_groups(batches, ["cluster", "i", "j"]):
                if group.num_rows > 1:
                    sets = [np.frombuffer(s, dtype=np.uint64) for s in group.column("shingles").to_pylist()]
                    yield confirmed_forest(group.column("node").to_numpy(), sets, percent)

        return _gather(pairs())

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, matches: int = MATCHES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs(doc_id, text)``.

    ``t1`` and ``t2`` name the row's text, ``group`` its component, by a number that is null
    for empty sets.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    sketched = docs.select("doc_id", "text", *text_key()).mapInArrow(_sketch, "doc_id long, t1 long, t2 long, n long, k1 long, k2 long, sig array<int>")
    sketched = materialize(sketched, "signatures")
    sets = sketched.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    sets = materialize(sets.withColumn("node", F.monotonically_increasing_id()), "sets")

    # skip: whoever agrees with another in so many coordinates does so in one of the first few
    lead = _codes(sets, COORDS - matches + 1)
    shared = materialize(lead.groupBy("code").count().where("count > 1"), "shared")
    able = hot_join(lead, shared, ["code"], "count").select("node").distinct()
    nodes = materialize(sets.select("node", "sig").join(able, "node", "left_semi"), "able")
    codes = _codes(nodes, COORDS)
    counts = materialize(codes.groupBy("code").count().where("count > 1"), "counts")
    own = Window.partitionBy("node")
    prefix = (
        hot_join(codes, counts, ["code"], "count")
        .withColumn("held", F.count("*").over(own))
        .where(F.col("held") >= matches)
        .withColumn("r", F.row_number().over(own.orderBy("count", "code")))
        .where(F.col("r") <= F.col("held") - matches + 1)
    )
    prefix = materialize(prefix.select("node", "code"), "prefix")
    discard(shared, counts)
    lists = materialize(prefix.groupBy("code").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    posted = hot_join(prefix, lists, ["code"], "size").join(nodes, "node")
    width = 3 * shuffle_width(spark)
    matched = _dealt(_blocks(posted, "code", "size", POSTING_BLOCK), width, "code", "i", "j").select("code", "i", "j", "node", "sig").mapInArrow(_match(matches), "a long, b long")

    roots = materialize(connected_components(matched), "roots")
    discard(prefix, lists, nodes)
    members = roots.select("node", F.col("root").alias("cluster")).unionByName(roots.select(F.col("root").alias("node"), F.col("root").alias("cluster")).distinct())
    members = materialize(members.join(sets.select("node", "k1", "k2", "first_id"), "node"), "members")
    wanted = IdFilter(members, "first_id")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(wanted.passes(batch.column("h").to_numpy())))
            raw, offs = text_buffers(batch.column("text"))
            own = list(shingle_sets(raw, offs))
            keys = [set_key(s) for s in own]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())],
                ["first_id", "k1", "k2", "shingles"],
            )

    full = rows.withColumn("h", wanted.key("doc_id")).mapInArrow(sets_of, "first_id long, k1 long, k2 long, shingles binary")
    sizes = materialize(members.groupBy("cluster").agg(F.count("*").alias("size")), "sizes")
    held = members.join(full, (members.first_id.eqNullSafe(full.first_id)) & (members.k1 == full.k1) & (members.k2 == full.k2))
    held = materialize(held.select("node", "cluster", "shingles").dropDuplicates(["node"]), "cluster-sets")
    held_ = hot_join(held, sizes, ["cluster"], "size")
    linked = _dealt(_blocks(held_, "cluster", "size", SET_BLOCK), width, "cluster", "i", "j").select("cluster", "i", "j", "node", "shingles").mapInArrow(_confirm(percent), "a long, b long")

    parts = connected_components(linked)
    named = sets.select("node", "k1", "k2", "first_id", "copies").join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = materialize(named.select("k1", "k2", "first_id", "copies", "root"), "named")
    discard(roots, members, held, sizes)
    smallest = materialize(named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("sets")), "smallest")
    named = materialize(hot_join(named.drop("first_id"), smallest, ["root"], "sets").select("k1", "k2", "copies", "root", "component_id"), "components")
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "t1", "t2", F.col("root").alias("group")]
    sketched = sketched.drop("sig")
    empty = sketched.where("n = 0").withColumns({"component_id": F.col("doc_id"), "root": F.lit(None).cast("long")})
    return hot_join(sketched.where("n > 0"), named, ["k1", "k2"], "copies").select(*columns).unionByName(empty.select(*columns))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")
