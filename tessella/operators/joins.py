"""Joins of the space operators, written so that an equality carries each of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import bits
from tessella.runtime import cores

#: Pairs of a query and a row that one task of :func:`in_blocks` meets, where they are counted.
PAIRS = 1 << 26
#: Up to so many queries are broadcast there; more meet the rows part by part.
SENT = 1 << 17


def counts(queries: DataFrame, rows: DataFrame) -> tuple[int, int]:
    """The sizes of a query set and of the rows, for :func:`in_blocks`."""
    return queries.count(), rows.count()


def in_blocks(queries: DataFrame, rows: DataFrame, condition: Column | None = None, size: int = 256, sizes: tuple[int, int] | None = None) -> DataFrame:
    """A stated query set against all rows: queries travel in arrays of about ``size``.

    ``queries`` and ``rows`` have distinct column names. Rows are scanned once for each
    block, and only pairs that meet ``condition`` leave the scan. Where queries grow with the
    rows, give the ``sizes`` of both: rows are then dealt over so many tasks that each meets
    about ``PAIRS`` of them, however few files they lie in.
    """
    number = F.floor(F.monotonically_increasing_id() / size)
    if sizes:
        width = max(2 * cores(rows.sparkSession), -(-sizes[0] * sizes[1] // PAIRS))
        rows, number = rows.repartition(width), F.pmod(F.xxhash64(*queries.columns), F.lit(-(-sizes[0] // size) or 1))
    blocks = queries.select(F.struct(*queries.columns).alias("q_"), number.alias("block_")).groupBy("block_").agg(F.collect_list("q_").alias("qs_")).drop("block_")
    if sizes:
        # the planner may send the rows, where these are the smaller side, and then blocks are the tasks
        blocks = F.broadcast(blocks) if sizes[0] <= SENT else blocks.coalesce(1 + sizes[0] // (64 * size))
    crossed = rows.crossJoin(blocks).select("*", F.explode("qs_").alias("q_")).select(*rows.columns, "q_.*")
    return crossed if condition is None else crossed.where(condition)


def superset_join(queries: DataFrame, rows: DataFrame, q_fp: str = "q_fp", fp: str = "fp", on: list[str] | None = None, words: int | None = None, dealt: bool = False) -> DataFrame:
    """Queries with the rows whose bitset holds all of theirs.

    With ``on``, an equality (reaction, set) makes it a hash join with the containment as a
    residual; without, the query set goes over all rows in blocks, ``dealt`` as in :func:`in_blocks`.
    """
    contains = bits.superset(F.col(fp), F.col(q_fp), words)
    if on:
        return queries.join(rows, on).where(contains)
    return in_blocks(queries, rows, contains, sizes=counts(queries, rows) if dealt else None)


def all_supersets(queries: DataFrame, rows: DataFrame, words: int, *by: str, q_fp: str = "q_fp") -> DataFrame:
    """For each query and group of ``rows``, whether every bitset of the group holds the query's.

    That is the case if the group's intersection does, so the rows are aggregated first and
    only groups meet queries: ``queries``' columns but ``q_fp``, ``by`` and ``all_superset``.
    Null bitsets are left out.
    """
    common = rows.where("fp is not null").groupBy(*by).agg(F.array(*[F.bit_and(F.col("fp")[w]) for w in range(words)]).alias("all_bits"))
    pairs = in_blocks(queries, common, sizes=counts(queries, rows))
    return pairs.withColumn("all_superset", bits.superset(F.col("all_bits"), F.col(q_fp), words)).drop("all_bits", q_fp)


def similarity_matrix(references: DataFrame, library: DataFrame, descriptors: Sequence[str], key: str = "item", words: int | None = None) -> DataFrame:
    """the similarity of every library entry to each of a stated set of references.

    Both have ``key`` and one bitset column for each descriptor. Result: ``reference, item,
    descriptor, similarity``, NaN where either lacks the descriptor or both bitsets are empty.
    Entries of one key count once (the least bitsets of it); references travel in blocks. The
    result has every pair, so the work grows with their number; tasks are of a bounded one.
    """
    once = library.groupBy(F.col(key).alias("item")).agg(*[F.min(d).alias(f"i_{d}") for d in descriptors])
    wanted = references.groupBy(F.col(key).alias("reference")).agg(*[F.min(d).alias(f"r_{d}") for d in descriptors])
    each = [F.struct(F.lit(d).alias("descriptor"), F.coalesce(bits.tanimoto(F.col(f"r_{d}"), F.col(f"i_{d}"), words), F.lit(float("nan"))).alias("similarity")) for d in descriptors]
    return in_blocks(wanted, once, sizes=counts(references, library)).select("reference", "item", F.inline(F.array(*each)))


def hamming_join(queries: DataFrame, rows: DataFrame, radius: int, n_bits: int, q_id: str = "query_id", r_id: str = "row_id") -> DataFrame:
    """All pairs within ``radius`` by the pigeonhole over ``radius + 1`` bit ranges.

    Two bitsets that differ in at most ``radius`` bits agree wholly in one of the ranges, so
    an equi-join on (range, value) finds every pair and the distance check removes the rest.
    """
    parts = radius + 1
    text = bits.to_bit_string(F.col("fp"))
    edges = [round(k * n_bits / parts) for k in range(parts + 1)]
    keys = F.array(*[F.struct(F.lit(k).alias("part"), F.substring(text, a + 1, b - a).alias("value")) for k, (a, b) in enumerate(zip(edges, edges[1:]))])
    left = queries.select(F.col(q_id), F.col("fp").alias("q_fp"), F.inline(keys))
    right = rows.select(F.col(r_id), F.col("fp"), F.inline(keys))
    near = left.join(right, ["part", "value"]).select(q_id, r_id, bits.hamming(F.col("q_fp"), F.col("fp")).alias("distance"))
    return near.where(F.col("distance") <= radius).distinct()


def counts_fit(need: Column, have: Column) -> Column:
    """Whether descending connector counts ``need`` fit under ``have`` place by place."""
    return (F.size(need) <= F.size(have)) & F.forall(F.zip_with(need, F.slice(have, 1, F.size(need)), lambda a, b: a <= b), lambda t: t)


def injective_maps(parts: DataFrame, sets: DataFrame, n_parts: int, on: Column) -> DataFrame:
    """All injective assignments of parts 0..n-1 to sets of the same reaction.

    ``parts(part, ...)``, ``sets(rxn_id, set_idx, ...)``; ``on`` is the match condition, with
    columns of parts prefixed ``p_`` and of sets prefixed ``s_``. One row for each
    assignment: ``rxn_id, assigned`` (set indices by part).
    """
    left = parts.select(*[F.col(c).alias(f"p_{c}") for c in parts.columns])
    right = sets.select(*[F.col(c).alias(f"s_{c}") for c in sets.columns])
    pairs = in_blocks(left, right, on).select("p_part", F.col("s_rxn_id").alias("rxn_id"), F.col("s_set_idx").alias("set_idx")).distinct()
    out = pairs.where("p_part = 0").select("rxn_id", F.array("set_idx").alias("assigned"))
    for k in range(1, n_parts):
        step = pairs.where(F.col("p_part") == k).select("rxn_id", "set_idx")
        out = out.join(step, "rxn_id").where(~F.array_contains("assigned", F.col("set_idx"))).select("rxn_id", F.concat("assigned", F.array("set_idx")).alias("assigned"))
    return out


def bijective_maps(parts: DataFrame, sets: DataFrame, n_parts: int, on: Column) -> DataFrame:
    """Injective assignments that use every set of the reaction."""
    sizes = sets.groupBy("rxn_id").agg(F.countDistinct("set_idx").alias("n_"))
    return injective_maps(parts, sets, n_parts, on).join(sizes, "rxn_id").where(F.col("n_") == F.size("assigned")).drop("n_")


def fill_incomplete(hits: DataFrame, synthons: DataFrame) -> DataFrame:
    """Give every hit all synthons of the sets it says nothing about.

    ``hits(hit_id, rxn_id, set_idx, frag_id)``; returns the same columns.
    """
    keys = hits.select("hit_id", "rxn_id").distinct()
    sets = synthons.select("rxn_id", "set_idx").distinct()
    missing = keys.join(sets, "rxn_id").join(hits.select("hit_id", "rxn_id", "set_idx").distinct(), ["hit_id", "rxn_id", "set_idx"], "left_anti")
    rest = missing.join(synthons.select("rxn_id", "set_idx", "frag_id"), ["rxn_id", "set_idx"])
    return hits.select("hit_id", "rxn_id", "set_idx", "frag_id").unionByName(rest.select("hit_id", "rxn_id", "set_idx", "frag_id"))


def expand_building_blocks(hits: DataFrame, synthons: DataFrame) -> DataFrame:
    """The matched set keeps its hits, all other sets of the reaction keep everything."""
    named = hits.select(F.concat_ws(":", "rxn_id", F.col("set_idx").cast("string")).alias("hit_id"), "rxn_id", "set_idx", "frag_id").distinct()
    return fill_incomplete(named, synthons)


def assemble(synthons: DataFrame, n_sets: int, cap: int | None = None, order: str = "frag_id", group: str = "rxn_id") -> DataFrame:
    """The products of the first ``n_sets`` sets of each group, at most ``cap`` each.

    With a cap, only the first ``cap`` members of every set are joined: the products that
    come first in lexicographic order of the members need no others.
    """
    rows = synthons.select(group, "set_idx", order)
    if cap is not None:
        w = Window.partitionBy(group, "set_idx").orderBy(order)
        rows = rows.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= cap).drop("r_")
    out = None
    for k in range(n_sets):
        side = rows.where(F.col("set_idx") == k).select(group, F.col(order).alias(f"f{k}"))
        out = side if out is None else out.join(side, group)
        if cap is not None:
            w = Window.partitionBy(group).orderBy(*[f"f{i}" for i in range(k + 1)])
            out = out.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= cap).drop("r_")
    return out


def lookup_by_fingerprint(keys: DataFrame, synthons: DataFrame) -> DataFrame:
    """Synthons of equal reaction, set and fingerprint."""
    return keys.join(synthons, ["rxn_id", "set_idx", "fp"])


def topology_join(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """Equal connectors, compatible size and pairwise distances.

    Both sides have ``connectors, size, dists``; queries also ``low, high`` and
    ``dist_low, dist_high`` arrays. Arrays of unlike lengths are not compatible.
    """
    inside = F.forall(F.zip_with("dist_low", "dists", lambda a, d: a <= d), lambda t: t) & F.forall(F.zip_with("dist_high", "dists", lambda b, d: d <= b), lambda t: t)
    return queries.join(rows, "connectors").where(F.col("size").between(F.col("low"), F.col("high"))).where(inside)


def attach_metadata(reactions: DataFrame, metadata: DataFrame, key: str = "rxn_id") -> DataFrame:
    """Metadata of a reaction by its id, else by the part after the last ``__``."""
    short = F.regexp_replace(F.col(key), r"^.*__", "")
    exact = metadata.select(F.col(key), F.col("metadata").alias("m1_"))
    other = metadata.select(F.col(key).alias("k2_"), F.col("metadata").alias("m2_"))
    out = reactions.join(exact, key, "left").withColumn("k_", short)
    return out.join(other, F.col("k_") == F.col("k2_"), "left").withColumn("metadata", F.coalesce("m1_", "m2_")).drop("m1_", "m2_", "k_", "k2_")


def require_fragments(wanted: DataFrame, synthons: DataFrame, keys: list[str]) -> DataFrame:
    """Fragments by id; raises if any is missing."""
    gone = wanted.join(synthons, keys, "left_anti").select(*keys).limit(5).collect()
    if gone:
        raise KeyError(f"unknown fragments, for instance {[tuple(g) for g in gone]}")
    return wanted.join(synthons, keys)


def retained_attributes(attributes: DataFrame, representatives: DataFrame) -> DataFrame:
    """Attributes of representatives only."""
    return attributes.join(representatives.select("rxn_id", "frag_id"), ["rxn_id", "frag_id"], "left_semi")


def disjoint_pairs(fragments: DataFrame, low: int, high: int) -> DataFrame:
    """Pairs of one molecule's fragments without common atoms, at a distance within bounds.

    ``fragments(mol_id, frag_id, mask bigint, centre int)``.
    """
    a = fragments.select("mol_id", F.col("frag_id").alias("a"), F.col("mask").alias("ma"), F.col("centre").alias("ca"))
    b = fragments.select("mol_id", F.col("frag_id").alias("b"), F.col("mask").alias("mb"), F.col("centre").alias("cb"))
    return a.join(b, "mol_id").where("a < b").where(F.col("ma").bitwiseAND(F.col("mb")) == 0).where(F.abs(F.col("ca") - F.col("cb")).between(low, high))
