"""Ranking, limits, set operations and filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions.scalars import sanitise


def top_per(rows: DataFrame, by: list[str], order: list[Column], k: int | Column, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; ``k`` may be a column."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def best_per(rows: DataFrame, by: list[str], score: str, tie: str) -> DataFrame:
    """The row of the largest score of every group."""
    return top_per(rows, by, [F.desc(score), F.asc(tie)], 1, "r_").drop("r_")


def largest_group(rows: DataFrame, within: str, group: str) -> DataFrame:
    """The rows of the most frequent ``group`` value within each ``within``."""
    counts = rows.groupBy(within, group).agg(F.count("*").alias("n_"))
    win = top_per(counts, [within], [F.desc("n_"), F.asc(group)], 1, "r_").select(within, group)
    return rows.join(win, [within, group], "left_semi")


def running_share(rows: DataFrame, weight: str, order: list[str], by: list[str]) -> DataFrame:
    """The running sum of weights as a share, for weighted picks."""
    w = Window.partitionBy(*by)
    return rows.withColumn("cum", F.sum(weight).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("share", F.col("cum") / F.sum(weight).over(w))


def merge_spaces(spaces: DataFrame, on_duplicate: str = "rename") -> DataFrame:
    """The union of ``(source, rxn_id, ...)``; repeated ids fail or become ``id__source[_n]``."""
    pairs = spaces.select("source", "rxn_id").distinct()
    counted = pairs.withColumn("copies_", F.count("*").over(Window.partitionBy("rxn_id")))
    if on_duplicate == "fail":
        bad = counted.where("copies_ > 1").select("rxn_id").limit(3).collect()
        if bad:
            raise ValueError(f"reaction ids repeat: {[b.rxn_id for b in bad]}")
    name = F.concat_ws("__", "rxn_id", sanitise(F.col("source")))
    nth = F.row_number().over(Window.partitionBy(name).orderBy("source"))
    named = counted.withColumn("base_", name).withColumn("nth_", nth)
    merged = F.when(F.col("copies_") == 1, F.col("rxn_id")).when(F.col("nth_") == 1, F.col("base_")).otherwise(F.concat_ws("_", "base_", F.col("nth_").cast("string")))
    return spaces.join(named.select("source", "rxn_id", merged.alias("merged_id")), ["source", "rxn_id"])


def split_by_sets(sizes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reactions with two, three and any other number of sets."""
    return sizes.where("n_sets = 2"), sizes.where("n_sets = 3"), sizes.where("n_sets not in (2, 3)")


def merge_sets(synthons: DataFrame, a: int, b: int) -> DataFrame:
    """Two sets of every reaction become one, of all pairs, with ids ``x:::y``."""
    left = synthons.where(F.col("set_idx") == a).select("rxn_id", F.col("frag_id").alias("x"), F.col("connectors").alias("cx"))
    right = synthons.where(F.col("set_idx") == b).select("rxn_id", F.col("frag_id").alias("y"), F.col("connectors").alias("cy"))
    both = left.join(right, "rxn_id").select("rxn_id", F.lit(a).alias("set_idx"), F.concat_ws(":::", "x", "y").alias("frag_id"), F.col("cx").bitwiseXOR(F.col("cy")).alias("connectors"))
    rest = synthons.where(~F.col("set_idx").isin(a, b)).select("rxn_id", "set_idx", "frag_id", "connectors")
    return rest.unionByName(both)


def merged_summary(synthons: DataFrame, a: int, b: int) -> DataFrame:
    """What :func:`merge_sets` makes, set by set and without its pairs: ``rxn_id, set_idx, n, first_id``.

    The first of the ids ``x:::y`` of one ``x`` has the least ``y``, so one row for each ``x`` is enough.
    """
    sizes = synthons.groupBy("rxn_id", "set_idx").agg(F.count("*").alias("n"), F.min("frag_id").alias("first_id"))
    right = sizes.where(F.col("set_idx") == b).select("rxn_id", F.col("n").alias("n_"), F.col("first_id").alias("y_"))
    left = synthons.where(F.col("set_idx") == a).select("rxn_id", "frag_id").join(right, "rxn_id")
    both = left.groupBy("rxn_id", "n_").agg(F.count("*").alias("m_"), F.min(F.concat("frag_id", F.lit(":::"), "y_")).alias("first_id"))
    both = both.select("rxn_id", F.lit(a).alias("set_idx"), (F.col("m_") * F.col("n_")).alias("n"), "first_id")
    return sizes.where(~F.col("set_idx").isin(a, b)).unionByName(both)


def distinct_replacements(rows: DataFrame) -> DataFrame:
    """U8: one replacement of each structure for every parent."""
    return rows.dropDuplicates(["parent", "structure"])


def validate(synthons: DataFrame) -> DataFrame:
    """``rxn_id, problem`` for reactions that break a rule, one row for each problem.

    All members of a set have the same connectors; every connector is on exactly two sets;
    connectors are consecutive from the first. Synthons are read once.
    """
    c = F.col("connectors")
    sets = synthons.groupBy("rxn_id", "set_idx").agg((F.min(c) != F.max(c)).alias("mixed"), F.min(c).alias("c"))
    on = [F.sum(F.call_function("getbit", F.col("c").cast("long"), F.lit(i))).alias(f"on{i}") for i in range(8)]
    uses = sets.groupBy("rxn_id").agg(F.bool_or("mixed").alias("mixed"), F.bool_or(F.col("c") == 0).alias("bare"), *on)
    n = [F.coalesce(F.col(f"on{i}"), F.lit(0)) for i in range(8)]
    gap = F.lit(False)
    for i in range(7):
        gap = gap | ((n[i] == 0) & reduce(lambda a, b: a | b, [x > 0 for x in n[i + 1 :]]))
    dangling = reduce(lambda a, b: a | b, [(x > 0) & (x != 2) for x in n])
    found = [("mixed connectors in a set", F.col("mixed")), ("connector not on two sets", dangling), ("connectors not consecutive", gap), ("no connector", F.col("bare"))]
    return uses.select("rxn_id", F.explode(F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in found]))).alias("problem"))


def max_sets(synthons: DataFrame, most: int = 3) -> DataFrame:
    """Reactions of at most ``most`` sets; 0 or less keeps all."""
    if most <= 0:
        return synthons
    keep = synthons.groupBy("rxn_id").agg(F.countDistinct("set_idx").alias("n")).where(F.col("n") <= most)
    return synthons.join(keep.select("rxn_id"), "rxn_id", "left_semi")


def max_size(synthons: DataFrame, size: Column, most: int) -> DataFrame:
    """P10: synthons of at most ``most`` atoms; a reaction with an emptied set goes."""
    kept = synthons.where(size <= most)
    emptied = synthons.select("rxn_id", "set_idx").distinct().join(kept.select("rxn_id", "set_idx").distinct(), ["rxn_id", "set_idx"], "left_anti").select("rxn_id").distinct()
    return kept.join(emptied, "rxn_id", "left_anti")


def contains_anywhere(rows: DataFrame, needle: str) -> DataFrame:
    """Rows with the text, in any case, in any column."""
    columns = F.array(*[F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    return rows.where(F.exists(columns, lambda c: c.contains(needle.lower())))


def omit_discovered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Leave out reactions that have been hit."""
    return rows.join(found.select("rxn_id").distinct(), "rxn_id", "left_anti")


def require_role(metadata: dict[str, str], role: str = "downsampled") -> None:
    """Raise unless the space has the role."""
    if metadata.get("space.role") != role:
        raise ValueError(f"space.role is {metadata.get('space.role')!r}, not {role!r}")


def threshold(rows: DataFrame, column: str, least: float) -> DataFrame:
    """Rows of at least ``least``; 0 or less keeps all. NaN is unknown and goes."""
    return rows if least <= 0 else rows.where((F.col(column) >= least) & ~F.isnan(column))


def gates(rows: DataFrame, min_atoms: int = 1, max_atoms: int = 0, max_rotatable: int = 0, min_similarity: float = 0.0) -> DataFrame:
    """Atom range, rotatable-bond cap and similarity gate; 0 means unlimited."""
    out = rows.where(F.col("atoms") >= min_atoms)
    if max_atoms > 0:
        out = out.where(F.col("atoms") <= max_atoms)
    if max_rotatable > 0:
        out = out.where(F.col("rotatable_bonds") <= max_rotatable)
    return threshold(out, "similarity", min_similarity)
