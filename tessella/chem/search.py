"""Searches of combinatorial spaces that never enumerate their products.

Queries are single structures, so their cuts are listed on the driver; everything about
synthons runs as joins. Structure tests are Arrow-batched UDFs behind a fingerprint filter
that Spark evaluates itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from tessella.chem import fragments as fr
from tessella.chem.molecule import Molecule, fingerprint, match, parse
from tessella.functions import bits, scalars
from tessella.operators import joins, ranking
from tessella.runtime import byte_width, materialize

WORDS = 16
_INTS = T.ArrayType(T.IntegerType())
INDEX = T.StructType([
    T.StructField("fp", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType()), T.StructField("connectors", T.IntegerType()), T.StructField("dists", _INTS),
    T.StructField("orders", _INTS), T.StructField("rotatable", T.IntegerType()), T.StructField("problems", T.ArrayType(T.StringType())),
])


@lru_cache(maxsize=32_768)
def _description(text: str) -> tuple:
    try:
        mol = parse(text)
    except ValueError:
        return (None, None, None, None, None, None, ["unreadable"])
    mask, far, size = fr.topology(mol)
    return (fingerprint(mol, WORDS), size, mask, far, fr.bond_orders(mol), mol.rotatable(), fr.problems(mol))


@pandas_udf(INDEX)
def describe(structures: pd.Series) -> pd.DataFrame:
    """Fingerprint, size, topology, bond orders and problems of every structure; texts that
    cannot be read have a problem and nulls. Workers keep those of the latest structures."""
    return pd.DataFrame([_description(text or "") for text in structures], columns=["fp", "size", "connectors", "dists", "orders", "rotatable", "problems"])


def build_index(synthons: DataFrame) -> DataFrame:
    """``synthons(rxn_id, set_idx, frag_id, structure)`` with what searches need. Rows are
    dealt anew, as a small file of many synthons would be one task here and in every search."""
    rows = synthons.select("rxn_id", "set_idx", "frag_id", "structure")
    rows = rows.repartition(byte_width(rows, 16 << 20)).withColumn("d_", describe("structure"))
    return materialize(rows.select("rxn_id", "set_idx", "frag_id", "structure", "d_.*"), "index")


def check_index(index: DataFrame) -> DataFrame:
    """``rxn_id, problem``, chemistry included: unreadable structures, connectors that
    repeat or have more than one bond, and bond orders that differ between the two ends."""
    own = index.select("rxn_id", F.explode("problems").alias("problem"))
    ends = index.where("orders is not null").select("rxn_id", F.posexplode("orders").alias("bit", "order")).where("order > 0")
    mixed = ends.groupBy("rxn_id", "bit").agg(F.min("order").alias("least"), F.max("order").alias("most")).where("least < most").select("rxn_id", F.lit("bond orders differ at a connector").alias("problem"))
    return ranking.validate(index.where("connectors is not null")).unionByName(own).unionByName(mixed).distinct()


@lru_cache(maxsize=100_000)
def _contains(query: str, target: str) -> bool:
    return match(parse(query), parse(target)) is not None


@pandas_udf(T.BooleanType())
def contains(queries: pd.Series, targets: pd.Series) -> pd.Series:
    """Whether each target has the query as a subgraph."""
    return pd.Series([_contains(q, t) for q, t in zip(queries, targets)], dtype=bool)


@pandas_udf(T.StringType())
def assembled(parts: pd.Series) -> pd.Series:
    """F12 over arrays of structures; null where the parts do not fit."""

    def one(texts: Iterable[str]) -> str | None:
        try:
            return fr.assemble([parse(t) for t in texts])[0].write()
        except ValueError:
            return None

    return pd.Series([one(p) for p in parts])


def _labels(index: DataFrame) -> list[int]:
    used = index.agg(F.bit_or("connectors").alias("m")).first().m or 0
    return [b for b in range(8) if used >> b & 1]


def _splits(query: Molecule, cuts: int, labels: list[int]) -> list[tuple[str, ...]]:
    """The distinct splits of a query, as sorted notations of their parts."""
    if cuts == 0:
        return [(query.write(),)]
    found = {tuple(sorted(p.write() for p in parts)) for parts in fr.splits(query, cuts, cuts + 1, labels)}
    return sorted(found)


def search_level(index: DataFrame, query: Molecule, cuts: int, labels: list[int], first_only: bool = False, fill: bool = True) -> DataFrame | None:
    """Factorised hits of one split level: ``hit_id, rxn_id, set_idx, frag_id``.

    Every part of a split must be in some synthon of a set of its own; sets without a part
    keep all of their synthons, which are listed only with ``fill``.
    """
    spark = index.sparkSession
    splits = _splits(query, cuts, labels)
    if not splits:
        return None
    parts = sorted({p for s in splits for p in s})
    table = spark.createDataFrame([(p, fingerprint(parse(p), WORDS)) for p in parts], "part string, q_fp array<bigint>")
    screened = joins.superset_join(table, index.where("fp is not null").select("rxn_id", "set_idx", "frag_id", "structure", "fp"), words=WORDS)
    found = screened.where(contains("part", "structure")).select("part", "rxn_id", "set_idx", "frag_id")
    if first_only:
        found = ranking.top_per(found, ["part", "rxn_id", "set_idx"], [F.asc("frag_id")], 1, "r_").drop("r_")
    found = materialize(found, "matches")
    sets = found.select("part", "rxn_id", "set_idx").distinct()
    rows = [(k, i, p) for k, s in enumerate(splits) for i, p in enumerate(s)]
    places = spark.createDataFrame(rows, "split int, place int, part string").join(sets, "part")
    by_size: dict[int, list[int]] = {}
    for k, s in enumerate(splits):
        by_size.setdefault(len(s), []).append(k)
    hits = None
    for n, own in by_size.items():
        chosen = places.join(spark.createDataFrame([(k,) for k in own], "split int"), "split", "left_semi")
        out = chosen.where("place = 0").select("split", "rxn_id", F.array("set_idx").alias("assigned"), F.array("part").alias("parts"))
        for i in range(1, n):
            step = chosen.where(F.col("place") == i).select("split", "rxn_id", "set_idx", "part")
            out = out.join(step, ["split", "rxn_id"]).where(~F.array_contains("assigned", F.col("set_idx")))
            out = out.select("split", "rxn_id", F.concat("assigned", F.array("set_idx")).alias("assigned"), F.concat("parts", F.array("part")).alias("parts"))
        hits = out if hits is None else hits.unionByName(out)
    hits = hits.withColumn("hit_id", F.concat_ws(":", F.lit(str(cuts)), F.col("split").cast("string"), "rxn_id", F.array_join(F.transform("assigned", lambda x: x.cast("string")), ",")))
    each = hits.select("hit_id", "rxn_id", F.inline(F.arrays_zip(F.col("assigned").alias("set_idx"), F.col("parts").alias("part"))))
    members = each.join(found, ["part", "rxn_id", "set_idx"]).select("hit_id", "rxn_id", "set_idx", "frag_id")
    return joins.fill_incomplete(members, index) if fill else members


def substructure_search(index: DataFrame, structure: str, max_cuts: int = 3, skip_discovered: bool = True, min_bits: int = 0, first_only: bool = False, fill: bool = True) -> DataFrame:
    """Hits of all split levels, ``level, hit_id, rxn_id, set_idx, frag_id``.

    Level 0 finds the query in single synthons. With ``skip_discovered``, a reaction is
    searched no further once a level has hit it. ``min_bits`` refuses queries that are too
    simple (P7). Without ``fill``, sets that a hit leaves whole have no rows. The levels are
    few and known, so the driver walks them.
    """
    query = parse(structure)
    if sum(w.bit_count() for w in fingerprint(query, WORDS)) < min_bits:
        raise ValueError("the query is too simple")
    labels = _labels(index)
    out = None
    for cuts in range(max_cuts + 1):
        rest = index if out is None or not skip_discovered else ranking.omit_discovered(index, out)
        hits = search_level(rest, query, cuts, labels, first_only, fill)
        if hits is None:
            continue
        hits = materialize(hits.withColumn("level", F.lit(cuts)), "hits")
        out = hits if out is None else out.unionByName(hits)
    return out.select("level", "hit_id", "rxn_id", "set_idx", "frag_id")


def expand(hits: DataFrame, index: DataFrame, cap: int = 1024) -> DataFrame:
    """Up to ``cap`` products of every hit, in the order of their fragments, with
    their structures: ``hit_id, rxn_id, frag_ids, structure``."""
    n_sets = hits.agg(F.max("set_idx").alias("m")).first().m
    if n_sets is None:
        return hits.sparkSession.createDataFrame([], "hit_id string, rxn_id string, frag_ids array<string>, structure string")
    found = None
    sizes = hits.groupBy("hit_id").agg(F.countDistinct("set_idx").alias("n_"))
    for n in range(1, n_sets + 2):
        own = hits.join(sizes.where(F.col("n_") == n), "hit_id", "left_semi")
        wide = joins.assemble(own, n, cap, "frag_id", "hit_id")
        wide = wide.select("hit_id", F.array(*[f"f{k}" for k in range(n)]).alias("frag_ids"))
        found = wide if found is None else found.unionByName(wide)
    named = found.join(hits.select("hit_id", "rxn_id").distinct(), "hit_id")
    each = named.select("hit_id", "rxn_id", "frag_ids", F.posexplode("frag_ids").alias("set_idx", "frag_id"))
    texts = each.join(index.select("rxn_id", "set_idx", "frag_id", "structure"), ["rxn_id", "set_idx", "frag_id"])
    whole = texts.groupBy("hit_id", "rxn_id", "frag_ids").agg(F.transform(F.sort_array(F.collect_list(F.struct("set_idx", "structure"))), lambda x: x["structure"]).alias("s"))
    return whole.select("hit_id", "rxn_id", "frag_ids", assembled("s").alias("structure"))


@pandas_udf(T.DoubleType())
def _similarity(structures: pd.Series, queries: pd.Series) -> pd.Series:
    def one(s: str | None, q: str) -> float | None:
        if s is None:
            return None
        a, b = fingerprint(parse(s), WORDS), fingerprint(parse(q), WORDS)
        either = sum((x | y).bit_count() for x, y in zip(a, b))
        return sum((x & y).bit_count() for x, y in zip(a, b)) / either if either else None

    return pd.Series([one(s, q) for s, q in zip(structures, queries)])


def similarity_search(index: DataFrame, structure: str, max_hits: int = 100, extensions: tuple[int, int] = (20, 6), max_cuts: int = 2) -> DataFrame:
    """Products most similar to a query, without enumerating any but the best.

    Every split of the query into as many parts as a reaction has sets is laid over it: parts
    meet synthons of equal connectors and compatible size and distances (J9), the best
    ``extensions`` of every part stay (W2), combinations are scored by their parts (A15), the
    best ``max_hits`` of every level are assembled and scored whole (T1).
    """
    spark = index.sparkSession
    query, labels = parse(structure), _labels(index)
    n_sets = index.groupBy("rxn_id").agg(F.countDistinct("set_idx").alias("n_sets"))
    out = None
    for cuts in range(1, max_cuts + 1):
        rows = []
        for k, own in enumerate(s for s in _splits(query, cuts, labels) if len(s) == cuts + 1):
            for i, text in enumerate(own):
                mask, far, size = fr.topology(parse(text))
                rows.append((k, i, size, mask, far, fingerprint(parse(text), WORDS)))
        if not rows:
            continue
        parts = spark.createDataFrame(rows, "split int, place int, q_size int, connectors int, q_dists array<int>, q_fp array<bigint>")
        low, high = scalars.size_range(F.col("q_size"))
        near_low, near_high = F.transform("q_dists", lambda d: scalars.distance_range(d)[0]), F.transform("q_dists", lambda d: scalars.distance_range(d)[1])
        parts = parts.select("*", low.alias("low"), high.alias("high"), near_low.alias("dist_low"), near_high.alias("dist_high"))
        fit = joins.topology_join(parts, index.where("fp is not null").select("rxn_id", "set_idx", "frag_id", "structure", "fp", "size", "connectors", "dists"))
        fit = fit.withColumn("similarity", bits.tanimoto(F.col("q_fp"), F.col("fp"))).where("similarity is not null")
        best = ranking.top_per(fit, ["split", "place", "rxn_id", "set_idx"], [F.desc("similarity"), F.asc("frag_id")], extensions[0] if cuts == 1 else extensions[1], "r_")
        best = materialize(best.select("split", "place", "rxn_id", "set_idx", "frag_id", "structure", "similarity", F.pow(F.col("q_size"), F.lit(2.0)).alias("w")), "parts")
        whole = None
        for i in range(cuts + 1):
            member = F.struct("set_idx", "frag_id", "structure")
            side = best.where(F.col("place") == i).select("split", "rxn_id", F.col("set_idx").alias("s_"), member.alias("m_"), (F.col("similarity") * F.col("w")).alias("v_"), F.col("w").alias("w_"))
            if whole is None:
                whole = side.select("split", "rxn_id", F.array("s_").alias("sets"), F.array("m_").alias("members"), F.col("v_").alias("v"), F.col("w_").alias("w"))
            else:
                whole = whole.join(side, ["split", "rxn_id"]).where(~F.array_contains("sets", F.col("s_")))
                whole = whole.select("split", "rxn_id", F.concat("sets", F.array("s_")).alias("sets"), F.concat("members", F.array("m_")).alias("members"), (F.col("v") + F.col("v_")).alias("v"), (F.col("w") + F.col("w_")).alias("w"))
        whole = whole.join(n_sets.where(F.col("n_sets") == cuts + 1), "rxn_id", "left_semi").withColumn("members", F.sort_array("members"))
        scored = whole.select("rxn_id", F.transform("members", lambda m: m["frag_id"]).alias("frag_ids"), F.transform("members", lambda m: m["structure"]).alias("structures"), (F.col("v") / F.col("w")).alias("part_score"))
        distinct = scored.groupBy("rxn_id", "frag_ids").agg(F.max("part_score").alias("part_score"), F.first("structures").alias("structures"))  # W3
        top = distinct.orderBy(F.desc("part_score"), "rxn_id", "frag_ids").limit(max_hits).withColumn("level", F.lit(cuts))  # a top-k report
        out = top if out is None else out.unionByName(top)
    if out is None:
        return spark.createDataFrame([], "level int, rxn_id string, frag_ids array<string>, structure string, part_score double, similarity double")
    built = out.withColumn("structure", assembled("structures")).withColumn("similarity", _similarity("structure", F.lit(query.write())))
    return built.select("level", "rxn_id", "frag_ids", "structure", "part_score", "similarity").orderBy(F.desc("similarity"), "rxn_id", "frag_ids")


def connected_pair_search(index: DataFrame, structure: str, pairs: list[tuple[list[int], list[int]]], slack: tuple[int, int] = (-1, 2)) -> DataFrame:
    """Queries that keep two fragments of a structure, joined by chains of about the
    length between them, each searched as in :func:`substructure_search`."""
    mol = parse(structure)
    texts: set[str] = set()
    for a, b in pairs:
        far = {(x, y): mol.distances(x)[y] for x in a for y in b}
        x, y = min(far, key=lambda k: (far[k], k))
        both = mol.part([*a, *b])
        gap = far[x, y] - 1
        low, high = max(1, gap + slack[0]), max(1, gap + slack[1])
        texts |= {m.write() for m in fr.bridges(both, [(a.index(x), len(a) + b.index(y))], [(low, high)])}
    out = None
    for text in sorted(texts):
        hits = substructure_search(index, text, max_cuts=2).withColumn("query", F.lit(text))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise ValueError("no pairs")
    return out


def search_spaces(indexes: dict[str, DataFrame], structure: str, **options) -> DataFrame:
    """:func:`substructure_search` over several named spaces, with the column ``space``."""
    if not indexes:
        raise ValueError("no spaces")
    out = None
    for name, index in indexes.items():
        hits = substructure_search(index, structure, **options).select(F.lit(name).alias("space"), "*")
        out = hits if out is None else out.unionByName(hits)
    return out


def without_salts(mol: Molecule) -> tuple[Molecule, list[int]]:
    """A cleaner: what is not joined to the largest component (of the first atom on ties) goes."""
    kept = sorted(max(mol.components(), key=lambda c: (len(c), -min(c))))
    at = {a: i for i, a in enumerate(kept)}
    return mol.part(kept), [at.get(i, -1) for i in range(len(mol.atoms))]


def clean_space(synthons: DataFrame, cleaner: Callable = without_salts, seed: int = 0) -> DataFrame:
    """``rxn_id, set_idx, frag_id, structure, cleaned`` of every synthon.

    Each is assembled with one member of every other set of its reaction, which a hash of
    its id and ``seed`` picks, the product is cleaned, and the synthon's atoms are read off.
    ``cleaned`` is null if nothing could be assembled or is left, or a connector lost its atom; parts that
    an incomplete reaction does not join count as apart, so the default cleaner drops the smaller.
    """
    rows = synthons.select("rxn_id", "set_idx", "frag_id", "structure")
    order = Window.partitionBy("rxn_id", "set_idx").orderBy("frag_id")
    numbered = rows.select("rxn_id", F.col("set_idx").alias("other"), (F.row_number().over(order) - 1).alias("k"), F.col("structure").alias("partner"))
    sizes = rows.groupBy("rxn_id", F.col("set_idx").alias("other")).agg(F.count("*").alias("n"))
    wanted = rows.join(sizes, "rxn_id").where("other <> set_idx").withColumn("k", F.pmod(F.xxhash64("frag_id", "set_idx", "other", F.lit(seed)), F.col("n")).cast("int"))
    found = wanted.join(numbered, ["rxn_id", "other", "k"])
    partners = found.groupBy("rxn_id", "set_idx", "frag_id").agg(F.sort_array(F.collect_list("partner")).alias("partners"))  # a few sets

    @pandas_udf(T.StringType())
    def cleaned(own: pd.Series, others: pd.Series) -> pd.Series:
        def one(text: str, rest: Iterable[str] | None) -> str | None:
            try:
                return fr.clean_synthon(text, list(rest) if rest is not None else [], cleaner)
            except ValueError:
                return None

        return pd.Series([one(t, r) for t, r in zip(own, others)], dtype=object)

    return rows.join(partners, ["rxn_id", "set_idx", "frag_id"], "left").select("rxn_id", "set_idx", "frag_id", "structure", cleaned("structure", "partners").alias("cleaned"))
