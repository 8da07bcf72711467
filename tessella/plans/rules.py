"""Queries of the filters, lookups, groupings and counters that the larger plans are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import bits
from tessella.operators import aggregates, joins, ranking, stored
from tessella.plans.catalogue import EITHER, FP, SHARED, S, fingerprints, query, synthons, table
from tessella.runtime import scratch_path

WIDE = "w AS (SELECT p_brand || '/' || p_type AS rxn_id, CAST(p_size % 3 AS INTEGER) AS set_idx, CAST(p_partkey AS VARCHAR) AS frag_id FROM part)"


def _wide(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("rxn_id"), (F.col("p_size") % 3).cast("int").alias("set_idx"), F.col("p_partkey").cast("string").alias("frag_id"))


@query(f"""WITH {S}, c AS (SELECT rxn_id, set_idx, count(*) AS n FROM s GROUP BY ALL), z AS (SELECT rxn_id, count(*) AS sets FROM c GROUP BY ALL)
SELECT a.rxn_id, a.set_idx || ',' || b.set_idx || ',' || d.set_idx AS assigned FROM c a JOIN c b USING (rxn_id) JOIN c d USING (rxn_id) JOIN z USING (rxn_id)
WHERE z.sets = 3 AND a.set_idx <> b.set_idx AND a.set_idx <> d.set_idx AND b.set_idx <> d.set_idx AND a.n % 4 >= 0 AND b.n % 4 >= 1 AND d.n % 4 >= 2""")
def bijective_mapping(spark, sf_dir):
    """J4 with counts modulo four in place of connectors."""
    sets = synthons(spark, sf_dir).groupBy("rxn_id", "set_idx").agg((F.count("*") % 4).alias("n"))
    parts = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "part int, need int")
    out = joins.bijective_maps(parts, sets, 3, F.col("s_n") >= F.col("p_need"))
    return out.select("rxn_id", F.array_join(F.transform("assigned", lambda x: x.cast("string")), ",").alias("assigned"))


@query(f"""WITH {S}, h AS (SELECT rxn_id || ':' || set_idx AS hit_id, rxn_id, set_idx, frag_id FROM s WHERE size = 7), k AS (SELECT DISTINCT hit_id, rxn_id, set_idx FROM h)
SELECT * FROM h UNION ALL SELECT k.hit_id, s.rxn_id, s.set_idx, s.frag_id FROM k JOIN s ON s.rxn_id = k.rxn_id AND s.set_idx <> k.set_idx""")
def building_block_expansion(spark, sf_dir):
    """Synthons of one size are the building blocks found."""
    rows = synthons(spark, sf_dir)
    return joins.expand_building_blocks(rows.where("size = 7"), rows)


@query(f"WITH {FP}, r AS (SELECT 'r' || label AS rxn_id, vec_id % 3 AS k, * FROM f WHERE label IS NOT NULL) SELECT q.vec_id AS query_id, r.vec_id FROM r q JOIN r ON q.vec_id % 100 = 0 AND q.rxn_id = r.rxn_id AND q.k = r.k AND q.a = r.a AND q.b = r.b")
def fingerprint_lookup(spark, sf_dir):
    """J8."""
    rows = fingerprints(spark, sf_dir).where("label is not null").select("vec_id", F.concat(F.lit("r"), F.col("label").cast("string")).alias("rxn_id"), F.pmod("vec_id", F.lit(3)).alias("set_idx"), "fp")
    keys = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "rxn_id", "set_idx", "fp")
    return joins.lookup_by_fingerprint(keys, rows).select("query_id", "vec_id")


@query("""WITH r AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN n_name WHEN 1 THEN 'own__' || n_name ELSE 'unknown' END AS rxn_id FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey, rxn_id, CAST(n_regionkey AS VARCHAR) AS metadata FROM r LEFT JOIN nation ON n_name = regexp_replace(rxn_id, '^.*__', '')""")
def reaction_metadata(spark, sf_dir):
    """Ids that are known, known after a prefix, and unknown."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").cast("string").alias("metadata"))
    named = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 3
    reactions = named.select("s_suppkey", F.when(k == 0, F.col("n_name")).when(k == 1, F.concat(F.lit("own__"), "n_name")).otherwise("unknown").alias("rxn_id"))
    return joins.attach_metadata(reactions, nation.select(F.col("n_name").alias("rxn_id"), "metadata"))


@query(f"WITH {S}, k AS (SELECT rxn_id, set_idx, min(frag_id) AS frag_id FROM s GROUP BY ALL) SELECT s.rxn_id, s.frag_id, s.p_type FROM s JOIN k USING (rxn_id, frag_id)")
def retained_attributes(spark, sf_dir):
    """Attributes of one representative of every set, all of which must be known."""
    rows = synthons(spark, sf_dir)
    kept = rows.groupBy("rxn_id", "set_idx").agg(F.min("frag_id").alias("frag_id"))
    known = joins.require_fragments(kept.select("rxn_id", "frag_id"), rows.select("rxn_id", "frag_id"), ["rxn_id", "frag_id"])
    return joins.retained_attributes(rows.select("rxn_id", "frag_id", "p_type"), known)


@query("""WITH g AS (SELECT l_orderkey AS mol_id, CAST(l_linenumber AS BIGINT) AS frag_id, (1::BIGINT << CAST(l_partkey % 8 AS INTEGER)) | (1::BIGINT << CAST(l_suppkey % 8 AS INTEGER)) AS mask, l_suppkey % 10 AS centre FROM lineitem)
SELECT a.mol_id, a.frag_id AS a, b.frag_id AS b FROM g a JOIN g b ON a.mol_id = b.mol_id AND a.frag_id < b.frag_id AND (a.mask & b.mask) = 0 AND abs(a.centre - b.centre) BETWEEN 1 AND 3""")
def disjoint_fragments(spark, sf_dir):
    """An order is a molecule, its lines are fragments of one or two atoms."""
    one = F.lit(1).cast("long")
    mask = F.call_function("shiftleft", one, (F.col("l_partkey") % 8).cast("int")).bitwiseOR(F.call_function("shiftleft", one, (F.col("l_suppkey") % 8).cast("int")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mol_id"), F.col("l_linenumber").cast("long").alias("frag_id"), mask.alias("mask"), (F.col("l_suppkey") % 10).cast("int").alias("centre"))
    return joins.disjoint_pairs(rows, 1, 3).select("mol_id", "a", "b")


@query("SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 30 AND p_partkey % 12 <= 8 AND CAST(p_retailprice AS DOUBLE) / 2000 >= 0.47")
def hit_gates(spark, sf_dir):
    """P6, P14."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("atoms"), (F.col("p_partkey") % 12).alias("rotatable_bonds"), (F.col("p_retailprice").cast("double") / 2000).alias("similarity"))
    return ranking.gates(rows, 5, 30, 8, 0.47).select("p_partkey")


@query(f"WITH {WIDE}, n AS (SELECT rxn_id, count(DISTINCT set_idx) AS n FROM w GROUP BY ALL) SELECT rxn_id, set_idx, frag_id FROM w JOIN n USING (rxn_id) WHERE n <= 2")
def set_count_filter(spark, sf_dir):
    """P9."""
    return ranking.max_sets(_wide(spark, sf_dir), 2).select("rxn_id", "set_idx", "frag_id")


@query(f"WITH {WIDE}, n AS (SELECT rxn_id, count(DISTINCT set_idx) AS n FROM w GROUP BY ALL) SELECT rxn_id, CASE n WHEN 2 THEN 'two' WHEN 3 THEN 'three' ELSE 'other' END AS kind FROM n")
def split_by_sets(spark, sf_dir):
    """U2."""
    two, three, other = ranking.split_by_sets(aggregates.reaction_sizes(_wide(spark, sf_dir)))
    kinds = [df.select("rxn_id", F.lit(kind).alias("kind")) for df, kind in ((two, "two"), (three, "three"), (other, "other"))]
    return kinds[0].unionByName(kinds[1]).unionByName(kinds[2])


@query(f"WITH {S} SELECT rxn_id, set_idx, frag_id FROM s WHERE rxn_id NOT IN (SELECT rxn_id FROM s WHERE size = 50 AND set_idx = 2)")
def omit_discovered(spark, sf_dir):
    """P12."""
    rows = synthons(spark, sf_dir)
    return ranking.omit_discovered(rows, rows.where("size = 50 and set_idx = 2")).select("rxn_id", "set_idx", "frag_id")


@query("SELECT DISTINCT p_brand AS parent, p_type AS structure FROM part")
def distinct_replacements(spark, sf_dir):
    """U8."""
    return ranking.distinct_replacements(table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent"), F.col("p_type").alias("structure")))


@query("""WITH k AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS r FROM part) SELECT p_brand, p_partkey FROM k WHERE r = 1""")
def best_per_reaction(spark, sf_dir):
    """W3."""
    return ranking.best_per(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey").select("p_brand", "p_partkey")


@query("""SELECT l_returnflag || l_linestatus AS rxn_id, count(*) AS attempts, count(*) FILTER (l_partkey % 5 <> 0) AS assemblies, count(*) FILTER (l_partkey % 5 <> 0 AND l_suppkey % 3 = 0) AS passed,
count(*) FILTER (l_partkey % 5 <> 0 AND l_suppkey % 6 = 0) AS hits FROM lineitem GROUP BY ALL""")
def reaction_counters(spark, sf_dir):
    """An order line is an attempt."""
    made = F.col("l_partkey") % 5 != 0
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("rxn_id"), made.alias("assembled"), (made & (F.col("l_suppkey") % 3 == 0)).alias("passed"), (made & (F.col("l_suppkey") % 6 == 0)).alias("hit"))
    return aggregates.reaction_counters(rows)


@query("SELECT p_brand AS center, count(*) AS size, min(CAST(p_size AS DOUBLE) / 50) AS min_similarity FROM part GROUP BY p_brand")
def cluster_summary(spark, sf_dir):
    """A12."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("center"), F.col("p_partkey").alias("item"), (F.col("p_size").cast("double") / 50).alias("similarity"))
    return aggregates.cluster_summary(rows)


@query(f"""WITH {S}, g AS (SELECT rxn_id, set_idx, p_type AS core, count(*) AS n, max(CAST(size % 4 AS INTEGER)) AS exits FROM s GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY rxn_id, set_idx ORDER BY n DESC, core) AS INTEGER) AS rank FROM g""")
def core_groups(spark, sf_dir):
    """A part's type is its core."""
    return aggregates.core_groups(synthons(spark, sf_dir).select("rxn_id", "set_idx", F.col("p_type").alias("core"), (F.col("size") % 4).cast("int").alias("exits"), "frag_id"))


@query("""SELECT l_returnflag || l_linestatus AS pattern, count(*) AS splits, count(*) FILTER (l_partkey % 2 = 0) AS valid, CAST(sum(l_linenumber) AS BIGINT) AS mappings, CAST(sum(l_suppkey) AS BIGINT) AS tests FROM lineitem GROUP BY ALL""")
def split_statistics(spark, sf_dir):
    """A14."""
    rows = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("pattern"), (F.col("l_partkey") % 2 == 0).alias("valid"), F.col("l_linenumber").alias("mappings"), F.col("l_suppkey").alias("tests"))
    return aggregates.split_statistics(rows)


@query(f"WITH {FP} SELECT vec_id, CAST(floor(CAST(bit_count(a) + bit_count(b) AS DOUBLE) * (1.0::DOUBLE / 0.75 - 1.0)) AS INTEGER) AS radius FROM f")
def similarity_radius(spark, sf_dir):
    """F3."""
    return fingerprints(spark, sf_dir).select("vec_id", bits.tanimoto_to_hamming(bits.popcount(F.col("fp")), 0.75).alias("radius"))


@query(f"WITH {FP} SELECT vec_id, a, b FROM f")
def base64_round_trip(spark, sf_dir):
    """bitsets as Base64 text and back, trailing zero bytes dropped on the way."""
    back = bits.from_base64(bits.to_base64(F.col("fp")), 2)
    return fingerprints(spark, sf_dir).select("vec_id", back[0].alias("a"), back[1].alias("b"))


POSITIONS, FACTORS = (0, 5, 11, 17, 23, 29, 34, 41, 47, 53, 59), (7919, 104729, 1299709, 15485863, 31, 127, 8191, 131071, 524287, 6700417, 2971215073)


@query(f"WITH {FP} SELECT vec_id, CAST(({' + '.join(f'(({chr(97 + p // 32)} >> {p % 32}) & 1) * {m}::BIGINT' for p, m in zip(POSITIONS, FACTORS))}) % 32768 AS BIGINT) AS code FROM f")
def projection_hash(spark, sf_dir):
    """F4."""
    return fingerprints(spark, sf_dir).select("vec_id", bits.projection_hash(F.col("fp"), POSITIONS, FACTORS).cast("long").alias("code"))


def _stored(spark, sf_dir):
    path = scratch_path(spark, "bits")
    stored.write_index(fingerprints(spark, sf_dir).select("vec_id", "fp"), path)
    return stored.read_index(spark, path)


@query(f"WITH {FP}, q AS (SELECT vec_id, a & 16711935 AS a, b & 255 AS b FROM f WHERE vec_id % 100 = 0) SELECT q.vec_id AS query_id, r.vec_id FROM q JOIN f r ON (q.a & r.a) = q.a AND (q.b & r.b) = q.b")
def stored_supersets(spark, sf_dir):
    """Bits 0-7 and 16-23 of the first word and 0-7 of the second."""
    mask = F.array(F.lit(16711935).cast("long"), F.lit(255).cast("long"))
    q = fingerprints(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), bits.intersection(F.col("fp"), mask).alias("q_fp"))
    return stored.supersets(_stored(spark, sf_dir), q, words=2).select("query_id", "vec_id")


@query(f"WITH {FP} SELECT q.vec_id AS query_id, r.vec_id, CAST({SHARED} AS DOUBLE) / CAST({EITHER} AS DOUBLE) AS similarity FROM f q JOIN f r ON q.vec_id % 100 = 0 AND {EITHER} > 0 AND CAST({SHARED} AS DOUBLE) / CAST({EITHER} AS DOUBLE) >= 0.45")
def stored_similar(spark, sf_dir):
    """X6."""
    q = fingerprints(spark, sf_dir).where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("fp").alias("q_fp"))
    return stored.similar(_stored(spark, sf_dir), q, 0.45, words=2).select("query_id", "vec_id", "similarity")
