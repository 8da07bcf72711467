"""Named queries of the engine over the generic tables, with their DuckDB counterparts.

Stand-ins: a *reaction* is a part's brand, a *set* its size modulo three, a *synthon* the
part; a *fingerprint* is the signs of an embedding. Query sets are the rows whose id is
divisible by 100; everything runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.functions import bits, scalars
from tessella.operators import aggregates, joins, nearest, ranking, sampling
from tessella.runtime import byte_width

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        name = f.__name__.strip("_")
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def synthons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.pmod("p_size", F.lit(3))
    mask = F.call_function("shiftleft", F.lit(1), k).bitwiseOR(F.call_function("shiftleft", F.lit(1), F.pmod(k + 1, F.lit(3))))
    return p.select(F.col("p_brand").alias("rxn_id"), k.cast("int").alias("set_idx"), F.col("p_partkey").cast("string").alias("frag_id"), F.col("p_size").alias("size"), mask.alias("connectors"), "p_type")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors are dealt anew first: a table in one file would be one task for all that follows."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    return e.repartition(byte_width(e, 16 << 20)).select("vec_id", "label", bits.from_flags(F.transform("embedding", lambda x: x > 0), 2).alias("fp"))


def _queries_of(fps: DataFrame) -> DataFrame:
    return fps.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("fp").alias("q_fp"))


S = """s AS (SELECT p_brand AS rxn_id, CAST(p_size % 3 AS INTEGER) AS set_idx, CAST(p_partkey AS VARCHAR) AS frag_id, p_size AS size, p_type,
       CAST((1 << (p_size % 3)) | (1 << ((p_size % 3 + 1) % 3)) AS INTEGER) AS connectors FROM part)"""


def _word(start: int) -> str:
    return f"CAST(list_sum(list_transform(range(0, 32), lambda i: CASE WHEN embedding[i + {start + 1}] > 0 THEN 1::BIGINT << CAST(i AS INTEGER) ELSE 0::BIGINT END)) AS BIGINT)"


FP = f"f AS (SELECT vec_id, label, {_word(0)} AS a, {_word(32)} AS b FROM embeddings WHERE embedding IS NOT NULL)"
HAMMING = "CAST(bit_count(xor(q.a, r.a)) AS BIGINT) + CAST(bit_count(xor(q.b, r.b)) AS BIGINT)"
SHARED = "(CAST(bit_count(q.a & r.a) AS BIGINT) + CAST(bit_count(q.b & r.b) AS BIGINT))"
EITHER = "(CAST(bit_count(q.a | r.a) AS BIGINT) + CAST(bit_count(q.b | r.b) AS BIGINT))"


@query(f"WITH {FP} SELECT vec_id, CAST(bit_count(a) + bit_count(b) AS BIGINT) AS bits FROM f WHERE bit_count(a) + bit_count(b) >= 24")
def fp_popcount(spark, sf_dir):
    fps = fingerprints(spark, sf_dir).select("vec_id", bits.popcount(F.col("fp")).cast("long").alias("bits"))
    return fps.where("bits >= 24")


@query(f"""WITH {FP}, q AS (SELECT vec_id, a & 1048577 & a AS a, b & 1 AS b FROM f WHERE vec_id % 100 = 0)
SELECT q.vec_id AS query_id, r.vec_id FROM q JOIN f r ON (q.a & r.a) = q.a AND (q.b & r.b) = q.b""")
def fp_superset_join(spark, sf_dir):
    fps = fingerprints(spark, sf_dir)
    mask = F.array(F.lit(1048577).cast("long"), F.lit(1).cast("long"))  # three bits
    q = _queries_of(fps).withColumn("q_fp", bits.intersection(F.col("q_fp"), mask))
    return joins.superset_join(q, fps.select("vec_id", "fp"), words=2, dealt=True).select("query_id", "vec_id")


@query(f"WITH {FP} SELECT q.vec_id AS query_id, r.vec_id, {HAMMING} AS distance FROM f q JOIN f r ON q.vec_id % 100 = 0 AND {HAMMING} <= 20")
def hamming_range(spark, sf_dir):
    fps = fingerprints(spark, sf_dir)
    near = joins.in_blocks(_queries_of(fps), fps.select("vec_id", "fp"), sizes=joins.counts(_queries_of(fps), fps))
    return near.select("query_id", "vec_id", bits.hamming(F.col("q_fp"), F.col("fp"), 2).cast("long").alias("distance")).where("distance <= 20")


@query(f"""WITH {FP}, t AS (SELECT q.vec_id AS query_id, r.vec_id, CAST({SHARED} AS DOUBLE) / CAST({EITHER} AS DOUBLE) AS similarity FROM f q JOIN f r ON q.vec_id % 100 = 0 AND r.vec_id <> q.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM t)
SELECT query_id, vec_id, similarity, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 10""")
def tanimoto_knn(spark, sf_dir):
    fps = fingerprints(spark, sf_dir)
    return nearest.most_similar(_queries_of(fps), fps, 10, 2, others=True).select("query_id", "vec_id", "similarity", "rank")


@query(f"WITH {FP} SELECT q.vec_id AS query_id, r.vec_id AS row_id, {HAMMING} AS distance FROM f q JOIN f r ON q.vec_id % 100 = 0 AND {HAMMING} <= 9")
def mih_lookup(spark, sf_dir):
    fps = fingerprints(spark, sf_dir)
    q = fps.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "fp")
    return joins.hamming_join(q, fps.select(F.col("vec_id").alias("row_id"), "fp"), 9, 64).withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH {S}, c AS (SELECT rxn_id, set_idx, CAST(min(bit_count(connectors)) AS INTEGER) AS n, min(size) AS m FROM s GROUP BY ALL),
h AS (SELECT rxn_id, list_reverse_sort(list(n + m % 3)) AS have FROM c GROUP BY rxn_id),
q AS (SELECT * FROM (VALUES (1, [3, 2]), (2, [4, 3]), (3, [4, 4, 2]), (4, [2, 2, 2, 1])) v(split_id, need))
SELECT CAST(split_id AS INTEGER) AS split_id, rxn_id FROM q JOIN h ON len(need) <= len(have) AND len(list_filter(range(1, len(need) + 1), lambda i: need[i] > have[i])) = 0""")
def connector_count_match(spark, sf_dir):
    c = synthons(spark, sf_dir).groupBy("rxn_id", "set_idx").agg((F.min(F.bit_count("connectors")) + F.min("size") % 3).alias("n"))
    have = c.groupBy("rxn_id").agg(F.sort_array(F.collect_list("n"), False).alias("have"))
    splits = spark.createDataFrame([(1, [3, 2]), (2, [4, 3]), (3, [4, 4, 2]), (4, [2, 2, 2, 1])], "split_id int, need array<int>")
    return joins.in_blocks(splits, have, joins.counts_fit(F.col("need"), F.col("have"))).select("split_id", "rxn_id")


@query(f"""WITH {S}, c AS (SELECT rxn_id, set_idx, count(*) AS n FROM s GROUP BY ALL), p AS (SELECT * FROM (VALUES (0, 1), (1, 2)) v(part, need)),
m AS (SELECT part, rxn_id, set_idx FROM p JOIN c ON c.n >= p.need)
SELECT a.rxn_id, a.set_idx AS first_set, b.set_idx AS second_set FROM m a JOIN m b ON a.rxn_id = b.rxn_id AND a.part = 0 AND b.part = 1 AND a.set_idx <> b.set_idx""")
def injective_mapping(spark, sf_dir):
    sets = synthons(spark, sf_dir).groupBy("rxn_id", "set_idx").agg(F.count("*").alias("n"))
    parts = spark.createDataFrame([(0, 1), (1, 2)], "part int, need int")
    found = joins.injective_maps(parts, sets, 2, F.col("s_n") >= F.col("p_need"))
    return found.select("rxn_id", F.col("assigned")[0].alias("first_set"), F.col("assigned")[1].alias("second_set"))


SIZES = f"""{S}, sets AS (SELECT rxn_id, set_idx, count(*) AS n FROM s GROUP BY ALL),
sizes AS (SELECT rxn_id, count(*) AS n_sets, CAST(sum(n) AS BIGINT) AS n_synthons, list_reduce(list(CAST(n AS HUGEINT)), lambda a, x: a * x) AS compounds FROM sets GROUP BY rxn_id)"""


@query(f"WITH {SIZES} SELECT rxn_id, n_sets, n_synthons, CAST(compounds AS VARCHAR) AS compounds FROM sizes")
def space_size(spark, sf_dir):
    return aggregates.reaction_sizes(synthons(spark, sf_dir)).withColumn("compounds", F.col("compounds").cast("string"))


def factorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three queries: parts of each set whose type holds a word; every set must be hit."""
    words = spark.createDataFrame([("q1", "STEEL"), ("q2", "BRASS"), ("q3", "E")], "hit_id string, word string")
    rows = synthons(spark, sf_dir)
    matched = joins.in_blocks(words, rows, F.col("p_type").contains(F.col("word")))
    sets = rows.groupBy("rxn_id").agg(F.countDistinct("set_idx").alias("n_sets"))
    hits = matched.groupBy("hit_id", "rxn_id", "set_idx").agg(F.sort_array(F.collect_list("frag_id")).alias("frag_ids"))
    full = hits.groupBy("hit_id", "rxn_id").agg(F.countDistinct("set_idx").alias("hit_sets")).join(sets, "rxn_id").where("hit_sets = n_sets")
    return hits.join(full.select("hit_id", "rxn_id"), ["hit_id", "rxn_id"], "left_semi")


HITS = f"""{S}, words AS (SELECT * FROM (VALUES ('q1', 'STEEL'), ('q2', 'BRASS'), ('q3', 'E')) v(hit_id, word)),
hits AS (SELECT hit_id, rxn_id, set_idx, list(frag_id) AS frag_ids FROM words JOIN s ON contains(p_type, word) GROUP BY ALL),
n AS (SELECT rxn_id, count(DISTINCT set_idx) AS n_sets FROM s GROUP BY rxn_id),
full_hits AS (SELECT hit_id, rxn_id FROM hits JOIN n USING (rxn_id) GROUP BY hit_id, rxn_id, n_sets HAVING count(DISTINCT set_idx) = n_sets)"""


@query(f"""WITH {HITS} SELECT hit_id, rxn_id, CAST(list_reduce(list(CAST(len(frag_ids) AS HUGEINT)), lambda a, x: a * x) AS VARCHAR) AS hits
FROM hits SEMI JOIN full_hits USING (hit_id, rxn_id) GROUP BY hit_id, rxn_id""")
def factorised_hits(spark, sf_dir):
    return aggregates.hit_counts(factorised(spark, sf_dir)).withColumn("hits", F.col("hits").cast("string"))


@query(f"""WITH {S}, r AS (SELECT rxn_id, a.frag_id AS f0, b.frag_id AS f1, c.frag_id AS f2 FROM s a JOIN s b USING (rxn_id) JOIN s c USING (rxn_id)
 WHERE a.set_idx = 0 AND b.set_idx = 1 AND c.set_idx = 2),
k AS (SELECT *, row_number() OVER (PARTITION BY rxn_id ORDER BY f0, f1, f2) AS n FROM r) SELECT rxn_id, f0, f1, f2 FROM k WHERE n <= 64""")
def capped_expansion(spark, sf_dir):
    return joins.assemble(synthons(spark, sf_dir), 3, cap=64)


@query(f"""WITH {HITS}, one AS (SELECT hit_id, rxn_id, set_idx, unnest(frag_ids) AS frag_id FROM hits WHERE set_idx = 0)
SELECT hit_id, rxn_id, set_idx, frag_id FROM one
UNION ALL SELECT k.hit_id, k.rxn_id, s.set_idx, s.frag_id FROM (SELECT DISTINCT hit_id, rxn_id FROM one) k JOIN s USING (rxn_id) WHERE s.set_idx <> 0""")
def fill_incomplete(spark, sf_dir):
    rows = synthons(spark, sf_dir)
    words = spark.createDataFrame([("q1", "STEEL"), ("q2", "BRASS"), ("q3", "E")], "hit_id string, word string")
    one = joins.in_blocks(words, rows.where("set_idx = 0"), F.col("p_type").contains(F.col("word")))
    return joins.fill_incomplete(one.select("hit_id", "rxn_id", "set_idx", "frag_id"), rows)


@query("""WITH l AS (SELECT o_orderkey AS rxn_id, o_orderpriority AS priority, l_quantity AS q, l_returnflag AS f FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
l1 AS (SELECT rxn_id, 1 AS level, count(*) AS n FROM l WHERE f = 'R' AND q >= 45 GROUP BY rxn_id),
l2 AS (SELECT rxn_id, 2 AS level, count(*) AS n FROM l WHERE f = 'A' AND q >= 40 AND rxn_id NOT IN (SELECT rxn_id FROM l1) GROUP BY rxn_id),
l3 AS (SELECT rxn_id, 3 AS level, count(*) AS n FROM l WHERE q >= 48 AND rxn_id NOT IN (SELECT rxn_id FROM l1 UNION ALL SELECT rxn_id FROM l2) GROUP BY rxn_id)
SELECT rxn_id, CAST(level AS INTEGER) AS level, n FROM l1 UNION ALL SELECT rxn_id, CAST(level AS INTEGER), n FROM l2 UNION ALL SELECT rxn_id, CAST(level AS INTEGER), n FROM l3""")
def level_search(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rxn_id"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("f"))
    lines = lines.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("rxn_id")), "rxn_id")
    # one pass instead of three anti-joins: a reaction belongs to its first level with a hit
    n = [F.count_if((F.col("f") == "R") & (F.col("q") >= 45)), F.count_if((F.col("f") == "A") & (F.col("q") >= 40)), F.count_if(F.col("q") >= 48)]
    rows = lines.groupBy("rxn_id").agg(*[c.alias(f"n{k + 1}") for k, c in enumerate(n)])
    level = F.when(F.col("n1") > 0, 1).when(F.col("n2") > 0, 2).when(F.col("n3") > 0, 3)
    return rows.withColumn("level", level).where("level is not null").select("rxn_id", "level", F.when(F.col("level") == 1, F.col("n1")).when(F.col("level") == 2, F.col("n2")).otherwise(F.col("n3")).alias("n"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthons(spark, sf_dir).groupBy("rxn_id", "set_idx", "size").agg(F.count("*").alias("n"))


CONV = f"""{S}, h AS (SELECT rxn_id, set_idx, size, CAST(count(*) AS HUGEINT) AS n FROM s GROUP BY ALL),
conv AS (SELECT a.rxn_id, a.size + b.size + c.size AS size, sum(a.n * b.n * c.n) AS n FROM h a JOIN h b ON a.rxn_id = b.rxn_id AND b.set_idx = 1
 JOIN h c ON a.rxn_id = c.rxn_id AND c.set_idx = 2 WHERE a.set_idx = 0 GROUP BY ALL)"""


@query(f"WITH {CONV} SELECT rxn_id, CAST(size AS BIGINT) AS size, CAST(CAST(n AS HUGEINT) AS VARCHAR) AS n FROM conv")
def size_convolution(spark, sf_dir):
    return aggregates.convolve(histograms(spark, sf_dir), 3).select("rxn_id", F.col("size").cast("long").alias("size"), F.col("n").cast("string").alias("n"))


@query(f"""WITH {CONV}, c AS (SELECT *, sum(n) OVER (PARTITION BY rxn_id ORDER BY size) AS cum, sum(n) OVER (PARTITION BY rxn_id) AS total FROM conv)
SELECT rxn_id, CAST(min(size) AS BIGINT) AS min_size, CAST(max(size) AS BIGINT) AS max_size, CAST(arg_max(size, n * 1000 - size) AS BIGINT) AS mode_size,
 CAST(min(CASE WHEN cum >= (total + 1) // 2 THEN size END) AS BIGINT) AS median_size, CAST(CAST(max(total) AS HUGEINT) AS VARCHAR) AS compounds FROM c GROUP BY rxn_id""")
def convolution_stats(spark, sf_dir):
    stats = aggregates.histogram_stats(aggregates.convolve(histograms(spark, sf_dir), 3))
    return stats.select("rxn_id", *[F.col(c).cast("long").alias(c) for c in ("min_size", "max_size", "mode_size", "median_size")], F.col("compounds").cast("string").alias("compounds"))


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reactions, return flags as sets."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("rxn_id"), F.col("l_returnflag").alias("set_idx"))
    return aggregates.reaction_sizes(lines)


ORDER_SIZES = """sets AS (SELECT CAST(l_orderkey AS VARCHAR) AS rxn_id, l_returnflag AS set_idx, count(*) AS n FROM lineitem GROUP BY ALL),
sizes AS (SELECT rxn_id, count(*) AS n_sets, CAST(sum(n) AS BIGINT) AS n_synthons, list_reduce(list(CAST(n AS HUGEINT)), lambda a, x: a * x) AS compounds FROM sets GROUP BY rxn_id)"""


@query(f"""WITH {ORDER_SIZES} SELECT count(*) AS reactions, CAST(sum(n_synthons) AS BIGINT) AS synthons, CAST(CAST(sum(compounds) AS HUGEINT) AS VARCHAR) AS compounds,
count(*) FILTER (compounds = 0) AS empty_reactions, count(*) FILTER (n_sets = 2) AS two_sets, count(*) FILTER (n_sets = 3) AS three_sets, count(*) FILTER (n_sets NOT IN (2, 3)) AS other_sets FROM sizes""")
def space_profile(spark, sf_dir):
    return aggregates.space_profile(order_sizes(spark, sf_dir)).withColumn("compounds", F.col("compounds").cast("string"))


@query(f"""WITH {SIZES}, b AS (SELECT CASE WHEN compounds < 1000000 THEN 0 WHEN compounds < 10000000 THEN 1 WHEN compounds < 100000000 THEN 2 WHEN compounds < 1000000000 THEN 3
 WHEN compounds < 10000000000 THEN 4 WHEN compounds < 100000000000 THEN 5 ELSE 6 END AS position, compounds FROM sizes),
l AS (SELECT * FROM (VALUES (0, '<1M'), (1, '1M-10M'), (2, '10M-100M'), (3, '100M-1B'), (4, '1B-10B'), (5, '10B-100B'), (6, '>100B')) v(position, bucket))
SELECT CAST(l.position AS INTEGER) AS position, bucket, count(compounds) AS reactions, CAST(CAST(coalesce(sum(compounds), 0) AS HUGEINT) AS VARCHAR) AS compounds FROM l LEFT JOIN b ON l.position = b.position GROUP BY l.position, bucket""")
def profile_buckets(spark, sf_dir):
    out = aggregates.size_buckets(aggregates.reaction_sizes(synthons(spark, sf_dir)))
    return out.select("position", "bucket", F.col("reactions").cast("long").alias("reactions"), F.col("compounds").cast("string").alias("compounds"))


@query(f"WITH {ORDER_SIZES} SELECT rxn_id, CAST(compounds AS VARCHAR) AS compounds FROM sizes ORDER BY sizes.compounds DESC, rxn_id LIMIT 20")
def largest_reactions(spark, sf_dir):
    top = order_sizes(spark, sf_dir).orderBy(F.desc("compounds"), "rxn_id").limit(20)  # a top-k report
    return top.select("rxn_id", F.col("compounds").cast("string").alias("compounds"))


@query("""SELECT CAST(l_partkey AS VARCHAR) AS structure, count(DISTINCT l_returnflag) AS n_spaces, count(DISTINCT (l_returnflag, l_suppkey, l_linenumber)) AS n_sets FROM lineitem GROUP BY l_partkey""")
def unique_item_stats(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return aggregates.unique_synthons(lines.select(F.col("l_partkey").cast("string").alias("structure"), F.col("l_returnflag").alias("space"), F.col("l_suppkey").alias("rxn_id"), F.col("l_linenumber").alias("set_idx")))


@query("""WITH u AS (SELECT 'customer #1' AS source, 'n' || c_nationkey AS rxn_id, c_custkey AS item FROM customer UNION ALL SELECT 'supplier!' , 'n' || s_nationkey, s_suppkey FROM supplier),
p AS (SELECT DISTINCT source, rxn_id FROM u), c AS (SELECT *, count(*) OVER (PARTITION BY rxn_id) AS n FROM p)
SELECT u.source, u.rxn_id, u.item, CASE WHEN n = 1 THEN u.rxn_id ELSE u.rxn_id || '__' || regexp_replace(u.source, '[^a-zA-Z0-9._-]+', '_', 'g') END AS merged_id FROM u JOIN c USING (source, rxn_id)""")
def merge_rename(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer #1").alias("source"), F.concat(F.lit("n"), "c_nationkey").alias("rxn_id"), F.col("c_custkey").alias("item"))
    b = table(spark, sf_dir, "supplier").select(F.lit("supplier!").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("rxn_id"), F.col("s_suppkey").alias("item"))
    return ranking.merge_spaces(a.unionByName(b)).select("source", "rxn_id", "item", "merged_id")


@query("""WITH s AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS rxn_id, CAST(l_linenumber % 3 AS INTEGER) AS set_idx, CAST(CASE l_returnflag WHEN 'R' THEN 3 WHEN 'A' THEN 5 ELSE 6 END AS INTEGER) AS c FROM lineitem),
t AS (SELECT rxn_id, set_idx, count(DISTINCT c) AS kinds, min(c) AS c FROM s GROUP BY ALL),
b AS (SELECT rxn_id, set_idx, unnest(list_filter(range(0, 8), lambda i: (c >> CAST(i AS INTEGER)) & 1 = 1)) AS bit FROM t),
u AS (SELECT rxn_id, bit, count(*) AS sets FROM b GROUP BY ALL)
SELECT DISTINCT rxn_id, 'mixed connectors in a set' AS problem FROM t WHERE kinds > 1 UNION ALL
SELECT DISTINCT rxn_id, 'connector not on two sets' FROM u WHERE sets <> 2 UNION ALL
SELECT rxn_id, 'connectors not consecutive' FROM u GROUP BY rxn_id HAVING max(bit) + 1 <> count(*)""")
def validate_sets(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    c = F.when(F.col("l_returnflag") == "R", 3).when(F.col("l_returnflag") == "A", 5).otherwise(6)
    return ranking.validate(lines.select(F.col("l_orderkey").cast("string").alias("rxn_id"), (F.col("l_linenumber") % 3).cast("int").alias("set_idx"), c.alias("connectors")))


@query(f"""WITH {S}, n AS (SELECT rxn_id, set_idx, count(*) AS n FROM s GROUP BY ALL), l AS (SELECT rxn_id, 0.5 * sum(ln(n)) AS l FROM n GROUP BY rxn_id),
w AS (SELECT rxn_id, greatest(0.000001, exp(l - max(l) OVER ())) AS weight FROM l) SELECT rxn_id, round(weight, 9) AS weight FROM w""")
def reaction_weights(spark, sf_dir):
    n = synthons(spark, sf_dir).groupBy("rxn_id", "set_idx").agg(F.count("*").alias("n"))
    return sampling.reaction_weights(n).withColumn("weight", F.round("weight", 9))


def _bound(k: int, d: str) -> str:
    """SQL of the least (0) or most (1) distance compatible with ``d``."""
    return f"[{', '.join(str(pair[k]) for pair in scalars.DISTANCES)}][least({d}, {len(scalars.DISTANCES) - 1}) + 1]"


@query(f"""WITH {S}, d AS (SELECT frag_id, connectors, size, size % 9 AS d1, CAST(frag_id AS INTEGER) % 40 AS d2 FROM s),
q AS (SELECT rxn_id, set_idx, connectors, CAST(avg(size) AS INTEGER) AS m, CAST(max(CAST(frag_id AS INTEGER)) % 40 AS INTEGER) AS d FROM s GROUP BY ALL),
r AS (SELECT *, least(m - 4, CAST(floor(m * 0.75) AS INTEGER)) AS low, greatest(m + 4, CAST(ceil(m * 1.33) AS INTEGER)) AS high FROM q)
SELECT r.rxn_id AS query_rxn, r.set_idx AS query_set, d.frag_id FROM r JOIN d ON r.connectors = d.connectors AND d.size BETWEEN r.low AND r.high
AND d.d1 BETWEEN {_bound(0, "m % 9")} AND {_bound(1, "m % 9")} AND d.d2 BETWEEN {_bound(0, "d")} AND {_bound(1, "d")}""")
def topology_distance_join(spark, sf_dir):
    """Stand-in distances: the size modulo 9 and the part's number modulo 40."""
    number = F.col("frag_id").cast("int") % 40
    rows = synthons(spark, sf_dir).select("rxn_id", "set_idx", "frag_id", "connectors", "size", F.array(F.col("size") % 9, number).alias("dists"))
    q = rows.groupBy("rxn_id", "set_idx", "connectors").agg(F.rint(F.avg("size")).cast("int").alias("m"), (F.max(F.col("frag_id").cast("int")) % 40).alias("d"))
    low, high = scalars.size_range(F.col("m"))
    near = [scalars.distance_range(d) for d in (F.col("m") % 9, F.col("d"))]
    q = q.select(
        F.col("rxn_id").alias("query_rxn"), F.col("set_idx").alias("query_set"), "connectors", low.alias("low"), high.alias("high"),
        F.array(*[n[0] for n in near]).alias("dist_low"), F.array(*[n[1] for n in near]).alias("dist_high"),
    )
    return joins.topology_join(q, rows.drop("rxn_id", "set_idx")).select("query_rxn", "query_set", "frag_id")


@query(f"""WITH {FP}, g AS (SELECT vec_id // 4 AS quad, bit_and(a) AS a, bit_and(b) AS b FROM f GROUP BY ALL), q AS (SELECT vec_id, a & 1048577 AS a, b & 1 AS b FROM f WHERE vec_id % 100 = 0)
SELECT q.vec_id AS query_id, g.quad, (g.a & q.a) = q.a AND (g.b & q.b) = q.b AS all_superset FROM q, g""")
def group_all_supersets(spark, sf_dir):
    fps = fingerprints(spark, sf_dir)
    mask = F.array(F.lit(1048577).cast("long"), F.lit(1).cast("long"))
    q = _queries_of(fps).withColumn("q_fp", bits.intersection(F.col("q_fp"), mask))
    return joins.all_supersets(q, fps.withColumn("quad", F.floor(F.col("vec_id") / 4)), 2, "quad")


@query(f"""WITH {FP}, w AS (SELECT vec_id, 'first' AS descriptor, a AS x FROM f UNION ALL SELECT vec_id, 'second', b FROM f)
SELECT q.vec_id AS reference, r.vec_id AS item, q.descriptor, CASE WHEN (q.x | r.x) = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(bit_count(q.x & r.x) AS DOUBLE) / bit_count(q.x | r.x) END AS similarity
FROM w q JOIN w r ON q.descriptor = r.descriptor AND q.vec_id % 100 = 0""")
def descriptor_similarities(spark, sf_dir):
    fps = fingerprints(spark, sf_dir).select(F.col("vec_id").alias("item"), *[F.array(F.col("fp")[w]).alias(d) for w, d in enumerate(("first", "second"))])
    return joins.similarity_matrix(fps.where("item % 100 = 0"), fps, ("first", "second"), words=1)


@query(f"""WITH {S}, q AS (SELECT rxn_id, set_idx, connectors, CAST(avg(size) AS INTEGER) AS m FROM s GROUP BY ALL),
r AS (SELECT rxn_id, set_idx, connectors, least(m - 4, CAST(floor(m * 0.75) AS INTEGER)) AS low, greatest(m + 4, CAST(ceil(m * 1.33) AS INTEGER)) AS high FROM q)
SELECT r.rxn_id AS query_rxn, r.set_idx AS query_set, s.frag_id FROM r JOIN s ON r.connectors = s.connectors AND s.size BETWEEN r.low AND r.high""")
def topology_interval_join(spark, sf_dir):
    rows = synthons(spark, sf_dir).select("rxn_id", "set_idx", "frag_id", "connectors", "size", F.array().cast("array<int>").alias("dists"))
    q = rows.groupBy("rxn_id", "set_idx", "connectors").agg(F.rint(F.avg("size")).cast("int").alias("m"))
    low, high = scalars.size_range(F.col("m"))
    none = F.array().cast("array<int>")
    q = q.select(F.col("rxn_id").alias("query_rxn"), F.col("set_idx").alias("query_set"), "connectors", low.alias("low"), high.alias("high"), none.alias("dist_low"), none.alias("dist_high"))
    return joins.topology_join(q, rows.drop("rxn_id", "set_idx")).select("query_rxn", "query_set", "frag_id")


@query(f"""WITH {FP}, t AS (SELECT q.vec_id AS query_id, r.label, r.vec_id, CAST(bit_count(r.a) + bit_count(r.b) AS DOUBLE) AS size, CAST({SHARED} AS DOUBLE) / CAST({EITHER} AS DOUBLE) AS similarity FROM f q JOIN f r ON q.vec_id % 100 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY similarity DESC, vec_id) AS n FROM t)
SELECT query_id, round(sum(similarity * size * size) / sum(size * size), 9) AS score FROM k WHERE n <= 6 GROUP BY query_id""")
def assembly_score(spark, sf_dir):
    fps = fingerprints(spark, sf_dir)
    best = nearest.most_similar(_queries_of(fps), fps, 6, 2, by="label")
    return aggregates.assembly_score(best, "query_id").withColumn("score", F.round("score", 9))


@query()
def kcenters(spark, sf_dir):
    fps = fingerprints(spark, sf_dir).select(F.lit("all").alias("rxn_id"), F.coalesce("label", F.lit(-1)).alias("set_idx"), F.col("vec_id").alias("item"), "fp")
    return sampling.k_centers(fps, 0.5, 64, scale=2.0)


@query(f"""WITH {S}, k AS (SELECT rxn_id, set_idx, frag_id, row_number() OVER (PARTITION BY rxn_id, set_idx ORDER BY frag_id) - 1 AS k FROM s),
n AS (SELECT rxn_id, set_idx, count(*) AS n FROM s GROUP BY ALL), t AS (SELECT *, unnest(range(0, 20)) AS attempt FROM n),
c AS (SELECT rxn_id, set_idx, attempt, CAST(('0x' || substr(md5('7|' || rxn_id || '|' || set_idx || '|' || attempt), 1, 7)) AS BIGINT) % n AS k FROM t)
SELECT rxn_id, CAST(attempt AS INTEGER) AS attempt, set_idx, frag_id FROM c JOIN k USING (rxn_id, set_idx, k)""")
def seed_sampling(spark, sf_dir):
    return sampling.random_assemblies(synthons(spark, sf_dir).select("rxn_id", "set_idx", "frag_id"), 20, seed=7)


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    fps = fingerprints(spark, sf_dir).where("label is not null")
    return fps.select(F.concat(F.lit("r"), F.col("label").cast("string")).alias("rxn_id"), F.pmod("vec_id", F.lit(3)).cast("int").alias("set_idx"), F.col("vec_id").cast("string").alias("frag_id"), "fp")


@query()
def beam_search(spark, sf_dir):
    m = members(spark, sf_dir)
    picked = sampling.random_assemblies(m.select("rxn_id", "set_idx", "frag_id"), 2, seed=1)
    seeds = picked.groupBy("rxn_id", "attempt").agg(F.sort_array(F.collect_list(F.struct("set_idx", "frag_id"))).alias("f"))
    seeds = seeds.select(F.col("attempt").cast("long").alias("seed_id"), "rxn_id", F.transform("f", lambda x: x["frag_id"]).alias("frag_ids"))
    return sampling.beam_search(seeds, m, [0x0F0F0F0F, 0x00FF00FF])


@query("""SELECT event_type, count(value) FILTER (isfinite(value)) AS n, round(avg(value) FILTER (isfinite(value)), 6) AS mean, round(stddev_pop(value) FILTER (isfinite(value)), 6) AS sd,
min(value) FILTER (isfinite(value)) AS low, max(value) FILTER (isfinite(value)) AS high FROM events GROUP BY event_type""")
def metrics_moments(spark, sf_dir):
    out = aggregates.moments(table(spark, sf_dir, "events"), "value", "event_type")
    return out.withColumn("mean", F.round("mean", 6)).withColumn("sd", F.round("sd", 6))


@query("""SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY md5(text)""")
def dedup_exact(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("""SELECT doc_id, 'len=' || length(coalesce(text, '')) || ';words=' || len(list_filter(string_split(coalesce(text, ''), ' '), lambda x: x <> '')) AS tags FROM documents""")
def descriptor_augment(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    words = F.size(F.filter(F.split(text, " "), lambda x: x != ""))
    added = scalars.merge_descriptors(F.lit(None).cast("map<string,string>"), {"len": F.length(text), "words": words})
    docs = table(spark, sf_dir, "documents").select("doc_id", added.alias("a"))
    return docs.select("doc_id", F.concat(F.lit("len="), F.col("a")["len"], F.lit(";words="), F.col("a")["words"]).alias("tags"))


@query(r"""SELECT page_id, coalesce(TRY_CAST(trim(url) AS INTEGER), TRY_CAST(nullif(regexp_extract(url, '([0-9]+)[^0-9]*$', 1), '') AS INTEGER)) AS set_idx,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^.*/', ''), '\.[^.]*$', ''), '_synthons?$', ''), '_[0-9]+$', '') AS stem FROM pages""")
def lenient_parse(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.lenient_index(F.col("url")).alias("set_idx"), scalars.file_reaction(F.col("url")).alias("stem"))


@query("""SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
WHERE contains(lower(concat_ws('|', CAST(c_custkey AS VARCHAR), c_name, CAST(c_nationkey AS VARCHAR), c_mktsegment)), 'build')""")
def substring_any_column(spark, sf_dir):
    return ranking.contains_anywhere(table(spark, sf_dir, "customer"), "BUILD")


@query()
def screening_pipeline(spark, sf_dir):
    from tessella.streaming.screening import screen_batch

    return screen_batch(members(spark, sf_dir), [0x0F0F0F0F, 0x00FF00FF], jobs=40, threshold=0.1)


@query("""SELECT user_id, event_type, min(ts) AS first_ts, count(*) AS n FROM events GROUP BY user_id, event_type""")
def stream_dedup(spark, sf_dir):
    from tessella.streaming.screening import first_events

    return first_events(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)


@query(f"WITH {S}, c AS (SELECT rxn_id, set_idx, min(connectors) AS c FROM s GROUP BY ALL), g AS (SELECT rxn_id, string_agg(lpad(format('{{:b}}', c), 8, '0'), ';' ORDER BY lpad(format('{{:b}}', c), 8, '0')) AS config FROM c GROUP BY rxn_id) SELECT config, count(*) AS reactions FROM g GROUP BY config")
def connector_configs(spark, sf_dir):
    return aggregates.connector_configs(synthons(spark, sf_dir))


@query(f"WITH {FP} SELECT label, bit_or(a) AS any_a, bit_or(b) AS any_b, bit_and(a) AS all_a, bit_and(b) AS all_b FROM f GROUP BY label")
def group_bits(spark, sf_dir):
    g = aggregates.group_bits(fingerprints(spark, sf_dir), 2, "label")
    return g.select("label", *[F.col(f"{k}_bits")[w].alias(f"{k}_{'ab'[w]}") for k in ("any", "all") for w in (0, 1)])


@query(f"WITH {FP} SELECT vec_id, array_to_string(list_transform(range(0, 32), lambda i: CAST((a >> CAST(i AS INTEGER)) & 1 AS VARCHAR)), '') || array_to_string(list_transform(range(0, 32), lambda i: CAST((b >> CAST(i AS INTEGER)) & 1 AS VARCHAR)), '') AS bit_string FROM f")
def bit_strings(spark, sf_dir):
    return fingerprints(spark, sf_dir).select("vec_id", bits.to_bit_string(F.col("fp")).alias("bit_string"))


@query(f"""WITH {S}, c AS (SELECT p_type, set_idx, count(*) AS n FROM s GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY n DESC, set_idx) AS r FROM c)
SELECT s.frag_id, s.p_type, s.set_idx FROM s JOIN k USING (p_type, set_idx) WHERE r = 1""")
def largest_group(spark, sf_dir):
    return ranking.largest_group(synthons(spark, sf_dir), "p_type", "set_idx").select("frag_id", "p_type", "set_idx")


@query(f"""WITH {S}, a AS (SELECT rxn_id, frag_id AS x FROM s WHERE set_idx = 0), b AS (SELECT rxn_id, frag_id AS y FROM s WHERE set_idx = 1)
SELECT rxn_id, CAST(0 AS INTEGER) AS set_idx, count(*) AS n, min(x || ':::' || y) AS first_id FROM a JOIN b USING (rxn_id) GROUP BY rxn_id
UNION ALL SELECT rxn_id, set_idx, count(*), min(frag_id) FROM s WHERE set_idx = 2 GROUP BY rxn_id, set_idx""")
def merge_sets(spark, sf_dir):
    """The pairs are counted and their first is found, not listed."""
    return ranking.merged_summary(synthons(spark, sf_dir), 0, 1)


@query(f"""WITH {S}, k AS (SELECT * FROM s WHERE size <= 40), e AS (SELECT DISTINCT rxn_id FROM (SELECT DISTINCT rxn_id, set_idx FROM s EXCEPT SELECT DISTINCT rxn_id, set_idx FROM k))
SELECT rxn_id, set_idx, frag_id FROM k WHERE rxn_id NOT IN (SELECT rxn_id FROM e)""")
def size_filter(spark, sf_dir):
    rows = synthons(spark, sf_dir)
    return ranking.max_size(rows, F.col("size"), 40).select("rxn_id", "set_idx", "frag_id")


@query(f"""WITH {S}, w AS (SELECT rxn_id, CAST(count(*) AS DOUBLE) AS weight FROM s GROUP BY rxn_id)
SELECT rxn_id, weight, round(sum(weight) OVER (ORDER BY rxn_id) / sum(weight) OVER (), 9) AS share FROM w""")
def running_shares(spark, sf_dir):
    w = synthons(spark, sf_dir).groupBy("rxn_id").agg(F.count("*").cast("double").alias("weight"))
    out = ranking.running_share(w.withColumn("one", F.lit(1)), "weight", ["rxn_id"], ["one"])  # one row for each reaction
    return out.select("rxn_id", "weight", F.round("share", 9).alias("share"))


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def windowed_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
