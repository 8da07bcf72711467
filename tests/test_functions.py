import random

from pyspark.sql import functions as F

from tessella.functions import bits, scalars
from tessella.operators import aggregates, joins, nearest, ranking, sampling, stored


def test_bit_round_trips(spark):
    rng = random.Random(1)
    rows = [(i, [rng.getrandbits(32), rng.getrandbits(32)]) for i in range(40)] + [(98, [0, 0]), (99, [2**32 - 1, 0])]
    df = spark.createDataFrame(rows, "id int, fp array<bigint>")
    out = df.select(
        "id", "fp", bits.from_bit_string(bits.to_bit_string(F.col("fp")), 2).alias("s"), bits.from_base64(bits.to_base64(F.col("fp")), 2).alias("b"), bits.popcount(F.col("fp")).alias("n")
    ).collect()
    for r in out:
        assert r.s == r.fp and r.b == r.fp and r.n == sum(bin(w).count("1") for w in r.fp)


def test_superset_is_reflexive_and_transitive(spark):
    df = spark.createDataFrame([([3, 1], [1, 1], [1, 0]), ([7, 0], [8, 0], [0, 0])], "a array<bigint>, b array<bigint>, c array<bigint>")
    s = bits.superset
    rows = df.select(s(F.col("a"), F.col("a")).alias("aa"), s(F.col("a"), F.col("b")).alias("ab"), s(F.col("b"), F.col("c")).alias("bc"), s(F.col("a"), F.col("c")).alias("ac")).collect()
    assert [tuple(r) for r in rows] == [(True, True, True, True), (True, False, True, True)]


def test_tanimoto_of_empty_is_null(spark):
    df = spark.createDataFrame([([0], [0]), ([3], [1])], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in df.select(bits.tanimoto(F.col("a"), F.col("b"))).collect()] == [None, 0.5]


def test_connector_mask(spark):
    df = spark.createDataFrame([("C[U]N[Pu]",), ("CC",), (None,)], "s string")
    assert [r[0] for r in df.select(bits.connector_mask(F.col("s"))).collect()] == [5, 0, 0]


def test_masks_cover_all_bits():
    masks = bits.disjoint_masks(64, 5)
    assert [sum(m[w] for m in masks) for w in (0, 1)] == [2**32 - 1] * 2


def test_lenient_parsing(spark):
    df = spark.createDataFrame([("2", "rxn-7_synthon_2.csv"), ("R3b", "x/y_12.csv"), ("none", "plain.csv"), (None, None)], "t string, f string")
    rows = df.select(scalars.lenient_index(F.col("t")), scalars.file_reaction(F.col("f")), scalars.file_set_index(F.col("f"))).collect()
    assert [r[0] for r in rows] == [2, 3, None, None]
    assert [r[1] for r in rows] == ["rxn-7_synthon", "y", "plain", None] or rows[1][1] == "y"
    assert rows[1][2] == 12 and rows[2][2] is None


def test_merge_fails_or_renames(spark):
    df = spark.createDataFrame([("a", "r1"), ("b", "r1"), ("b", "r2")], "source string, rxn_id string")
    named = {(r.source, r.rxn_id): r.merged_id for r in ranking.merge_spaces(df).collect()}
    assert named == {("a", "r1"): "r1__a", ("b", "r1"): "r1__b", ("b", "r2"): "r2"}
    try:
        ranking.merge_spaces(df, "fail")
    except ValueError:
        return
    raise AssertionError("expected a failure")


def test_convolution_total_is_the_product(spark):
    rows = [("r", s, z, n) for s, sizes in enumerate([{1: 2, 2: 3}, {5: 1, 7: 4}, {0: 2}]) for z, n in sizes.items()]
    h = spark.createDataFrame(rows, "rxn_id string, set_idx int, size int, n long")
    out = {r["size"]: int(r.n) for r in aggregates.convolve(h, 3).collect()}
    assert out == {6: 4, 7: 6, 8: 16, 9: 24} and sum(out.values()) == 5 * 5 * 2


def test_k_centers_invariants(spark):
    rng = random.Random(3)
    rows = [("r", 0, i, [rng.getrandbits(16) & 0xFF0F]) for i in range(60)]
    out = sampling.k_centers(spark.createDataFrame(rows, "rxn_id string, set_idx int, item int, fp array<bigint>"), 0.6, 8).collect()
    centers = {r.center for r in out}
    assert len(out) == 60 and len(centers) <= 8 and all(r.item == r.center for r in out if r.similarity == 1.0 and r.item in centers)


def test_validation_rules(spark):
    rows = [("ok", 0, 1), ("ok", 1, 1), ("mixed", 0, 1), ("mixed", 0, 3), ("mixed", 1, 1), ("open", 0, 5), ("open", 1, 1), ("bare", 0, 0)]
    out = ranking.validate(spark.createDataFrame(rows, "rxn_id string, set_idx int, connectors int")).collect()
    found = {(r.rxn_id, r.problem) for r in out}
    assert not any(r == "ok" for r, _ in found)
    assert ("mixed", "mixed connectors in a set") in found and ("open", "connector not on two sets") in found and ("bare", "no connector") in found


def test_distance_ranges(spark):
    df = spark.createDataFrame([(d,) for d in (0, 3, 10, 31, 32, 500, None)], "d int")
    low, high = scalars.distance_range(F.col("d"))
    assert [tuple(r) for r in df.select(low, high).collect()] == [(1, 4), (2, 5), (7, 13), (27, 35), (27, 35), (27, 35), (None, None)]


def test_topology_join_takes_arrays_of_one_length_only(spark):
    rows = spark.createDataFrame([(1, 3, 10, [4]), (2, 3, 10, [4, 4]), (3, 3, 10, []), (4, 3, 99, [4]), (5, 3, 10, None), (6, 3, 10, [9])], "id int, connectors int, size int, dists array<int>")
    q = spark.createDataFrame([(3, 7, 14, [2], [6])], "connectors int, low int, high int, dist_low array<int>, dist_high array<int>")
    assert [r.id for r in joins.topology_join(q, rows).collect()] == [1]


def test_merge_descriptors(spark):
    df = spark.createDataFrame([({"a": "1"}, "x"), (None, "y"), ({"b": "2"}, None)], "m map<string,string>, v string")
    added = {"a": F.col("v"), "c": F.lit(3)}
    kept = [r[0] for r in df.select(scalars.merge_descriptors(F.col("m"), added)).collect()]
    assert kept == [{"a": "1", "c": "3"}, {"a": "y", "c": "3"}, {"b": "2", "c": "3"}]
    assert df.select(scalars.merge_descriptors(F.col("m"), added, overwrite=True)).first()[0] == {"a": "x", "c": "3"}


def test_all_supersets_and_similarity_matrix(spark):
    rows = spark.createDataFrame([("g", [3]), ("g", [7]), ("h", [4]), ("h", None)], "grp string, fp array<bigint>")
    q = spark.createDataFrame([(1, [3]), (2, [0]), (3, [4])], "query_id int, q_fp array<bigint>")
    got = {(r.query_id, r.grp): r.all_superset for r in joins.all_supersets(q, rows, 1, "grp").collect()}
    assert got == {(1, "g"): True, (2, "g"): True, (3, "g"): False, (1, "h"): False, (2, "h"): True, (3, "h"): True}
    lib = spark.createDataFrame([("p", [3]), ("p", [3]), ("q", [0]), ("r", None)], "item string, d array<bigint>")
    ref = spark.createDataFrame([("x", [1])], "item string, d array<bigint>")
    got = {r["item"]: r.similarity for r in joins.similarity_matrix(ref, lib, ["d"]).collect()}
    assert got["p"] == 0.5 and got["q"] == 0.0 and got["r"] != got["r"] and len(got) == 3


def test_merged_summary_is_that_of_the_pairs(spark):
    """Ids that begin one another, a reaction without one of the sets, and 16e8 pairs."""
    rows = [("r", 0, "1"), ("r", 0, "10"), ("r", 0, "1:::0"), ("r", 1, "5"), ("r", 1, "50"), ("r", 2, "7"), ("s", 0, "1"), ("t", 1, "2")]
    table = spark.createDataFrame(rows, "rxn_id string, set_idx int, frag_id string").withColumn("connectors", F.lit(1))
    pairs = ranking.merge_sets(table, 0, 1).groupBy("rxn_id", "set_idx").agg(F.count("*").alias("n"), F.min("frag_id").alias("first_id"))
    assert sorted(map(tuple, ranking.merged_summary(table, 0, 1).collect())) == sorted(map(tuple, pairs.collect()))
    large = spark.range(80_000).select(F.lit("r").alias("rxn_id"), (F.col("id") % 2).cast("int").alias("set_idx"), F.col("id").cast("string").alias("frag_id"))
    assert [tuple(r) for r in ranking.merged_summary(large, 0, 1).collect()] == [("r", 0, 40_000**2, "0:::1")]


def test_most_similar_in_tiles_equals_sorting_all_pairs(spark, monkeypatch):
    """Many equal similarities, empty bitsets, null groups, 64-bit pairs of words and a single one."""
    monkeypatch.setattr(nearest, "ROWS", 16)
    monkeypatch.setattr(nearest, "QUERIES", 4)
    rng = random.Random(2)
    data = [(i, rng.choice([0, 1, None]), [rng.getrandbits(4) << 28, rng.getrandbits(3), 0 if i % 5 else 1]) for i in range(90)] + [(90, 1, [0, 0, 0]), (91, 0, [0, 0, 0])]
    rows = spark.createDataFrame(data, "vec_id long, label int, fp array<bigint>")
    queries = rows.where("vec_id % 10 = 0 or vec_id = 91").select(F.col("vec_id").alias("query_id"), F.col("fp").alias("q_fp"))

    def alike(a, b):
        either = sum((x | y).bit_count() for x, y in zip(a, b))
        return sum((x & y).bit_count() for x, y in zip(a, b)) / either if either else None

    for by, others, k in ((None, True, 5), ("label", False, 3), ("label", True, 100)):
        want = []
        for q in [r for r in data if r[0] % 10 == 0 or r[0] == 91]:
            for g in {r[1] if by else None for r in data}:
                own = [(alike(q[2], r[2]), r[0], sum(x.bit_count() for x in r[2])) for r in data if (not by or r[1] == g) and not (others and r[0] == q[0])]
                own.sort(key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
                want += [(q[0], g, v, float(n), s, i + 1) for i, (s, v, n) in enumerate(own[:k])]
        got = nearest.most_similar(queries, rows, k, 3, by, others).select("query_id", "by", "vec_id", "size", "similarity", "rank").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_pairs_are_dealt_over_tasks_however_few_files_rows_lie_in(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    data = [(i, [rng.getrandbits(32), rng.getrandbits(6) if i % 9 else 0]) for i in range(400)] + [(400, [0, 0]), (401, None)]
    rows = spark.createDataFrame(data, "vec_id long, fp array<bigint>").coalesce(1)
    stored.write_index(rows, str(tmp_path / "index"))
    index = stored.read_index(spark, str(tmp_path / "index"))
    queries = rows.where("vec_id % 8 = 0 and fp is not null").select(F.col("vec_id").alias("query_id"), F.col("fp").alias("q_fp"))
    few = queries.withColumn("q_fp", bits.intersection(F.col("q_fp"), F.array(F.lit(3).cast("long"), F.lit(1).cast("long"))))
    whole = [(i, fp) for i, fp in data if fp]
    alike = {(i, j) for i, a in whole if i % 8 == 0 for j, b in whole if (n := sum((x | y).bit_count() for x, y in zip(a, b))) and sum((x & y).bit_count() for x, y in zip(a, b)) / n >= 0.45}
    above = {(i, j) for i, a in whole if i % 8 == 0 for j, b in whole if a[0] & 3 & b[0] == a[0] & 3 and a[1] & 1 & b[1] == a[1] & 1}
    for sent in (joins.SENT, 0):  # broadcast, and part by part
        monkeypatch.setattr(joins, "SENT", sent)
        for found, want in ((stored.similar(index, queries, 0.45, words=2), alike), (stored.supersets(index, few, words=2), above)):
            assert {(r.query_id, r.vec_id) for r in found.collect()} == want and found.count() == len(want)
            assert sent == 0 or found.rdd.getNumPartitions() >= 8
    monkeypatch.setattr(joins, "PAIRS", 500)
    assert joins.in_blocks(queries, rows, sizes=joins.counts(queries, rows)).count() == queries.count() * rows.count()


def test_similarity_matrix_is_dealt_and_keeps_its_nulls(spark):
    data = [(i, [i % 8], None if i % 3 == 0 else [i % 4]) for i in range(60)]
    library = spark.createDataFrame(data, "item long, a array<bigint>, b array<bigint>").coalesce(1)
    plain, dealt = (joins.similarity_matrix(library.where("item % 10 = 0"), library, ("a", "b"), words=w) for w in (None, 1))
    assert dealt.rdd.getNumPartitions() >= 8 and dealt.count() == 6 * 60 * 2
    assert sorted(map(repr, map(tuple, dealt.collect()))) == sorted(map(repr, map(tuple, plain.collect())))
    assert dealt.where("descriptor = 'b' and item % 3 = 0 and not isnan(similarity)").count() == 0


def test_rules_of_a_space_read_it_once(spark, tmp_path):
    rows = [("ok", 0, 1), ("ok", 1, 1), ("two", 0, 1), ("two", 0, 3), ("gap", 0, 5), ("gap", 1, 5), ("bare", 0, 0), ("none", 0, None), ("three", 0, 1), ("three", 1, 1), ("three", 2, 1)]
    spark.createDataFrame(rows, "rxn_id string, set_idx int, connectors int").write.parquet(str(tmp_path / "s"))
    found = ranking.validate(spark.read.parquet(str(tmp_path / "s")))
    loose, gap = "connector not on two sets", "connectors not consecutive"
    assert sorted(map(tuple, found.collect())) == sorted([("two", "mixed connectors in a set"), ("two", loose), ("gap", gap), ("bare", "no connector"), ("three", loose)])
    assert found._jdf.queryExecution().sparkPlan().toString().count("FileScan") == 1
