"""Stages and the whole pipeline on the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_stages_have_their_effects(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(10**9, "1234 --", "en", "s", 7), (10**9 + 1, None, None, None, None), (10**9 + 2, "", "en", "s", 0)], docs.schema)
    docs = docs.unionByName(odd).withColumn("t1", F.lit("clash"))
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        if name != "packing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert now <= ids
        if name == "language_id":
            assert ids - now == {10**9, 10**9 + 1, 10**9 + 2}
        if name == "near_dedup":
            assert docs.select("text").distinct().count() == docs.count() < before.count()
        if name == "pii":
            assert docs.where(F.col("text").rlike(r"[a-z]@mail[0-9]")).count() == 0 and docs.where("text like '%[EMAIL]%'").count() > 0
        ids = now
    used = docs.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert used <= 2048


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b, z = (" ".join(f"{k}{i}" for i in range(30)) for k in "abz")
    rows = [(3, b), (5, a), (5, b), (None, b), (None, z), (5, a), (None, z), (7, ""), (7, ""), (None, None), (8, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, t1 int")
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DATA).collect()), key=repr)
    assert kept == sorted([(3, b), (5, a), (None, z), (7, ""), (None, None), (8, None)], key=repr)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and out.where("offset + length > 2048").count() == 0


def test_entry_module_without_the_operators(monkeypatch):
    import builtins
    import importlib
    import sys

    for m in [m for m in sys.modules if m.startswith(("tessella.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, m)
    real = builtins.__import__

    def gone(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith("tessella.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name="tessella.llm")
        return real(name, globals, locals, fromlist, level)

    monkeypatch.setattr(builtins, "__import__", gone)
    entry = importlib.import_module("__spark_entry__")
    assert entry.queries() and not any(q.startswith("op") or q == "pipeline" for q in entry.queries())
