"""Every query of the catalogue against its DuckDB counterpart on the smallest tables."""

import datetime

import duckdb
import pytest

from tessella.plans import catalogue, rules, structures  # noqa: F401  (they register queries)

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(rows):
    def one(x):
        if isinstance(x, float):
            return float(f"{x:.9g}")
        return x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x

    return sorted(repr(tuple(one(x) for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_oracle(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    result = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in result.fetchall()]
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_rows_only(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_pigeonhole_equals_scan(spark):
    """The bucket join finds exactly what the scan finds."""
    from pyspark.sql import functions as F

    from tessella.functions import bits
    from tessella.operators import joins

    fps = catalogue.fingerprints(spark, DATA)
    a = fps.select(F.col("vec_id").alias("query_id"), "fp")
    b = fps.select(F.col("vec_id").alias("row_id"), "fp")
    near = {tuple(r) for r in joins.hamming_join(a, b, 12, 64).collect()}
    pairs = a.select("query_id", F.col("fp").alias("q_fp")).crossJoin(b).select("query_id", "row_id", bits.hamming(F.col("q_fp"), F.col("fp")).alias("d")).where("d <= 12")
    assert near == {tuple(r) for r in pairs.collect()}
