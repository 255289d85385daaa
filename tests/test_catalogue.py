"""Each query against its SQL on the smallest tables, and the status lattice by brute force."""

import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from factlattice.functions import status as st
from factlattice.operators import relational as rel
from factlattice.plans import domain as catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(con.execute(catalogue.ORACLE[name]).fetchdf())


def test_lattice_is_a_join(spark):
    def join(names):
        if "PRESENT_AND_FUTURE" in names or {"PRESENT", "FUTURE"} <= set(names):
            return "PRESENT_AND_FUTURE"
        return max(names, key=["PAST", "OFFSITE", "FUTURE", "PRESENT"].index)

    cases = [c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(st.BITS, n)]
    df = spark.createDataFrame([(i, s) for i, c in enumerate(cases) for s in c], "k int, s string")
    got = {r.k: r.s for r in df.groupBy("k").agg(st.merge(F.col("s")).alias("s")).collect()}
    assert got == {i: join(c) for i, c in enumerate(cases)}


def test_parse_status(spark):
    df = spark.createDataFrame([(" present ",), ("0",), ("0.0",), ("nan",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(st.parse(F.col("s"))).collect()] == ["PRESENT", None, None, None, None, None]
    with pytest.raises(Exception, match="unknown status"):
        spark.createDataFrame([("MAYBE",)], "s string").select(st.parse(F.col("s"))).collect()


def test_strict_lookup_raises(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    with pytest.raises(Exception, match="unknown key"):
        rel.strict_lookup(a, b, "k", "v", "w").collect()


def test_first_present_takes_columns_apart(spark):
    df = spark.createDataFrame([(1, 0, None, "a"), (1, 1, "x", "b"), (1, 2, "y", None)], "k int, o int, p string, q string")
    assert [tuple(r) for r in rel.first_present(df, ["k"], ["p", "q"], "o").collect()] == [(1, "x", "a")]


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
