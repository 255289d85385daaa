"""Readers and text functions on small cases."""

from pyspark.sql import functions as F

from factlattice.functions import text as tx
from factlattice.sources import tables


def test_csv_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n007,NA\n08,""\n9,"x, ""y"""\n')
    path = f"file://{tmp_path}/a.csv"
    assert sorted(map(tuple, tables.read_csv(spark, path).collect())) == [("007", None), ("08", None), ("9", 'x, "y"')]
    assert sorted(map(tuple, tables.read_csv(spark, path, na=()).collect())) == [("007", "NA"), ("08", ""), ("9", 'x, "y"')]


def test_texts_by_stem(spark, tmp_path):
    (tmp_path / "a.b.txt").write_text("one\ntwo")
    assert [tuple(r) for r in tables.read_texts(spark, f"file://{tmp_path}").collect()] == [("a.b", "one\ntwo")]


def test_normalisation(spark):
    df = spark.createDataFrame([(" \ufb01\u200bne\u00a0\u00a0 Day ",), (None,), ("",)], "s string")
    assert [r[0] for r in df.select(tx.normalised(F.col("s"), lower=True)).collect()] == ["fine day", None, ""]


def test_ids(spark):
    df = spark.createDataFrame([("12.0",), ("123456789012",), ("x",), (None,)], "s string")
    got = df.select(tx.plain_id(F.col("s")), tx.one_zero(F.col("s"), 5), tx.zero_filled(F.col("s"), 5)).collect()
    assert [tuple(r) for r in got] == [("12", "012.0", "00012"), ("123456789012", "123456789012", "123456789012"), ("x", "0x", None), (None, None, None)]
