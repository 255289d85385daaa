"""Stored sketches beyond their exact range, and the table function's contract."""

import pytest
from pyspark.sql import functions as F

from factlattice.functions import tables
from factlattice.operators import sketches


def test_sketches_merge_and_keep_their_error(spark, tmp_path):
    path = f"file://{tmp_path}/sketches"
    rows = spark.range(60_000).select((F.col("id") % 6).alias("day"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), (F.col("id") % 30_000).alias("who"), F.col("id").cast("double").alias("v"))
    sketches.add(rows.filter("id < 30000"), path, "day", ["g"], "who", "v", 1)
    for _ in range(2):  # the second batch done again counts once
        sketches.add(rows.filter("id >= 30000"), path, "day", ["g"], "who", "v", 2)
    stored = spark.read.parquet(path)
    assert stored.count() == 12
    got = {r.g: r for r in sketches.over(stored, ["g"]).collect()}
    for g, middle in (("a", 29_999), ("b", 30_000)):
        assert got[g].n == 30_000 and abs(got[g].distinct - 15_000) < 15_000 * 0.03 and abs(got[g].quantile - middle) < 60_000 * 0.01
    merged = sketches.over(stored.filter("day < 2"), [F.lit(1).alias("k"), "g"])
    assert sketches.shared(merged, ["k"], "g", "a", "b").first().shared == 0


@pytest.mark.parametrize("lg_k", [6, 14])
def test_sketches_settled_by_rows_are_exact(spark, lg_k):
    """With sketches of 64 values both counts would be estimates; so would the median with one of 8."""
    rows = spark.range(20_000).select((F.col("id") % 3).alias("day"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"), F.expr("nullif(id % 2001, 7)").alias("who"), F.expr("nullif(double(id * 7919 % 10007), 5)").alias("v"))
    k = 8 if lg_k == 6 else 8192
    keyed = [df.withColumn("k", F.col("day") % 2) for df in (sketches.daily(rows, "day", ["g"], "who", "v", lg_k, k), rows)]
    got = {(r.k, r.g): (r.n, r.distinct, r.quantile) for r in sketches.settled(*keyed, ["k", "g"], "who", "v", lg_k=lg_k, k=k).collect()}
    users, values = {}, {}
    for i in range(20_000):
        key = (i % 3 % 2, "ab"[i % 2])
        users.setdefault(key, set()).add(i % 2001)
        values.setdefault(key, []).append(i * 7919 % 10007)
    for key, v in values.items():
        known = sorted(x for x in v if x != 5)
        assert got[key] == (len(v), len(users[key] - {7}), known[-(-len(known) // 2) - 1])
    merged = sketches.over(keyed[0], ["k", "g"], lg_k=lg_k, k=k)
    both = {r.k: r.shared for r in sketches.settled_shared(merged, keyed[1], ["k"], "g", "a", "b", "who", lg_k).collect()}
    assert both == {k: len((users[k, "a"] & users[k, "b"]) - {7}) for k in (0, 1)}
    apart = [df.filter("day = 0 AND g = 'a' OR day = 1 AND g = 'b'").withColumn("k", F.lit(1)) for df in (keyed[0], keyed[1].filter("who < 1"))]
    assert sketches.settled_shared(sketches.over(apart[0].filter("g = 'a'"), ["k", "g"], lg_k=lg_k, k=k), apart[1], ["k"], "g", "a", "b", "who", lg_k).count() == 0


def test_table_function(spark):
    tables.register(spark)
    rows = spark.createDataFrame([("x", 2, "the THE"), ("x", 1, None), ("x", 3, "the"), (None, 1, "a the"), ("y", 1, "none")], "k string, turn int, text string")
    rows.createOrReplaceTempView("rows")
    got = spark.sql("SELECT * FROM term_turns(TABLE(SELECT k, turn, text FROM rows) PARTITION BY k ORDER BY (turn), 'the,zz')")
    assert got.columns == ["k", "term", "first_turn", "turns", "hits"] and sorted(map(tuple, got.collect()), key=str) == [("x", "the", 2, 2, 3), (None, "the", 1, 1, 1)]
    with pytest.raises(Exception, match="turn and text"):
        spark.sql("SELECT * FROM term_turns(TABLE(SELECT k FROM rows) PARTITION BY (k), 'the')").collect()
