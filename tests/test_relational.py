import math
import random

import pytest
from pyspark.sql import functions as F

from factlattice.operators import relational as rel


def test_ancestors_of_a_long_chain_and_of_a_cycle(spark):
    chain = [(i, i + 1) for i in range(40)]
    got = rel.ancestors(spark.createDataFrame([*chain, (0, 5)], "c int, p int"), "c", "p").collect()
    assert len(got) == 41 * 42 // 2 and {(r.node, r.ancestor) for r in got} == {(i, j) for i in range(41) for j in range(i, 41)}
    with pytest.raises(ValueError):
        rel.ancestors(spark.createDataFrame([(1, 2), (2, 3), (3, 2)], "c int, p int"), "c", "p")


def test_nearest_by_brute_force(spark):
    """Ties, equal vectors, and vectors that take no part, over several tasks and blocks of queries."""
    rng = random.Random(3)
    vectors = [[float(rng.randint(-2, 2)) for _ in range(3)] for _ in range(120)] + [None, [0.0] * 3, [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [1.0, 2.0]]
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, vec array<double>").repartition(5)
    got = {}
    for r in rel.nearest(rows.filter("id % 9 = 0"), rows, 4, block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.row_id, r.score))
    good = {i: v for i, v in enumerate(vectors) if v and len(v) == 3 and all(x is not None and x == x for x in v) and any(v)}
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    assert got.keys() == {i for i in good if i % 9 == 0}
    for i, found in got.items():
        scores = sorted((cosine(good[i], v) for j, v in good.items() if j != i), reverse=True)[:4]
        assert [r for r, _, _ in sorted(found)] == [1, 2, 3, 4] and all(math.isclose(s, w, abs_tol=1e-9) for (_, _, s), w in zip(sorted(found), scores))
        assert all(math.isclose(s, cosine(good[i], good[j]), abs_tol=1e-9) for _, j, s in found)
    assert rel.nearest(rows.limit(0), rows, 4).count() == 0


def test_reranking_orders_survivors_alone(spark):
    found = spark.createDataFrame([(1, 1, 10, 0.9, 0.1), (1, 2, 11, 0.8, 0.5), (1, 3, 12, 0.7, None), (1, 4, 13, 0.6, 0.5)], "query_id int, rank int, row_id int, score double, other double")
    got = [(r["rank"], r.row_id, r.first_rank) for r in rel.reranked(found, F.col("other"), 3).orderBy("rank").collect()]
    assert got == [(1, 11, 2), (2, 13, 4), (3, 10, 1)]


def test_containment_by_brute_force(spark):
    rng = random.Random(4)
    some = lambda n: "".join(rng.choice("abé") for _ in range(n))
    left = [(i, rng.choice([some(rng.randint(0, 3)), some(rng.randint(3, 9))])) for i in range(80)] + [(80, None), (81, "")]
    right = [(i, rng.choice([some(rng.randint(0, 2)), some(rng.randint(4, 12))])) for i in range(60)] + [(60, None)]
    out = rel.containing(spark.createDataFrame(left, "a int, t string"), "a", "t", spark.createDataFrame(right, "b int, u string"), "b", "u")
    got = [tuple(r) for r in out.collect()]
    want = {(i, j) for i, t in left for j, u in right if t is not None and u is not None and (t in u or u in t)}
    assert len(got) == len(set(got)) and set(got) == want
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_totals_inside_ranges_by_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.choice([1, 2, None]), rng.choice([None, *range(-40, 40)]), float(rng.randint(0, 9))) for _ in range(300)]
    ranges = [(i // 2, rng.choice([1, 2, 3, None]), low, None if i == 7 else low + rng.choice([-3, 0, 1, 2, 7, 8, 33, 70])) for i, low in enumerate(rng.randint(-45, 45) for _ in range(120))]
    p, r = spark.createDataFrame(points, "k int, at int, v double"), spark.createDataFrame(ranges, "id int, k int, low int, high int")
    totals = {"n": (F.count(F.lit(1)), F.sum), "v": (F.sum("v"), F.sum), "first": (F.min("at"), F.min)}
    got = {row.id: (row.n, row.v, row.first) for row in rel.totals_inside(p, r, ["k"], "at", "low", "high", ["id"], totals).collect()}
    want = {}
    for i, k, low, high in ranges:
        for kp, at, v in points:
            if high is not None and at is not None and k is not None and k == kp and low <= at < high:
                n, total, first = want.get(i, (0, 0.0, at))
                want[i] = (n + 1, total + v, min(first, at))
    assert got == want
    assert rel.totals_inside(p, r.limit(0), ["k"], "at", "low", "high", ["id"], totals).count() == 0


def test_totals_inside_forms_no_pairs(spark):
    """20,000 points and as many ranges over the same places: 400 million pairs, but few blocks."""
    same = spark.range(20_000)
    p, r = same.select(F.lit(1).alias("k"), (F.col("id") % 40).alias("at")), same.select("id", F.lit(1).alias("k"), F.lit(0).alias("low"), F.lit(40).alias("high"))
    out = rel.totals_inside(p, r, ["k"], "at", "low", "high", ["id"], {"n": (F.count(F.lit(1)), F.sum)})
    assert out.agg(F.count(F.lit(1)), F.sum("n")).first()[:] == (20_000, 400_000_000)
    assert [tuple(b) for b in r.limit(1).select(F.explode(rel._blocks(F.col("low").cast("long"), F.col("high").cast("long"), range(6))).alias("b")).select("b.*").collect()] == [(3, 4), (5, 0)]


def test_containment_within_groups_by_brute_force(spark):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abé") for _ in range(n))
    rows = [(i, rng.choice([1, 2, None]), rng.choice(["x", "y"]), rng.choice([None, "", some(2), some(3), some(rng.randint(3, 7))])) for i in range(150)]
    df = spark.createDataFrame(rows, "a int, g int, h string, t string")
    got = [tuple(r) for r in rel.containing(df, "a", "t", df.withColumnRenamed("a", "b"), "b", "t", ["g", "h"]).collect()]
    want = {(i, j) for i, g, h, t in rows for j, g2, h2, u in rows if g is not None and (g, h) == (g2, h2) and t is not None and u is not None and (t in u or u in t)}
    assert len(got) == len(set(got)) and set(got) == want


def test_containment_join_with_many_parts_of_a_name(spark, tmp_path):
    """Names are compared once, not once for each pair of parts: the plan's joins meet by names."""
    from factlattice.plans import catalogue

    rows = [(i, None if i == 9 else "b", i % 2, ["red bolt", "bolt", "red", None][i % 4]) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    out = catalogue.QUERIES["containment_join"](spark, str(tmp_path))
    want = {(i, j) for i, g, h, t in rows for j, g2, h2, u in rows if i < j and g and (g, h) == (g2, h2) and t and u and (t in u or u in t)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "contains(" not in out._jdf.queryExecution().optimizedPlan().toString().lower()  # no pair of parts is tested


def test_containment_join_with_sizes_that_are_no_numbers(spark, tmp_path):
    """NaN equals itself, as 0.0 does -0.0, in the SQL's joins: parts of such a size are paired too; NULL meets nothing."""
    import duckdb

    from factlattice.plans import catalogue

    sizes = [float("nan"), 0.0, -0.0, 1.5, None]
    rows = [(i, "b", sizes[i % 5], ["red bolt", "bolt", "red", "", None, "cold bolt", "old bolt"][i % 7]) for i in range(70)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size double, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.ORACLE["containment_join"]).fetchall())
    assert any(i % 5 == 0 and j % 5 == 0 for i, j in want)
    assert sorted(tuple(r) for r in catalogue.QUERIES["containment_join"](spark, str(tmp_path)).collect()) == want


def test_quantile_by_brute_force(spark):
    """Ties, one row, NULL keys and values, places at both ends, and spans that lie beside the place."""
    rng = random.Random(7)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(float, range(-5, 5)), rng.random()])) for _ in range(400)] + [("one", 4.0), ("none", None)] + [("many", float(i)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    values = {k: sorted(v for key, v in rows if key == k and v is not None) for k in {k for k, _ in rows}}
    beside = spark.createDataFrame([(k, -2.0, -1.0) for k in values], "k string, __a double, __b double")
    for q, spans in ((0.0, None), (0.25, None), (0.5, beside), (1.0, None)):
        got = {r.k: r.q for r in rel.quantile(df, ["k"], "v", q, "q", spans=spans).collect()}
        disc = {r.k: r.q for r in rel.quantile(df, ["k"], "v", q, "q", between=False, spans=spans).collect()}
        assert got.keys() == disc.keys() == {"a", "b", None, "one", "many"}
        for k, v in values.items():
            if v:
                at = (len(v) - 1) * q
                lo, hi = v[math.floor(at)], v[math.ceil(at)]
                assert math.isclose(got[k], lo + (hi - lo) * (at - math.floor(at)), abs_tol=1e-12) and disc[k] == v[max(math.ceil(len(v) * q) - 1, 0)]


def test_quantile_counts_few_values_one_by_one(spark):
    df = spark.range(100_000).select((F.col("id") % 2).alias("k"), F.col("id").cast("double").alias("v"))
    spans = df.groupBy("k").agg(F.percentile_approx("v", [0.498, 0.502], 10_000).alias("e")).select("k", F.col("e")[0].alias("__a"), F.col("e")[1].alias("__b"))
    counted = rel._counted(df.withColumnRenamed("v", "__v"), ["k"], spans)
    assert counted.count() < 1000 and counted.agg(F.sum("__n")).first()[0] == 100_000


def test_nearest_looks_at_few_scores_at_a_time():
    """A worker's memory doesn't grow with a batch: 1,000 queries against one batch of 10,000 rows."""
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pandas as pd

    made = np.random.default_rng(1).integers(-3, 4, (10_000, 8)).astype(float)
    made[:, 0] = 1.0
    unit, good = rel._unit(list(made))
    batch = pd.DataFrame({"row_id": np.arange(10_000), "vec": list(made)})
    tracemalloc.start()
    (got,) = rel._best_rows(SimpleNamespace(value=(unit[:1000], np.arange(1000))), 5)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert good.all() and len(got) == 5000 and peak < 60e6
    for q in (0, 17, 999):
        score = np.round(unit[q] @ unit.T, 12)
        score[q] = -np.inf
        assert np.allclose(got[got.query_id == q].score, np.sort(score)[::-1][:5])
