"""Scores of predicted statuses against labels, on long tables (key, process, status).

Presence is a parameter: ``wide`` counts FUTURE and OFFSITE too. What a table lacks is absent. Ratios with a
zero denominator are NULL, so that averages leave them out, unless ``empty`` says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions import numbers as nb
from factlattice.functions import status as st

from . import relational as rel


def ratios(tp: Column, fp: Column, fn: Column, empty: float | None = None) -> list[Column]:
    """precision_, recall, f1."""
    filled = lambda c: c if empty is None else F.coalesce(c, F.lit(float(empty)))
    return [filled(nb.ratio(a, b)).alias(n) for n, a, b in (("precision_", tp, tp + fp), ("recall", tp, tp + fn), ("f1", 2 * tp, 2 * tp + fp + fn))]


def paired(labels: DataFrame, predictions: DataFrame, key: str, wide: bool = False) -> DataFrame:
    """key, process, m, p (present in labels, in predictions), same_token and same_state for every cell that
    either has; predictions of keys without labels are left out."""
    one = lambda df, s, f: df.select(key, "process", st.parse(F.col("status"), strict=False).alias(s), st.is_present(F.col("status"), wide).alias(f))
    mine = one(predictions.join(labels.select(key).distinct(), key, "left_semi"), "__p", "p")
    cells = one(labels, "__m", "m").join(mine, [key, "process"], "full")
    state = lambda c: F.when(F.col(c) == "PRESENT_AND_FUTURE", "PRESENT").otherwise(F.col(c))
    false = lambda c: F.coalesce(c, F.lit(False))
    return cells.select(key, "process", false("m").alias("m"), false("p").alias("p"), F.col("__m").eqNullSafe(F.col("__p")).alias("same_token"), state("__m").eqNullSafe(state("__p")).alias("same_state"))


def counts() -> list[Column]:
    m, p = F.col("m"), F.col("p")
    return [F.count_if(c).alias(n) for n, c in (("tp", m & p), ("fp", ~m & p), ("fn", m & ~p))]


def per_label(labels: DataFrame, predictions: DataFrame, key: str, processes: DataFrame, wide: bool = False) -> DataFrame:
    """process, supports, confusion counts and all scores, over the keys that both tables have; every process
    of ``processes`` has a row."""
    shared = labels.select(key).intersect(predictions.select(key))
    cells = paired(labels.join(shared, key, "left_semi"), predictions, key, wide)
    sums = cells.groupBy("process").agg(*counts(), F.count_if(F.col("m") & F.col("same_token")).alias("right"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = processes.select("process").join(sums, "process", "left").withColumn("keys", F.lit(shared.count()).cast("long"))
    out = out.select("process", "keys", *(zero(c) for c in ("tp", "fp", "fn", "right"))).withColumn("tn", F.col("keys") - F.col("tp") - F.col("fp") - F.col("fn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.select(
        "process", (tp + fn).alias("support_label"), (tp + fp).alias("support_predicted"), "tp", "fp", "fn", "tn", *ratios(tp, fp, fn),
        nb.ratio(tp + tn, F.col("keys")).alias("accuracy"), nb.ratio(fn, tp + fn).alias("missed"), nb.ratio(fp, tp + fp).alias("invented"),
        nb.ratio(F.col("right"), tp + fn).alias("state_accuracy"),
    )


def by_category(rows: DataFrame, key: str, categories: DataFrame) -> DataFrame:
    """key, process (the category), status: leaves rolled up over the lattice. ``categories``: process, category."""
    joined = rows.join(rel.small(categories), "process")
    return joined.groupBy(key, F.col("category").alias("process")).agg(st.merge(F.col("status")).alias("status"))


def run_scores(labels: DataFrame, predictions: DataFrame, key: str, taxonomy: DataFrame) -> DataFrame:
    """One row: macro and micro F1 over processes that aren't "unspecified", macro F1 over categories, and
    state accuracy over the label's processes; macro means are over the labelled keys."""
    unit = ~F.startswith(F.lower("process"), F.lit("unspecified"))
    cells = paired(labels, predictions, key, wide=True)
    units = cells.filter(unit).groupBy(key).agg(*counts(), F.count_if(F.col("m") & F.col("same_state")).alias("right"))
    leaf = taxonomy.select(F.col("leaf").alias("process"), "category")
    per_category = cells.join(rel.small(leaf), "process").groupBy(key, "category").agg(F.max("m").alias("m"), F.max("p").alias("p")).groupBy(key).agg(*counts())
    f1 = lambda: nb.ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    a = units.agg(F.avg(f1()).alias("macro_f1"), nb.ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("micro_f1"), F.avg(nb.ratio(F.col("right"), F.col("tp") + F.col("fn"))).alias("state_accuracy"))
    (category_f1,) = per_category.agg(F.avg(f1())).first()
    return a.withColumn("category_f1", F.lit(category_f1).cast("double"))


def category_confusion(truth: DataFrame, sources: dict[str, DataFrame], key: str, categories: DataFrame | None = None) -> DataFrame:
    """category, source, in_truth, tp, fp, fn over sets of keys. A process without a category is its own;
    keys that ``truth`` lacks altogether don't count."""
    def sets(df: DataFrame) -> DataFrame:
        rows = df.filter(st.is_present(F.col("status"))).select(key, "process")
        if categories is None:
            return rows.select(key, F.col("process").alias("category")).distinct()
        return rows.join(rel.small(categories), "process", "left").select(key, F.coalesce("category", "process").alias("category")).distinct()

    keys, right = truth.select(key).distinct(), sets(truth)
    out = None
    for name, df in sources.items():
        cells = right.withColumn("m", F.lit(True)).join(sets(df).join(keys, key, "left_semi").withColumn("p", F.lit(True)), [key, "category"], "full").fillna(False, ["m", "p"])
        one = cells.groupBy("category").agg(F.count_if("m").alias("in_truth"), *counts()).withColumn("source", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def error_parts(tp: Column, fp: Column, fn: Column, over: str = "f1", columns: Column | None = None) -> list[Column]:
    """missed, invented, error as shares: of 2 tp + fp + fn ("f1"), of the truth ("truth"), or missed of the
    truth, invented of the absent columns and both of all columns ("columns")."""
    truth = tp + fn
    if over == "f1":
        below = (2 * tp + fp + fn,) * 3
    elif over == "truth":
        below = (truth,) * 3
    else:
        below = (truth, columns - truth, columns)
    return [nb.ratio(a, b).alias(n) for n, a, b in zip(("missed", "invented", "error"), (fn, fp, fn + fp), below)]


def audit(labels: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Processes with errors: counts and their sum, worst first."""
    sums = paired(labels, predictions, key, wide=True).groupBy("process").agg(*counts()).withColumn("errors", F.col("fp") + F.col("fn"))
    return sums.filter("errors > 0").orderBy(F.desc("errors"), F.desc("fp"), "process")


def mean_cost(usage: DataFrame, prices: DataFrame, keys: Sequence[str], add_on: DataFrame | None = None) -> DataFrame:
    """keys, cost, structured: the mean cost of a row, as billed where any row is, else by tokens at the model's
    prices per million; families in ``add_on`` (model, extra) cost that more; and the share of rows whose
    output was structured, of those that say so."""
    priced = usage.join(rel.small(prices), "model", "left")
    by_tokens = F.col("prompt_tokens") / 1e6 * F.col("input_price") + F.col("completion_tokens") / 1e6 * F.col("output_price")
    said = F.lower(F.trim(F.col("structured").cast("string")))
    out = priced.groupBy(*keys).agg(
        F.coalesce(F.avg("billed"), F.avg(by_tokens)).alias("cost"), nb.ratio(F.count_if(said == "true"), F.count_if(said.isin("true", "false"))).alias("structured")
    )
    if add_on is None:
        return out
    more = out.join(rel.small(add_on), "model", "left")
    return more.withColumn("cost", F.col("cost") + F.coalesce("extra", F.lit(0.0))).drop("extra")


def profile(sites: DataFrame, populations: dict[str, DataFrame], regions: Sequence[str]) -> DataFrame:
    """population, n, the share of each region, of major and minor among those classified, of places with two
    or more documents, of places with a shared one; in percent. ``sites``: place_id, region, size, n_documents,
    shared, one row per place."""
    out = None
    for name, keys in populations.items():
        own = sites.join(keys.select("place_id").distinct(), "place_id", "left_semi")
        share = lambda c, d=1: nb.half_even(100 * F.avg(c.cast("double")), d)
        major = F.when(F.coalesce(F.trim("size"), F.lit("")) != "", F.startswith("size", F.lit("Major")))
        one = own.agg(
            F.count(F.lit(1)).alias("n"), *(share(F.col("region").eqNullSafe(r)).alias(r) for r in regions), share(major, 0).alias("major"), share(~major, 0).alias("minor"),
            share(F.col("n_documents") >= 2).alias("several"), share(F.col("shared")).alias("shared"),
        ).withColumn("population", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def summary(df: DataFrame, run: str, columns: Sequence[str]) -> DataFrame:
    """``df`` and three rows more: mean, std and variance (of a sample) of its columns."""
    stats = [("mean", F.avg), ("std", F.stddev_samp), ("variance", F.var_samp)]
    out = df.select(run, *columns)
    for name, f in stats:
        out = out.unionByName(df.agg(*(f(c).alias(c) for c in columns)).select(F.lit(name).alias(run), *columns))
    return out
