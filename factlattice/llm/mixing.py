"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

Each source has a target number of words; a document's expected copies are target / source size, at
most ``max_repeat``. The whole part is taken; the fractional parts are rounded together. Two
documents of a source with fractions p, q and sizes v, w trade mass (v*p + w*q stays the same) at
random, without bias, until one fraction is 0 or 1; the other goes on to the next pair. Groups of
about ``FAN`` documents are folded this way, each passes on its residual and ``HOLD`` documents that it
left alone, and these are grouped again: a reduction tree whose levels are keyed by (source, group), so
a source with a third of all rows is spread like any other. Rows that are equal in doc_id, text and
source trade with each other first: of n such rows with fraction p, floor(n * p) get a copy more and one
residual goes on. At the root of a source one fraction is left; it is rounded to the nearer whole, and
what then still misses the target is settled by flipping documents of the root group, the largest
first. The trades are unbiased; the settlement isn't (in a source of up to about ``FAN`` documents it
may touch any of them), it buys a sum within about one small document of the target.

A document is known by a digest of its doc_id, source and text, and all randomness is a hash of that
and ``seed``: the same rows give the same result however they are partitioned or ordered.

Defined results: null text has size 0; the null source is a source of its own, after all others; a
document of size 0 takes 0 words; a source of size 0 has target 0; texts of any length count whole; an
empty table gives an empty result; rows that repeat a doc_id are mixed as documents of their own (of
rows that are also equal in text and source, ``mixed_rows`` takes any, as many as ``mix`` says); other
columns are ignored by ``mix`` and carried unchanged by ``mixed_rows``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents in a group, and how many of them are held back for the next level: small and large ones
#: alike, so that at a source's root enough documents are open to come near the target.
FAN, HOLD = 64, 4
SEED = 20_011
#: Rows of one key that are numbered in one task.
CHUNK = 4_096


def words(text: str = "text") -> Column:
    """Number of runs of characters that aren't ASCII white space."""
    trimmed = F.ltrim(common.text_of(text), F.lit(" \t\n\x0b\f\r"))
    marks = F.regexp_replace(trimmed, f"[^{common.SPACE}]++[{common.SPACE}]*+", "x")
    return F.length(marks).cast("long")


def _key() -> Column:
    """A digest of doc_id, source and text, each marked off from the next."""
    doc, source = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.col("source").cast("string")
    return F.unhex(F.sha2(F.concat(doc, F.lit(":"), F.coalesce(F.length(source), F.lit(-1)), F.lit(":"), F.coalesce(source, F.lit("")), common.text_of()).cast("binary"), 256))


def targets(sizes: DataFrame, max_repeat: int = 3, cycle: int = 3) -> DataFrame:
    """source, source_size, docs -> with target. One row per source; sources may be many.

    Weights 1, 2, ..., cycle repeat in code point order, null last: sources are numbered within the
    ranges of a range partitioning, and the ranges' sizes are summed up. Resharing the excess over
    max_repeat * source_size by weight ends where target = min(cap, level * weight) and the targets add
    up to the total; the level rises by aggregates until no more sources reach their cap.
    """
    dealt = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    dealt = common.cut(dealt, "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    t = dealt.join(F.broadcast(parts), "part").withColumn("weight", (place % cycle + 1).cast("double"))  # a row per partition
    t = common.cut(t.withColumn("cap", (F.col("source_size") * max_repeat).cast("double")).drop("part", "before"), "mix-weights")
    total = float(t.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, mass, weight = t.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == capped or not weight:
            break
        level, capped = (total - max_repeat * float(mass)) / weight, n
    return t.select("source", "source_size", "docs", F.least("cap", F.lit(level) * F.col("weight")).alias("target"))


_ITEM = "named_struct('key', {0}.key, 'size', {0}.size, 'p', {1})"
#: One trade between the residual s.r and the next document x. u decides the direction.
_TRADE = f"""
transform(array(named_struct('r', s.r, 'x', x,
    'up', double(pmod(xxhash64(s.r.key, x.key, {{seed}}), 1048576)) / 1048576
          * (least(1 - s.r.p, x.p * x.size / s.r.size) + least(s.r.p, (1 - x.p) * x.size / s.r.size))
          < least(s.r.p, (1 - x.p) * x.size / s.r.size))), t ->
  CASE
    WHEN t.up AND 1 - t.r.p <= t.x.p * t.x.size / t.r.size THEN named_struct(
      'r', {_ITEM.format('t.x', 'greatest(0D, t.x.p - (1 - t.r.p) * t.r.size / t.x.size)')}, 'd', {_ITEM.format('t.r', '1D')})
    WHEN t.up THEN named_struct(
      'r', {_ITEM.format('t.r', 'least(1D, t.r.p + t.x.p * t.x.size / t.r.size)')}, 'd', {_ITEM.format('t.x', '0D')})
    WHEN t.r.p <= (1 - t.x.p) * t.x.size / t.r.size THEN named_struct(
      'r', {_ITEM.format('t.x', 'least(1D, t.x.p + t.r.p * t.r.size / t.x.size)')}, 'd', {_ITEM.format('t.r', '0D')})
    ELSE named_struct(
      'r', {_ITEM.format('t.r', 'greatest(0D, t.r.p - (1 - t.x.p) * t.x.size / t.r.size)')}, 'd', {_ITEM.format('t.x', '1D')})
  END)[0]
"""
_FOLD = f"""
aggregate(slice(items, 2, size(items)),
  named_struct('r', {_ITEM.format('items[0]', 'items[0].p')}, 'done', filter(array({_ITEM.format('items[0]', 'items[0].p')}), i -> false)),
  (s, x) -> transform(array({_TRADE}), t -> named_struct('r', t.r, 'done', concat(s.done, array(t.d))))[0])
"""
#: At a source's root: round the residual to the nearer whole; e is the number of words still missing.
#: Then, from the largest document down, flip one whenever that brings the sum nearer.
_SETTLE = f"""
aggregate(array_sort(concat(done, array({_ITEM.format('rem', 'double(round(rem.p))')})),
    (a, b) -> CASE WHEN a.size <> b.size THEN IF(a.size > b.size, -1, 1) WHEN a.key < b.key THEN -1 WHEN a.key > b.key THEN 1 ELSE 0 END),
  named_struct('e', (rem.p - round(rem.p)) * rem.size, 'done', filter(done, i -> false)),
  (s, x) -> CASE
    WHEN x.p = 0 AND abs(s.e - x.size) < abs(s.e) THEN named_struct('e', s.e - x.size, 'done', concat(s.done, array({_ITEM.format('x', '1D')})))
    WHEN x.p = 1 AND abs(s.e + x.size) < abs(s.e) THEN named_struct('e', s.e + x.size, 'done', concat(s.done, array({_ITEM.format('x', '0D')})))
    ELSE named_struct('e', s.e, 'done', concat(s.done, array(x))) END).done
"""


def _taken(docs: DataFrame, max_repeat: int, cycle: int, seed: int) -> DataFrame:
    """One row per key of ``docs`` (doc_id, size, source, key): doc_id, key, n (rows with that key), size,
    source, source_size, target, total (copies of all rows with that key)."""
    keyed = docs.groupBy("key").agg(
        F.any_value("doc_id").alias("doc_id"), F.any_value("source").alias("source"), F.any_value("size").alias("size"), F.count(F.lit(1)).alias("n")
    )
    keyed = common.cut(keyed, "mix-keys")
    sums = keyed.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_source = common.cut(targets(sums, max_repeat, cycle), "mix-targets")
    n_sources, largest = by_source.agg(F.count(F.lit(1)), F.coalesce(F.max("docs"), F.lit(0))).first()
    renamed = common.small(by_source.withColumnRenamed("source", "__s"), n_sources)
    every = keyed.join(renamed, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    every = every.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    whole = F.least(F.floor("rate"), F.lit(max_repeat))
    every = every.withColumn("whole", whole.cast("int"))
    every = every.withColumn("more", (F.col("rate") - F.col("whole")) * F.col("n")).withColumn("sure", F.col("n") * F.col("whole") + F.floor("more"))
    every = every.withColumn("p", F.col("more") - F.floor("more"))
    head, own = ["source", "source_size", "docs", "target"], ["key", "size"]

    open_ = every.filter("size > 0 AND p > 0").select(*own, "p", *head)
    level, parts = 0, []
    while True:
        per_group = FAN * (FAN / (HOLD + 1)) ** level
        groups = math.ceil(largest / per_group)
        n_groups = F.greatest(F.lit(1), F.ceil(F.col("docs") / per_group))
        item = F.struct(F.xxhash64("key", F.lit(seed + level)).alias("h"), *own, "p")
        dealt = open_.withColumn("groups", n_groups).withColumn("g", F.pmod(F.xxhash64("key", F.lit(seed - 1 - level)), F.col("groups")))
        grouped = dealt.groupBy(*head, "groups", "g").agg(F.sort_array(F.collect_list(item)).alias("items"))
        grouped = grouped.withColumn("held", F.when(F.col("groups") > 1, F.slice("items", 1, F.least(F.lit(HOLD), F.size("items") - 1))).otherwise(F.slice("items", 1, 0)))
        grouped = grouped.withColumn("items", F.slice("items", F.size("held") + 1, F.size("items")))
        folded = grouped.select(*head, "groups", "held", F.expr(_FOLD.format(seed=seed)).alias("f")).select(
            *head, "groups", F.col("f.done").alias("done"), F.col("f.r").alias("rem"), F.expr("concat(transform(held, i -> " + _ITEM.format("i", "i.p") + "), array(f.r))").alias("open")
        )
        folded = common.cut(folded, f"mix-level{level}")
        parts.append(folded.filter("groups = 1").select(F.explode(F.expr(_SETTLE)).alias("d")))
        inner = folded.filter("groups > 1")
        parts.append(inner.select(F.explode("done").alias("d")))
        if groups <= 1:
            break
        open_ = inner.select(F.explode("open").alias("o"), *head).select("o.key", "o.size", "o.p", *head)
        level += 1
    rounded = parts[0]
    for part in parts[1:]:
        rounded = rounded.unionByName(part)
    rounded = rounded.select(F.col("d.key").alias("key"), F.round("d.p").cast("long").alias("extra")).filter("extra = 1")
    total = F.when(F.col("size") > 0, F.col("sure") + F.coalesce("extra", F.lit(0))).otherwise(0)
    return every.join(rounded, "key", "left").select("doc_id", *own, "n", "source", "source_size", "target", total.cast("long").alias("total"))


def _sized(docs: DataFrame, *more: str) -> DataFrame:
    return common.cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), _key().alias("key"), *more), "mix-sizes")


def _copies(place: Column) -> Column:
    """Copies of the row with that place (from 0) among the n rows of its key."""
    return (F.floor(F.col("total") / F.col("n")) + (place < F.col("total") % F.col("n")).cast("long")).cast("int")


def mix(docs: DataFrame, max_repeat: int = 3, cycle: int = 3, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source, source_size, target, copies,
    taken."""
    taken = common.cut(_taken(_sized(docs), max_repeat, cycle, seed), "mix-taken")
    one = taken.filter("n = 1").withColumn("copies", F.col("total").cast("int"))
    # rows that are equal: numbered by a part and a place in it, parts dealt to all tasks
    parts = taken.filter("n > 1").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    parts = parts.repartition("key", "part").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(CHUNK), F.col("n") - F.col("part") * CHUNK) - 1)))
    many = parts.withColumn("copies", _copies(F.col("part") * CHUNK + F.col("place")))
    out = one.unionByName(many.select(*one.columns))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, max_repeat: int = 3, cycle: int = 3, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0 to max_repeat times)."""
    row, copies, again = common.free(docs.columns, "__fl_row", "__fl_copies", "__fl_copy")
    rows = common.cut(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    sized = _sized(rows, row)
    taken = common.cut(_taken(sized, max_repeat, cycle, seed).select("key", "n", "total"), "mix-taken")
    one = sized.select("key", row).join(taken.filter("n = 1 AND total <> 1"), "key").select(row, F.col("total").cast("int").alias(copies))
    # rows of one key: numbered within parts of a bounded size, the parts' sizes summed up
    many = taken.filter("n > 1")
    many = common.small(many, many.count())
    part = F.pmod(F.xxhash64(row), F.ceil(F.col("n") / CHUNK))
    equal = common.cut(sized.select("key", row).join(many, "key").withColumn("part", part), "mix-equal")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = equal.groupBy("key", "part").agg(F.count(F.lit(1)).alias("k")).select("key", "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("key", "part").orderBy(row)) - 1 + F.col("before")
    equal = equal.join(sizes, ["key", "part"]).select(row, _copies(place).alias(copies)).filter(F.col(copies) != 1)
    plan = common.cut(one.unionByName(equal), "mix-copies")
    joined = rows.join(common.small(plan, plan.count()), row, "left")
    repeated = joined.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.coalesce(copies, F.lit(1)))))
    return repeated.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
