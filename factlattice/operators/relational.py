"""Relational operators with defined winners: deduplication, lookups, masks, unions, pivots.

Row order is an explicit column everywhere; "first" means the smallest by that column. Winners are
taken with aggregates where one column decides (partial aggregation before the exchange, so a hot key
is one row per task), with windows only where whole rows are ranked.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """A broadcast hint if the table has at most ``most`` rows, which is counted; else Spark shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def best_of(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key, the first by ``order``, taken with an aggregate: partial before the exchange, so
    a hot key is one row per task. Column types must be comparable in a struct."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))).alias("__r"))
    return first.select("__r.*")


def with_suffix(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", suffix: str = "_right") -> DataFrame:
    """A join on several keys; columns of ``right`` that ``left`` has too get a suffix."""
    named = right.select(*on, *(F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c not in on))
    return left.join(named, list(on), how)


def pair_semi(df: DataFrame, pairs: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose combination of keys occurs in ``pairs``."""
    return df.join(pairs.select(*on).distinct(), list(on), "left_semi")


def aligned(labels: DataFrame, found: DataFrame, key: str, fill: dict[str, Column]) -> DataFrame:
    """``found`` laid out over the keys of ``labels``: keys that it lacks get ``fill``, others go."""
    have = found.withColumn("__have", F.lit(True))
    joined = labels.select(key).distinct().join(have, key, "left")
    filled = [F.when(F.col("__have").isNull(), fill[c]).otherwise(F.col(c)).alias(c) if c in fill else F.col(c) for c in found.columns]
    return joined.select(*filled)


def common_keys(left: DataFrame, right: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """Both tables cut to the keys they share, one row per key in each: the first by ``order``."""
    shared = left.select(key).filter(F.col(key).isNotNull()).intersect(right.select(key))
    return tuple(pick(df.join(shared, key, "left_semi"), [key], [F.col(order)]) for df in (left, right))


def in_ranges(df: DataFrame, ranges: DataFrame, value: Column, low: str, high: str) -> DataFrame:
    """Each row with the ranges [low, high) that hold its value; a NULL bound is open. ``ranges`` is a table
    of bounded size (a curve's segments, bins); a row outside all of them is left out."""
    inside = (F.col(low).isNull() | (value >= F.col(low))) & (F.col(high).isNull() | (value < F.col(high)))
    return df.join(small(ranges), inside)


def as_of(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, since: str, width: float) -> DataFrame:
    """Each row of ``left`` with the row of ``right`` of the same key that is the latest at or before it: its
    columns in a struct ``found``, NULL where there is none. ``at`` and ``since`` are numbers; of rows of ``right``
    at one place the greatest counts. Both tables are united and sorted, never joined on a range. A key is cut into
    spans of ``width``, so that a hot key's rows are spread: what an earlier span leaves behind is one row a span."""
    keys = [f"__k{i}" for i in range(len(on))]
    row, mine = F.struct(*(F.col(f"`{c}`") for c in right.columns)), F.struct(*(F.col(f"`{c}`") for c in left.columns))
    named = lambda df, t: [F.col(f"`{c}`").alias(k) for c, k in zip(on, keys)] + [F.col(t).cast("double").alias("__t"), F.floor(F.col(t) / width).cast("long").alias("__span")]
    known = right.filter(F.col(since).isNotNull()).select(*named(right, since), row.alias("__right"))
    asked = left.select(*named(left, at), mine.alias("__left"))
    left_behind = known.groupBy(*keys, "__span").agg(F.max_by("__right", F.struct("__t", "__right")).alias("__last"))
    spans = left_behind.unionByName(asked.select(*keys, "__span").distinct(), allowMissingColumns=True).groupBy(*keys, "__span").agg(F.first("__last", ignorenulls=True).alias("__last"))
    before = Window.partitionBy(*keys).orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "__span", F.last("__last", ignorenulls=True).over(before).alias("__carried"))
    both = known.unionByName(asked, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__span").orderBy("__t", F.col("__right").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__right", ignorenulls=True).over(inside)).filter("__left IS NOT NULL")
    same = [F.col(f"s.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*keys, "__span")]
    joined = seen.alias("s").join(carried.alias("c"), same, "left")
    usable = F.col("__t").isNotNull() & ~sum_of([F.col(f"s.{k}").isNull() for k in keys])
    return joined.select("__left.*", F.when(usable, F.coalesce("__seen", "__carried")).alias("found"))


def sum_of(flags: Sequence[Column]) -> Column:
    """Whether any flag is set."""
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def inside(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, low: str, high: str, width: float = 1.0) -> DataFrame:
    """Each row of ``points`` with each row of ``ranges`` of the same key whose [low, high) holds ``at``; once a pair,
    columns of both (other names than ``on`` must differ). Two tables of any size: a range is filed under the
    one or two buckets that it touches at the level whose buckets are at least as long as itself, a point under its
    bucket at each level that occurs (at most some 60), and both meet by equality. So no row is copied often, however
    long the ranges are, and a key with many rows is spread over its buckets. Ranges that are empty or open hold nothing."""
    span = (F.col(high) - F.col(low)).cast("double")
    level = F.greatest(F.lit(0), F.ceil(F.log2(span / width))).cast("int")
    bucket = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(2.0), F.col("__level")))).cast("long")
    filed = ranges.filter(span > 0).withColumn("__level", level)
    levels = [r[0] for r in filed.select("__level").distinct().orderBy("__level").collect()]  # a number for each doubling
    filed = filed.withColumn("__bucket", F.explode(F.array_distinct(F.array(bucket(low), bucket(high)))))
    asked = points.withColumn("__level", F.explode(F.lit(levels) if levels else F.array().cast("array<int>"))).withColumn("__bucket", bucket(at))
    met = asked.join(filed, [*on, "__level", "__bucket"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high)))
    return met.drop("__level", "__bucket")


def totals_inside(points: DataFrame, ranges: DataFrame, on: Sequence[str], at: str, low: str, high: str, by: Sequence[str], totals: dict) -> DataFrame:
    """``by`` (columns of ``ranges``) and totals of the rows of ``points`` of the same key whose ``at`` is in [low, high), for those
    that hold any; all three are whole numbers. ``totals``: name -> (aggregate of points, aggregate that merges its
    parts). Points are summed up to blocks of 1, 2, 4, ... places before they meet a range, and a range takes the
    at most two blocks of each size that it is made of: no pair of a point and a range is formed, however many
    overlap, and nothing is subtracted."""
    from_, to = F.col(low).cast("long"), F.col(high).cast("long")
    longest = ranges.agg(F.max(to - from_)).first()[0] or 0
    sizes = range(max(longest, 0).bit_length())
    merged = [merge(name).alias(name) for name, (_, merge) in totals.items()]
    places = points.filter(F.col(at).isNotNull()).groupBy(*on, F.col(at).cast("long").alias("__place")).agg(*(made.alias(name) for name, (made, _) in totals.items()))
    block = F.explode(F.array(*(F.struct(F.lit(j).alias("__size"), F.shiftright("__place", j).alias("__block")) for j in sizes)).cast("array<struct<__size:int,__block:bigint>>"))
    summed = places.select(*on, *totals, block.alias("__b")).select(*on, "__b.*", *totals).groupBy(*on, "__size", "__block").agg(*merged)
    asked = ranges.select(*dict.fromkeys([*on, *by]), F.explode(_blocks(from_, to, sizes)).alias("__b")).select("*", "__b.*").drop("__b")
    return asked.join(summed, [*on, "__size", "__block"]).groupBy(*by).agg(*merged)


def _blocks(low: Column, high: Column, sizes: Sequence[int]) -> Column:
    """The aligned blocks (size as a power of two, number) that [low, high) is made of."""
    each = []
    for j in sizes:
        first, end = F.shiftright(low + F.lit((1 << j) - 1), j), F.shiftright(high, j)
        odd = lambda c: F.pmod(c, F.lit(2)) == 1
        for number, here in ((first, odd(first)), (end - 1, odd(end))):
            each.append(F.when((first < end) & here, F.struct(F.lit(j).alias("__size"), number.alias("__block"))))
    return F.array_compact(F.array(*each).cast("array<struct<__size:int,__block:bigint>>"))


def blank_last(*columns: str) -> list[Column]:
    """Sort keys: lower-cased, blank and NULL after all others."""
    return [k for c in columns for k in (F.coalesce(F.trim(c) == "", F.lit(True)).asc(), F.lower(c).asc())]


def in_order(column: str, order: Sequence[str]) -> Column:
    """A sort key: the place in an explicit list, others after it."""
    out = F.lit(len(order))
    for i, name in enumerate(order):
        out = F.when(F.col(column) == name, F.lit(i)).otherwise(out)
    return out


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One whole row per key: the first by ``order``. All columns are kept."""
    names = df.columns
    rank = [F.expr(o) if isinstance(o, str) else o for o in order]
    by = Window.partitionBy(*keys).orderBy(*rank)
    return df.withColumn("__rn", F.row_number().over(by)).filter("__rn = 1").select(*names)


def first_present(df: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str) -> DataFrame:
    """Per key each column's first non-null, non-blank value by ``order``, independently."""
    blank = {c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c)) for c in columns}
    return df.groupBy(*keys).agg(*(F.min_by(v, F.when(v.isNotNull(), F.col(order))).alias(c) for c, v in blank.items()))


def lookup(df: DataFrame, side: DataFrame, on: str, value: str, alias: str, order: str) -> DataFrame:
    """N:1 lookup: the side's first value per key by ``order``; a miss is NULL. No fan-out."""
    one = side.groupBy(F.col(on).alias("__k")).agg(F.min_by(value, order).alias(alias))
    return df.join(one, F.col(on) == F.col("__k"), "left").drop("__k")


def strict_lookup(df: DataFrame, side: DataFrame, on: str, value: str, alias: str) -> DataFrame:
    """A lookup whose miss is an error."""
    joined = df.join(side.select(F.col(on).alias("__k"), F.col(value).alias(alias)), F.col(on) == F.col("__k"), "left")
    checked = F.when(F.col("__k").isNull(), F.raise_error(F.concat(F.lit("unknown key: "), F.col(on).cast("string")))).otherwise(F.col(alias))
    return joined.withColumn(alias, checked).drop("__k")


def newest_tier(df: DataFrame, key: str, tier: Column, year: Column, superseded: int) -> DataFrame:
    """Rows of each key's best (lowest) tier; where even that is superseded, only the newest year's."""
    by = Window.partitionBy(key)
    ranked = df.withColumn("__t", tier).withColumn("__y", year).withColumn("__best", F.min("__t").over(by))
    kept = ranked.filter("__t = __best").withColumn("__new", F.max("__y").over(by))
    old = F.col("__best") % 3 == superseded
    return kept.filter(~old | (F.col("__y") == F.col("__new"))).drop("__t", "__y", "__best", "__new")


def best_priority(df: DataFrame, group: Sequence[str], priority: str, present: Column) -> DataFrame:
    """Among present siblings of a group only those of the best (lowest) priority stay; ties all do."""
    best = F.min(F.when(present, F.col(priority))).over(Window.partitionBy(*group))
    return df.withColumn("__best", best).withColumn("cleared", present & (F.col(priority) > F.col("__best"))).drop("__best")


def in_every(df: DataFrame, key: str, source: str, n: int) -> DataFrame:
    """Keys that occur in all ``n`` sources."""
    return df.groupBy(key).agg(F.count_distinct(source).alias("__n")).filter(F.col("__n") == n).select(key)


def add_missing(df: DataFrame, required: DataFrame, keys: Sequence[str], fill: dict[str, Column]) -> DataFrame:
    """Rows for required keys that ``df`` lacks, the other columns filled."""
    gone = required.select(*keys).distinct().join(df, list(keys), "left_anti")
    return df.unionByName(gone.select(*keys, *(v.alias(c) for c, v in fill.items())), allowMissingColumns=True)


def pivot_values(df: DataFrame, keys: Sequence[str], name: str, value: str, names: Sequence[str], default: str) -> DataFrame:
    """Long to wide with an explicit list of columns; what is absent gets ``default``."""
    wide = df.groupBy(*keys).pivot(name, list(names)).agg(F.max(value))
    return wide.select(*keys, *(F.coalesce(F.col(n), F.lit(default)).alias(n) for n in names))


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in ``spark.checkpoint.dir``. Only where that setting is unset and
    all runs in one process a temporary folder is taken."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factlattice-")
        sc.setCheckpointDir(at)
    return f"{at.rstrip('/')}/factlattice/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written once as a table in a ``folder`` of its own and read again: what several steps read is made once, and
    a lost executor brings back no more than its files. (``checkpoint()`` would compute all twice.)"""
    path = folder(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ancestors(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Closure of a parent relation (a DAG): node, ancestor, itself included. Breadth first with
    distinct pairs; ends with the longest path. A cycle is an error."""
    nodes = edges.select(F.col(child).alias("node")).union(edges.select(F.col(parent))).distinct()
    up = edges.select(F.col(child).alias("c"), F.col(parent).alias("p")).distinct()
    out = nodes.select("node", F.col("node").alias("ancestor"))
    front = out
    while True:
        front = front.join(up, front.ancestor == up.c).select("node", F.col("p").alias("ancestor")).distinct()
        front = saved(front)
        pairs, loops = front.agg(F.count(F.lit(1)), F.count_if(F.col("node") == F.col("ancestor"))).first()
        if loops:
            raise ValueError(f"{parent} of {child} has a cycle")
        if not pairs:
            return out.distinct()
        out = out.union(front)


def dnf_match(tokens: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """Rules in disjunctive normal form: a conjunct (rule, conjunct, token) matches a key that has all
    of its tokens; a rule matches by any conjunct. tokens: key, token."""
    sized = rules.select("rule", "conjunct", "token").distinct()
    sized = sized.join(sized.groupBy("rule", "conjunct").agg(F.count(F.lit(1)).alias("need")), ["rule", "conjunct"])
    have = tokens.select(key, "token").distinct().join(small(sized), "token").groupBy(key, "rule", "conjunct", "need").agg(F.count(F.lit(1)).alias("have"))
    return have.filter("have = need").select(key, "rule").distinct()


def budgeted(df: DataFrame, key: str, rank: str, order: str, size: str, max_rows: int, max_size: int, by: str) -> DataFrame:
    """Rank-interleaved selection per ``by``: all first ranks (in the order of their queries) before any
    second; a key counts once, at its first place; it stops before the first row that would pass either
    cap, and takes nothing after it."""
    names = df.columns
    once = pick(df, [by, key], [F.col(rank), F.col(order)])
    w = Window.partitionBy(by).orderBy(F.col(rank), F.col(order), F.col(key))
    run = once.withColumn("__n", F.row_number().over(w)).withColumn("__s", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.filter((F.col("__n") <= max_rows) & (F.col("__s") <= max_size)).select(*names)


#: How far around the asked place the values are counted one by one, as a share of a key's rows; the last takes all.
SPANS = (0.002, 0.05, 1.0)


def quantile(df: DataFrame, keys: Sequence[str], value: str, q: float, name: str, between: bool = True, spans: DataFrame | None = None) -> DataFrame:
    """The exact quantile per key, between two values in proportion, or else the first value that a share of ``q`` of the rows
    doesn't pass. A sketch of fixed size gives each key a span of values around the place; rows outside of it are
    only counted, equal values in it are counted and summed up, so no task holds or sorts a key's values. Whether the
    place lies in the span follows from the counts, so the result doesn't depend on the sketch's error: a key
    outside of its span is asked again with a wider one. ``spans``: keys, __a, __b of the first round, if known."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"))
    found = None
    for width in SPANS:
        edges = F.percentile_approx("__v", [max(q - width, 0.0), min(q + width, 1.0)], 10_000)
        a, b = (edges[0], edges[1]) if width < 1 else (F.min("__v"), F.max("__v"))
        if spans is None:
            spans = saved(rows.groupBy(*keys).agg(a.alias("__a"), b.alias("__b")))
        out = saved(_at_place(rows, keys, q, between, spans))
        good = out.filter("__x IS NOT NULL AND __y IS NOT NULL")
        found = good if found is None else found.unionByName(good)
        left = out.filter("__x IS NULL OR __y IS NULL").select(*keys)
        if not left.limit(1).count():
            break
        rows, spans = rows.alias("r").join(small(left.alias("l")), _same(keys, "r", "l"), "left_semi"), None
    return found.select(*keys, (F.col("__x") + (F.col("__y") - F.col("__x")) * F.col("__part") if between else F.col("__x")).alias(name))


def _same(keys: Sequence[str], one: str, other: str) -> Column:
    """Whether the keys of two named tables are equal; NULL is equal to NULL."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{one}.{k}").eqNullSafe(F.col(f"{other}.{k}"))
    return out


def _counted(rows: DataFrame, keys: Sequence[str], spans: DataFrame) -> DataFrame:
    """keys, __zone (below, in or above the span), __w (each value in it), __n, __least, __most."""
    zone = F.when(F.col("__v") < F.col("__a"), -1).when(F.col("__v") > F.col("__b"), 1).otherwise(0)
    placed = rows.alias("r").join(small(spans).alias("s"), _same(keys, "r", "s")).select(*(f"r.{k}" for k in keys), "__v", zone.alias("__zone"))
    return placed.groupBy(*keys, "__zone", F.when(F.col("__zone") == 0, F.col("__v")).alias("__w")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__least"), F.max("__v").alias("__most"))


def _at_place(rows: DataFrame, keys: Sequence[str], q: float, between: bool, spans: DataFrame) -> DataFrame:
    """keys, __x, __y, __part: the values on both sides of the place, NULL where they aren't in the span or next to it."""
    counted = _counted(rows, keys, spans)
    by = Window.partitionBy(*keys)
    upto = by.orderBy("__zone", "__w").rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumn("__to", F.sum("__n").over(upto)).withColumn("__all", F.sum("__n").over(by))
    at = (F.col("__all") - 1) * F.lit(float(q)) if between else F.greatest(F.ceil(F.col("__all") * F.lit(float(q))) - 1, F.lit(0)).cast("double")
    run = run.withColumn("__lo", F.floor(at)).withColumn("__hi", F.ceil(at)).withColumn("__part", at - F.floor(at))

    def holds(i):  # the first row above a span and the last one below are known too
        first = F.col("__to") - F.col("__n")
        inside = (F.col("__zone") == 0) & (F.col(i) >= first) & (F.col(i) < F.col("__to"))
        edge = F.when(inside, F.col("__w")).when((F.col("__zone") == 1) & (F.col(i) == first), F.col("__least"))
        return F.max(edge.when((F.col("__zone") == -1) & (F.col(i) == F.col("__to") - 1), F.col("__most")))

    return run.groupBy(*keys, "__part").agg(holds("__lo").alias("__x"), holds("__hi").alias("__y"))


#: Scores that a worker of ``nearest`` holds at a time.
CELLS = 1 << 20


def nearest(queries: DataFrame, rows: DataFrame, k: int, block: int = 1_000) -> DataFrame:
    """query_id, rank, row_id, score: the k rows of the largest cosine with each query, by looking at all. Queries
    (id, vec) are a stated set; they are sent to the rows in blocks of some ``block``, so what is broadcast is
    bounded. Each task keeps the best k of a query among its rows, of which it looks at ``CELLS`` / ``block`` at a time,
    and only these are shuffled. Vectors that are null,
    zero or hold null or non-finite numbers take no part."""
    blocks = max(1, -(-queries.count() // block))
    kind = rows.schema["id"].dataType.simpleString()
    asked = queries.select(F.col("id").alias("query_id"), "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("__block"))
    own = rows.select(F.col("id").alias("row_id"), "vec")
    out = None
    for b in range(blocks):
        some = asked.filter(F.col("__block") == b).select("query_id", "vec").toPandas()
        unit, good = _unit(some.vec)
        sent = rows.sparkSession.sparkContext.broadcast((unit, some.query_id[good].to_numpy()))
        top = own.mapInPandas(_best_rows(sent, k), f"query_id {kind}, row_id {kind}, score double")
        out = top if out is None else out.unionByName(top)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _unit(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, of those that take part, and which do."""
    sizes = [0 if v is None else len(v) for v in vectors]
    full = np.full((len(vectors), max(sizes, default=0)), np.nan)
    for i, v in enumerate(vectors):
        if sizes[i] == full.shape[1] and sizes[i]:
            full[i] = [np.nan if x is None else x for x in v]
    norm = np.sqrt((full * full).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return full[good] / norm[good, None], good


def _best_rows(sent, k: int):
    """The best k rows of each query in a task, batch by batch; equal scores by the smaller id."""

    def run(batches):
        unit, ids = sent.value
        best = None
        for batch in batches:
            step = max(1, CELLS // max(1, len(ids)))
            for some in (batch.iloc[i : i + step] for i in range(0, len(batch), step)):
                mine, good = _unit(some.vec)
                if not len(ids) or not len(mine) or mine.shape[1] != unit.shape[1]:
                    continue
                row_ids = some.row_id[good].to_numpy()
                score = unit @ mine.T
                score[ids[:, None] == row_ids[None, :]] = -np.inf
                few = min(k, len(row_ids))
                edge = np.partition(score, len(row_ids) - few, axis=1)[:, len(row_ids) - few]
                if best is not None:  # below what the query has k of already
                    edge = np.maximum(edge, floor)
                q, r = np.nonzero((score >= edge[:, None]) & np.isfinite(score))  # ties at the edge stay
                found = pd.DataFrame({"at": q, "query_id": ids[q], "row_id": row_ids[r], "score": score[q, r]})
                best = found if best is None else pd.concat([best, found])
                best = best.sort_values(["at", "score", "row_id"], ascending=[True, False, True]).groupby("at").head(k)
                held, floor = best.groupby("at").score.agg(["size", "min"]), np.full(len(ids), -np.inf)
                held = held[held["size"] >= k]
                floor[held.index] = held["min"]
        if best is not None:
            yield best.drop(columns="at")

    return run


def reranked(found: DataFrame, second: Column, k: int) -> DataFrame:
    """The k survivors of each query (query_id, rank, row_id, score, and columns that ``second`` reads) by a second
    score, then by their first rank: two stages, of which the second looks at few rows."""
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("second"), "rank", "row_id")
    again = found.withColumn("second", second)
    return again.withColumn("first_rank", F.col("rank")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without NULL in the columns. (``na.drop`` drops NaN too, which equals itself in a join.)"""
    return df.filter(reduce(Column.__and__, (F.col(c).isNotNull() for c in columns)))


def containing(df: DataFrame, key: str, text: str, other: DataFrame, other_key: str, other_text: str, on: Sequence[str] = ()) -> DataFrame:
    """Pairs (key, other_key) where either text contains the other, of rows alike in the columns ``on`` (not NULL). Ids alone are joined: a text of three characters or
    more by the trigram of it that fewest of the longer texts hold, a shorter one by itself, as one of the longer
    ones' pieces of its length. Texts are fetched for these candidates alone, and compared."""
    group = F.struct(*on) if on else F.lit(0)
    a, b = (present(d, [*on, t]).select(F.col(k).alias("k"), F.col(t).alias("t"), group.alias("w")) for d, k, t in ((df, key, text), (other, other_key, other_text)))
    one = _contained(a, b).toDF(key, other_key)
    return one.unionByName(_contained(b, a).toDF(other_key, key)).distinct()


def _pieces(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """k, w, g: the distinct pieces of the given lengths of each text; the ids stand beside them, not the texts."""
    each = [F.expr(f"transform(sequence(1, greatest(char_length(t) - {n - 1}, 1)), i -> substring(t, i, {n}))") if n else F.array(F.lit("")) for n in sizes]
    return df.select("k", "w", F.explode(F.array_distinct(F.flatten(F.array(*each)))).alias("g"))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    tiny = short.filter(F.char_length("t") < 3)
    sizes = [r[0] for r in tiny.select(F.char_length("t")).distinct().collect()]  # at most three numbers
    held = _pieces(long, [3])
    often = held.groupBy("w", "g").agg(F.count(F.lit(1)).alias("n"))
    own = _pieces(short.filter(F.char_length("t") >= 3), [3])
    rarest = own.join(often, ["w", "g"], "left").groupBy("k", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("m"))
    asked = rarest.filter("m.n > 0").select(F.col("k").alias("s"), "w", F.col("m.g").alias("g"))
    pairs = asked.join(held.withColumnRenamed("k", "l"), ["w", "g"]).select("s", "l")
    if sizes:
        pairs = pairs.unionByName(tiny.select(F.col("k").alias("s"), "w", F.col("t").alias("g")).join(_pieces(long, sizes).withColumnRenamed("k", "l"), ["w", "g"]).select("s", "l"))
    texts = pairs.distinct().join(short.select(F.col("k").alias("s"), F.col("t").alias("ts")), "s").join(long.select(F.col("k").alias("l"), F.col("t").alias("tl")), "l")
    return texts.filter(F.contains("tl", F.col("ts"))).select("s", "l").distinct()
