"""How the filters of a cleaning recipe interact: what each removes in every order of application.

Each document becomes a bit mask of the filters that it fails. Masks are counted per part (source), so that
everything after that works on at most 32 cells a part. The cells are unpivoted against the steps of all
orders; a running bit-or over the earlier steps of an order tells whether a document was gone before;
conditional sums over the cells, and a window over each filter's rows of all orders, give the metrics.

Filters (``FILTERS``, in bit order): A too few words, B too many repeated words, C too many capitals, D
holds special characters, E has the text of a document with a smaller doc_id.

Texts are compared by their SHA-256. Copies meet after map-side counts by (text, doc_id) and again by
(text, part): a text with a third of all rows arrives as a few rows a task, and no row is joined with its
group. Only digests and counts are shuffled, never texts.

Defined results: null text counts as empty and null source as the part ''; texts of any length are read
whole; a document without a doc_id is never a copy and nobody's original; rows that repeat a doc_id and its
text are not copies of one another (no doc_id is smaller); a doc_id that is labelled twice counts if one
label says so, and labels without a doc_id belong to nobody; other label values count as no label; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

FILTERS = "ABCDE"
#: Fixed values of the filters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SPECIAL = 50, 65, 5, "[#$%&*|]"


def _mask(text: Column) -> Column:
    """Bits of the filters A to D that the text itself fails."""
    words = F.array_remove(F.split(text, f"[{common.SPACE}]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    chars = F.char_length(text)
    capitals = chars - F.char_length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < LEAST_WORDS, distinct.cast("long") * 100 < n.cast("long") * LEAST_DISTINCT, capitals.cast("long") * 100 > chars.cast("long") * MOST_CAPITALS, text.rlike(SPECIAL)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents (doc_id, text, source) of a part fail just the filters of
    the mask, and how many of them are labelled so. ``labels``: doc_id, quality, toxic."""
    text = common.text_of()
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        _mask(text).alias("mask"),
    )
    # Written once: the texts are read a single time, and a lost executor doesn't bring them back.
    narrow = common.cut(narrow, "audit-masks").groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    given = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    given = given.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # Rows without an id would all meet in one task of the join; they have no label.
    known = narrow.filter("doc_id IS NOT NULL").join(given, "doc_id", "left").fillna(0, ["good", "toxic"])
    rows = known.unionByName(narrow.filter("doc_id IS NULL").withColumns({"good": F.lit(0), "toxic": F.lit(0)}))
    # Per text and part: all rows, and those that have no smaller doc_id there.
    by_text = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"),
    )
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    by_text = by_text.withColumn("own", F.col("nameless") + F.when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0))
    copy = 1 << FILTERS.index("E")
    pair = F.array(F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("own")).alias("n")))
    marked = by_text.select("part", "good", "toxic", F.explode(pair).alias("c")).select("part", "good", "toxic", "c.*").filter("n > 0")
    return marked.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def audit(cell: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The metrics of every order of ``filters`` from its ``cells``: part, filter_order, step, kept, removed,
    redundant, unique_fails, good_lost, toxic_lost, shapley. ``filters`` names at most eight filters by a
    letter each, in bit order (8! orders times 8 steps are a table of fixed size)."""
    if len(filters) > 8:
        raise ValueError("at most eight filters")
    orders = " ".join(map("".join, itertools.permutations(filters)))
    bit = F.element_at(F.create_map(*(x for i, f in enumerate(filters) for x in (F.lit(f), F.lit(1 << i)))), F.col("filter"))
    long = cell.select("*", F.explode(F.split(F.lit(orders), " ")).alias("filter_order"))
    long = long.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "filter")).filter("filter != ''")
    long = long.select("*", (F.col("at") + 1).alias("step"), F.col("mask").bitwiseAND(bit).alias("fails"), bit.alias("bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    fails, gone = F.col("fails") > 0, F.col("earlier") > 0
    of = lambda condition, what="n": F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long")
    out = long.groupBy("part", "filter_order", "step", "filter").agg(
        of(~fails & ~gone).alias("kept"),
        of(fails & ~gone).alias("removed"),
        of(fails & gone).alias("redundant"),
        of(F.col("mask") == F.col("bit")).alias("unique_fails"),
        of(fails & ~gone, "good").alias("good_lost"),
        of(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    every = F.sum("removed").over(Window.partitionBy("part", "filter"))
    return out.withColumn("shapley", every.cast("long")).withColumn("step", F.col("step").cast("int")).drop("filter")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return audit(cells(docs, common.table(spark, sf_dir, "labels")))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY 1
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    len(words) < 50 AS a,
    100 * len(list_distinct(words)) < 65 * len(words) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c,
    regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM d LEFT JOIN l USING (doc_id)
), cell AS (
  SELECT part, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
  FROM f GROUP BY ALL
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x), orders AS (
  SELECT [p.x, q.x, r.x, s.x, t.x] AS o FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
), steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders), m AS (
  SELECT part, array_to_string(o, '') AS filter_order, step, o[step] AS filter,
    sum(CASE WHEN NOT list_has_any(failed, o[:step]) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1]) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN list_contains(failed, o[step]) AND list_has_any(failed, o[:step - 1]) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = [o[step]] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1]) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN list_contains(failed, o[step]) AND NOT list_has_any(failed, o[:step - 1]) THEN toxic ELSE 0 END) AS toxic_lost
  FROM cell, steps GROUP BY ALL
)
SELECT m.part, filter_order, m.step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
  unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM m JOIN (SELECT part, filter, sum(removed) AS shapley FROM m GROUP BY ALL) USING (part, filter)
"""
