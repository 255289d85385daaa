"""Which of several present processes stay, and what fills a category that has none.

Tables are long: keys (a document, or a document and an item), process, status; an absent process has no
row or a NULL status. The taxonomy's table is joined by its leaves, and broadcast if its counted rows are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlattice.functions import status as st

from .relational import small


def prune(df: DataFrame, keys: Sequence[str], within: Column, priority: Column) -> DataFrame:
    """Of the present processes of a key that share a value of ``within`` only those of the best (lowest)
    priority stay, ties all; processes that aren't present neither compete nor go, nor do those for
    which ``within`` is NULL."""
    names = df.columns
    present = st.is_present(F.col("status")) & within.isNotNull()
    marked = df.withColumn("__in", within).withColumn("__p", F.when(present, priority))
    best = F.min("__p").over(Window.partitionBy(*keys, "__in"))
    return marked.withColumn("__best", best).filter(F.col("__p").isNull() | F.col("__in").isNull() | (F.col("__p") == F.col("__best"))).select(*names)


def three_stages(df: DataFrame, keys: Sequence[str], taxonomy: DataFrame, category: str = "Filtration") -> DataFrame:
    """Pruned among siblings of a group, then within one category, both by priority, then among all by
    global priority."""
    names = df.columns
    known = taxonomy.select(F.col("leaf").alias("process"), F.col("grp").alias("__grp"), F.col("category").alias("__cat"), F.col("priority").alias("__pr"), F.col("global_priority").alias("__gl"))
    df = df.join(small(known), "process", "left")
    df = prune(df, keys, F.col("__grp"), F.col("__pr"))
    df = prune(df, keys, F.when(F.col("__cat") == category, F.col("__cat")), F.col("__pr"))
    return prune(df, keys, F.lit(0), F.col("__gl")).select(*names)


def backfill(df: DataFrame, keys: Sequence[str], taxonomy: DataFrame, matched: DataFrame | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """A present process whose secondary category has nothing present makes one process of that category
    PRESENT: one that is in ``matched`` (keys, process), else the category's own "Unspecified <category>",
    else one with "Unspecified" in its name, else any; of several the first by priority, global
    priority and name. Those in ``excluded`` (keys, process) are never taken. Sources are what is present
    at the start, so the result doesn't depend on any order."""
    leaf = taxonomy.select("leaf", "category", "priority", "global_priority", "secondary")
    present = df.filter(st.is_present(F.col("status"))).join(small(leaf), F.col("process") == F.col("leaf"))
    wanted = present.select(*keys, F.explode("secondary").alias("category")).distinct()
    wanted = wanted.join(present.select(*keys, "category").distinct(), [*keys, "category"], "left_anti")
    options = wanted.join(small(leaf.select("category", F.col("leaf").alias("process"), "priority", "global_priority")), "category")
    if excluded is not None:
        options = options.join(excluded.select(*keys, "process").distinct(), [*keys, "process"], "left_anti")
    if matched is not None:
        options = options.join(matched.select(*keys, "process", F.lit(True).alias("__m")).distinct(), [*keys, "process"], "left")
    else:
        options = options.withColumn("__m", F.lit(False))
    own = F.lower("process") == F.concat(F.lit("unspecified "), F.lower("category"))
    pool = F.when(F.coalesce("__m", F.lit(False)), 0).when(own, 1).when(F.contains(F.col("process"), F.lit("Unspecified")), 2).otherwise(3)
    chosen = options.groupBy(*keys, "category").agg(F.min(F.struct(pool.alias("pool"), "priority", "global_priority", "process")).alias("c"))
    chosen = chosen.select(*keys, F.col("c.process").alias("process"), F.lit("PRESENT").alias("status")).distinct()
    rest = df.select(*keys, "process", "status").join(chosen, [*keys, "process"], "left_anti")
    return rest.unionByName(chosen)
