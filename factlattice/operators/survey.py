"""Survey tables: statuses from flags, vintages reconciled by names, and coverage by report year."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlattice.functions import numbers as nb
from factlattice.functions import text as tx

from . import relational as rel
from .taxonomy import named_leaves


def status(change: Column, present: Column, projected: Column) -> Column:
    """Abandonment is PAST; present and projected is PRESENT_AND_FUTURE if a change is named, else PRESENT;
    present alone PRESENT; else FUTURE. ``change`` is a comma-separated list."""
    named = F.exists(F.split(F.coalesce(change, F.lit("")), ","), lambda t: (F.trim(t) != "") & (F.lower(F.trim(t)) != "no change"))
    return (
        F.when(change == "Abandonment", "PAST")
        .when((present == 1) & (projected == 1), F.when(named, "PRESENT_AND_FUTURE").otherwise("PRESENT"))
        .when(present == 1, "PRESENT")
        .otherwise("FUTURE")
    )


def flag(yes_no: Column) -> Column:
    """Y is 1, N is 0, anything else NULL."""
    return F.when(yes_no == "Y", 1).when(yes_no == "N", 0)


def records(raw: DataFrame, names: DataFrame) -> DataFrame:
    """survey_id (with one leading zero if short), year, present, projected, change, process (its common name)
    of ``raw`` (survey_id, year, process, present, projected, change: as written) and ``names`` (process,
    common); rows that say N to both are left out, rows whose flags are missing aren't."""
    both_no = F.coalesce((F.col("present") == "N") & (F.col("projected") == "N"), F.lit(False))
    joined = raw.filter(~both_no).join(rel.small(names), "process", "left")
    return joined.select(tx.one_zero(F.col("survey_id")).alias("survey_id"), "year", flag(F.col("present")).alias("present"), flag(F.col("projected")).alias("projected"), "change", F.col("common").alias("process"))


def statuses(active: DataFrame, taxonomy: DataFrame, place: str = "place") -> DataFrame:
    """survey_id, process, status from records (with ``place``, the order of their rows): the latest of each
    name, mapped to leaves; where two names map to one leaf the older record counts."""
    rows = active.filter("present = 1 OR projected = 1")
    latest = rel.best_of(rows, ["survey_id", "process"], [-F.col("year"), -F.col(place)])
    leaf = named_leaves(taxonomy).withColumnRenamed("name", "__name")
    mapped = latest.withColumn("status", status(F.col("change"), F.col("present"), F.col("projected"))).join(rel.small(leaf), F.lower(F.trim("process")) == F.col("__name"))
    first = rel.best_of(mapped.select("survey_id", "leaf", "status", "year", place), ["survey_id", "leaf"], [F.col("year"), F.col(place)])
    return first.select("survey_id", F.col("leaf").alias("process"), "status")


def wide(rows: DataFrame, key: str, leaves: Sequence[str], default: str = "0") -> DataFrame:
    """key and one column per leaf, in the order given, ``default`` where there is none."""
    return rel.pivot_values(rows, [key], "process", "status", leaves, default)


def required_ids(permits: DataFrame, crosswalk: DataFrame, known: DataFrame) -> DataFrame:
    """survey_id, permit: ids that the table must have: those with a permit (but for numbers that begin with
    CAS) or a place in the cross-walk, if ``known`` has them; the permit table's number before the other's."""
    own = permits.filter(~F.startswith(F.upper(F.coalesce("permit", F.lit("nan"))), F.lit("CAS"))).groupBy("survey_id").agg(F.min_by("permit", "place").alias("a"))
    linked = crosswalk.filter(~tx.blank(F.col("survey_id"))).select(tx.one_zero(F.col("survey_id")).alias("survey_id"), "permit", "place").groupBy("survey_id").agg(F.min_by("permit", "place").alias("b"))
    both = own.join(linked, "survey_id", "full").select("survey_id", tx.first_filled(F.trim("a"), F.col("b")).alias("permit"))
    return both.join(known.select("survey_id").distinct(), "survey_id", "left_semi")


def coverage(listed: DataFrame, processes: DataFrame, latest: DataFrame, years: Sequence[int]) -> DataFrame:
    """Per year: facilities listed for the first time, facilities with records in it and the survey before
    whose sets of processes differ (NULL for the first), facilities whose latest records are of that year;
    each as a count and in percent of all facilities ever listed.

    ``listed``: year, facility. ``processes``: year, facility, process. ``latest``: year, facility (records)."""
    order = {y: i for i, y in enumerate(years)}
    nth = lambda: F.element_at(F.create_map(*(F.lit(x) for kv in order.items() for x in kv)), F.col("year"))
    base = listed.sparkSession.createDataFrame([(y,) for y in years], "year int")
    first = listed.filter(F.col("year").isin(*years)).groupBy("facility").agg(F.min("year").cast("int").alias("year"))
    total = first.count()
    new = first.groupBy("year").agg(F.count(F.lit(1)).alias("new"))
    sets = processes.withColumn("nth", nth()).filter("nth IS NOT NULL").groupBy("facility", "nth", "year").agg(F.sort_array(F.collect_set("process")).alias("set"))
    earlier = sets.select("facility", (F.col("nth") + 1).alias("nth"), F.col("set").alias("before"))
    changed = sets.join(earlier, ["facility", "nth"]).filter("set <> before").groupBy(F.col("year").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("changed"))
    recent = latest.groupBy("facility").agg(F.max("year").cast("int").alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("recent"))
    out = base.join(new, "year", "left").join(changed, "year", "left").join(recent, "year", "left").withColumn("total", F.lit(total).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    out = out.select("year", zero("new").alias("new"), F.when(F.col("year") != years[0], zero("changed")).alias("changed"), zero("recent").alias("recent"), "total")
    return out.select("*", *(nb.percent_of(F.col(c), F.col("total")).alias(c + "_percent") for c in ("new", "changed", "recent")))


def cumulative_new(listed: DataFrame, by: str, member: str) -> DataFrame:
    """by, new members, and all so far. One row per value of ``by`` is summed up in order."""
    new = listed.groupBy(member).agg(F.min(by).alias(by)).groupBy(by).agg(F.count(F.lit(1)).alias("new"))
    return new.withColumn("total", F.sum("new").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0)))
