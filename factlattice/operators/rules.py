"""From extraction items to processes: components with their ancestors, rules, exclusions, pruning, backfill.

Tables: ``items`` (keys, Equipment, Process, Role, Substance: arrays, Implementation, Location), ``up`` (node,
ancestor: the closure of a class hierarchy, see ``relational.ancestors``), ``does`` (equipment, process: what
a class does by itself). All of it is joins of long tables; nothing is looked up per row. What several
steps read (components, matches, pruned rows) is written to the checkpoint folder once.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions import status as st
from factlattice.functions import text as tx

from . import priority
from .relational import saved, small

KINDS = ("Process", "Role", "Equipment", "Substance")


def _labels(named: DataFrame, up: DataFrame) -> DataFrame:
    """``named`` (..., kind, name) with label: the name without its kind, and its ancestors without theirs."""
    names = [c for c in named.columns if c not in ("kind", "name")]
    bare = F.col("name")
    for kind in KINDS:
        bare = F.when((F.col("kind") == kind), tx.without_prefix(F.col("name"), kind + "-")).otherwise(bare)
    own = named.withColumn("label", bare).select(*names, "kind", "label")
    prefixed = F.concat(F.col("kind"), F.lit("-"), F.col("label"))
    nodes = own.withColumn("node", F.explode(F.when(F.col("kind").isin("Process", "Substance"), F.array(prefixed, "label")).otherwise(F.array("label"))))
    above = nodes.drop("label").join(small(up), "node").withColumn("label", F.col("ancestor"))
    for kind in KINDS:
        above = above.withColumn("label", F.when(F.col("kind") == kind, tx.without_prefix(F.col("label"), kind + "-")).otherwise(F.col("label")))
    return own.unionByName(above.select(*names, "kind", "label")).distinct()


def components(items: DataFrame, keys: Sequence[str], up: DataFrame, does: DataFrame) -> DataFrame:
    """keys, kind, label: an item's processes, equipment and substances with all their ancestors, its roles as
    they are, and the processes that its equipment does (with their ancestors)."""
    parts = [items.select(*keys, F.lit(kind).alias("kind"), F.explode(kind).alias("name")) for kind in KINDS]
    named = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    own = _labels(named.filter("kind <> 'Role'"), up)
    done = own.filter("kind = 'Equipment'").join(small(up), F.col("label") == F.col("node")).select(*keys, F.col("ancestor").alias("equipment"))
    done = done.unionByName(own.filter("kind = 'Equipment'").select(*keys, F.col("label").alias("equipment"))).distinct()
    implied = done.join(small(does), "equipment").select(*keys, F.lit("Process").alias("kind"), F.col("process").alias("name"))
    roles = named.filter("kind = 'Role'").select(*keys, "kind", F.col("name").alias("label"))
    return own.unionByName(_labels(implied, up)).unionByName(roles).distinct()


def _token(token: Column) -> tuple[Column, Column]:
    """Kind and label of a rule's token; one without a kind is a substance."""
    kind, label = F.lit("Substance"), token
    for k in reversed(KINDS):
        has = F.startswith(token, F.lit(k + "-"))
        kind, label = F.when(has, k).otherwise(kind), F.when(has, tx.without_prefix(token, k + "-")).otherwise(label)
    return kind, label


def clauses(taxonomy: DataFrame) -> DataFrame:
    """leaf, clause, kind, label, need: one row per token of a leaf's rules in disjunctive normal form."""
    rows = taxonomy.select("leaf", F.posexplode("clauses").alias("clause", "tokens"))
    kind, label = _token(F.col("token"))
    rows = rows.select("leaf", "clause", F.explode("tokens").alias("token")).select("leaf", "clause", kind.alias("kind"), label.alias("label")).distinct()
    return rows.join(rows.groupBy("leaf", "clause").agg(F.count(F.lit(1)).alias("need")), ["leaf", "clause"])


def matches(parts: DataFrame, keys: Sequence[str], taxonomy: DataFrame) -> DataFrame:
    """keys, process: the leaves one of whose clauses has all its tokens among an item's components."""
    hits = parts.join(small(clauses(taxonomy)), ["kind", "label"]).groupBy(*keys, "leaf", "clause", "need").agg(F.count(F.lit(1)).alias("have"))
    return hits.filter("have = need").select(*keys, F.col("leaf").alias("process")).distinct()


def gated(found: DataFrame, keys: Sequence[str], taxonomy: DataFrame) -> DataFrame:
    """Of the matching rules of a group only those of the best (lowest) priority fire; rules without a
    group all do."""
    known = taxonomy.select(F.col("leaf").alias("process"), "grp", "priority")
    ranked = found.join(small(known), "process")
    best = ranked.filter("grp IS NOT NULL").groupBy(*keys, "grp").agg(F.min("priority").alias("best"))
    fired = ranked.join(best, [*keys, "grp"], "left").filter("grp IS NULL OR priority = best")
    return fired.select(*keys, "process")


def exclusions(parts: DataFrame, keys: Sequence[str], taxonomy: DataFrame) -> DataFrame:
    """keys, process: the leaves that one of an item's components excludes."""
    kind, label = _token(F.col("token"))
    tokens = taxonomy.select("leaf", F.explode("excluded_by").alias("token")).select("leaf", kind.alias("kind"), label.alias("label")).distinct()
    return parts.join(small(tokens), ["kind", "label"]).select(*keys, F.col("leaf").alias("process")).distinct()


def asked_for(taxonomy: DataFrame, does: DataFrame) -> DataFrame:
    """label: all that a rule, an exclusion, a leaf or ``does`` names. Ancestors that none of them names can't decide
    anything."""
    of = lambda token: _token(token)[1].alias("label")
    rows = clauses(taxonomy).select("label").unionByName(taxonomy.select(F.explode("excluded_by").alias("token")).select(of(F.col("token"))))
    return rows.unionByName(taxonomy.select(F.col("leaf").alias("label"))).unionByName(does.select(F.col("equipment").alias("label"))).distinct()


def reduced(up: DataFrame, taxonomy: DataFrame, does: DataFrame) -> DataFrame:
    """The closure cut to the ancestors that are asked for (a semi-join before items meet it): a large hierarchy
    shrinks to what the rules speak of."""
    bare = F.col("ancestor")
    for kind in KINDS:
        bare = F.when(F.startswith(F.col("ancestor"), F.lit(kind + "-")), tx.without_prefix(F.col("ancestor"), kind + "-")).otherwise(bare)
    return up.withColumn("label", bare).join(small(asked_for(taxonomy, does)), "label", "left_semi").select(*up.columns)


def item_processes(items: DataFrame, keys: Sequence[str], taxonomy: DataFrame, up: DataFrame, does: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """keys, process: what each item shows, after rules, exclusions, pruning in three stages and backfill.
    ``parts``: the items' components, if they are at hand."""
    parts = saved(components(items, keys, reduced(up, taxonomy, does), does)) if parts is None else parts
    leaf = taxonomy.select(F.col("leaf").alias("label"))
    direct = parts.filter("kind = 'Process'").join(small(leaf), "label", "left_semi").select(*keys, F.col("label").alias("process"))
    ungated = saved(matches(parts, keys, taxonomy))
    present = saved(direct.unionByName(gated(ungated, keys, taxonomy)).distinct())
    out = exclusions(parts, keys, taxonomy).join(present, [*keys, "process"], "left_semi")
    rows = present.join(out, [*keys, "process"], "left_anti").withColumn("status", F.lit("PRESENT"))
    rows = saved(priority.three_stages(rows, keys, taxonomy))
    rows = priority.backfill(rows, keys, taxonomy, matched=ungated, excluded=out)
    return rows.filter("status = 'PRESENT'").select(*keys, "process")


def triggers(shown: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, trigger_process: the sorted processes that each item shows."""
    return shown.groupBy(*keys).agg(F.sort_array(F.collect_set("process")).alias("trigger_process"))


def _multi(taxonomy: DataFrame) -> tuple[list, list, list]:
    """The facility-wide rules: (rule, leaf), (rule, equipment), (rule, role, low, high)."""
    rules, equipment, bounds = [], [], []
    for leaf, text in taxonomy.select("leaf", "multi").collect():  # bounded: a taxonomy
        for rule in json.loads(text):
            rules.append((len(rules), leaf, len(rule.get("role_counts", {}))))
            equipment += [(rules[-1][0], e) for e in set(rule["Equipment"])]
            bounds += [(rules[-1][0], role, b.get("min", 0), b.get("max")) for role, b in rule.get("role_counts", {}).items()]
    return rules, equipment, bounds


def facility_processes(items: DataFrame, document: str, item: str, taxonomy: DataFrame, up: DataFrame, does: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """document, process, status by rules over all items of a document: items with one of the rule's
    equipment classes match; the counts of roles in them (as written) must lie within the rule's bounds;
    a component of a matching item that excludes the leaf cancels the rule; the status is the best of
    the matching items'."""
    spark, keys = items.sparkSession, [document, item]
    listed = _multi(taxonomy)
    kinds = ("rule int, leaf string, n_bounds int", "rule int, label string", "rule int, role string, low int, high int")
    rules, equipment, bounds = (spark.createDataFrame(rows, kind) for rows, kind in zip(listed, kinds))
    if not listed[0]:
        return items.select(document).limit(0).select(document, F.lit("").alias("process"), F.lit("").alias("status"))
    parts = saved(components(items, keys, up, does)) if parts is None else parts
    matching = parts.filter("kind = 'Equipment'").join(F.broadcast(equipment), "label").select(*keys, "rule").distinct()  # a taxonomy's rules
    matching = saved(matching.join(F.broadcast(rules), "rule"))
    cancelled = matching.join(exclusions(parts, keys, taxonomy), [*keys]).filter("leaf = process").select(document, "rule").distinct()
    with_items = matching.join(items.select(*keys, "Role", "Implementation", "Location"), keys).join(cancelled, [document, "rule"], "left_anti")
    status = with_items.groupBy(document, "rule", "leaf", "n_bounds").agg(st.best(st.of_implementation(F.col("Implementation"), F.col("Location"))).alias("status"))
    counts = with_items.select(document, "rule", F.explode("Role").alias("role")).groupBy(document, "rule", "role").agg(F.count(F.lit(1)).alias("n"))
    asked = status.select(document, "rule").join(F.broadcast(bounds), "rule").join(counts, [document, "rule", "role"], "left")
    n = F.coalesce("n", F.lit(0))
    kept = asked.filter((n >= F.col("low")) & (F.col("high").isNull() | (n <= F.col("high")))).groupBy(document, "rule").agg(F.count(F.lit(1)).alias("met"))
    fine = status.join(kept, [document, "rule"], "left").filter(F.coalesce("met", F.lit(0)) == F.col("n_bounds"))
    return fine.filter("status IS NOT NULL").select(document, F.col("leaf").alias("process"), "status")


def document_statuses(items: DataFrame, document: str, item: str, taxonomy: DataFrame, up: DataFrame, does: DataFrame) -> DataFrame:
    """document, process, status: the best status of the items that show a process, and of the rules over
    all items. Within a document statuses are ranked, not joined."""
    parts = saved(components(items, [document, item], up, does))
    shown = item_processes(items, [document, item], taxonomy, up, does, parts)
    when = items.select(document, item, st.of_implementation(F.col("Implementation"), F.col("Location")).alias("status"))
    rows = shown.join(when, [document, item]).select(document, "process", "status")
    rows = rows.unionByName(facility_processes(items, document, item, taxonomy, up, does, parts))
    return rows.groupBy(document, "process").agg(st.best(F.col("status")).alias("status")).filter("status IS NOT NULL")


def listed_statuses(items: DataFrame, document: str, taxonomy: DataFrame) -> DataFrame:
    """document, process, status of items that name leaves directly."""
    rows = items.select(document, F.explode("Process").alias("process"), st.of_implementation(F.col("Implementation"), F.col("Location")).alias("status"))
    rows = rows.join(small(taxonomy.select(F.col("leaf").alias("process"))), "process", "left_semi")
    return rows.groupBy(document, "process").agg(st.best(F.col("status")).alias("status")).filter("status IS NOT NULL")


def runs(of: dict[tuple[str, str], DataFrame], labels: DataFrame, key: str, metadata: Sequence[str]) -> DataFrame:
    """Manual labels (key, metadata, process, status) and the predictions (key, process, status) of every
    (method, model), stacked; predictions get the labels' metadata by key."""
    out = labels.select(F.lit("Manual Read").alias("method"), F.lit(None).cast("string").alias("model"), key, *metadata, "process", "status")
    about = labels.groupBy(key).agg(*(F.max(c).alias(c) for c in metadata))
    for (method, model), found in of.items():
        rows = found.select(F.lit(method).alias("method"), F.lit(model).alias("model"), key, "process", "status").join(about, key, "left")
        out = out.unionByName(rows.select(*out.columns))
    return out
