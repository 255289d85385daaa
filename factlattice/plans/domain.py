"""Registered queries of the domain's operators over the driver's tables, and their SQL.

The tables stand in for the domain's: documents and pages for permits, orders for a facility's documents,
events for dated observations and survey records, conversations for extraction records and token usage.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from factlattice.functions import dates, numbers
from factlattice.functions import status as st
from factlattice.functions import text as tx
from factlattice.operators import emissions, keywords, needs, permits, priority, records, rules, scoring, survey, taxonomy
from factlattice.operators import relational as rel
from factlattice.session import table
from factlattice.sinks import files
from factlattice.sources import pages as page_source
from factlattice.streaming import incremental

from .catalogue import _CASE, _DECODE, ORACLE, QUERIES, _event_status, query

__all__ = ["ORACLE", "QUERIES"]


def _leaf(names=(), cased=(), **more):
    return {"alt_names": list(names), "alt_names_case_sensitive": list(cased), **more}


#: A small taxonomy whose terms occur in the documents, and whose rules speak of event types (authored).
TREE = {
    "Clarification": {"Settling": {"Primary Settling": _leaf(["tion"], priority=1, secondary_category=["Chemistry"]), "Unspecified Settling": _leaf(["ung"], priority=5, global_priority=2)}},
    "Filtration": {"Sand Filter": _leaf(["with"], priority=1), "Unspecified Filtration": _leaf(["mit"], priority=3, global_priority=2)},
    "Chemistry": {"Dosing": _leaf(["idiot"], priority=1), "Unspecified Chemistry": _leaf(["zzzz"], priority=9)},
    "Light": {"UV Disinfection": _leaf([], ["The", "UV"], priority=1)},
}
LEAVES = [(leaf, group, category, d["priority"], d.get("global_priority", 1)) for _, leaf, group, category, d in ((0, n, g, c, d) for c, inner in TREE.items() for n, d, g in taxonomy.leaves({c: inner}))]
_TAX = "tax(leaf, grp, category, priority, gpriority) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}', {p}, {g})" for a, b, c, p, g in LEAVES) + ")"
_FOUND = {"Primary Settling": "contains(lower({0}), 'tion')", "Unspecified Settling": "contains(lower({0}), 'ung')", "Sand Filter": "contains(lower({0}), 'with')", "Unspecified Filtration": "contains(lower({0}), 'mit')", "Dosing": "contains(lower({0}), 'idiot')", "UV Disinfection": "(contains({0}, 'The') OR regexp_matches({0}, '(^|[^A-Za-z0-9])UVs?($|[^A-Za-z0-9])'))"}
_NAMED = "named AS (" + " UNION ALL ".join(f"SELECT doc_id, '{leaf}' AS process, CASE WHEN {t.format('d')} AND {t.format('c')} THEN 'PRESENT_AND_FUTURE' WHEN {t.format('d')} THEN 'PRESENT' ELSE 'FUTURE' END AS status FROM p WHERE trim(d) <> '' AND ({t.format('d')} OR {t.format('c')})" for leaf, t in _FOUND.items()) + ")"
_PARTS = "p AS (SELECT doc_id, CASE WHEN strpos(text, '. ') > 0 THEN substr(text, 1, strpos(text, '. ') - 1) ELSE text END AS d, CASE WHEN strpos(text, '. ') > 0 THEN substr(text, strpos(text, '. ') + 2) ELSE '' END AS c FROM documents WHERE text IS NOT NULL)"
_KEYWORDS = f"{_PARTS}, {_TAX}, {_NAMED}, r AS (SELECT n.*, t.grp, t.category, t.priority, CASE WHEN n.status <> 'FUTURE' THEN 1 ELSE 0 END AS pr FROM named n JOIN tax t ON n.process = t.leaf), best AS (SELECT doc_id, grp, min(priority) AS best FROM r WHERE pr = 1 GROUP BY 1, 2), kept AS (SELECT r.* FROM r LEFT JOIN best b ON r.doc_id = b.doc_id AND r.grp = b.grp WHERE r.pr = 0 OR r.priority = b.best), fill AS (SELECT DISTINCT doc_id, 'Unspecified Chemistry' AS process, 'PRESENT' AS status FROM kept WHERE process = 'Primary Settling' AND pr = 1 AND doc_id NOT IN (SELECT doc_id FROM kept WHERE category = 'Chemistry' AND pr = 1)), kw AS (SELECT doc_id, process, status FROM kept UNION ALL SELECT * FROM fill)"


def _tax(spark):
    return taxonomy.table(spark, TREE)


@query(f"WITH {_KEYWORDS} SELECT * FROM kw")
def keyword_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter("text IS NOT NULL")
    return keywords.table(docs, "doc_id", _tax(spark), mark=". ")


@query(f"WITH {_PARTS}, {_TAX}, {_NAMED} SELECT leaf, grp, category, priority, gpriority AS global_priority, count(doc_id) AS documents FROM tax LEFT JOIN named ON process = leaf GROUP BY ALL")
def taxonomy_leaves(spark, sf_dir):
    """The leaves with the number of documents that name each."""
    docs, tax = table(spark, sf_dir, "documents").select("doc_id", "text"), _tax(spark)
    named = keywords.named(docs, "doc_id", tax, mark=". ").groupBy(F.col("process").alias("leaf")).agg(F.count(F.lit(1)).alias("documents"))
    return tax.join(named, "leaf", "left").select("leaf", "grp", "category", "priority", "global_priority", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"))


_BITS = "CASE status WHEN 'PAST' THEN 1 WHEN 'OFFSITE' THEN 2 WHEN 'FUTURE' THEN 4 WHEN 'PRESENT' THEN 8 WHEN 'PRESENT_AND_FUTURE' THEN 12 END"


@query(f"WITH {_KEYWORDS}, j AS (SELECT source, process, status FROM kw JOIN documents USING (doc_id)) SELECT source, category, {_DECODE.format('mask')} AS status FROM (SELECT source, category, bit_or({_BITS}) AS mask FROM j JOIN tax ON process = leaf GROUP BY 1, 2)")
def category_rollup(spark, sf_dir):
    found = keyword_table(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    categories = _tax(spark).select(F.col("leaf").alias("process"), "category")
    return scoring.by_category(found, "source", categories).withColumnRenamed("process", "category")


# Documents of customers: order numbers printed in them, listed ones, and whether they show anything.
_DOCS = "docs AS (SELECT CAST(o_custkey AS VARCHAR) AS place_id, CAST(o_orderkey AS VARCHAR) AS document, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'R5-' || year(o_orderdate) || '-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') WHEN 2 THEN substr(CAST(year(o_orderdate) AS VARCHAR), 3, 2) || '-' || (o_orderkey % 97) ELSE 'wq ' || year(o_orderdate) || ' ' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') || '-DWQ' END AS document_order, year(o_orderdate) || '-' || lpad(CAST(o_custkey AS VARCHAR), 4, '0') AS order_no, CASE o_orderstatus WHEN 'O' THEN '2021-06-01;2022-06-01' WHEN 'P' THEN '2022-06-01' ELSE '2021-06-01' END AS as_of_dates, CASE WHEN o_orderpriority = '5-LOW' THEN '0' ELSE 'PRESENT' END AS status FROM orders)"
_NORMAL = "CASE WHEN regexp_replace(upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')), '^WQ', '') <> '' THEN regexp_replace(upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')), '^WQ', '') ELSE upper(regexp_replace({0}, '[^A-Za-z0-9]', '', 'g')) END"
_YEAR_TEXT = "regexp_replace(upper(regexp_replace(document_order, '\\s+', '', 'g')), '^R[0-9]{1,2}[A-Z]?-?', '')"
_IN_FORCE = f"{_DOCS}, listed AS (SELECT * FROM docs WHERE CAST(document AS BIGINT) % 3 = 0), held AS (SELECT DISTINCT place_id, {_NORMAL.format('order_no')} AS o FROM listed WHERE contains(as_of_dates, '2022-06-01')), n AS (SELECT d.*, {_NORMAL.format('document_order')} AS dn, {_NORMAL.format('order_no')} AS own, EXISTS (SELECT 1 FROM held h WHERE h.place_id = d.place_id) AS has FROM docs d), t AS (SELECT *, CASE WHEN document_order = '' THEN 1 WHEN has AND EXISTS (SELECT 1 FROM held h WHERE h.place_id = n.place_id AND (contains(h.o, n.dn) OR contains(n.dn, h.o))) THEN 0 WHEN NOT has AND (contains(own, dn) OR contains(dn, own)) THEN 0 ELSE 2 END + CASE WHEN status = '0' THEN 3 ELSE 0 END AS tier, coalesce(CAST(nullif(regexp_extract({_YEAR_TEXT}, '((?:19|20)[0-9]{{2}})', 1), '') AS INTEGER), CAST(nullif(regexp_extract({_YEAR_TEXT}, '^(?:[0-9]-)?([0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INTEGER) + CASE WHEN CAST(nullif(regexp_extract({_YEAR_TEXT}, '^(?:[0-9]-)?([0-9]{{2}})(?:[^0-9]|$)', 1), '') AS INTEGER) >= 90 THEN 1900 ELSE 2000 END, 0) AS y FROM n), k AS (SELECT *, min(tier) OVER (PARTITION BY place_id) AS best FROM t), b AS (SELECT *, max(y) OVER (PARTITION BY place_id) AS newest FROM k WHERE tier = best), force AS (SELECT * FROM b WHERE best % 3 <> 2 OR y = newest)"


def _documents(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    year, place = F.year("o_orderdate").cast("string"), F.lpad(F.col("o_custkey").cast("string"), 4, "0")
    kind = F.col("o_orderkey") % 4
    printed = (
        F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("R5-"), year, F.lit("-"), place))
        .when(kind == 2, F.concat(F.substring(year, 3, 2), F.lit("-"), (F.col("o_orderkey") % 97).cast("string"))).otherwise(F.concat(F.lit("wq "), year, F.lit(" "), place, F.lit("-DWQ")))
    )
    days = F.when(F.col("o_orderstatus") == "O", "2021-06-01;2022-06-01").when(F.col("o_orderstatus") == "P", "2022-06-01").otherwise("2021-06-01")
    return o.select(
        F.col("o_custkey").cast("string").alias("place_id"), F.col("o_orderkey").cast("string").alias("document"), printed.alias("document_order"), F.concat_ws("-", year, place).alias("order_no"),
        days.alias("as_of_dates"), F.when(F.col("o_orderpriority") == "5-LOW", "0").otherwise("PRESENT").alias("status"), "o_orderkey",
    )


def _now(spark, sf_dir):
    d = _documents(spark, sf_dir)
    listed = d.filter("o_orderkey % 3 = 0").select("place_id", "order_no", "as_of_dates")
    return permits.in_force(d.select("place_id", "document", "document_order", "order_no"), listed, d.select("place_id", "document", "status"), "2022-06-01")


@query(f"WITH {_IN_FORCE} SELECT place_id, document FROM force")
def documents_in_force(spark, sf_dir):
    return _now(spark, sf_dir).select("place_id", "document")


@query(f"WITH {_IN_FORCE} SELECT place_id, count(*) AS documents, max(CASE WHEN status = 'PRESENT' THEN 1 ELSE 0 END) = 1 AS shows FROM force GROUP BY 1")
def facility_documents(spark, sf_dir):
    d = _documents(spark, sf_dir).select("place_id", "document", "status")
    shown = _now(spark, sf_dir).join(d, ["place_id", "document"])
    return shown.groupBy("place_id").agg(F.count(F.lit(1)).alias("documents"), F.max(st.is_present(st.parse(F.col("status")))).alias("shows"))


@query("SELECT o_custkey AS place_id, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS as_of_dates, count(DISTINCT o_orderpriority) AS n_snapshots, o_orderstatus AS document, arg_max(year(o_orderdate), o_orderpriority || o_orderkey)::VARCHAR AS newest FROM orders GROUP BY o_custkey, o_orderstatus")
def snapshot_table(spark, sf_dir):
    """Snapshots (priorities stand for days): a row per place, order and document, the newest one's metadata."""
    o = table(spark, sf_dir, "orders")
    rows = o.select(F.col("o_custkey").alias("place_id"), F.lit("").alias("measure_id"), F.col("o_orderstatus").alias("order_no"), F.col("o_orderstatus").alias("document"), F.lit("A").alias("agency"), F.year("o_orderdate").cast("string").alias("newest"), F.col("o_orderpriority").alias("as_of"), "o_orderkey")
    last = rel.best_of(rows.withColumn("k", F.concat("as_of", F.col("o_orderkey").cast("string"))).groupBy("place_id", "measure_id", "order_no", "document", "agency", "as_of").agg(F.max_by("newest", "k").alias("newest")), ["place_id", "document", "as_of"], [F.col("newest")])
    return permits.snapshot_union(last).select("place_id", "as_of_dates", "n_snapshots", "document", "newest")


def _user_hour(name):
    """A user in one hour of the day, as a number."""
    return (F.col("user_id") * 24 + F.hour("ts")).alias(name)




@query("WITH u AS (SELECT DISTINCT user_id, event_type FROM events), m AS (SELECT user_id, min(CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 WHEN 'click' THEN 2 ELSE 3 END) AS best FROM u WHERE event_type IN ('purchase', 'click', 'signup') AND (user_id + length(event_type)) % 3 = 0 GROUP BY 1) SELECT u.user_id, u.event_type AS process, CASE WHEN (u.user_id + length(u.event_type)) % 3 = 0 THEN 'PRESENT' ELSE 'FUTURE' END AS status FROM u LEFT JOIN m ON u.user_id = m.user_id WHERE u.event_type NOT IN ('purchase', 'click', 'signup') OR (u.user_id + length(u.event_type)) % 3 <> 0 OR (CASE u.event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 2 END) = m.best")
def sibling_prune(spark, sf_dir):
    """Of present siblings only the best priority stays; those that aren't present neither compete nor go."""
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("process")).distinct()
    e = e.withColumn("status", F.when((F.col("user_id") + F.length("process")) % 3 == 0, "PRESENT").otherwise("FUTURE"))
    group = F.when(F.col("process").isin("purchase", "click", "signup"), "g")
    return priority.prune(e, ["user_id"], group, F.when(F.col("process") == "purchase", 1).otherwise(2))


RULE_TREE = {
    "Basic": {"Group": {"Active": _leaf(priority=1, ontology_triggers=[["Process-click", "Process-view"]]), "Any": _leaf(priority=5, ontology_triggers=[["Process-click"], ["Process-error"]], global_priority=1)}},
    "Filtration": {"Buyer": _leaf(priority=1, ontology_triggers=[["Process-purchase", "Process-signup"]], exclude_if_any=["Role-night"], secondary_category=["Extra"]), "Unspecified Filtration": _leaf(priority=2, global_priority=2, ontology_triggers=["Process-purchase"])},
    "Extra": {"Unspecified Extra": _leaf(priority=9)},
}
_ITEMS = "SELECT user_id, CAST(floor(hour(ts) / 4) AS INTEGER) AS item, event_type, ts FROM events"
_RULES = f"WITH i AS ({_ITEMS}), h AS (SELECT user_id, item, max((event_type = 'click')::INT) AS cl, max((event_type = 'view')::INT) AS vi, max((event_type = 'error')::INT) AS er, max((event_type = 'purchase')::INT) AS pu, max((event_type = 'signup')::INT) AS si, max((hour(ts) < 6)::INT) AS night FROM i GROUP BY 1, 2), r AS (SELECT user_id, item, 'Active' AS process FROM h WHERE cl = 1 AND vi = 1 UNION ALL SELECT user_id, item, 'Any' FROM h WHERE (cl = 1 OR er = 1) AND NOT (cl = 1 AND vi = 1) UNION ALL SELECT user_id, item, 'Buyer' FROM h WHERE pu = 1 AND si = 1 AND night = 0 UNION ALL SELECT user_id, item, 'Unspecified Extra' FROM h WHERE pu = 1 AND si = 1 AND night = 0 UNION ALL SELECT user_id, item, 'Unspecified Filtration' FROM h WHERE pu = 1 AND si = 0 AND cl = 0 AND er = 0)"


def _items(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    none = F.array().cast("array<string>")
    roles = F.array_compact(F.array_distinct(F.collect_list(F.when(F.hour("ts") < 6, "night"))))
    g = e.groupBy("user_id", F.floor(F.hour("ts") / 4).cast("int").alias("item")).agg(F.collect_set("event_type").alias("Process"), roles.alias("Role"))
    when = F.when(F.col("item") == 5, "future").otherwise("present")
    return g.select("user_id", "item", none.alias("Equipment"), "Process", "Role", none.alias("Substance"), when.alias("Implementation"), F.when(F.col("item") == 4, "off-site").alias("Location"))


def _world(spark):
    edges = spark.createDataFrame([("Process-x", "Process-y")], "child string, parent string")
    return rel.ancestors(edges, "child", "parent"), spark.createDataFrame([], "equipment string, process string")


# Where Buyer is excluded, Unspecified Filtration is gated away: both belong to one group, and Buyer's rule fired.
# Beside Active or Any it goes by its global priority.
@query(_RULES + " SELECT * FROM r")
def rule_mapper(spark, sf_dir):
    return rules.item_processes(_items(spark, sf_dir), ["user_id", "item"], taxonomy.table(spark, RULE_TREE), *_world(spark))


@query(_RULES + ", s AS (SELECT user_id, process, max(CASE WHEN item = 5 THEN 3 WHEN item = 4 THEN 2 ELSE 4 END) AS rank FROM r GROUP BY 1, 2) SELECT user_id, process, CASE rank WHEN 4 THEN 'PRESENT' WHEN 3 THEN 'FUTURE' ELSE 'OFFSITE' END AS status FROM s")
def document_mapper(spark, sf_dir):
    return rules.document_statuses(_items(spark, sf_dir), "user_id", "item", taxonomy.table(spark, RULE_TREE), *_world(spark))


MULTI_TREE = {"Basic": {"Pair": _leaf(ontology_triggers_multi=[{"Equipment": ["assistant"], "role_counts": {"long": {"min": 1, "max": 3}, "short": {"max": 2}}}], exclude_if_any=["Role-none"])}}


@query("WITH t AS (SELECT conv_id, role, CASE WHEN length(text) > 300 THEN 'long' ELSE 'short' END AS r FROM conversations WHERE role = 'assistant' AND text IS NOT NULL) SELECT conv_id, 'Pair' AS process, 'PRESENT' AS status FROM t GROUP BY 1 HAVING count(*) FILTER (WHERE r = 'long') BETWEEN 1 AND 3 AND count(*) FILTER (WHERE r = 'short') <= 2")
def facility_rules(spark, sf_dir):
    """Rules over all items of a document: counts of roles in the matching ones must lie within bounds."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    none = F.array().cast("array<string>")
    items = c.select("conv_id", F.col("turn").alias("item"), F.array("role").alias("Equipment"), none.alias("Process"), F.array(F.when(F.length("text") > 300, "long").otherwise("short")).alias("Role"), none.alias("Substance"), F.lit("present").alias("Implementation"), F.lit(None).cast("string").alias("Location"))
    return rules.facility_processes(items, "conv_id", "item", taxonomy.table(spark, MULTI_TREE), *_world(spark))


@query(
    "WITH c AS (SELECT *, conv_id % 6 AS kind FROM conversations WHERE text IS NOT NULL) "
    "SELECT conv_id, kind = 4 AS valid, '' AS failure, CAST(turn AS BIGINT) AS item, CASE WHEN role = 'user' THEN 'present' ELSE 'future' END AS implementation, 'a' || length(text) AS process FROM c WHERE kind NOT IN (3, 5) "
    "UNION ALL SELECT DISTINCT conv_id, false, CASE WHEN kind = 3 THEN 'not JSON' ELSE 'no list of items' END, CAST(-1 AS BIGINT), '', '' FROM c WHERE kind IN (3, 5)"
)
def json_records(spark, sf_dir):
    """Items written in the shapes that writers give them, odd and valid, mended and read; failures with their reason, item -1."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    named, nothing = F.concat(F.lit("a"), F.length("text").cast("string")), F.lit(None).cast("string")
    when = F.when(F.col("role") == "user", "present").otherwise("future")
    item = F.struct(F.array(named).alias("Process"), F.array(when).alias("Implementation"), F.array().cast("array<string>").alias("Role"))
    plain = F.struct(named.alias("Process"), when.alias("Implementation"), F.lit(" ").alias("Role"))
    whole = F.struct(nothing.alias("Equipment"), F.array(named).alias("Process"), nothing.alias("Role"), nothing.alias("Substance"), when.alias("Implementation"), nothing.alias("Location"), F.col("text").alias("Sentence"))
    odd = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", item.alias("i"), plain.alias("p"), whole.alias("w")))).alias("l"))
    json = lambda field: F.to_json(F.transform("l", lambda x: x[field]), {"ignoreNullFields": "false"})
    around = lambda start, field, end: F.concat(F.lit(start), json(field), F.lit(end))
    kind = F.col("conv_id") % 6
    body = F.when(kind == 0, json("i")).when(kind == 1, around('{"results": ', "p", "}")).when(kind == 2, around('{"output": {"items": ', "i", "}}")).when(kind == 3, around('{"items": ', "w", "} and so on"))
    body = body.when(kind == 4, around('{"items": ', "w", "}")).otherwise(around('{"records": ', "w", "}"))
    found = odd.select("conv_id", records.read(body).alias("r"))
    items = found.select("conv_id", "r.valid", "r.failure", F.posexplode_outer("r.items").alias("item", "i"))
    filled = lambda value: F.coalesce(value, F.lit(""))
    return items.select("conv_id", "valid", filled(F.col("failure")).alias("failure"), F.coalesce(F.col("item").cast("long"), F.lit(-1)).alias("item"), filled(F.col("i.Implementation")).alias("implementation"), filled(F.col("i.Process")[0]).alias("process"))


# Survey records from lineitem: supplier = facility, ship year = survey, return flag = process name.
SURVEY_TREE = {"C": {"Alpha": _leaf(cwns_processes=["a", "r"]), "Beta": _leaf(cwns_processes=["N "])}}
_SURVEY = "s AS (SELECT lpad(CAST(l_suppkey AS VARCHAR), 10, '7') AS id, year(l_shipdate) AS y, l_returnflag AS f, CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END AS pres, CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS proj, CASE WHEN l_linestatus = 'F' AND l_linenumber = 6 THEN 'New, No Change' ELSE 'No Change' END AS change, l_orderkey * 10 + l_linenumber AS place FROM lineitem), a AS (SELECT * FROM s WHERE pres = 1 OR proj = 1), latest AS (SELECT *, CASE WHEN pres = 1 AND proj = 1 THEN CASE WHEN change LIKE 'New%' THEN 'PRESENT_AND_FUTURE' ELSE 'PRESENT' END WHEN pres = 1 THEN 'PRESENT' ELSE 'FUTURE' END AS status, CASE WHEN f = 'N' THEN 'Beta' ELSE 'Alpha' END AS leaf FROM a QUALIFY row_number() OVER (PARTITION BY id, f ORDER BY y DESC, place DESC) = 1)"


def _survey(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    yes = lambda n: F.when(F.col("l_linenumber") % n == 0, "Y").otherwise("N")
    change = F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 6), "New, No Change").otherwise("No Change")
    raw = li.select(F.lpad(F.col("l_suppkey").cast("string"), 10, "7").alias("survey_id"), F.year("l_shipdate").alias("year"), F.col("l_returnflag").alias("process"), yes(2).alias("present"), yes(3).alias("projected"), change.alias("change"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    names = spark.createDataFrame([("A", "A"), ("R", "R "), ("N", "n")], "process string, common string")
    places = raw.select("survey_id", "year", "process", "present", "projected", "change", "place")
    both = places.filter("NOT (present = 'N' AND projected = 'N')").join(F.broadcast(names), "process")
    return both.select(tx.one_zero(F.col("survey_id")).alias("survey_id"), "year", survey.flag(F.col("present")).alias("present"), survey.flag(F.col("projected")).alias("projected"), "change", F.col("common").alias("process"), "place")


@query(f"WITH {_SURVEY} SELECT '0' || id AS survey_id, leaf AS process, status FROM latest QUALIFY row_number() OVER (PARTITION BY id, leaf ORDER BY y, place) = 1")
def survey_statuses(spark, sf_dir):
    return survey.statuses(_survey(spark, sf_dir), taxonomy.table(spark, SURVEY_TREE))


@query("WITH e AS (SELECT CAST(least(floor((day(ts) - 1) / 10), 2) AS INTEGER) AS w, user_id * 24 + hour(ts) AS user_id, event_type FROM events), years(w) AS (VALUES (0), (1), (2)), f AS (SELECT user_id, min(w) AS w FROM e GROUP BY 1), sets AS (SELECT user_id, w, list_sort(list(DISTINCT event_type)) AS t FROM e GROUP BY 1, 2), ch AS (SELECT a.w, count(*) AS n FROM sets a JOIN sets b ON a.user_id = b.user_id AND a.w = b.w + 1 AND a.t <> b.t GROUP BY 1), la AS (SELECT w, count(*) AS n FROM (SELECT user_id, max(w) AS w FROM e GROUP BY 1) GROUP BY 1), tot AS (SELECT count(*) AS n FROM f) SELECT y.w AS year, (SELECT count(*) FROM f WHERE f.w = y.w) AS new, CASE WHEN y.w > 0 THEN CAST(coalesce(ch.n, 0) AS VARCHAR) END AS changed, coalesce(la.n, 0) AS recent, tot.n AS total, CAST(round_even(100.0 * (SELECT count(*) FROM f WHERE f.w = y.w) / tot.n, 1) AS DOUBLE) AS new_percent FROM years y LEFT JOIN ch ON ch.w = y.w LEFT JOIN la ON la.w = y.w, tot")
def survey_table(spark, sf_dir):
    """Coverage by survey (thirds of a month): new facilities (a user in an hour of the day), changed sets of processes,
    most recent records."""
    e = table(spark, sf_dir, "events").select(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)).cast("int").alias("year"), _user_hour("facility"), F.col("event_type").alias("process"))
    return survey.coverage(e, e, e, [0, 1, 2]).select("year", "new", F.col("changed").cast("string").alias("changed"), "recent", "total", "new_percent")


# Labels and predictions of statuses per user's hour of the day and process: two halves of the month.
_HALVES = f"SELECT user_id * 24 + hour(ts) AS user_id, event_type, {_CASE} AS status, day(ts) AS d, event_id FROM events"
_LABELS = f"l AS (SELECT user_id AS k, event_type AS process, {_DECODE.format('bit_or(' + _BITS + ')')} AS status FROM ({_HALVES}) WHERE d <= 15 GROUP BY 1, 2), p AS (SELECT user_id AS k, event_type AS process, {_DECODE.format('bit_or(' + _BITS + ')')} AS status FROM (SELECT user_id, event_type, CASE WHEN event_id % 2 = 0 THEN status ELSE 'FUTURE' END AS status, d FROM ({_HALVES})) WHERE d > 15 GROUP BY 1, 2)"
_CELLS = "c AS (SELECT k, process, max(m) AS m, max(p) AS p, max(ms) AS ms, max(ps) AS ps FROM (SELECT k, process, CASE WHEN status IN ({0}) THEN 1 ELSE 0 END AS m, 0 AS p, status AS ms, NULL AS ps FROM l UNION ALL SELECT k, process, 0, CASE WHEN status IN ({0}) THEN 1 ELSE 0 END, NULL, status FROM p WHERE k IN (SELECT k FROM l)) GROUP BY 1, 2)"
_NARROW, _WIDE = "'PRESENT', 'PRESENT_AND_FUTURE'", "'PRESENT', 'PRESENT_AND_FUTURE', 'FUTURE', 'OFFSITE'"
SCORE_TREE = {"Use": {"click": _leaf(), "view": _leaf(), "purchase": _leaf()}, "Else": {"signup": _leaf(), "error": _leaf()}}


def _labels(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(_user_hour("k"), F.col("event_type").alias("process"), _event_status().alias("status"), F.dayofmonth("ts").alias("d"), "event_id")
    labels = permits.collapsed(e.filter("d <= 15"), ["k"])
    odd = e.withColumn("status", F.when(F.col("event_id") % 2 == 0, F.col("status")).otherwise("FUTURE"))
    return labels, permits.collapsed(odd.filter("d > 15"), ["k"])


_SUMS = "count(*) FILTER (WHERE m = 1 AND p = 1) AS tp, count(*) FILTER (WHERE m = 0 AND p = 1) AS fp, count(*) FILTER (WHERE m = 1 AND p = 0) AS fn"


@query(f"WITH {_LABELS}, shared AS (SELECT k FROM l INTERSECT SELECT k FROM p), lb AS (SELECT * FROM l WHERE k IN (SELECT k FROM shared)), {_CELLS.format(_NARROW).replace('FROM l UNION', 'FROM lb UNION').replace('SELECT k FROM l)', 'SELECT k FROM shared)')}, s AS (SELECT process, {_SUMS}, count(*) FILTER (WHERE m = 1 AND ms = ps) AS good FROM c GROUP BY 1) SELECT process, tp + fn AS support_label, tp + fp AS support_predicted, tp, fp, fn, (SELECT count(*) FROM shared) - tp - fp - fn AS tn, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1, round(good / nullif(tp + fn, 0), 9) AS state_accuracy FROM s")
def label_metrics(spark, sf_dir):
    labels, found = _labels(spark, sf_dir)
    every = taxonomy.table(spark, SCORE_TREE).select(F.col("leaf").alias("process"))
    out = scoring.per_label(labels, found, "k", every)
    return out.select("process", "support_label", "support_predicted", "tp", "fp", "fn", "tn", F.round("f1", 9).alias("f1"), F.round("state_accuracy", 9).alias("state_accuracy"))


@query(f"WITH {_LABELS}, {_CELLS.format(_WIDE)}, u AS (SELECT k, {_SUMS}, count(*) FILTER (WHERE m = 1 AND replace(ms, 'PRESENT_AND_FUTURE', 'PRESENT') = replace(ps, 'PRESENT_AND_FUTURE', 'PRESENT')) AS good FROM c GROUP BY 1), f AS (SELECT k, {_SUMS} FROM (SELECT k, CASE WHEN process IN ('click', 'view', 'purchase') THEN 'Use' ELSE 'Else' END AS cat, max(m) AS m, max(p) AS p FROM c GROUP BY 1, 2) GROUP BY 1) SELECT (SELECT round(avg(2.0 * tp / nullif(2 * tp + fp + fn, 0)), 9) FROM u) AS macro_f1, (SELECT round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) FROM u) AS micro_f1, (SELECT round(avg(good / nullif(tp + fn, 0)), 9) FROM u) AS state_accuracy, (SELECT round(avg(2.0 * tp / nullif(2 * tp + fp + fn, 0)), 9) FROM f) AS category_f1")
def run_metrics(spark, sf_dir):
    out = scoring.run_scores(*_labels(spark, sf_dir), "k", taxonomy.table(spark, SCORE_TREE))
    return out.select(*(F.round(c, 9).alias(c) for c in ("macro_f1", "micro_f1", "state_accuracy", "category_f1")))


@query(f"WITH {_LABELS}, g AS (SELECT DISTINCT k, CASE WHEN process IN ('click', 'view', 'purchase') THEN 'Use' ELSE 'Else' END AS category FROM l WHERE status IN ({_NARROW})), q AS (SELECT DISTINCT k, CASE WHEN process IN ('click', 'view', 'purchase') THEN 'Use' ELSE 'Else' END AS category FROM p WHERE status IN ({_NARROW}) AND k IN (SELECT k FROM l)), j AS (SELECT coalesce(g.category, q.category) AS category, g.k IS NOT NULL AS m, q.k IS NOT NULL AS p FROM g FULL JOIN q ON g.k = q.k AND g.category = q.category) SELECT category, count(*) FILTER (WHERE m) AS in_truth, count(*) FILTER (WHERE m AND p) AS tp, count(*) FILTER (WHERE NOT m AND p) AS fp, count(*) FILTER (WHERE m AND NOT p) AS fn, round(count(*) FILTER (WHERE m AND NOT p) / count(*) FILTER (WHERE m), 9) AS missed FROM j GROUP BY 1")
def category_errors(spark, sf_dir):
    labels, found = _labels(spark, sf_dir)
    categories = taxonomy.table(spark, SCORE_TREE).select(F.col("leaf").alias("process"), "category")
    out = scoring.category_confusion(labels, {"p": found}, "k", categories)
    missed, _, _ = scoring.error_parts(F.col("tp"), F.col("fp"), F.col("fn"), "truth")
    return out.select("category", "in_truth", "tp", "fp", "fn", F.round(missed, 9).alias("missed"))


@query("SELECT CASE WHEN role = 'user' THEN 'a' ELSE 'b' END AS model, round(avg(CASE WHEN role = 'user' THEN length(text) / 1e6 * 3 + turn / 1e6 * 15 ELSE length(text) / 1e6 + turn / 1e6 * 5 END) + max(CASE WHEN role = 'user' THEN 0.25 ELSE 0 END), 9) AS cost, round(count(*) FILTER (WHERE turn % 3 = 0) / nullif(count(*) FILTER (WHERE turn % 3 < 2), 0), 9) AS structured FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def token_cost(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    said = F.when(F.col("turn") % 3 == 0, "True").when(F.col("turn") % 3 == 1, "false").otherwise("FAILED")
    usage = c.select(F.when(F.col("role") == "user", "a").otherwise("b").alias("model"), F.length("text").alias("prompt_tokens"), F.col("turn").alias("completion_tokens"), F.lit(None).cast("double").alias("billed"), said.alias("structured"))
    prices = spark.createDataFrame([("a", 3.0, 15.0), ("b", 1.0, 5.0)], "model string, input_price double, output_price double")
    out = scoring.mean_cost(usage, prices, ["model"], spark.createDataFrame([("a", 0.25)], "model string, extra double"))
    return out.select("model", F.round("cost", 9).alias("cost"), F.round("structured", 9).alias("structured"))


@query("SELECT population, count(*) AS n, CAST(round_even(100.0 * avg((r = 'R1')::INT), 1) AS DOUBLE) AS R1, CAST(round_even(100.0 * avg((r = 'R4')::INT), 1) AS DOUBLE) AS R4, CAST(round_even(100.0 * avg((c_mktsegment LIKE 'Major%')::INT), 0) AS DOUBLE) AS major, CAST(round_even(100.0 * avg((o >= 2)::INT), 1) AS DOUBLE) AS several FROM (SELECT c_mktsegment, 'R' || (c_nationkey % 5 + 1) AS r, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS o, unnest(CASE WHEN c_acctbal > 5000 THEN ['all', 'rich'] ELSE ['all'] END) AS population FROM customer) GROUP BY 1")
def representativeness(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, sf_dir, "customer").join(n, "c_custkey", "left")
    sites = c.select(F.col("c_custkey").alias("place_id"), F.concat(F.lit("R"), (F.col("c_nationkey") % 5 + 1).cast("string")).alias("region"), F.col("c_mktsegment").alias("size"), F.coalesce("n", F.lit(0)).alias("n_documents"), F.lit(False).alias("shared"), "c_acctbal")
    return scoring.profile(sites, {"all": sites, "rich": sites.filter("c_acctbal > 5000")}, ["R1", "R4"]).select("population", "n", "R1", "R4", "major", "several")


# Needs: plans of a user's hour of the day from events (the month's second half is the future), flows from its number,
# curves of two systems.
NEED_TREE = {"Lagoon": {"Unspecified Lagoon": _leaf(), "Aerated Lagoon": _leaf()}, "Activated Sludge": {"Unspecified AS": _leaf()}, "Disinfection": {"UV Disinfection": _leaf(), "Chlorination": _leaf()}}
NEED_LEAF = {"click": "Unspecified Lagoon", "view": "Aerated Lagoon", "purchase": "Unspecified AS", "signup": "UV Disinfection", "error": "Chlorination"}
_spec = lambda a, b: {"limit_mgd": 4.0, "segments": [{"max_mgd": 1.5, "form": "linear", "a": a, "b": b, "basis": "x"}, {"max_mgd": None, "form": "power", "a": a, "b": 0.5, "basis": "y"}]}
CURVES = {
    "cpi_adjustment": 1.2, "location_factor": 1.1, "national_average_location_factor": 1.0,
    "systems": {s: {c: _spec(10.0 * (i + 1), 5.0) for c in ("new", "treatment_upgrade", "system_expansion", "rehabilitation")} for i, s in enumerate(("lagoon", "aerated_lagoon", "secondary_mechanical"))} | {"add_disinfection": {"uv": _spec(7.0, 1.0), "chlorine": _spec(3.0, 1.0)}},
}
_TIER = "CASE process WHEN 'click' THEN 0 WHEN 'view' THEN 1 WHEN 'purchase' THEN 2 END"
_NEEDS = f"e AS (SELECT DISTINCT user_id * 24 + hour(ts) AS user_id, event_type AS process, day(ts) <= 15 AS now FROM events), s AS (SELECT user_id, process, max(now::INT) AS now, max((NOT now)::INT) AS later FROM e GROUP BY 1, 2), pl AS (SELECT user_id, max(CASE WHEN now = 1 THEN {_TIER} END) AS tn, max({_TIER}) AS tier, count(*) FILTER (WHERE now = 1) AS n_now, count(*) FILTER (WHERE now = 0) AS n_future, count(*) FILTER (WHERE now = 0 AND process IN ('signup', 'error')) AS n_dis, max((now = 0 AND process = 'signup')::INT) AS uv FROM s GROUP BY 1 HAVING count(*) FILTER (WHERE now = 0) > 0), fl AS (SELECT *, CASE WHEN user_id % 5 = 0 THEN (user_id % 4)::DOUBLE ELSE (user_id % 6) * 0.75 END AS flow, CASE WHEN user_id % 5 <> 0 THEN (user_id % 7) * 0.75 END AS ft FROM pl), k AS (SELECT *, CASE WHEN n_now = 0 THEN 'new' WHEN n_dis = n_future THEN 'add_disinfection' WHEN tier > tn THEN 'treatment_upgrade' WHEN flow > 0 AND ft > flow * 1.05 THEN 'system_expansion' ELSE 'rehabilitation' END AS kind FROM fl), m AS (SELECT *, CASE WHEN kind IN ('new', 'system_expansion') THEN ft ELSE flow END AS mgd FROM k), x AS (SELECT *, CASE WHEN coalesce(mgd, 0) <= 0 THEN 'no design flow' WHEN tier IS NULL AND kind <> 'add_disinfection' THEN 'unclassified system' ELSE '' END AS reason, CASE WHEN kind = 'add_disinfection' THEN CASE WHEN uv = 1 THEN 7.0 ELSE 3.0 END ELSE 10.0 * (tier + 1) END AS a, CASE WHEN kind = 'add_disinfection' THEN 1.0 ELSE 5.0 END AS b FROM m)"


def _costs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(_user_hour("user_id"), "event_type", F.dayofmonth("ts").alias("d"))
    leaf = F.create_map(*(F.lit(x) for kv in NEED_LEAF.items() for x in kv))
    rows = e.select("user_id", leaf[F.col("event_type")].alias("process"), F.when(F.col("d") <= 15, "PRESENT").otherwise("FUTURE").alias("status"))
    plans = needs.planned(rows, "user_id").withColumn("survey_id", F.col("user_id")).withColumn("facility_id", F.col("user_id"))
    users = e.select("user_id").distinct()
    six = users.filter("user_id % 5 <> 0").select(F.col("user_id").alias("survey_id"), ((F.col("user_id") % 6) * 0.75).cast("double").alias("flow"), ((F.col("user_id") % 7) * 0.75).cast("double").alias("flow_then"))
    listed = users.filter("user_id % 5 = 0").select(F.col("user_id").alias("facility_id"), (F.col("user_id") % 4).cast("double").alias("flow"))
    return needs.costed(plans, "user_id", taxonomy.table(spark, NEED_TREE), CURVES, six, listed)


@query(f"WITH {_NEEDS} SELECT user_id, kind AS construction_type, n_future::INT AS n_future, reason AS excluded_reason, CASE WHEN reason = '' THEN round(1.32 * CASE WHEN mgd <= 1.5 THEN a * mgd + b ELSE a * pow(mgd, 0.5) END, 6) END AS cost, CASE WHEN reason = '' THEN CAST(mgd <= 4.0 AS VARCHAR) END AS within_limit FROM x")
def needs_costed(spark, sf_dir):
    return _costs(spark, sf_dir).select("user_id", "construction_type", "n_future", "excluded_reason", F.round("cost", 6).alias("cost"), F.col("within_limit").cast("string").alias("within_limit"))


@query(f"WITH {_NEEDS} SELECT CASE WHEN kind = 'add_disinfection' THEN 'new' ELSE kind END AS construction_type, count(*) AS facilities, round(sum(1.32 * CASE WHEN mgd <= 1.5 THEN a * mgd + b ELSE a * pow(mgd, 0.5) END), 4) AS cost FROM x WHERE reason = '' AND mgd < 5 AND mgd <= 4.0 GROUP BY 1")
def needs_by_construction(spark, sf_dir):
    return needs.by_construction(_costs(spark, sf_dir)).select("construction_type", "facilities", F.round("cost", 4).alias("cost"))


# Emissions: suppliers are facilities; their codes are the return flags whose lines are larger than the supplier's mean.
_CODES = "co AS (SELECT k, code FROM (SELECT l_suppkey AS k, l_returnflag AS code, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2) QUALIFY q * sum(n) OVER (PARTITION BY k) > n * sum(q) OVER (PARTITION BY k)), fa AS (SELECT s_suppkey AS k, CAST(s_suppkey % 120 AS DOUBLE) + 0.5 AS flow FROM supplier), tr AS (SELECT k, 'T1' AS train FROM co WHERE code = 'A' UNION SELECT a.k, 'T2' FROM co a JOIN co b ON a.k = b.k WHERE a.code = 'N' AND b.code = 'R')"
_FACTORS = "fx(train, gas, factor) AS (VALUES ('T1', 'N2O', 0.25), ('T1', 'elec', 40.0), ('T2', 'N2O', 0.05), ('T2', 'CH4', 0.5), ('T2', 'NG_up', 0.125))"


def _trains(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("code")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    own = Window.partitionBy("k")  # a row per flag
    codes = lines.withColumn("larger", F.col("q") * F.sum("n").over(own) > F.col("n") * F.sum("q").over(own)).filter("larger").select("k", "code")
    facilities = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), ((F.col("s_suppkey") % 120).cast("double") + 0.5).alias("flow"))
    requires = spark.createDataFrame([("T1", "A"), ("T2", "N"), ("T2", "R")], "train string, code string")
    return facilities, codes, requires, emissions.trains(codes, "k", requires)


@query(f"WITH {_CODES}, {_FACTORS}, sh AS (SELECT tr.k, tr.train, fa.flow / count(*) OVER (PARTITION BY tr.k) AS f FROM tr JOIN fa USING (k)), em AS (SELECT k, gas, CASE WHEN gas = 'elec' THEN sum(f * factor) * 0.5 ELSE sum(f * factor) * 3785.412 END AS kg FROM sh JOIN fx USING (train) GROUP BY 1, 2) SELECT (SELECT count(*) FROM fa) AS n_facilities, (SELECT round(sum(flow), 6) FROM fa) AS flow, round(sum(kg) FILTER (WHERE gas IN ('CH4', 'N2O')) * 365 / 1e6, 6) AS scope1_kt, round(sum(kg) FILTER (WHERE gas = 'elec') * 365 / 1e6, 6) AS scope2_kt, round(sum(kg) FILTER (WHERE gas = 'NG_up') * 365 / 1e6, 6) AS scope3_kt, round(sum(kg) * 365 / 1e6, 6) AS total_kt FROM em")
def emission_totals(spark, sf_dir):
    facilities, _, _, trains = _trains(spark, sf_dir)
    factors = spark.createDataFrame([("T1", "N2O", 0.25), ("T1", "elec", 40.0), ("T2", "N2O", 0.05), ("T2", "CH4", 0.5), ("T2", "NG_up", 0.125)], "train string, gas string, factor double")
    kg = emissions.emitted(emissions.flows(trains, facilities, "k"), factors, facilities.withColumn("kg_per_kwh", F.lit(0.5)), "k")
    return emissions.totals(kg, facilities).select("n_facilities", *(F.round(c, 6).alias(c) for c in ("flow", "scope1_kt", "scope2_kt", "scope3_kt", "total_kt")))


_BIN = "CASE WHEN flow < 2 THEN '<2' WHEN flow < 4 THEN '2-4' WHEN flow < 7 THEN '4-7' WHEN flow < 16 THEN '7-16' WHEN flow < 46 THEN '16-46' WHEN flow < 100 THEN '46-100' ELSE '≥100' END"


@query(f"WITH {_CODES}, b AS (SELECT fa.*, {_BIN} AS bin FROM fa), n AS (SELECT bin, train, count(*) AS n FROM tr JOIN b USING (k) GROUP BY 1, 2), rb AS (SELECT bin, train, row_number() OVER (PARTITION BY bin ORDER BY n DESC, train) AS place, 0 AS stage FROM n), ra AS (SELECT train, row_number() OVER (ORDER BY sum(n) DESC, train) AS place, 1 AS stage FROM n GROUP BY train), o AS (SELECT * FROM b WHERE k NOT IN (SELECT k FROM tr)) SELECT k, arg_min(train, stage * 1000 + place) AS train FROM (SELECT o.k, rb.train, rb.place, rb.stage FROM o JOIN rb USING (bin) UNION ALL SELECT o.k, ra.train, ra.place, ra.stage FROM o, ra) GROUP BY 1")
def regional_fallback(spark, sf_dir):
    facilities, codes, requires, trains = _trains(spark, sf_dir)
    return emissions.fallback(facilities, "k", codes, trains, requires)


@query("SELECT r_regionkey AS area, round((r_regionkey + 1) * 1e9 / 1e6 / 1000 + (100.0 * (24 + 24 + 18 + 1.9 + 2.86 * 2 + 10.48 * 4 + 19.02 + 1.35 + 2.08 * 2) / 1000 * 3.6 * 1000) / 1e6 / 1000, 9) AS kg_per_kwh FROM region")
def grid_carbon(spark, sf_dir):
    areas = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("area"), (F.col("r_regionkey") + 1).cast("double").alias("co2_gen_mmt"), F.lit(1e6).alias("generation"), *(F.lit(100.0).alias(c) for cs in emissions.FUELS.values() for c in cs))
    return emissions.grid_intensity(areas).select("area", F.round("kg_per_kwh", 9).alias("kg_per_kwh"))


# Smaller operators.
@query("SELECT coalesce(lang, '(none)') AS lang, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM (SELECT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE lang END AS lang FROM documents) GROUP BY 1")
def value_counts_with_nulls(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 7 != 0, F.col("lang")).alias("lang"))
    g = d.groupBy(F.coalesce("lang", F.lit("(none)")).alias("lang")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("lang", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 9).alias("share"))  # a row per language


@query("SELECT p_partkey, regexp_matches(' ' || translate(lower(f), '._-', '   '), ' (map|memo|nov) ') OR contains(lower(f), 'report') OR contains(lower(f), 'study') AS skipped, regexp_matches(lower(f), '(^|[^a-z])(order|wdr)([^a-z]|$)') AS kept FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'my_map_' WHEN 1 THEN 'Report ' WHEN 2 THEN 'order-' WHEN 3 THEN 'remap ' WHEN 4 THEN 'memo.' ELSE 'wdrx ' END || p_name AS f FROM part)")
def file_names(spark, sf_dir):
    kind = F.col("p_partkey") % 6
    start = F.when(kind == 0, "my_map_").when(kind == 1, "Report ").when(kind == 2, "order-").when(kind == 3, "remap ").when(kind == 4, "memo.").otherwise("wdrx ")
    f = F.concat(start, F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", permits.name_skipped(f).alias("skipped"), permits.name_kept(f).alias("kept"))


@query("SELECT doc_id, contains(upper(coalesce(text, '')), 'TION') OR contains(upper(coalesce(text, '')), 'UNG') AS has_any, NOT starts_with(upper(coalesce(text, 'nan')), 'THE') AS other_start, lang = 'en' OR source = 'src1' AS any_of, lang = 'en' AND source = 'src1' AS all_of FROM documents")
def text_predicates(spark, sf_dir):
    upper = F.upper(F.col("text"))
    en, one = F.col("lang") == "en", F.col("source") == "src1"
    return table(spark, sf_dir, "documents").select("doc_id", tx.contains_any(upper, ["TION", "UNG"]).alias("has_any"), (~F.startswith(F.upper(F.coalesce("text", F.lit("nan"))), F.lit("THE"))).alias("other_start"), (en | one).alias("any_of"), (en & one).alias("all_of"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'R' || (o_orderkey % 9 + 1) WHEN o_orderkey % 3 = 1 THEN 'R' || substr(o_orderpriority, 1, 1) ELSE 'Unspecified' END AS region FROM orders")
def region_with_fallbacks(spark, sf_dir):
    k = F.col("o_orderkey")
    order = F.when(k % 3 == 0, F.concat(F.lit("x r"), (k % 9 + 1).cast("string"), F.lit("-2001"))).otherwise("7-R77")
    return table(spark, sf_dir, "orders").select("o_orderkey", permits.region(order, F.lit("f.pdf"), F.when(k % 3 == 1, F.col("o_orderpriority")).otherwise("SB")).alias("region"))


@query("SELECT o.o_orderkey, CAST(l.l_linenumber AS VARCHAR) AS l_linenumber, o.o_totalprice AS price, l.l_extendedprice AS price_right FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey AND o.o_orderkey % 7 + 1 = l.l_linenumber")
def composite_join(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("n"), F.col("o_totalprice").alias("price"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price"), F.col("l_linenumber").cast("string").alias("l_linenumber"))
    return rel.with_suffix(o, li, ["o_orderkey", "n"]).select("o_orderkey", "l_linenumber", "price", "price_right")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def pair_semi_join(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return rel.pair_semi(li, li.filter("l_returnflag = 'R' AND l_quantity > 45"), ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber")


@query("SELECT l.doc_id, coalesce(CAST(d.n_chars AS VARCHAR), 'missing') AS n FROM (SELECT doc_id FROM labels) l LEFT JOIN (SELECT doc_id, n_chars FROM documents WHERE doc_id % 2 = 0) d ON l.doc_id = d.doc_id")
def aligned_join(spark, sf_dir):
    found = table(spark, sf_dir, "documents").filter("doc_id % 2 = 0").select("doc_id", F.col("n_chars").cast("string").alias("n"))
    return rel.aligned(table(spark, sf_dir, "labels"), found, "doc_id", {"n": F.lit("missing")})


@query("WITH a AS (SELECT c_nationkey AS k, min(c_custkey) AS c FROM customer GROUP BY 1), b AS (SELECT s_nationkey AS k, min(s_suppkey) AS s FROM supplier GROUP BY 1) SELECT k, c, s FROM a JOIN b USING (k)")
def common_key_join(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("c"), F.col("c_custkey").alias("o"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_suppkey").alias("s"), F.col("s_suppkey").alias("o"))
    a, b = rel.common_keys(c, s, "k", "o")
    return a.select("k", "c").join(b.select("k", "s"), "k")


@query("SELECT p_partkey, lower(replace(p_name, ' ', '_')) || '_' || p_size AS file_key, s_suppkey FROM part JOIN supplier ON lower(replace(p_name, ' ', '_')) || '_' || p_size = lower(replace('Hot Gear', ' ', '_')) || '_' || (s_suppkey % 50)")
def file_key_join(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", records.file_key(F.concat("p_name", F.lit(".pdf")), F.col("p_size").cast("string")).alias("file_key"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", records.file_key(F.lit("Hot Gear.PDF"), (F.col("s_suppkey") % 50).cast("string")).alias("file_key"))
    return p.join(s, "file_key").select("p_partkey", "file_key", "s_suppkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON upper(trim(' ' || lower(a.n_name) || '  ')) = upper(trim(b.n_name))")
def name_join(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    left = n.select(F.col("n_nationkey").alias("a"), F.concat(F.lit(" "), F.lower("n_name"), F.lit("  ")).alias("name"))
    return permits.by_name(left, n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("other")), "name", "other").select("a", "b")


@query("SELECT DISTINCT a.p_partkey AS a, b.n_nationkey AS b FROM part a JOIN (SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN substr(p_name, 2, 4 + n_nationkey % 3) ELSE 'x' || p_name || 'y' END AS t FROM nation JOIN part ON p_partkey = n_nationkey + 1) b ON contains(a.p_name, b.t) OR contains(b.t, a.p_name)")
def text_containment(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    n = table(spark, sf_dir, "nation").join(p, F.col("p_partkey") == F.col("n_nationkey") + 1)
    t = F.when(F.col("n_nationkey") % 2 == 0, F.substring("p_name", F.lit(2), 4 + F.col("n_nationkey") % 3)).otherwise(F.concat(F.lit("x"), "p_name", F.lit("y")))
    return rel.containing(p.toDF("a", "ta"), "a", "ta", n.select(F.col("n_nationkey").alias("b"), t.alias("tb")), "b", "tb")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 's' WHEN l_quantity < 30 THEN 'm' ELSE 'l' END AS size FROM lineitem")
def range_join(spark, sf_dir):
    ranges = spark.createDataFrame([(None, 10.0, "s"), (10.0, 30.0, "m"), (30.0, None, "l")], "low double, high double, size string")
    return rel.in_ranges(table(spark, sf_dir, "lineitem"), ranges, F.col("l_quantity"), "low", "high").select("l_orderkey", "l_linenumber", "size")


@query("SELECT c_custkey, row_number() OVER (ORDER BY (coalesce(trim(s), '') = ''), lower(s), CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 ELSE 2 END, c_custkey) AS place FROM (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN ' ' WHEN c_custkey % 4 = 1 THEN upper(c_mktsegment) ELSE lower(c_mktsegment) END AS s FROM customer) ORDER BY place LIMIT 100")
def sorted_blank_last(spark, sf_dir):
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").withColumn("s", F.when(k % 4 == 0, " ").when(k % 4 == 1, F.upper("c_mktsegment")).otherwise(F.lower("c_mktsegment")))
    top = c.orderBy(*rel.blank_last("s"), rel.in_order("c_mktsegment", ["MACHINERY", "BUILDING"]), "c_custkey").limit(100)
    w = Window.orderBy(*rel.blank_last("s"), rel.in_order("c_mktsegment", ["MACHINERY", "BUILDING"]), "c_custkey")  # 100 rows
    return top.select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT c_custkey, split_part(c_name, '#', 1) AS before_, split_part(c_name, '#', 2) AS after_, regexp_extract(c_name, '([^0]*)$', 1) AS last_, regexp_replace(regexp_replace(c_name, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, upper(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) AS letters, len(string_split(c_name, '0')) AS parts, printf('%.3f', c_acctbal) AS fixed_, replace(c_name, 'Customer#', '') AS bare FROM customer")
def text_parts(spark, sf_dir):
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", tx.before(n, "#").alias("before_"), tx.after(n, "#").alias("after_"), tx.last_part(n, "0").alias("last_"), tx.slug(n).alias("slug"), tx.letters_digits(n).alias("letters"), tx.count_of(n, "0").cast("long").alias("parts"), tx.fixed(F.col("c_acctbal"), 3).alias("fixed_"), tx.without_prefix(n, "Customer#").alias("bare"))


@query("SELECT event_id, try_cast(substr(event_type, 1, 1) || event_id AS DOUBLE) IS NULL AS no_number, CAST(round_even(CAST(event_id % 1000 AS DOUBLE) / 8, 2) AS DOUBLE) AS half_even, CAST(round_even(100.0 * (event_id % 37) / 37, 1) AS DOUBLE) AS percent, CASE WHEN event_id % 5 <> 0 THEN round(100.0 * ((event_id % 11) - (event_id % 5)) / (event_id % 5), 9) END AS change FROM events")
def number_functions(spark, sf_dir):
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", numbers.numeric(F.concat(F.substring("event_type", 1, 1), k.cast("string"))).isNull().alias("no_number"), numbers.half_even((k % 1000) / 8, 2).alias("half_even"), numbers.percent_of(k % 37, F.lit(37)).alias("percent"), F.round(numbers.percent_change(k % 11, k % 5), 9).alias("change"))


@query("SELECT event_type, count(*) AS n, count(d) AS days, CAST(min(d) AS VARCHAR) AS first_, count(*) FILTER (WHERE d <= DATE '2024-01-15') AS by_then FROM (SELECT event_type, CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) WHEN 1 THEN CAST(ts AS DATE) ELSE NULL END AS d FROM events) GROUP BY 1")
def date_parsing(spark, sf_dir):
    """Dates written in two ways and as no date at all."""
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "MM/dd/yyyy")).otherwise("2024-02-30")
    rows = e.select("event_type", dates.parsed(text).alias("d"))
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count("d").alias("days"), F.min("d").cast("string").alias("first_"), F.count_if(F.col("d") <= F.lit("2024-01-15").cast("date")).alias("by_then"))


@query(f"WITH {_DOCS} SELECT as_of_dates, count(*) AS n, contains(as_of_dates, (SELECT max(d) FROM (SELECT unnest(string_split(as_of_dates, ';')) AS d FROM docs))) AS newest FROM docs GROUP BY 1")
def as_of_target(spark, sf_dir):
    d = _documents(spark, sf_dir)
    day = dates.newest_day(d, "as_of_dates")
    return d.groupBy("as_of_dates").agg(F.count(F.lit(1)).alias("n")).withColumn("newest", dates.held_on(F.col("as_of_dates"), F.lit(day)))


@query("SELECT r_name, n_name, count(*) AS n, CAST(grouping(r_name, n_name) AS INTEGER) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def rollup_counts(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


@query("SELECT user_id, event_id, lag(event_type) OVER w AS before_, lead(event_type) OVER w AS after_, count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS rank FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_frames(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.lag("event_type").over(w).alias("before_"), F.lead("event_type").over(w).alias("after_"), F.count(F.lit(1)).over(w.rowsBetween(-2, 0)).alias("recent"), F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("rank"))


@query("SELECT event_type, true AS users_near, true AS median_near FROM events GROUP BY 1")
def approximate_aggregates(spark, sf_dir):
    """Sketches within their error of the exact values."""
    g = table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("a"), F.count_distinct("user_id").alias("n"), F.percentile_approx("value", 0.5, 10_000).alias("m"), F.min("value").alias("lo"), F.percentile("value", F.array(F.lit(0.48), F.lit(0.52))).alias("q"))
    return g.select("event_type", (F.abs(F.col("a") - F.col("n")) <= 0.1 * F.col("n")).alias("users_near"), F.col("m").between(F.col("q")[0], F.col("q")[1]).alias("median_near"))


@query(f"SELECT user_id, time_bucket(INTERVAL '6 hours', ts) AS start, {_DECODE.format('bit_or(' + _BITS + ')')} AS status FROM (SELECT user_id, ts, {_CASE} AS status FROM events) GROUP BY 1, 2")
def windowed_statuses(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), _event_status().alias("status"))
    return incremental.windowed(e, "user_id", "ts", "status", "6 hours", "1 day").select("user_id", F.col("window.start").cast("timestamp_ntz").alias("start"), "status")


@query("SELECT user_id FROM events WHERE ts > TIMESTAMP '2024-01-01 12:00:00' EXCEPT SELECT user_id FROM events WHERE ts <= TIMESTAMP '2024-01-01 12:00:00' AND event_type <> 'error'")
def undone_work(spark, sf_dir):
    """Jobs without a result; failed ones count as undone."""
    e = table(spark, sf_dir, "events")
    noon = "ts {} TIMESTAMP '2024-01-01 12:00:00'"
    results = e.filter(noon.format("<=")).select("user_id", F.when(F.col("event_type") == "error", "FAILED").otherwise("True").alias("state"))
    return incremental.undone(e.filter(noon.format(">")).select("user_id").distinct(), results, ["user_id"], "state")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'kept' END AS kind FROM documents")
def fingerprint_cache(spark, sf_dir):
    """A cache whose entries are kept where size and time are the same, and made again elsewhere."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    stamp = lambda n: incremental.fingerprint(n, F.timestamp_seconds(F.col("doc_id")))
    now = d.select("doc_id", stamp(F.col("n_chars")).alias("fp"))
    cache = d.select("doc_id", stamp(F.when(F.col("doc_id") % 3 == 0, -1).otherwise(F.col("n_chars"))).alias("fp"), F.lit("kept").alias("kind"))
    return incremental.refreshed(now, cache, "doc_id", lambda todo: todo.select("doc_id", F.lit("new").alias("kind"))).select("doc_id", "kind")


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, regexp_replace(regexp_replace(url, '([?&])ref=[^&#]*', '\\1', 'g'), '[?&]+$', '') AS plain FROM pages")
def address_parameters(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", page_source.parameter(F.col("url"), "page").alias("page"), page_source.without_parameter(F.col("url"), "ref").alias("plain"))


@query("SELECT page_id, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a [^>]*href=')) FROM pages) GROUP BY 1")
def page_links(spark, sf_dir):
    return page_source.links(table(spark, sf_dir, "pages"), "page_id", "html").groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


@query("WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, round(list_inner_product(q.e, r.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(r.e, r.e)), 9) AS score FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0) SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS INTEGER) AS rank, row_id, score FROM p QUALIFY rank <= 5")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    out = rel.nearest(v.filter("id % 100 = 0"), v, 5)
    return out.select("query_id", "rank", "row_id", F.round("score", 9).alias("score"))


@query("WITH q AS (SELECT conv_id, turn, length(text) AS size, CASE WHEN turn % 2 = 0 THEN turn ELSE turn - 1 END AS key, row_number() OVER (PARTITION BY conv_id, turn % 3 ORDER BY turn) AS rank, turn % 3 AS asked FROM conversations WHERE text IS NOT NULL), once AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY conv_id, key ORDER BY rank, asked) = 1), run AS (SELECT *, row_number() OVER w AS n, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM once WINDOW w AS (PARTITION BY conv_id ORDER BY rank, asked, key)) SELECT conv_id, turn FROM run WHERE n <= 4 AND s <= 1500")
def retrieval_budget(spark, sf_dir):
    """All first ranks of the queries before any second, a key once, until the first that doesn't fit."""
    c = table(spark, sf_dir, "conversations").filter("text IS NOT NULL").withColumn("asked", F.col("turn") % 3)
    rank = F.row_number().over(Window.partitionBy("conv_id", "asked").orderBy("turn"))
    q = c.select("conv_id", "turn", F.length("text").alias("size"), F.when(F.col("turn") % 2 == 0, F.col("turn")).otherwise(F.col("turn") - 1).alias("key"), rank.alias("rank"), "asked")
    return rel.budgeted(q, "key", "rank", "asked", "size", 4, 1500, "conv_id").select("conv_id", "turn")


@query("SELECT bar, part, round(v, 6) AS v, round(coalesce(sum(v) OVER (PARTITION BY bar ORDER BY CASE part WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS bottom FROM (SELECT l_linestatus AS bar, l_returnflag AS part, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)")
def stacked_frame(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("bar"), F.col("l_returnflag").alias("part"), F.col("l_quantity").alias("v"))
    return files.stacked(li, "bar", "part", "v", ["R", "A", "N"]).select("bar", "part", F.round("v", 6).alias("v"), F.round("bottom", 6).alias("bottom"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q FROM lineitem GROUP BY 1")
def exact_quantile(spark, sf_dir):
    return rel.quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.25, "q").select("l_returnflag", F.round("q", 6).alias("q"))


@query("SELECT s_nationkey, min_by(s_name, (s_acctbal < 0, s_suppkey)) AS s_name, count(*) AS n FROM supplier GROUP BY 1")
def preferred_row(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    best = rel.best_of(s.select("s_nationkey", "s_name", "s_acctbal", "s_suppkey"), ["s_nationkey"], [F.col("s_acctbal") < 0, F.col("s_suppkey")])
    return best.join(s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n")), "s_nationkey").select("s_nationkey", "s_name", "n")


from . import places, registered, sites, stateful  # noqa: E402, F401  (they register their queries)
