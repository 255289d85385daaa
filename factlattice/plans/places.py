"""Queries over places and times: passages of texts by offsets, the latest row at a time, places in ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlattice.operators import passages, rules, taxonomy
from factlattice.operators import relational as rel
from factlattice.session import table

from .catalogue import query



def _leaf(**more):
    return {"alt_names": [], "alt_names_case_sensitive": [], **more}


#: The invented prose has no plants: its syllables stand in for a vocabulary, its marks for cues, with short distances.
RULES = passages.Rules(
    terms="(?i)tion|ung|with|ment|ing", cues="(?i)ation|ich", strong="(?i)onand", boilerplate="(?i)idiot|the the", changes="(?i)the in|en de|de la",
    stop="(?i)license|erstand", denial="(?i)an $", gap=40, around=60, diverse=4, joined=150, far=900, tail=60, back=200, trail=80, near=60, reach=400,
)


def _hits(pattern: str, text: str = "text") -> str:
    """SQL: doc_id, s, e, m of a pattern's matches."""
    p = pattern.replace("'", "''")
    return (
        "(SELECT doc_id, (e - length(m))::BIGINT AS s, e::BIGINT AS e, m FROM (SELECT doc_id, m, sum(length(g) + coalesce(length(m), 0)) OVER (PARTITION BY doc_id ORDER BY nth) AS e FROM "
        f"(SELECT doc_id, unnest(regexp_split_to_array({text}, '{p}')) AS g, unnest(regexp_extract_all({text}, '{p}')) AS m, unnest(range(length({text}) + 2)) AS nth FROM documents WHERE {text} IS NOT NULL) WHERE g IS NOT NULL) WHERE m IS NOT NULL)"
    )


def _islands(rows: str, s: str, e: str, gap: int) -> str:
    """SQL: the rows with the number of their island."""
    return (
        f"(SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY {s}, {e} ROWS UNBOUNDED PRECEDING) AS isle FROM (SELECT *, "
        f"CASE WHEN {s} - max({e}) OVER (PARTITION BY doc_id ORDER BY {s}, {e} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= {gap} THEN 0 ELSE 1 END AS fresh FROM {rows}))"
    )


_R = RULES
_RUNS = f"term AS {_hits(_R.terms)}, run AS (SELECT doc_id, min(s) AS s, max(e) AS e, count(*) AS n, count(DISTINCT lower(m)) AS kinds FROM {_islands('term', 's', 'e', _R.gap)} GROUP BY doc_id, isle HAVING count(*) > 1)"


@query(f'WITH {_RUNS} SELECT doc_id, s AS start, e AS "end", n, kinds FROM run')
def mention_runs(spark, sf_dir):
    """Runs of mentions of a vocabulary: gap sessions over offsets."""
    hits = passages.occurrences(table(spark, sf_dir, "documents"), "doc_id", "text", {"terms": RULES.terms})
    return passages.runs(hits, "doc_id", RULES.gap).select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("start", "end", "n", "kinds")))


def _count(hits: str, low: str, high: str) -> str:
    return f"(SELECT count(*) FROM {hits} h WHERE h.doc_id = run.doc_id AND h.s >= {low} AND h.e <= {high})"


_LOW = f"greatest(run.s - {_R.around}, 0)"
_SPANS = f"""
  {_RUNS}, dots AS {_hits(passages.DOTS)}, strong AS {_hits(_R.strong)}, cue AS {_hits(_R.cues)}, boiler AS {_hits(_R.boilerplate)}, stopper AS {_hits(_R.stop)},
  scored AS (SELECT doc_id, s, e, kinds, length(text) AS size, kinds / (1 + s / length(text)) AS worth,
    {_count('dots', _LOW, 'run.e')} < 3 AND (kinds >= {_R.diverse} OR {_count('strong', _LOW, 'run.e')} > 0 OR ({_count('cue', _LOW, 'run.e')} > 0 AND {_count('boiler', _LOW, f'run.e + {_R.around}')} < 2)) AS good
    FROM run JOIN documents USING (doc_id)),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY good DESC, worth DESC, s) AS r, max(good) OVER (PARTITION BY doc_id) AS anygood FROM scored),
  good AS (SELECT * FROM ranked WHERE good OR (NOT anygood AND r = 1)),
  best AS (SELECT doc_id, s AS anchor FROM good WHERE r = 1),
  near AS (SELECT i.*, anchor FROM {_islands('good', 's', 'e', _R.joined)} i JOIN best USING (doc_id)),
  stop AS (SELECT b.doc_id, min(h.s) AS stop FROM best b JOIN stopper h ON h.doc_id = b.doc_id AND h.s > anchor GROUP BY 1),
  chosen AS (SELECT n.doc_id, n.s, n.e, n.size, coalesce(stop, n.size) AS stop FROM near n LEFT JOIN stop USING (doc_id)
    WHERE (n.s >= anchor AND n.s <= anchor + {_R.far}) OR (n.s < anchor AND n.isle = (SELECT m.isle FROM near m WHERE m.doc_id = n.doc_id AND m.s = anchor))),
  merged AS (SELECT doc_id, min(s) AS s, max(e) AS e, any_value(size) AS size, any_value(stop) AS stop FROM {_islands('(SELECT * FROM chosen WHERE s < stop)', 's', 'e', _R.joined)} GROUP BY doc_id, isle),
  numbered AS {_hits(passages.NUMBERED)}, para AS {_hits('[.]' + chr(10))}, line AS {_hits(passages.LINE)}
"""
_BACK = "(SELECT max({at}) FROM {kind} h WHERE h.doc_id = m.doc_id AND h.e <= m.s)"
_NEAR = "CASE WHEN {v} >= m.s - " + str(_R.back) + " THEN {v} END"
_HEAD = "coalesce(" + ", ".join(_NEAR.format(v=_BACK.format(at=at, kind=kind)) for kind, at in (("numbered", "h.s"), ("para", "h.e"), ("line", "h.s"))) + ", m.s)"
_PARA_END = f"(SELECT min(h.s) + 2 FROM para h WHERE h.doc_id = m.doc_id AND h.s >= m.e AND h.s + 2 <= least(m.e + {_R.trail}, m.size))"


def _places(spark, sf_dir, *asked: str):
    """The documents and their places of the kinds asked for. Paragraphs end with a full stop and a line end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kinds = {"terms": RULES.terms, "dots": passages.DOTS, "strong": RULES.strong, "cues": RULES.cues, "boilerplate": RULES.boilerplate, "stop": RULES.stop, "changes": RULES.changes, "numbered": passages.NUMBERED, "paragraph": "[.]\n", "line": passages.LINE}
    return docs, rel.saved(passages.occurrences(docs, "doc_id", "text", {k: kinds[k] for k in asked}))


@query(f'WITH {_SPANS} SELECT doc_id, {_HEAD} AS head, m.s AS start, least(coalesce({_PARA_END}, least(m.e + {_R.trail}, m.size)), m.stop) AS "end" FROM merged m')
def described_passages(spark, sf_dir):
    """Where documents describe: runs chosen, anchored, merged, and drawn out to headers and paragraph ends."""
    docs, places = _places(spark, sf_dir, "terms", "dots", "strong", "cues", "boilerplate", "stop", "numbered", "paragraph", "line")
    sizes = docs.filter("text IS NOT NULL").select("doc_id", F.char_length("text").alias("size"))
    scored = passages.described(passages.runs(places.filter("kind = 'terms'"), "doc_id", RULES.gap), places, sizes, "doc_id", RULES)
    found = passages.spans(scored, places, sizes.select("doc_id", F.lit(False).alias("many")), "doc_id", RULES)
    found = passages.extended(passages.snapped(found, places, "doc_id", RULES), places, "doc_id", "end", "size", RULES)
    return found.select("doc_id", *(c.cast("long").alias(n) for n, c in (("head", F.col("head")), ("start", F.col("start")), ("end", F.least("end", "stop")))))


@query(f"""WITH term AS {_hits(_R.terms)}, isle AS {_islands('term', 's', 'e', _R.gap)}, para AS {_hits('[.]' + chr(10))},
  change AS (SELECT c.*, text, length(text) AS size FROM {_hits(_R.changes)} c JOIN documents USING (doc_id)),
  good AS (SELECT * FROM change c WHERE (s = 0 OR substr(text, s, 1) IN (chr(10), '.', ':', '(', ' ')) AND NOT regexp_matches(substr(text, greatest(s - 9, 1), least(s, 10)), '{_R.denial}')
    AND (SELECT count(*) FROM term t WHERE t.doc_id = c.doc_id AND t.s >= c.s AND t.e <= c.s + {_R.near}) > 1),
  held AS (SELECT g.doc_id, g.s, g.size, g.m, i.e, i.isle, min(i.isle) OVER (PARTITION BY g.doc_id, g.s) AS first FROM good g JOIN isle i ON i.doc_id = g.doc_id AND i.s >= g.s AND i.e <= g.s + {_R.reach}),
  m AS (SELECT doc_id, s, any_value(size) AS size, any_value(m) AS phrase, max(e) AS e FROM held WHERE isle = first GROUP BY 1, 2)
  SELECT doc_id, s AS start, coalesce({_PARA_END}, least(m.e + {_R.trail}, m.size)) AS "end", phrase FROM m""")
def change_parts(spark, sf_dir):
    """Where documents speak of planned changes, and how far."""
    docs, places = _places(spark, sf_dir, "terms", "changes", "paragraph")
    sizes = docs.filter("text IS NOT NULL").select("doc_id", F.char_length("text").alias("size"))
    parts = passages.changes(passages.change_starts(places, "doc_id", docs, RULES), places, "doc_id", sizes, RULES)
    return parts.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("match").alias("phrase"))


@query("""WITH sold AS (SELECT user_id, ts, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
  SELECT e.event_id, e.user_id, coalesce(sold.event_id, -1) AS purchase_id, coalesce(sold.value, -1) AS purchase_value, coalesce(date_diff('microsecond', sold.ts, e.ts), -1) AS micros_since
  FROM events e ASOF LEFT JOIN sold ON e.user_id = sold.user_id AND e.ts >= sold.ts""")
def latest_purchase(spark, sf_dir):
    """Each event with its user's latest purchase at or before it: all times at once; -1 where there is none."""
    e = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    sold = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("at").alias("since"), "value")
    found = rel.as_of(e.select("event_id", "user_id", "at"), sold, ["user_id"], "at", "since", 86_400e6)
    columns = {"purchase_id": F.col("found.event_id"), "purchase_value": F.col("found.value"), "micros_since": F.col("at") - F.col("found.since")}
    return found.select("event_id", "user_id", *(F.coalesce(c, F.lit(-1)).alias(n) for n, c in columns.items()))


@query("""SELECT o.o_orderkey, count(*) AS n, sum(l_quantity) AS quantity, min(date_diff('day', DATE '1970-01-01', l_shipdate::DATE)) AS first_day FROM orders o JOIN lineitem l
  ON l_linenumber = o_orderkey % 7 + 1 AND l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + to_days((o_orderkey * 7 % 40 + 1)::INTEGER) GROUP BY 1""")
def shipped_in_window(spark, sf_dir):
    """Each order's span of 1 to 40 days with totals of the lines shipped in it: as many overlapping ranges as orders."""
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    spans = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 7 + 1).cast("int").alias("l_linenumber"), days("o_orderdate").alias("low"), (days("o_orderdate") + F.col("o_orderkey") * 7 % 40 + 1).alias("high"))
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", days("l_shipdate").alias("at"), "l_quantity")
    totals = {"n": (F.count(F.lit(1)), F.sum), "quantity": (F.sum("l_quantity"), F.sum), "first_day": (F.min("at").cast("long"), F.min)}
    return rel.totals_inside(lines, spans, ["l_linenumber"], "at", "low", "high", ["o_orderkey"], totals)


#: Rules over a hierarchy of three levels (nation, region, world), with what regions do by themselves, and exclusions.
WORLD_TREE = {
    "Trade": {"Group": {"Eastern": _leaf(priority=1, ontology_triggers=[["Equipment-ASIA", "Process-Export"]]), "Any Trade": _leaf(priority=5, global_priority=1, ontology_triggers=[["Process-Export"], ["Process-Ship", "Role-rich"]])}},
    "Place": {"Worldly": _leaf(priority=1, ontology_triggers=[["Equipment-WORLD", "Role-rich"]], exclude_if_any=["Process-Ferry"]), "French": _leaf(priority=1, ontology_triggers=["Equipment-FRANCE"])},
}


@query("""WITH i AS (SELECT s_suppkey, n_name, r_name, s_acctbal > 5000 AS rich, r_name IN ('ASIA', 'AMERICA') AS export, r_name IN ('EUROPE', 'ASIA') AS ship, n_name = 'GERMANY' AS ferry
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT s_suppkey, 'Eastern' AS process FROM i WHERE r_name = 'ASIA' AND export
  UNION ALL SELECT s_suppkey, 'Any Trade' FROM i WHERE (export OR (ship AND rich)) AND NOT (r_name = 'ASIA' AND export)
  UNION ALL SELECT s_suppkey, 'Worldly' FROM i WHERE rich AND NOT ferry UNION ALL SELECT s_suppkey, 'French' FROM i WHERE n_name = 'FRANCE'""")
def world_rules(spark, sf_dir):
    """Suppliers by the rules of their nation, its region and the world, and by what these do."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    edges = edges.unionByName(region.select(F.col("r_name").alias("child"), F.lit("WORLD").alias("parent")))
    edges = edges.unionByName(region.limit(1).select(F.explode(F.array(F.struct(F.lit("Process-Ferry").alias("child"), F.lit("Process-Ship").alias("parent")))).alias("e")).select("e.*"))
    does = region.select(F.col("r_name").alias("equipment"), F.explode(F.array_compact(F.array(F.when(F.col("r_name").isin("ASIA", "AMERICA"), "Process-Export"), F.when(F.col("r_name").isin("EUROPE", "ASIA"), "Process-Ship")))).alias("process"))
    does = does.unionByName(nation.filter("n_name = 'GERMANY'").select(F.col("n_name").alias("equipment"), F.lit("Process-Ferry").alias("process")))
    none = F.array().cast("array<string>")
    items = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.array("n_name").alias("Equipment"), none.alias("Process"), F.when(F.col("s_acctbal") > 5000, F.array(F.lit("rich"))).otherwise(none).alias("Role"), none.alias("Substance"))
    return rules.item_processes(items, ["s_suppkey"], taxonomy.table(spark, WORLD_TREE), rel.saved(rel.ancestors(edges, "child", "parent")), rel.saved(does))


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), p AS (
    SELECT q.vec_id AS query_id, r.vec_id AS row_id, (q.label = r.label)::INT AS same, list_distance(q.e, r.e) AS far, list_inner_product(q.e, r.e) / sqrt(list_inner_product(q.e, q.e) * list_inner_product(r.e, r.e)) AS score
    FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS first_rank FROM p QUALIFY first_rank <= 20)
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY same - far DESC, first_rank, row_id)::INTEGER AS rank, first_rank::INTEGER AS first_rank, row_id, round(same - far, 9) AS second FROM top QUALIFY rank <= 5""")
def reranked_topk(spark, sf_dir):
    """The twenty nearest of each query by cosine, and of these the five best by label and distance."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    found = rel.nearest(v.filter("id % 100 = 0"), v, 20)
    a, b = (v.select(F.col("id").alias(i), F.col("vec").alias(f"{i}_vec"), F.col("label").alias(f"{i}_label")) for i in ("query_id", "row_id"))
    both = found.join(rel.small(a), "query_id").join(b, "row_id")
    far = F.sqrt(F.aggregate(F.zip_with("query_id_vec", "row_id_vec", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x))
    out = rel.reranked(both, (F.col("query_id_label") == F.col("row_id_label")).cast("int") - far, 5)
    return out.select("query_id", "rank", "first_rank", "row_id", F.round("second", 9).alias("second"))
