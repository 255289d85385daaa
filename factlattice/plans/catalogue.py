"""Registered queries over the driver's tables and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factlattice.functions import status as st
from factlattice.functions import text as tx
from factlattice.operators import relational as rel
from factlattice.session import table

QUERIES: dict = {}
ORACLE: dict = {}
#: event_type -> status, the analogue of dated status observations (fixed values).
EVENT_STATUS = {"click": "PRESENT", "view": "FUTURE", "purchase": "PRESENT_AND_FUTURE", "signup": "PAST", "error": "OFFSITE"}
#: Process -> words that show it (authored terms, frequent in the documents).
TAXONOMY = {"aeration": ("the", "der"), "clarifier": ("tion", "ung"), "digester": ("idiot", "trash"), "lagoon": ("que", "lo"), "filter": ("with", "mit")}
#: DNF rules over the event types of a user: (rule, conjunct, token).
RULES = [("active", 1, "click"), ("active", 1, "view"), ("buyer", 1, "purchase"), ("buyer", 2, "signup"), ("buyer", 2, "click")]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _event_status(col="event_type"):
    out = F.lit(None).cast("string")
    for event, name in EVENT_STATUS.items():
        out = F.when(F.col(col) == event, F.lit(name)).otherwise(out)
    return out


_CASE = "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{s}'" for e, s in EVENT_STATUS.items()) + " END"
_BIT = "CASE event_type " + " ".join(f"WHEN '{e}' THEN {st.BITS[s]}" for e, s in EVENT_STATUS.items()) + " END"
_DECODE = "CASE WHEN {0} & 12 = 12 THEN 'PRESENT_AND_FUTURE' WHEN {0} & 8 <> 0 THEN 'PRESENT' WHEN {0} & 4 <> 0 THEN 'FUTURE' WHEN {0} & 2 <> 0 THEN 'OFFSITE' WHEN {0} & 1 <> 0 THEN 'PAST' END"
_TOKEN_SQL = "(' ' || regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g') || ' ')"


def _tokens(text="text"):
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+", " "), F.lit(" "))


@query("SELECT source, process, " + _DECODE.format("mask") + " AS status FROM (SELECT source, process, bit_or(bit) AS mask FROM (" + " UNION ALL ".join(f"SELECT source, '{p}' AS process, CASE WHEN n_chars > 2000 THEN 8 ELSE 4 END AS bit FROM documents WHERE " + " OR ".join(f"contains({_TOKEN_SQL}, ' {w} ')" for w in words) for p, words in TAXONOMY.items()) + ") GROUP BY 1, 2)")
def facility_status_from_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword presence per document, merged over the lattice per facility (source) and process. Few terms:
    a compiled test each (a taxonomy's many are found at once by ``keywords.search``); hits are exploded,
    merged with a partial bit_or."""
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", _tokens().alias("t"))
    hits = F.array_compact(F.array(*(F.when(tx.contains_any(F.col("t"), [f" {w} " for w in words]), F.lit(p)) for p, words in TAXONOMY.items())))
    rows = docs.select("source", F.explode(hits).alias("process"), F.when(F.col("n_chars") > 2000, 8).otherwise(4).alias("bit"))
    return rows.groupBy("source", "process").agg(F.bit_or("bit").alias("mask")).select("source", "process", st.decode(F.col("mask")).alias("status"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P') AND NOT coalesce(o_orderpriority = '5-LOW' AND o_orderstatus = 'O', false)")
def scan_filter_project(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    both = F.coalesce((F.col("o_orderpriority") == "5-LOW") & (F.col("o_orderstatus") == "O"), F.lit(False))
    return o.filter(F.col("o_orderstatus").isin("O", "P") & ~both).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT l_returnflag, l_linestatus, CASE WHEN l_returnflag = 'R' THEN 'PAST' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'PRESENT_AND_FUTURE' WHEN l_linestatus = 'F' THEN 'PRESENT' ELSE 'FUTURE' END AS status, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def first_rule_classifier(spark, sf_dir):
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    rule = F.when(flag == "R", "PAST").when((flag == "A") & (line == "F"), "PRESENT_AND_FUTURE").when(line == "F", "PRESENT").otherwise("FUTURE")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus", rule.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, coalesce(nullif(regexp_extract(url, '/([a-z]{2})/', 1), ''), 'unspecified') AS region FROM pages")
def region_from_text(spark, sf_dir):
    found = F.regexp_extract(F.coalesce("url", F.lit("")), "/([a-z]{2})/", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.when(found != "", found).otherwise("unspecified").alias("region"))


@query("SELECT n_name, count(c_custkey) AS customers, count(o_orderkey) AS orders, count(*) AS row_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def inner_left_join_fanout(spark, sf_dir):
    n, c, o = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders"))
    j = n.join(c, n.n_nationkey == c.c_nationkey, "left").join(o, o.o_custkey == c.c_custkey, "left")
    return j.groupBy("n_name").agg(F.count("c_custkey").alias("customers"), F.count("o_orderkey").alias("orders"), F.count(F.lit(1)).alias("row_count"))


@query("SELECT c_mktsegment, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS matched, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS unmatched FROM customer GROUP BY 1")
def semi_anti_report(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    both = c.join(o, on, "left_semi").withColumn("m", F.lit(1)).unionByName(c.join(o, on, "left_anti").withColumn("m", F.lit(0)))
    return both.groupBy("c_mktsegment").agg(F.sum("m").cast("long").alias("matched"), F.sum(1 - F.col("m")).cast("long").alias("unmatched"))


@query("SELECT s_suppkey, coalesce(c.c_name, n.n_name, 'none') AS place FROM supplier LEFT JOIN (SELECT c_nationkey, min_by(c_name, c_custkey) AS c_name FROM customer WHERE c_acctbal > 9000 GROUP BY 1) c ON s_nationkey = c_nationkey LEFT JOIN nation n ON s_nationkey = n_nationkey")
def priority_coalesce_lookup(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    s = rel.lookup(s, table(spark, sf_dir, "customer").filter("c_acctbal > 9000").withColumnRenamed("c_nationkey", "s_nationkey"), "s_nationkey", "c_name", "a", "c_custkey")
    s = rel.lookup(s, table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey", "n_name", "b", "n_name")
    return s.select("s_suppkey", F.coalesce("a", "b", F.lit("none")).alias("place"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND (contains(a.p_name, b.p_name) OR contains(b.p_name, a.p_name))")
def containment_join(spark, sf_dir):
    """Names are compared once per brand and size, however many parts have them; parts meet by equality."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", "p_name")
    of = ["p_brand", "p_size", "p_name"]
    names = rel.saved(rel.present(p, of).select(*of).distinct().withColumn("x", F.monotonically_increasing_id()))
    near = rel.saved(rel.containing(names, "x", "p_name", names.withColumnRenamed("x", "y"), "y", "p_name", ["p_brand", "p_size"]))
    near = near.join(names.select("x", *of), "x").join(names.select(F.col("x").alias("y"), F.col("p_name").alias("other")), "y").select(*of, "other")
    a = p.select(F.col("p_partkey").alias("a"), *of)
    b = p.select(F.col("p_partkey").alias("b"), "p_brand", "p_size", F.col("p_name").alias("other"))
    return a.join(near, of).join(b, ["p_brand", "p_size", "other"]).filter("a < b").select("a", "b")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate DESC, o_orderkey) AS rn FROM orders WHERE o_orderdate <= TIMESTAMP '1997-01-01') WHERE rn = 1")
def asof_best_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderdate <= TIMESTAMP '1997-01-01'")
    rank = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2)
    best = F.min_by("o_orderkey", F.struct(rank, -F.unix_micros(F.col("o_orderdate").cast("timestamp")), "o_orderkey"))
    return o.groupBy("o_custkey").agg(best.alias("o_orderkey"))


@query("SELECT user_id, " + _DECODE.format(f"bit_or({_BIT})") + " AS status FROM events GROUP BY 1")
def lattice_merge(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(st.merge(_event_status()).alias("status"))


@query(f"SELECT source, min_by(lang, doc_id) FILTER (WHERE trim(lang) <> '') AS lang, " + _DECODE.format("bit_or(CASE WHEN toxic = 1 THEN 1 WHEN quality = 1 THEN 8 ELSE 4 END)") + " AS status FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
def collapse_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bit = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 8).otherwise(4)
    kept = F.when(F.trim("lang") != "", F.col("doc_id"))
    g = d.groupBy("source").agg(F.min_by("lang", kept).alias("lang"), F.bit_or(bit).alias("mask"))
    return g.select("source", "lang", st.decode(F.col("mask")).alias("status"))


@query("SELECT best, count(*) AS users FROM (SELECT user_id, max(CASE event_type WHEN 'purchase' THEN 5 WHEN 'click' THEN 4 WHEN 'view' THEN 3 WHEN 'error' THEN 2 WHEN 'signup' THEN 1 ELSE 0 END) AS best FROM events GROUP BY 1) GROUP BY 1")
def facility_status_counts(spark, sf_dir):
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in {"purchase": 5, "click": 4, "view": 3, "error": 2, "signup": 1}.items() for x in kv)), F.col("event_type")), F.lit(0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(rank).alias("best")).groupBy("best").agg(F.count(F.lit(1)).alias("users"))


@query("WITH f AS (SELECT user_id, min(CAST(ts AS DATE)) AS d FROM events GROUP BY 1), n AS (SELECT d, count(*) AS fresh FROM f GROUP BY 1) SELECT CAST(d AS VARCHAR) AS day, fresh, CAST(sum(fresh) OVER (ORDER BY d) AS BIGINT) AS total FROM n")
def survey_coverage(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.to_date("ts")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("fresh"))
    return n.select(F.col("d").cast("string").alias("day"), "fresh", F.sum("fresh").over(Window.orderBy("d")).alias("total"))


@query("SELECT c_mktsegment, count(*) AS n, round(count(*) * 1.0 / sum(count(*)) OVER (), 6) AS share FROM customer GROUP BY 1")
def value_share(spark, sf_dir):
    g = table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    return g.select("c_mktsegment", "n", F.round(F.col("n").cast("double") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6).alias("share"))


_CONF = "SELECT source, lang, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS p, quality AS m FROM documents JOIN labels USING (doc_id)"


def _confusion(spark, sf_dir, *keys):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    p, m = F.when(F.col("n_chars") > 1000, 1).otherwise(0), F.col("quality")
    return d.groupBy(*keys).agg(*(F.count_if(c).alias(n) for n, c in (("tp", (p == 1) & (m == 1)), ("fp", (p == 1) & (m == 0)), ("fn", (p == 0) & (m == 1)), ("tn", (p == 0) & (m == 0)))))


_COUNTS = "count(*) FILTER (WHERE p = 1 AND m = 1) AS tp, count(*) FILTER (WHERE p = 1 AND m = 0) AS fp, count(*) FILTER (WHERE p = 0 AND m = 1) AS fn, count(*) FILTER (WHERE p = 0 AND m = 0) AS tn"


def _div(a, b):
    return F.when(b != 0, F.round(a.cast("double") / b, 6))


@query(f"SELECT *, round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 6) AS precision_, round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 6) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (SELECT lang, {_COUNTS} FROM ({_CONF}) GROUP BY 1)")
def confusion_by_label(spark, sf_dir):
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return _confusion(spark, sf_dir, "lang").select("lang", "tp", "fp", "fn", "tn", _div(tp, tp + fp).alias("precision_"), _div(tp, tp + fn).alias("recall"), _div(2 * tp, 2 * tp + fp + fn).alias("f1"))


@query(f"WITH c AS (SELECT source, {_COUNTS} FROM ({_CONF}) GROUP BY 1) SELECT round(avg(2.0 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) AS micro_f1 FROM c")
def macro_micro_f1(spark, sf_dir):
    c = _confusion(spark, sf_dir, "source").withColumn("d", 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.agg(F.round(F.avg(F.when(F.col("d") != 0, 2.0 * F.col("tp") / F.col("d"))), 6).alias("macro_f1"), F.round(2.0 * F.sum("tp") / F.sum("d"), 6).alias("micro_f1"))


@query(f"WITH c AS (SELECT lang, {_COUNTS} FROM ({_CONF}) GROUP BY 1) SELECT lang, round(CAST(fn AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS missed, round(CAST(fp AS DOUBLE) / nullif(2 * tp + fp + fn, 0), 6) AS invented FROM c")
def error_decomposition(spark, sf_dir):
    c = _confusion(spark, sf_dir, "lang").withColumn("d", 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return c.select("lang", _div(F.col("fn"), F.col("d")).alias("missed"), _div(F.col("fp"), F.col("d")).alias("invented"))


@query("WITH r AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1, 2) SELECT event_type, 'mean' AS stat, round(avg(n), 4) AS v FROM r GROUP BY 1 UNION ALL SELECT event_type, 'std', round(stddev_samp(n), 4) FROM r GROUP BY 1 UNION ALL SELECT event_type, 'variance', round(var_samp(n), 4) FROM r GROUP BY 1")
def run_variance(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    g = r.groupBy("event_type").agg(F.round(F.avg("n"), 4).alias("mean"), F.round(F.stddev_samp("n"), 4).alias("std"), F.round(F.var_samp("n"), 4).alias("variance"))
    return g.unpivot("event_type", ["mean", "std", "variance"], "stat", "v")


@query("SELECT role, round(sum(length(text)) / 1e6 * CASE role WHEN 'user' THEN 3 ELSE 15 END, 8) AS cost FROM conversations GROUP BY role")
def weighted_cost(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("role").agg(F.sum(F.length("text")).alias("n"))
    return g.select("role", F.round(F.col("n") / 1e6 * F.when(F.col("role") == "user", 3).otherwise(15), 8).alias("cost"))


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5), 4) AS median_price FROM lineitem GROUP BY 1")
def quantile_factor(spark, sf_dir):
    out = rel.quantile(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.5, "median_price")
    return out.select("l_returnflag", F.round("median_price", 4).alias("median_price"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5")
def balanced_cohort(spark, sf_dir):
    return rel.in_every(table(spark, sf_dir, "events"), "user_id", "event_type", 5)


@query("WITH t AS (SELECT *, (CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END) + CASE WHEN o_totalprice > 100000 THEN 0 ELSE 3 END AS tier, year(o_orderdate) AS y FROM orders), b AS (SELECT *, min(tier) OVER (PARTITION BY o_custkey) AS best FROM t), k AS (SELECT *, max(y) OVER (PARTITION BY o_custkey) AS newest FROM b WHERE tier = best) SELECT o_orderkey, o_custkey FROM k WHERE best % 3 <> 2 OR y = newest")
def current_document_mask(spark, sf_dir):
    tier = F.when(F.col("o_orderstatus") == "O", 0).when(F.col("o_orderstatus") == "P", 1).otherwise(2) + F.when(F.col("o_totalprice") > 100000, 0).otherwise(3)
    return rel.newest_tier(table(spark, sf_dir, "orders"), "o_custkey", tier, F.year("o_orderdate"), 2).select("o_orderkey", "o_custkey")


@query("SELECT user_id, min_by(event_id, (ts, event_id)) AS first_event, max_by(event_id, (ts, event_id)) AS last_event FROM events GROUP BY 1")
def dedupe_keep_first_last(spark, sf_dir):
    at = F.struct("ts", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min_by("event_id", at).alias("first_event"), F.max_by("event_id", at).alias("last_event"))


@query("SELECT s_nationkey, s_suppkey, s_name FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY (s_acctbal < 0), s_suppkey) AS rn FROM supplier) WHERE rn = 1")
def dedupe_prefer_nonblank(spark, sf_dir):
    return rel.pick(table(spark, sf_dir, "supplier"), ["s_nationkey"], [F.col("s_acctbal") < 0, F.col("s_suppkey")]).select("s_nationkey", "s_suppkey", "s_name")


@query("WITH e AS (SELECT DISTINCT user_id, event_type, CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS prio FROM events) SELECT user_id, event_type, prio > min(prio) OVER (PARTITION BY user_id) AS cleared FROM e")
def priority_prune(spark, sf_dir):
    prio = F.when(F.col("event_type").isin("purchase", "signup"), 1).when(F.col("event_type") == "click", 2).otherwise(3)
    e = table(spark, sf_dir, "events").select("user_id", "event_type", prio.alias("prio")).distinct()
    return rel.best_priority(e, ["user_id"], "prio", F.lit(True)).select("user_id", "event_type", "cleared")


@query("WITH t AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_brand, p_size, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_size) AS place FROM t")
def mode_ranking_by_bin(spark, sf_dir):
    t = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("place", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_size")))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50")
def multi_key_sort_topk(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(50).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT user_id, string_agg(DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR), ';' ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR)) AS as_of_dates, count(DISTINCT CAST(ts AS DATE)) AS n_snapshots, max_by(event_type, (ts, event_id)) AS latest FROM events GROUP BY 1")
def snapshot_union_provenance(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    days = F.sort_array(F.collect_set(F.to_date("ts").cast("string")))
    g = e.groupBy("user_id").agg(days.alias("d"), F.max_by("event_type", F.struct("ts", "event_id")).alias("latest"))
    return g.select("user_id", F.array_join("d", ";").alias("as_of_dates"), F.size("d").cast("long").alias("n_snapshots"), "latest")


@query("SELECT 'union' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    out = [d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n") for n, d in (("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b)))]
    return out[0].union(out[1]).union(out[2])


@query("SELECT n_nationkey, coalesce(n, 0) AS n, n IS NULL AS synthetic FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 9900 GROUP BY 1) ON c_nationkey = n_nationkey")
def placeholder_rows(spark, sf_dir):
    g = table(spark, sf_dir, "customer").filter("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n")).withColumn("synthetic", F.lit(False))
    return rel.add_missing(g, table(spark, sf_dir, "nation"), ["n_nationkey"], {"n": F.lit(0).cast("long"), "synthetic": F.lit(True)})


@query("SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 11 THEN '0' || c_custkey ELSE CAST(c_custkey AS VARCHAR) END AS one_zero, lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS filled FROM customer")
def id_padding(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", F.when(F.length(k) < 11, F.concat(F.lit("0"), k)).otherwise(k).alias("one_zero"), F.lpad(k, 11, "0").alias("filled"))


@query(f"SELECT doc_id, contains({_TOKEN_SQL}, ' the ') AS has_token, contains(lower(coalesce(text, '')), 'tion') AS has_part FROM documents")
def keyword_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.contains(_tokens(), F.lit(" the ")).alias("has_token"), F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit("tion")).alias("has_part"))


@query("SELECT page_id, len(regexp_extract_all(coalesce(html, ''), '<p>')) AS paragraphs, regexp_extract(coalesce(url, ''), 'page=([0-9]+)', 1) AS page_no FROM pages")
def page_marker_extract(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_count(html, F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_extract(F.coalesce("url", F.lit("")), "page=([0-9]+)", 1).alias("page_no"))


@query("SELECT l_linestatus, round(sum(CASE WHEN l_quantity <= 10 THEN 5 + 2 * l_quantity WHEN l_quantity <= 30 THEN 3 * pow(l_quantity, 0.9) ELSE 100 END), 2) AS cost FROM lineitem GROUP BY 1")
def cost_curve(spark, sf_dir):
    q = F.col("l_quantity")
    cost = F.when(q <= 10, 5 + 2 * q).when(q <= 30, 3 * F.pow(q, F.lit(0.9))).otherwise(100)
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(cost), 2).alias("cost"))


@query("SELECT s_suppkey, round(2 * 6371.0088 * asin(sqrt(pow(sin(radians((s_suppkey % 90) - 38) / 2), 2) + cos(radians(38)) * cos(radians(s_suppkey % 90)) * pow(sin(radians((s_suppkey % 180) + 121) / 2), 2))), 3) AS km FROM supplier")
def geo_distance(spark, sf_dir):
    lat, lon = F.col("s_suppkey") % 90, F.col("s_suppkey") % 180
    a = F.pow(F.sin(F.radians(lat - 38) / 2), 2) + F.cos(F.radians(F.lit(38))) * F.cos(F.radians(lat)) * F.pow(F.sin(F.radians(lon + 121) / 2), 2)
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(2 * 6371.0088 * F.asin(F.sqrt(a)), 3).alias("km"))


@query("SELECT p_brand, round(sum(l_quantity / n * p_size), 3) AS kg FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1")
def flow_split_emissions(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")))
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return li.join(p, li.l_partkey == p.p_partkey).groupBy("p_brand").agg(F.round(F.sum(F.col("l_quantity") / F.col("n") * F.col("p_size")), 3).alias("kg"))


@query("SELECT CASE WHEN l_quantity < 10 THEN '[0,10)' WHEN l_quantity < 30 THEN '[10,30)' ELSE '[30,)' END AS bin, count(*) AS n FROM lineitem GROUP BY 1")
def binning_right_open(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy(F.when(q < 10, "[0,10)").when(q < 30, "[10,30)").otherwise("[30,)").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, array_to_string(list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(t, x)), ';') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)")
def sorted_difference(spark, sf_dir):
    every = F.array(*(F.lit(x) for x in sorted(EVENT_STATUS)))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    return g.select("user_id", F.array_join(F.sort_array(F.array_except(every, "t")), ";").alias("missing"))


@query("SELECT user_id, " + ", ".join(f"coalesce(max(CASE WHEN event_type = '{e}' THEN {_CASE} END), '0') AS {e}" for e in sorted(EVENT_STATUS)) + " FROM events GROUP BY 1")
def pivot_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", _event_status().alias("status"))
    return rel.pivot_values(e, ["user_id"], "event_type", "status", sorted(EVENT_STATUS), "0")


@query("SELECT doc_id, 'quality' AS metric, quality AS v FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels")
def unpivot_metrics(spark, sf_dir):
    return table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "metric", "v")


@query("SELECT user_id, max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS c1, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS c2, max(CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END) = 1 AS any_code FROM events GROUP BY 1")
def binary_code_pivot(spark, sf_dir):
    is_ = lambda n: F.max(F.when(F.col("event_type") == n, 1).otherwise(0))
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(is_("click").alias("c1"), is_("view").alias("c2"))
    return g.withColumn("any_code", (F.col("c1") + F.col("c2")) > 0)


@query("SELECT doc_id, coalesce(nullif(trim(lang), ''), nullif(trim(source), ''), 'none') AS place FROM documents")
def coalesce_blank(spark, sf_dir):
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(blank(F.col("lang")), blank(F.col("source")), F.lit("none")).alias("place"))


_TREE_SQL = "SELECT 'n' || n_nationkey AS c, 'r' || n_regionkey AS p FROM nation UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region"


@query(f"WITH RECURSIVE e AS ({_TREE_SQL}), a(node, ancestor) AS (SELECT c, c FROM e UNION SELECT p, p FROM e UNION SELECT a.node, e.p FROM a JOIN e ON a.ancestor = e.c) SELECT node, ancestor FROM a")
def ancestor_closure(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    e = n.select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("c"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("p"))
    return rel.ancestors(e.union(r.select(F.concat(F.lit("r"), F.col("r_regionkey")), F.lit("world"))), "c", "p")


@query("WITH r(rule, conjunct, token) AS (VALUES " + ", ".join(map(str, RULES)) + "), need AS (SELECT rule, conjunct, count(*) AS k FROM r GROUP BY 1, 2), have AS (SELECT user_id, rule, conjunct, count(DISTINCT token) AS k FROM events JOIN r ON event_type = token GROUP BY 1, 2, 3) SELECT DISTINCT user_id, rule FROM have JOIN need USING (rule, conjunct, k)")
def dnf_rule_match(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "rule string, conjunct int, token string")
    return rel.dnf_match(table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("token")), rules, "user_id")


@query("SELECT conv_id FROM conversations GROUP BY 1 HAVING sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) BETWEEN 1 AND 3")
def multi_rule_counts(spark, sf_dir):
    g = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("u"))
    return g.filter("u BETWEEN 1 AND 3").select("conv_id")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_items(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_rows(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("SELECT user_id FROM events GROUP BY 1 HAVING min(CAST(ts AS DATE)) > (SELECT min(CAST(ts AS DATE)) FROM events)")
def incremental_antijoin(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("d"))
    day = e.agg(F.min("d").alias("d0"))
    old = e.join(F.broadcast(day), F.col("d") == F.col("d0")).select("user_id")
    return e.select("user_id").distinct().join(old, "user_id", "left_anti")


def main_names() -> list[str]:
    return sorted(QUERIES)
