"""Queries over sites: surveys carried to places, sites with their documents, trains of a source, runs side by side."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlattice.operators import emissions, permits, rules
from factlattice.session import table

from .catalogue import _BIT, _DECODE, _event_status, query
from .domain import _HALVES, _LABELS, _labels, _user_hour

_STATUS = "CASE o_orderstatus WHEN 'O' THEN 8 WHEN 'P' THEN 4 ELSE 1 END"


def _orders(spark, sf_dir, key):
    """Orders as statuses of processes (their priorities)."""
    status = F.when(F.col("o_orderstatus") == "O", "PRESENT").when(F.col("o_orderstatus") == "P", "FUTURE").otherwise("PAST")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias(key), F.col("o_orderpriority").alias("process"), status.alias("status"))


@query(f"""SELECT c_nationkey AS place_id, o_orderpriority AS process, {_DECODE.format(f'bit_or({_STATUS})')} AS status FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE c_mktsegment NOT IN ('BUILDING', 'HOUSEHOLD') AND c_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY 1, 2""")
def surveyed_places(spark, sf_dir):
    """A survey's statuses (customers' orders) carried by a cross-walk to places; blank and NA ids link nothing."""
    survey = _orders(spark, sf_dir, "survey_id").withColumn("survey_id", F.col("survey_id").cast("string"))
    listed = F.when(F.col("c_mktsegment") == "BUILDING", "na").when(F.col("c_mktsegment") == "HOUSEHOLD", " ").otherwise(F.col("c_custkey").cast("string"))
    crosswalk = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("place_id"), listed.alias("survey_id"))
    return permits.survey_facilities(survey, crosswalk, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("place_id")))


@query("""WITH o AS (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderstatus AS s, o_orderpriority AS p, o_orderkey AS place FROM orders),
  li AS (SELECT DISTINCT k, d FROM o WHERE d IN (SELECT d FROM o WHERE s = 'O')), sh AS (SELECT d, count(*) > 1 AS shared FROM li GROUP BY 1), f AS (SELECT k, arg_min(p, place) AS p FROM o GROUP BY 1)
  SELECT c_custkey AS place_id, coalesce(li.d, '') AS document, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE coalesce(f.p, '') END AS order_no, coalesce(sh.shared, false) AS shared
  FROM customer LEFT JOIN f ON f.k = c_custkey LEFT JOIN li ON li.k = c_custkey LEFT JOIN sh ON sh.d = li.d WHERE coalesce(f.p, '') <> '1-URGENT'""")
def sites_with_documents(spark, sf_dir):
    """Customers with the days of their orders as documents: a row per site and accepted document, or one with a blank."""
    orders = table(spark, sf_dir, "orders").withColumn("document", F.date_format("o_orderdate", "yyyy-MM-dd"))
    c = table(spark, sf_dir, "customer").withColumn("facility_id", F.concat(F.lit("F"), F.col("c_custkey").cast("string")))
    lists = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("document").alias("documents"))
    own = F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment")).otherwise(" ")
    facilities = c.join(lists, "c_custkey", "left").select(F.col("c_custkey").alias("place_id"), "facility_id", F.col("c_name").alias("name"), F.coalesce("documents", F.array().cast("array<string>")).alias("documents"), own.alias("order_no"))
    agency = F.when(F.col("o_orderpriority") == "1-URGENT", "Organizations under order").otherwise("Board")
    about = orders.join(c, orders.o_custkey == c.c_custkey).select(F.concat(F.lit(" "), "facility_id").alias("facility_id"), F.col("c_name").alias("name"), agency.alias("agency"), F.col("o_orderpriority").alias("order_no"), F.col("o_orderkey").alias("place"))
    accepted = orders.filter("o_orderstatus = 'O'").select("document").distinct()
    return permits.relevant_sites(facilities, accepted, about).select("place_id", "document", "order_no", "shared")


#: Codes of the processes, and what trains require (authored).
LEAF_CODES = [("1-URGENT", ["AS", "BNR"]), ("2-HIGH", ["LAGOON_AER"]), ("3-MEDIUM", ["AND", "BIOGAS_CWNS"]), ("4-NOT SPECIFIED", ["PRIMARY", "TF"]), ("5-LOW", ["STBL_POND"])]
REQUIRES = [("N1", "NIT"), ("N1", "AND"), ("N1E", "NIT"), ("N1E", "BIOGAS_EL"), ("B1", "BASIC_AS"), ("B1", "PRIMARY"), ("P1", "TF_ALL"), ("P1", "AND")]
_values = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
_BIN = "CASE WHEN flow < 2 THEN 0 WHEN flow < 4 THEN 1 WHEN flow < 7 THEN 2 WHEN flow < 16 THEN 3 WHEN flow < 46 THEN 4 WHEN flow < 100 THEN 5 ELSE 6 END"
_KEYED = "'BASIC_AS', 'AS_BNR_N', 'TF_ALL', 'NIT', 'AND', 'PRIMARY'"


@query(f"""WITH leaf(process, code) AS (VALUES {_values((p, c) for p, cs in LEAF_CODES for c in cs)}), req(train, code) AS (VALUES {_values(REQUIRES)}),
  own AS (SELECT DISTINCT o_custkey AS k, code FROM orders JOIN leaf ON process = o_orderpriority WHERE o_orderstatus = 'O'),
  h AS (SELECT k, bool_or(code = 'BNR') AS nit, bool_or(code = 'AS') AS a, bool_or(code = 'TF') AS t, bool_or(code = 'AND') AS d, bool_or(code = 'STBL_POND') AS pond FROM own GROUP BY 1),
  r AS (SELECT k, code FROM own JOIN h USING (k) WHERE NOT (code IN ('LAGOON_AER', 'STBL_POND') AND (a OR t)) UNION SELECT k, 'NIT' FROM h WHERE nit UNION SELECT k, 'BIOGAS_EL' FROM h WHERE d
    UNION SELECT k, 'BASIC_AS' FROM h WHERE a UNION SELECT k, 'AS_BNR_N' FROM h WHERE a AND nit UNION SELECT k, 'TF_ALL' FROM h WHERE t UNION SELECT k, 'LAGOON_UNCATEGORIZED' FROM h WHERE pond AND NOT a AND NOT t),
  fa AS (SELECT *, {_BIN} AS bin FROM (SELECT c_custkey AS k, (c_custkey % 60) + 0.5::DOUBLE AS flow FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders))),
  tr AS (SELECT k, train FROM r JOIN req USING (code) GROUP BY 1, 2 HAVING count(*) = 2 UNION SELECT k, code FROM r WHERE code IN ('LAGOON_AER', 'LAGOON_UNCATEGORIZED')),
  kn AS (SELECT k, bin, flow, train, CASE WHEN train = 'N1E' THEN 'N1' ELSE train END AS base FROM tr JOIN fa USING (k)), top AS (SELECT max(flow) AS flow FROM kn WHERE base LIKE 'LAGOON%'),
  n AS (SELECT bin, base, count(*) AS n FROM kn GROUP BY 1, 2),
  ranks AS (SELECT 0 AS stage, bin, base, row_number() OVER (PARTITION BY bin ORDER BY n DESC, base) AS place FROM n UNION ALL SELECT 1, NULL, base, row_number() OVER (ORDER BY sum(n) DESC, base) FROM n GROUP BY base),
  op AS (SELECT *, k IN (SELECT k FROM r WHERE code IN ('NIT', 'AS_BNR_N')) AS nit FROM fa WHERE k NOT IN (SELECT k FROM tr)),
  asked AS (SELECT op.k, base, stage, place, EXISTS (SELECT 1 FROM r JOIN req USING (code) WHERE r.k = op.k AND req.train = base AND code IN ({_KEYED})) AS fits
    FROM op JOIN ranks ON (stage = 1 OR ranks.bin = op.bin) AND (base = 'N1') = nit, top WHERE base NOT LIKE 'LAGOON%' OR op.flow <= top.flow),
  every AS (SELECT k, train FROM tr UNION ALL SELECT k, arg_min(base, stage * 1000 + CASE WHEN fits THEN 0 ELSE 100 END + place) FROM asked GROUP BY 1)
  SELECT fa.k AS facility, fa.flow, coalesce(train, '') AS train FROM fa LEFT JOIN every USING (k)""")
def source_trains(spark, sf_dir):
    """A source's facilities (customers with orders) and their trains, by their codes, a proxy for biogas, else a fallback."""
    link = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_custkey").alias("facility"), ((F.col("c_custkey") % 60) + 0.5).cast("double").alias("flow"))
    leaf_codes = spark.createDataFrame(LEAF_CODES, "leaf string, codes array<string>")
    facilities, trains = emissions.source(_orders(spark, sf_dir, "place_id"), link, leaf_codes, spark.createDataFrame(REQUIRES, "train string, code string"), proxy=True)
    return facilities.join(trains, "facility", "left").select("facility", "flow", F.coalesce("train", F.lit("")).alias("train"))


@query(f"""WITH {_LABELS}, m AS (SELECT user_id AS k, event_type AS process, {_DECODE.format(f'bit_or({_BIT})')} AS status FROM ({_HALVES}) WHERE d > 15 GROUP BY 1, 2), about AS (SELECT k, max(k % 24) AS hour FROM l WHERE status IS NOT NULL GROUP BY 1),
  f AS (SELECT 'keywords' AS method, '' AS model, * FROM p UNION ALL SELECT 'model', 'm1', * FROM m)
  SELECT 'Manual Read' AS method, '' AS model, k, k % 24 AS hour, process, status FROM l WHERE status IS NOT NULL
  UNION ALL SELECT method, model, k, coalesce(hour, -1), process, status FROM f LEFT JOIN about USING (k) WHERE status IS NOT NULL""")
def runs_side_by_side(spark, sf_dir):
    """Labels and the predictions of two runs, stacked; predictions get the labels' hour."""
    labels, found = _labels(spark, sf_dir)
    later = table(spark, sf_dir, "events").filter(F.dayofmonth("ts") > 15).select(_user_hour("k"), F.col("event_type").alias("process"), _event_status().alias("status"))
    stacked = rules.runs({("keywords", None): found, ("model", "m1"): permits.collapsed(later, ["k"])}, labels.withColumn("hour", F.col("k") % 24), "k", ["hour"])
    return stacked.withColumn("model", F.coalesce("model", F.lit(""))).withColumn("hour", F.coalesce("hour", F.lit(-1)))
