"""Operators of the domain on small cases: the lattice within and across documents, taxonomy, rules, documents
in force, surveys, scores, needs, emissions, ontologies."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from factlattice.functions import dates, numbers
from factlattice.functions import status as st
from factlattice.functions import text as tx
from factlattice.operators import emissions, keywords, needs, ontology, permits, priority, records, rules, scoring, survey, taxonomy
from factlattice.operators import relational as rel

TREE = {
    "Lagoon": {
        "Pond": {
            "Aerated Lagoon": {"alt_names": ["aerated lagoon"], "alt_names_case_sensitive": [], "priority": 1, "ontology_triggers": ["Equipment-Pond", "Process-Aeration"], "cwns_processes": ["Lagoons, Aerated", "Old Lagoon"], "werf_codes": ["LAGOON_AER"]},
            "Unspecified Lagoon": {"alt_names": ["lagoon", "pond"], "alt_names_case_sensitive": [], "priority": 1000, "global_priority": 2, "ontology_triggers": [["Equipment-Pond"], ["Water-Hyacinth"]]},
        }
    },
    "Filtration": {
        "Media Filtration": {"alt_names": ["media filter"], "alt_names_case_sensitive": ["MF", "FeCl3"], "priority": 1, "ontology_triggers": ["Equipment-Filter"], "exclude_if_any": ["Equipment-GritChamber"]},
        "Unspecified Filtration": {"alt_names": ["filter"], "alt_names_case_sensitive": [], "priority": 5, "global_priority": 2, "ontology_triggers": ["Process-Filtration"]},
    },
    "Disinfection": {
        "Chlorination": {"alt_names": ["chlorin"], "alt_names_case_sensitive": [], "ontology_triggers": ["Chlorine"], "secondary_category": ["Chemical Addition"]},
        "UV Disinfection": {"alt_names": [], "alt_names_case_sensitive": ["UV"]},
        "Unspecified Disinfection": {"alt_names": ["disinfect"], "alt_names_case_sensitive": [], "priority": 9, "global_priority": 2},
    },
    "Chemical Addition": {
        "Neutralization": {"alt_names": ["neutraliz"], "alt_names_case_sensitive": [], "priority": 1},
        "Unspecified Chemical Addition": {"alt_names": ["chemical addition"], "alt_names_case_sensitive": [], "priority": 1000},
    },
    "Activated Sludge": {
        "Anoxic Tanks": {"alt_names": ["anoxic"], "alt_names_case_sensitive": [], "ontology_triggers_multi": {"Equipment": ["Reactor"], "role_counts": {"Aerobic": {"min": 1}, "Anoxic": {"min": 2, "max": 3}}}, "exclude_if_any": ["Role-Anaerobic"]},
    },
}


@pytest.fixture(scope="module")
def tax(spark):
    return taxonomy.table(spark, TREE).cache()


def statuses(spark, rows):
    return spark.createDataFrame(rows, "doc string, process string, status string")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_status_of_implementation(spark):
    cases = [("present", None, "PRESENT"), ("present", "off-site", "OFFSITE"), ("future", "off_site", None), ("past", "off-site", None), ("off-site", None, "OFFSITE"), (" Future ", "on-site", "FUTURE"), ("third-party", "x", "OFFSITE"), (None, None, None), ("maybe", None, None), ("past", None, "PAST")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, a string, b string")
    got = {r.i: r.s for r in df.select("i", st.of_implementation(F.col("a"), F.col("b")).alias("s")).collect()}
    assert got == {i: c for i, (_, _, c) in enumerate(cases)}
    one = spark.createDataFrame([(s,) for s in ("PAST", "FUTURE", "PRESENT", "OFFSITE")], "s string")
    assert one.agg(st.best(F.col("s"))).first()[0] == "PRESENT"  # no join within a document


def test_text_functions(spark):
    df = spark.createDataFrame([("a_b_c.pdf", " X  y ", "R5-2007-0090")], "f string, t string, o string")
    row = df.select(
        tx.before(F.col("f"), "_"), tx.after(F.col("f"), "_"), tx.last_part(F.col("f"), "_"), tx.stem(F.col("f")), tx.slug(F.col("t")), tx.squashed(F.col("t")), tx.letters_digits(F.col("o")),
        tx.count_of(F.col("f"), "_"), tx.fixed(F.lit(2.0005), 3), tx.without_prefix(F.col("o"), "R5-"), tx.without_suffix(F.col("f"), ".pdf"), tx.one_spaced(F.col("t")), tx.after(F.col("f"), "|"),
        tx.contains_any(F.col("f"), ["zz", "b_c"]), tx.found(F.col("o"), r"\d+"),
    ).first()
    assert list(row)[:14] == ["a", "b_c.pdf", "c.pdf", "a_b_c", "X_y", "xy", "R520070090", 3, "2.001" if f"{2.0005:.3f}" == "2.001" else f"{2.0005:.3f}", "2007-0090", "a_b_c", "X y", "", True]
    assert [(m.start, m.end, m.match) for m in row[14]] == [(1, 2, "5"), (3, 7, "2007"), (8, 12, "0090")]


def test_dates_and_years(spark):
    orders = {"R9-2020-0191": 2020, "97-10-DWQ": 1997, "05-025": 2005, "5-00-080": 2000, "R5 2007 0090": 0, "abc": 0, "": 0, None: 0, "R11A-89-1": 2089}
    df = spark.createDataFrame([(o,) for o in orders], "o string")
    assert {r.o: r.y for r in df.select("o", dates.adoption_year(F.col("o")).alias("y")).collect()} == orders
    days = spark.createDataFrame([("2022-06-01;2023-06-01",), ("2024-06-01; ",), ("",), (None,)], "d string")
    assert dates.newest_day(days, "d") == "2024-06-01" and days.filter(dates.held_on(F.col("d"), F.lit("2022-06-01"))).count() == 1
    row = spark.createDataFrame([("03/05/2021", "2021-02-30", "x")], "a string, b string, c string").select(*(dates.parsed(F.col(c)).cast("string") for c in "abc")).first()
    assert list(row) == ["2021-03-05", None, None] and dates.run_day("2020-01-01") == "2020-01-01" and len(dates.run_day()) == 10


def test_numbers(spark):
    df = spark.createDataFrame([(" 1.5", "x", 0.125, 2.0, 46.0)], "a string, b string, c double, d double, e double")
    bins = lambda c: numbers.binned(F.col(c), emissions.EDGES, emissions.BINS)
    row = df.select(numbers.numeric(F.col("a")), numbers.numeric(F.col("b")), numbers.half_even(F.col("c"), 2), bins("d"), bins("e"), numbers.percent_of(F.lit(352), F.lit(390)), numbers.percent_change(F.lit(3.0), F.lit(2.0)), numbers.percent_change(F.lit(3.0), F.lit(0.0))).first()
    assert list(row) == [1.5, None, 0.12, "2-4", "46-100", 90.3, 50.0, None]
    near = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (38.0, -121.0, 38.0, -121.0), (38.5, -121.5, 34.0, -118.25), (None, 0.0, 0.0, 0.0)], "a double, b double, c double, d double")
    got = [r[0] for r in near.select(numbers.geodesic_miles(*(F.col(c) for c in "abcd"))).collect()]
    assert math.isclose(got[0], 111_319.4907932 / 1609.344, rel_tol=1e-9) and got[1] == 0 and got[3] is None
    km = near.select(numbers.great_circle_km(*(F.col(c) for c in "abcd"))).collect()
    assert all(abs(k[0] / 1.609344 - g) < 0.006 * g + 1e-9 for k, g in zip(km[:3], got[:3]))


def test_taxonomy_flattens_and_refuses_doubles(spark, tax):
    rows = {r.leaf: r for r in tax.collect()}
    assert len(rows) == 10 and rows["Aerated Lagoon"].grp == "Pond" and rows["Aerated Lagoon"].category == "Lagoon"
    assert rows["Media Filtration"].grp == "Filtration" and rows["Unspecified Lagoon"].clauses == [["Equipment-Pond"], ["Water-Hyacinth"]]
    assert taxonomy.table(spark, TREE, without=("Pond",)).count() == 8 and taxonomy.scored(tax, units_only=True).count() == 6
    with pytest.raises(ValueError, match="twice"):
        taxonomy.rows({"A": {"X": {"alt_names": []}}, "B": {"X": {"alt_names": []}}})
    looked = spark.createDataFrame([(" OLD lagoon", "C2"), ("Old Lagoon", "C1"), ("x", "C3"), ("Old Lagoon", None)], "name string, code string")
    assert dict(map(tuple, taxonomy.leaf_codes(tax, looked).filter("size(codes) > 0").collect())) == {"Aerated Lagoon": ["C1", "C2"]}
    assert as_set(taxonomy.codes_of(looked, "Old Lagoon").filter("code IS NOT NULL")) == {("C1",)}


def test_keywords(spark, tax):
    mark = keywords.SEPARATOR
    texts = {
        "a": "An Aerated  Lagoon and a LAGOON." + mark + "UVs will be added.",  # sibling pruned; plural acronym
        "b": "The WWMF has a ﬁlter; MFs too, fecl3" + mark + "a filter",  # tokens, not parts; cased parts
        "c": "Chlor­ination.",  # backfills its secondary category; zero-width characters go
        "d": mark + "a filter",  # no description: nothing
        "e": "SCADUV uv",
    }
    got = as_set(keywords.table(spark.createDataFrame(list(texts.items()), "doc string, text string"), "doc", tax))
    assert got == {
        ("a", "Aerated Lagoon", "PRESENT"), ("a", "UV Disinfection", "FUTURE"), ("b", "Media Filtration", "PRESENT"), ("c", "Chlorination", "PRESENT"), ("c", "Unspecified Chemical Addition", "PRESENT"),
    }
    docs = spark.createDataFrame([("a", "A media filter, a pond,  an aerated lagoon" + mark + "x")], "doc string, text string")
    assert [r.query for r in keywords.queries_for(docs, "doc", tax).orderBy("place").collect()] == ["Aerated Lagoon wastewater treatment", "Media Filtration wastewater treatment", "Unspecified Filtration wastewater treatment", "A media filter, a pond, an aerated lagoon"]


def test_terms_against_plain_search():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abAB1 ") for _ in range(rng.randint(1, n)))
    for _ in range(60):
        leaves = [(f"L{i}", [word(3) for _ in range(2)], [word(3) for _ in range(2)]) for i in range(5)]
        text = word(30)
        tokens = set("".join(c if c.isalnum() else " " for c in text).split())
        cased = lambda t: (t in tokens or t + "s" in tokens) if t.isalnum() and t.isupper() else t in text  # noqa: B023, E731
        assert keywords.Terms(leaves).of(text) == {leaf for leaf, names, own in leaves if any(n.lower() in text.lower() for n in names) or any(cased(t.strip()) for t in own)}


def test_priority_looks_at_present_cells_only(spark, tax):
    rows = statuses(spark, [("a", "Media Filtration", "FUTURE"), ("a", "Unspecified Filtration", "PRESENT"), ("b", "Media Filtration", "PRESENT"), ("b", "Unspecified Filtration", "PRESENT_AND_FUTURE"), ("b", "Unspecified Lagoon", "FUTURE")])
    assert as_set(priority.three_stages(rows, ["doc"], tax)) == {("a", "Media Filtration", "FUTURE"), ("a", "Unspecified Filtration", "PRESENT"), ("b", "Media Filtration", "PRESENT"), ("b", "Unspecified Lagoon", "FUTURE")}


def test_backfill(spark, tax):
    rows = statuses(spark, [("a", "Chlorination", "PRESENT"), ("a", "Unspecified Chemical Addition", "FUTURE"), ("b", "Chlorination", "PRESENT"), ("b", "Neutralization", "PRESENT"), ("c", "Chlorination", "FUTURE"), ("d", "Chlorination", "PRESENT"), ("e", "Chlorination", "PRESENT_AND_FUTURE")])
    matched = statuses(spark, [("d", "Neutralization", "")]).drop("status")
    excluded = statuses(spark, [("e", "Unspecified Chemical Addition", "")]).drop("status")
    got = as_set(priority.backfill(rows, ["doc"], tax, matched, excluded).filter("process <> 'Chlorination'"))
    assert got == {("a", "Unspecified Chemical Addition", "PRESENT"), ("b", "Neutralization", "PRESENT"), ("d", "Neutralization", "PRESENT"), ("e", "Neutralization", "PRESENT")}


def judged(spark, values, rule=None):
    """read() of each value, as JSON unless it is text already."""
    bodies = [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]
    rows = spark.createDataFrame(list(enumerate(bodies)), "n int, body string").select("n", records.read(F.col("body"), rule).alias("r"))
    assert "Python" not in rows._jdf.queryExecution().toString() and "Arrow" not in rows._jdf.queryExecution().toString()
    return [r.r for r in rows.orderBy("n").collect()]


def test_records_are_mended(spark):
    item = {"Equipment": None, "Process": ["x"], "Role": None, "Substance": None, "Implementation": "present", "Location": None, "Sentence": "s"}
    right = [{"items": [item]}, {"items": []}, {"items": [{**item, "Location": "on-site", "Role": ["r"], "Equipment": "e", "Process": None}]}]
    wrong = [[item], {"items": [{**item, "Process": None}]}, {"items": [{**item, "Process": []}]}, {"items": [{**item, "more": 1}]}, {"items": [{**item, "Implementation": "soon"}]}, {"items": [{**item, "Implementation": None}]}, {"items": [item, 3]}, {"items": [{**item, "Process": ["x", 1]}]}, {"items": [{k: v for k, v in item.items() if k != "Location"}]}, {"items": [item], "x": 1}, 3, None, ""]
    assert [r.valid for r in judged(spark, right + wrong)] == [True] * len(right) + [False] * len(wrong)
    short = {"items": [{k: item[k] for k in ("Process", "Implementation", "Location", "Sentence")}]}
    assert judged(spark, [short], records.schema(lists_only=True))[0].valid and not judged(spark, [{"items": [item]}], records.schema(web=True))[0].valid
    assert judged(spark, [{"items": [{**item, "Source": "both", "Website": None}]}], records.schema(web=True))[0].valid
    odd = [[item], {"output": {"items": [item]}}, {"result": [item]}, item, {"items": item}, {"data": [item], "items": 3}, {"items": "x", "results": {"items": [item]}, "data": [3]}]
    for r in judged(spark, odd):
        assert r.failure is None and json.loads(r.raw) == [item] and r["items"][0].Process == ["x"] and r["items"][0].Sentence == "s"
    several = judged(spark, [{"items": [{**item, "Role": [], "Location": ["on-site", "x"], "Equipment": []}]}])[0]
    assert json.loads(several.raw) == [{**item, "Location": "on-site"}] and several["items"][0].Location == "on-site"
    bad = [3, '"x"', {"additionalProperties": True}, {"items": 3}, [1], "none", '{"items": []} more', '[] ] [', '{"items": [], "items": []}', " ", None]
    assert [r.failure for r in judged(spark, bad)] == ["not an object"] * 2 + ["no list of items"] * 3 + ["not JSON"] * 6
    texts = judged(spark, [[{"Process": [" a ", "", None, 3, True, ["b"]], "Role": "x", "Sentence": 7}]])[0]["items"][0]
    assert texts.Process == ["a", "3", "true", '["b"]'] and texts.Role == ["x"] and texts.Substance == [] and texts.Sentence == "7"
    long = judged(spark, [{"items": [{**item, "Sentence": "s" * 300_000}] * 10}])[0]
    assert long.valid and len(long["items"]) == 10 and len(long["items"][9].Sentence) == 300_000


def test_records_are_read_and_attributed(spark, tmp_path):
    bodies = {"one.a_12": '{"items": [{"Process": "Aeration", "Role": []}]}', "two_7": "no json", "Three X_9": "[]", "bad_7_FAILED": "{}"}
    for name, body in bodies.items():
        (tmp_path / f"{name}.json").write_text(body)
    found = records.scan(spark, f"file://{tmp_path}")
    assert {(r.document, r.place_id) for r in found.collect()} == {("one.a", "12"), ("two", "7"), ("Three X", "9")}
    read = {r.stem: r.x for r in found.select("stem", records.read(F.col("body")).alias("x")).collect()}
    assert read["one.a_12"]["items"][0].Process == ["Aeration"] and not read["one.a_12"].valid and read["two_7"].failure and read["Three X_9"]["items"] == []
    sites = spark.createDataFrame([(1, "one.a.pdf", "12", "A"), (2, "one.a.pdf", "12", "B"), (3, "three x.pdf", "9", "C")], "place int, document string, place_id string, name string")
    mine, others = records.attributed(found.select("stem", "body"), sites)
    assert {(r.stem, r.site.name) for r in mine.collect()} == {("one.a_12", "A"), ("Three X_9", "C")} and [r.stem for r in others.collect()] == ["two_7"]
    assert records.pinned(found, sites.filter("place = 1")).count() == 1
    text = spark.createDataFrame([('so {"a": {"b": 1}} it is',), ("none",)], "t string")
    assert [r[0] for r in text.select(records.outermost(F.col("t"))).collect()] == ['{"a": {"b": 1}}', None]


ITEM = "doc string, item int, Equipment array<string>, Process array<string>, Role array<string>, Substance array<string>, Implementation string, Location string"


@pytest.fixture(scope="module")
def world(spark):
    edges = spark.createDataFrame([("OxidationPond", "Pond"), ("Pond", "UnitProcess"), ("Process-DiffusedAeration", "Process-Aeration"), ("SandFilter", "Filter"), ("BatchReactor", "Reactor")], "child string, parent string")
    does = spark.createDataFrame([("Filter", "Process-Filtration"), ("OxidationPond", "Process-DiffusedAeration")], "equipment string, process string")
    return rel.ancestors(edges, "child", "parent"), does


def test_rules(spark, tax, world):
    rows = [
        ("a", 0, ["OxidationPond"], [], [], [], "present", None),  # an ancestor and an implied process fire the better rule, which gates the other
        ("b", 0, ["Pond"], [], [], [], "future", None),
        ("b", 1, ["Pond"], ["Aeration"], [], [], "past", "off-site"),  # no status
        ("c", 0, ["SandFilter", "GritChamber"], [], [], ["Chlorine"], "present", "off-site"),  # excluded; a substance; backfilled
        ("d", 0, [], ["Media Filtration"], [], [], "present", None),  # named directly
        ("e", 0, ["BatchReactor"], [], ["Aerobic", "Anoxic"], [], "future", None),
        ("e", 1, ["Reactor"], [], ["Anoxic"], [], "present", None),  # roles summed over items; the best status
        ("f", 0, ["Reactor"], [], ["Aerobic", "Anoxic", "Anoxic", "Anaerobic"], [], "present", None),  # cancelled
        ("g", 0, ["Reactor"], [], ["Aerobic", "Anoxic", "Anoxic", "Anoxic", "Anoxic"], [], "present", None),  # too many
    ]
    items = spark.createDataFrame(rows, ITEM)
    got = as_set(rules.document_statuses(items, "doc", "item", tax, *world))
    assert got == {
        ("a", "Aerated Lagoon", "PRESENT"), ("b", "Unspecified Lagoon", "FUTURE"), ("c", "Chlorination", "OFFSITE"), ("c", "Unspecified Chemical Addition", "OFFSITE"),
        ("d", "Media Filtration", "PRESENT"), ("e", "Anoxic Tanks", "PRESENT"),
    }
    # "c" has Filtration by what its equipment does, but the global priority of Chlorination is better
    shown = rules.triggers(rules.item_processes(items, ["doc", "item"], tax, *world), ["doc", "item"])
    assert {(r.doc, r.item): r.trigger_process for r in shown.collect()}[("c", 0)] == ["Chlorination", "Unspecified Chemical Addition"]
    listed = spark.createDataFrame([("a", ["Chlorination", "x"], "future", None), ("a", ["Chlorination"], "present", None)], "doc string, Process array<string>, Implementation string, Location string")
    assert as_set(rules.listed_statuses(listed, "doc", tax)) == {("a", "Chlorination", "PRESENT")}
    manual = spark.createDataFrame([("a", "A", "Chlorination", "PRESENT")], "doc string, name string, process string, status string")
    both = rules.runs({("Ontology", "m1"): statuses(spark, [("a", "Chlorination", "PAST")])}, manual, "doc", ["name"])
    assert {(r.method, r.model, r.name) for r in both.collect()} == {("Manual Read", None, "A"), ("Ontology", "m1", "A")}


def test_documents_in_force(spark):
    listed = spark.createDataFrame(
        [("1.0", "R5-2007-0090", "2021-06-01;2022-06-01"), ("2", "2014-0153-DWQ", "2022-06-01"), ("3", "R1-2019-0001", "2021-06-01"), ("5", "", "2022-06-01")], "place_id string, order_no string, as_of_dates string"
    )
    docs = [
        ("1", "new", "2007 0090", "x"), ("1", "old", "97-10", "x"),  # contained in the listed number
        ("2", "enrolled", "WQ 2014-0153-DWQ-R5348", "x"), ("2", "none", "", "x"),  # contains it; unreadable is worse
        ("3", "gone", "R1-2019-0001", "R1-2019-0001"), ("3", "other", "R1-2012-0001", "R1-2019-0001"),  # not held that day: its own number
        ("4", "a", "R9-2010-0001", "z"), ("4", "b", "05-025", "z"), ("4", "c", "R9-2010-0007", "z"),  # all superseded: the newest year
        ("5", "empty current", "2011-1", "2011-1"), ("5", "telling old", "2001-1", "2011-1"),  # an empty current document loses
    ]
    documents = spark.createDataFrame(docs, "place_id string, document string, document_order string, order_no string")
    shown = spark.createDataFrame([(p, d, "X", "PRESENT" if d != "empty current" else "0") for p, d, *_ in docs], "place_id string, document string, process string, status string")
    kept = {(r.place_id, r.document) for r in permits.in_force(documents, listed, shown, "2022-06-01").collect()}
    assert kept == {("1", "new"), ("2", "enrolled"), ("3", "gone"), ("4", "a"), ("4", "c"), ("5", "telling old")}
    about, merged = permits.facility_table(documents.withColumn("name", F.upper("document")).withColumn("o", F.monotonically_increasing_id()), listed, shown.withColumn("status", F.when(F.col("document") == "c", "FUTURE").otherwise(F.col("status"))), ["name"], "o")
    assert {(r.place_id, r.name) for r in about.collect()} >= {("1", "NEW"), ("4", "A")}
    assert ("4", "X", "PRESENT_AND_FUTURE") in as_set(merged)  # the join is made across documents


def test_snapshots_sites_and_names(spark):
    kind = "place_id string, measure_id string, order_no string, document string, agency string, name string"
    old = spark.createDataFrame([("1", "m", "o", "d", "A", "old"), ("2", "", "o2", "d2", "A", "n"), ("3", "m3", "o", "d", "Organizations under x", "n")], kind)
    new = spark.createDataFrame([("1", "m", "other", "d", "A", "new"), ("2", " ", "o3", "d2", "A", "n")], kind)
    got = {(r.place_id, r.order_no, r.name, r.as_of_dates, r.n_snapshots) for r in permits.snapshot_union({"2022-06-01": old, "2023-06-01": new}).collect()}
    assert got == {("1", "other", "new", "2022-06-01;2023-06-01", 2), ("2", "o2", "n", "2022-06-01", 1), ("2", "o3", "n", "2023-06-01", 1)}
    fac = spark.createDataFrame([("1", "f1", "N1", ["a.pdf", "b.pdf"], ""), ("2", "f2", "N2", ["a.pdf"], "own"), ("3", "f3", "N3", ["x.pdf"], "")], "place_id string, facility_id string, name string, documents array<string>, order_no string")
    about = spark.createDataFrame([(1, " f1", "N1 ", "A", "o1"), (2, "f1", "N1", "B", "o9"), (3, "f2", "N2", "A", "o2")], "place int, facility_id string, name string, agency string, order_no string")
    rows = {(r.place_id, r.document, r.order_no, r.shared) for r in permits.relevant_sites(fac, spark.createDataFrame([("a.pdf",), ("b.pdf",)], "document string"), about).collect()}
    assert rows == {("1", "a.pdf", "o1", True), ("1", "b.pdf", "o1", False), ("2", "a.pdf", "own", True), ("3", "", "", False)}
    names = spark.createDataFrame([("2014 report.pdf", 3), ("order_memo.pdf", 3), ("a_map.b", 3), ("map.pdf", 3), ("amap.pdf", 3), ("xmemo", 3), ("amendment.pdf", 2), ("amendment order.pdf", 2), ("letter.pdf", 1), ("a.memo", 5)], "n string, k int")
    assert {r.n for r in names.filter(permits.name_wanted(tx.stem(F.col("n")), F.col("k"))).collect()} == {"order_memo.pdf", "map.pdf", "amap.pdf", "xmemo", "amendment order.pdf", "letter.pdf", "a_map.b", "a.memo"}
    regions = spark.createDataFrame([("R5-2007", "x", "2"), ("", "my r3_x.pdf", "SB"), ("7", "x", "4 x"), ("", "", "SB"), (None, None, None)], "o string, d string, r string")
    assert [r[0] for r in regions.select(permits.region(F.col("o"), F.col("d"), F.col("r"))).collect()] == ["R5", "R3", "R4", "Unspecified", "Unspecified"]
    other = spark.createDataFrame([(" alpha ", 1), ("ALPHA", 2), ("beta", 3)], "other string, k int")
    assert as_set(permits.by_name(spark.createDataFrame([("Alpha",), ("gamma",)], "name string"), other, "name", "other").select("name", "k")) == {("Alpha", 1), ("Alpha", 2), ("gamma", None)}


def test_document_types(spark):
    general = "===PAGE 0===\nGENERAL   Waste Discharge Requirements\nState Water Resources Control Board"
    cases = [
        (general, 20, None), (general + " Notice of Applicability", 20, "NOA"), ("see the NOA", 20, "NOA"), ("noa", 20, None), ("ca g12345 order", 20, None),
        ("T h e follow- ing x is subject\n to y set forth in this z order", 20, "NPDES"), ("Table 1. Discharger Information", 20, "NPDES"), ("Waste Discharge\nRequirements", 20, "WDR"), ("Waste Discharge Requirements", 9, None), ("hello", 30, None),
    ]
    df = spark.createDataFrame([(i, t, n) for i, (t, n, _) in enumerate(cases)], "i int, t string, n int")
    assert {r.i: r.k for r in df.select("i", permits.document_type(F.col("t"), F.col("n")).alias("k")).collect()} == {i: k for i, (_, _, k) in enumerate(cases)}
    documents = spark.createDataFrame([("a.pdf", "NPDES", 20), ("b.pdf", "NOA", 20), ("c.pdf", None, 3), ("study.pdf", "WDR", 20), ("e.pdf", "WDR", 20), ("f.pdf", None, 2)], "document string, type string, pages int")
    listed = spark.createDataFrame([("1", "a.pdf", "ENROLLEE - WDR"), ("1", "b.pdf", "ENROLLEE - WDR"), ("2", "b.pdf", "ENROLLEE - WDR"), ("2", "x.pdf", "WDR"), ("3", "c.pdf", "WDR"), ("4", "study.pdf", "WDR"), ("4", "y.pdf", "WDR"), ("5", "e.pdf", "WDR"), ("5", "z", "WDR"), ("6", "f.pdf", "WDR")], "place_id string, document string, order_type string")
    assert {r.document: (r.type, r.accepted) for r in permits.accepted_documents(documents, listed).collect()} == {"a.pdf": (None, False), "b.pdf": (None, False), "c.pdf": (None, True), "study.pdf": (None, False), "e.pdf": ("WDR", True), "f.pdf": (None, False)}
    orders = [("1", "WDR", "Active", "01/02/2015", "WDRMUNILRG", "o1", "l"), ("1", "NPDES Permit", "Active", "01/02/2010", "x", "o2", None), ("1", "NPDES PERMIT", "Historical", "01/02/2019", "x", "o3", "l"), ("2", "WDR", "active", "2011-01-01", "OTHER", "o4", "l"), ("3", "WDR", "never active", "2011-01-01", "WDRMUNIOTH", "o5", "l"), ("1", "NPDES PERMIT", "Active", "bad", "x", "o6", "l")]
    table = spark.createDataFrame(orders, "place_id string, type string, status string, effective string, program string, order_no string, link string")
    assert [(r.place_id, r.order_no) for r in permits.governing_orders(table).collect()] == [("1", "o2")]
    assert [(r.place_id, r.order_no) for r in permits.governing_orders(table, "2020-01-01").collect()] == [("1", "o3")]


def test_survey(spark, tax):
    raw = spark.createDataFrame(
        [("0601", 2008, "lagoon a", "Y", "N", None), ("0601", 2012, "lagoon b", "N", "Y", "New"), ("0601", 2012, "gone", "N", "N", "Abandonment"), ("0602", 2012, "lagoon a", "Y", "Y", "No Change"), ("0603", 2012, "lagoon a", "Y", "Y", "No Change, Expansion"), ("0604", 2012, "lagoon a", None, "Y", None)],
        "survey_id string, year int, process string, present string, projected string, change string",
    )
    names = spark.createDataFrame([("lagoon a", "Lagoons, Aerated"), ("lagoon b", "Old Lagoon")], "process string, common string")
    active = survey.records(raw, names).withColumn("place", F.monotonically_increasing_id())
    assert active.count() == 5 and {r.survey_id for r in active.collect()} == {"00601", "00602", "00603", "00604"}
    got = as_set(survey.statuses(active, tax))
    # two names of one leaf: the older record counts
    assert got == {("00601", "Aerated Lagoon", "PRESENT"), ("00602", "Aerated Lagoon", "PRESENT"), ("00603", "Aerated Lagoon", "PRESENT_AND_FUTURE"), ("00604", "Aerated Lagoon", "FUTURE")}
    wide = survey.wide(survey.statuses(active, tax), "survey_id", ["Chlorination", "Aerated Lagoon"])
    assert wide.columns == ["survey_id", "Chlorination", "Aerated Lagoon"] and {r.Chlorination for r in wide.collect()} == {"0"}
    listed = spark.createDataFrame([(2004, "a"), (2008, "a"), (2008, "b"), (2012, "c"), (2012, "a"), (1999, "z")], "year int, facility string")
    processes = spark.createDataFrame([(2004, "a", "x"), (2008, "a", "x"), (2008, "b", "y"), (2012, "a", "y"), (2012, "b", "y")], "year int, facility string, process string")
    table = {r.year: (r.new, r.changed, r.recent, r.new_percent) for r in survey.coverage(listed, processes, processes.select("year", "facility"), [2004, 2008, 2012]).collect()}
    assert table == {2004: (1, None, 0, 33.3), 2008: (1, 0, 0, 33.3), 2012: (1, 1, 2, 33.3)}
    permit = spark.createDataFrame([("1", "CA1", 1), ("1", "CA0", 2), ("2", "cas5", 1), ("4", "CA4", 1)], "survey_id string, permit string, place int")
    walk = spark.createDataFrame([("3", "W3", 1), ("1", "W1", 1), ("", "W", 1)], "survey_id string, permit string, place int")
    known = spark.createDataFrame([("1",), ("2",), ("03",)], "survey_id string")
    assert as_set(survey.required_ids(permit, walk, known)) == {("1", "CA1"), ("03", "W3")}
    linked = spark.createDataFrame([("p1", "s1"), ("p1", "s2"), ("p2", "NA"), ("p3", "s1")], "place_id string, survey_id string")
    rows = spark.createDataFrame([("s1", "X", "PRESENT"), ("s2", "X", "FUTURE")], "survey_id string, process string, status string")
    assert as_set(permits.survey_facilities(rows, linked, linked.filter("place_id <> 'p3'"))) == {("p1", "X", "PRESENT_AND_FUTURE")}


def test_scores(spark, tax):
    labels = spark.createDataFrame([("1", "Chlorination", "PRESENT"), ("1", "Neutralization", "FUTURE"), ("1", "Unspecified Filtration", "PRESENT"), ("2", "Chlorination", "PRESENT_AND_FUTURE"), ("3", "Media Filtration", "PAST")], "k string, process string, status string")
    found = spark.createDataFrame([("1", "Chlorination", "PRESENT"), ("1", "UV Disinfection", "OFFSITE"), ("2", "Chlorination", "PRESENT"), ("9", "Chlorination", "PRESENT"), ("3", "Media Filtration", "0")], "k string, process string, status string")
    r = scoring.run_scores(labels, found, "k", tax).first()
    # key 3 has nothing to score and drops out of the means; categories of 1: {Disinfection, Chemical, Filtration} against {Disinfection}
    assert math.isclose(r.macro_f1, (0.5 + 1) / 2) and math.isclose(r.micro_f1, 4 / 6) and math.isclose(r.category_f1, (0.5 + 1) / 2) and math.isclose(r.state_accuracy, (0.5 + 1) / 2)
    by = {x.process: x for x in scoring.per_label(labels, found, "k", tax.select(F.col("leaf").alias("process"))).collect()}
    c = by["Chlorination"]
    assert (c.tp, c.fp, c.fn, c.tn, c.support_label, c.state_accuracy) == (2, 0, 0, 1, 2, 0.5) and by["Neutralization"].f1 is None and len(by) == 10
    rolled = scoring.by_category(spark.createDataFrame([("1", "Chlorination", "PRESENT"), ("1", "UV Disinfection", "FUTURE")], "k string, process string, status string"), "k", tax.select(F.col("leaf").alias("process"), "category"))
    assert as_set(rolled) == {("1", "Disinfection", "PRESENT_AND_FUTURE")}
    cells = {(x.category, x.source): (x.in_truth, x.tp, x.fp, x.fn) for x in scoring.category_confusion(labels, {"a": found, "b": labels}, "k").collect()}
    assert cells[("Chlorination", "a")] == (2, 2, 0, 0) and cells[("Unspecified Filtration", "a")] == (1, 0, 0, 1) and cells[("Chlorination", "b")] == (2, 2, 0, 0)
    parts = spark.createDataFrame([(2, 1, 1, 10), (0, 0, 0, 5)], "tp int, fp int, fn int, c int")
    get = lambda over: [tuple(x) for x in parts.select(*scoring.error_parts(F.col("tp"), F.col("fp"), F.col("fn"), over, F.col("c"))).collect()]
    assert get("f1") == [(1 / 6, 1 / 6, 2 / 6), (None, None, None)] and get("columns")[0] == (1 / 3, 1 / 7, 2 / 10) and get("truth")[0] == (1 / 3, 1 / 3, 2 / 3)
    assert [x.process for x in scoring.audit(labels, found, "k").collect()][0] == "UV Disinfection"
    usage = spark.createDataFrame([("m", 1_000_000, 0, None, "True"), ("m", 0, 1_000_000, None, "FAILED"), ("w", 0, 0, 2.0, "false"), ("w", 0, 0, None, "true")], "model string, prompt_tokens long, completion_tokens long, billed double, structured string")
    prices = spark.createDataFrame([("m", 1.0, 3.0)], "model string, input_price double, output_price double")
    more = spark.createDataFrame([("m", 0.5)], "model string, extra double")
    assert {x.model: (x.cost, x.structured) for x in scoring.mean_cost(usage, prices, ["model"], more).collect()} == {"m": (2.5, 1.0), "w": (2.0, 0.5)}
    sites = spark.createDataFrame([("1", "R1", "Major", 2, True), ("2", "R1", "", 1, False), ("3", "R2", "Minor x", 3, False)], "place_id string, region string, size string, n_documents int, shared boolean")
    p = {x.population: x for x in scoring.profile(sites, {"all": sites, "one": sites.filter("place_id = '2'")}, ["R1", "R2", "R9"]).collect()}
    assert (p["all"].n, p["all"].R1, p["all"].R9, p["all"].major, p["all"].several, p["all"].shared) == (3, 66.7, 0.0, 50.0, 66.7, 33.3) and p["one"].major is None
    runs = scoring.summary(spark.createDataFrame([("a", 1.0), ("b", 3.0)], "run string, f double"), "run", ["f"])
    assert dict(map(tuple, runs.collect())) == {"a": 1.0, "b": 3.0, "mean": 2.0, "std": math.sqrt(2), "variance": 2.0}


CURVES = {
    "cpi_adjustment": 2.0, "location_factor": 1.5, "national_average_location_factor": 1.0,
    "systems": {
        "lagoon": {"new": {"limit_mgd": 3, "segments": [{"max_mgd": 1, "form": "linear", "a": 10, "b": 5, "basis": "x"}, {"max_mgd": None, "form": "power", "a": 4, "b": 0.5, "basis": "y"}]}, "rehabilitation": {"limit_mgd": 2.1, "segments": [{"max_mgd": None, "form": "linear", "a": 1, "b": 0}]}},
        "add_disinfection": {"uv": {"limit_mgd": 9, "segments": [{"max_mgd": None, "form": "linear", "a": 7, "b": 0}]}, "chlorine": {"limit_mgd": 9, "segments": [{"max_mgd": None, "form": "linear", "a": 3, "b": 0}]}},
    },
}


def test_needs(spark, tax):
    rows = [
        ("a", "Unspecified Lagoon", "FUTURE"), ("b", "Unspecified Lagoon", "PRESENT"), ("b", "Unspecified Lagoon", "FUTURE"), ("c", "Unspecified Lagoon", "PRESENT_AND_FUTURE"),
        ("d", "Unspecified Lagoon", "PRESENT"), ("d", "UV Disinfection", "FUTURE"), ("d", "Chlorination", "FUTURE"), ("e", "Neutralization", "FUTURE"), ("f", "Unspecified Lagoon", "FUTURE"),
    ]
    plans = needs.planned(spark.createDataFrame(rows, "place_id string, process string, status string"), "place_id")
    assert {r.place_id: r.future for r in plans.collect()} == {"a": ["Unspecified Lagoon"], "c": ["Unspecified Lagoon"], "d": ["Chlorination", "UV Disinfection"], "e": ["Neutralization"], "f": ["Unspecified Lagoon"]}
    plans = plans.withColumn("survey_id", F.col("place_id")).withColumn("facility_id", F.col("place_id"))
    flow = spark.createDataFrame([("a", 1.0, 4.0), ("c", 2.0, 2.05), ("e", 1.0, 2.0)], "survey_id string, flow double, flow_then double")
    listed = spark.createDataFrame([("d", 2.0), ("f", 9.0)], "facility_id string, flow double")
    got = {r.place_id: r for r in needs.costed(plans, "place_id", tax, CURVES, flow, listed).collect()}
    assert (got["a"].construction_type, got["a"].mgd, got["a"].cost, got["a"].within_limit, got["a"].basis) == ("new", 4.0, 4 * 2 * 3.0, False, "y")
    assert (got["c"].construction_type, got["c"].cost, got["c"].within_limit) == ("rehabilitation", 6.0, True)
    assert (got["d"].construction_type, got["d"].disinfectant, got["d"].cost, got["d"].flow_source) == ("add_disinfection", "uv", 42.0, "listed")
    assert got["e"].excluded_reason == "unclassified system" and got["f"].excluded_reason == "no design flow" and got["f"].cost is None
    costs = needs.costed(plans, "place_id", tax, CURVES, flow, listed)
    assert {(r.construction_type, r.cost) for r in needs.by_construction(costs).collect()} == {("rehabilitation", 6.0), ("new", 42.0)}
    kept = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1"), ("b", "3")], "k string, s string")
    assert as_set(needs.cohort(kept, "k", "s", ["1", "2"])) == {("a",)}


def test_emissions(spark):
    statuses_ = spark.createDataFrame([("1", "AS2", "PRESENT"), ("1", "Pond", "PRESENT"), ("2", "Pond", "PRESENT"), ("3", "Digest", "PRESENT"), ("4", "AS2", "FUTURE"), ("4", "Digest", "PAST"), ("5", "AS2", "PRESENT")], "place_id string, process string, status string")
    leaf = spark.createDataFrame([("AS2", ["AS-A2O"]), ("Pond", ["LAGOON"]), ("Digest", ["AND", "PRIMARY"])], "leaf string, codes array<string>")
    own = emissions.codes(statuses_, "place_id", leaf)
    assert as_set(own) == {("1", "AS-A2O"), ("1", "NIT"), ("1", "BIO-P"), ("2", "LAGOON"), ("3", "AND"), ("3", "PRIMARY"), ("5", "AS-A2O"), ("5", "NIT"), ("5", "BIO-P")}
    assert {tuple(r) for r in emissions.pivoted(own, "place_id", ["AND", "NIT"]).collect()} == {("1", 0, 1), ("2", 0, 0), ("3", 1, 0), ("5", 0, 1)}
    requires = spark.createDataFrame([("G1", "AS_BNR_N"), ("G1", "NIT"), ("B1", "BASIC_AS"), ("O1", "AND"), ("O1", "BASIC_AS"), ("O1E", "BIOGAS_EL")], "train string, code string")
    link = spark.createDataFrame([("1", "f1", 10.0), ("2", "f2", 1.0), ("3", "f3", 12.0), ("5", "f5", 50.0)], "place_id string, facility string, flow double")
    facilities, trains = emissions.source(statuses_, link, leaf, requires)
    # f3 has no train; on its side of nitrification there are lagoons only, and it is larger than the largest: none
    assert as_set(trains) == {("f1", "G1"), ("f2", "LAGOON_UNCATEGORIZED"), ("f5", "G1")}
    biogas = spark.createDataFrame([("f3",), ("f5",)], "facility string")
    _, more = emissions.source(statuses_, link, leaf, requires, (spark.createDataFrame([("f3",)], "facility string"), biogas))
    assert {("f3", "O1E"), ("f5", "O1E")} <= as_set(more)
    open_ = spark.createDataFrame([("x", 3.0), ("y", 3.0), ("z", 3.0), ("w", 200.0)], "facility string, flow double")
    have = spark.createDataFrame([("x", "B1"), ("z", "O1E")], "facility string, train string")
    reported = spark.createDataFrame([("y", "AND"), ("w", "NIT")], "facility string, code string")
    known = spark.createDataFrame([("y", "O1")], "facility string, train string")
    assert as_set(emissions.fallback(open_, "facility", reported, have, requires)) == as_set(known)  # fits what is reported; no electricity; nothing crosses to nitrification
    shares = emissions.flows(spark.createDataFrame([("f1", "G1"), ("f1", "B1"), ("f2", "G1"), ("f2", "N1")], "facility string, train string"), facilities, "facility")
    factors = spark.createDataFrame([("G1", "N2O", 0.2), ("B1", "N2O", 0.1), ("G1", "elec", 100.0)], "train string, gas string, factor double")
    grid = spark.createDataFrame([("f1", 0.5), ("f2", 0.25)], "facility string, kg_per_kwh double")
    out = {(r.facility, r.gas): r.kg_per_day for r in emissions.emitted(shares, factors, grid, "facility").collect()}
    assert math.isclose(out[("f1", "N2O")], (5 * 0.2 + 5 * 0.1) * 3785.412) and math.isclose(out[("f1", "elec")], 5 * 100 * 0.5) and math.isclose(out[("f2", "elec")], 0.5 * 100 * 0.25)
    assert as_set(emissions.unfactored(shares, factors)) == {("N1", 0.5)}
    t = emissions.totals(emissions.emitted(shares, factors, grid, "facility"), facilities).first()
    assert t.n_facilities == 4 and t.flow == 73.0 and math.isclose(t.total_kt, t.scope1_kt + t.scope2_kt) and math.isclose(t.scope2_kt, (250 + 12.5) * 365 / 1e6) and t.CH4_kt == 0
    with pytest.raises(Exception, match="no grid intensity"):
        emissions.emitted(shares, factors, grid.limit(0), "facility").collect()
    area = spark.createDataFrame([tuple([1, 1.0, 1000.0] + [10.0] * 14)], "area int, co2_gen_mmt double, generation double, " + ", ".join(f"`{c}` double" for cs in emissions.FUELS.values() for c in cs))
    per_mwh = {f: v / 1000 * 3600 for f, v in emissions.UPSTREAM.items()}
    want = (1e9 + sum(10 * per_mwh[f] for f, cs in emissions.FUELS.items() for _ in cs)) / 1000 / 1000
    assert math.isclose(emissions.grid_intensity(area).first().kg_per_kwh, want)


TURTLE = '''
@prefix watr: <https://example.org/w#> .
@prefix sh: <http://www.w3.org/ns/shacl#> .
@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . # a comment; with . marks
watr:Tank a watr:Class ; rdfs:label "Tank" ; rdfs:comment "Holds water. \\"Big\\"; open"@en ;
  rdfs:subClassOf watr:Equipment , s223:Thing ;
  sh:property [ sh:path watr:hasProcess ; sh:hasValue watr:Process-Settling ] ,
    [ sh:path watr:hasProcess ; sh:qualifiedValueShape [ sh:class watr:Process-Mixing ] ; sh:minCount 1 ] ,
    [ sh:path watr:hasRole ; sh:hasValue watr:Role-X ] .
<https://example.org/w#Clarifier> a watr:Class ; rdfs:subClassOf watr:Tank .
watr:LevelSensor a watr:Class ; rdfs:subClassOf watr:WaterSensor .
watr:Process-Settling a watr:Class, watr:Process-Settling ; rdfs:comment """Falls
down.""" ; rdfs:subClassOf watr:Process-Old .
'''


def test_ontology(spark, tmp_path):
    (tmp_path / "m.ttl").write_text(TURTLE)
    t = ontology.read(spark, {"m": f"file://{tmp_path}/m.ttl"}, {"m": [("Process-Old", "Process-Separation")]}).cache()
    assert ("watr:Tank", "rdfs:comment", 'Holds water. "Big"; open') in as_set(t.select("s", "p", "o")) and ("watr:Clarifier", "rdfs:subClassOf", "watr:Tank") in as_set(t.select("s", "p", "o"))
    assert as_set(ontology.does(t)) == {("Tank", "Process-Settling"), ("Tank", "Process-Mixing")}
    assert ("Clarifier", "Equipment") in as_set(ontology.closure(t)) and ("Process-Settling", "Process-Separation") in as_set(ontology.closure(t))
    lines = dict(map(tuple, ontology.lines(t, "watr:Class", "SubEquipOf", ["Equipment"], doing=ontology.does(t), skip_parents=["Sensor"], foreign=["s223"]).collect()))
    assert lines["Tank"] == 'Tank | Holds water. "Big"; open | Process: Process-Mixing, Process-Settling' and lines["Clarifier"] == "Clarifier | SubEquipOf: Tank" and "LevelSensor" not in lines
    assert lines["Process-Settling"] == "Settling | Falls\ndown. | SubEquipOf: Separation"
    items = spark.createDataFrame([("7", 1, 1, "d.pdf", "N \"q\"", ["Tank"], ["Settling"], ["Odd"], [], "present", None), ("7", 1, 2, "d.pdf", "N \"q\"", [], ["Nope"], [], [], "future", None)], "place_id string, doc int, item int, document string, name string, Equipment array<string>, Process array<string>, Role array<string>, Substance array<string>, Implementation string, Location string")
    known = t.select(ontology.local(F.col("s")).alias("name")).distinct()
    triples, dropped = ontology.item_triples(items, known, {"name": "rdfs:label"})
    got = as_set(triples.select("s", "p", "o"))
    assert ("ex:item-7-1-1", "rdf:type", "watr:Tank") in got and ("ex:item-7-1-1", "watr:hasProcess", "watr:Process-Settling") in got and not any("item-7-1-2" in s + o for s, _, o in got)
    assert ("ex:facility-7", "rdfs:label", '"N \\"q\\""') in got and as_set(dropped) == {("Role", "Odd", 1), ("Process", "Nope", 1)}
    assert "EQUIPMENT:\nClarifier" in ontology.prompt_text({"EQUIPMENT": ontology.lines(t, "watr:Class", "SubEquipOf", skip=["Tank"], skip_parents=["Sensor"])})
