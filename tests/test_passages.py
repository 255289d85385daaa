"""Passages of texts by offsets against plain loops and hand-made documents; as-of and interval joins by brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factlattice.operators import passages
from factlattice.operators import relational as rel

TERMS = ["aerated lagoon", "screening", "chlorination", "clarifier", "sludge drying", "sand filter"]
FILLER = "Nothing of note is said in this line of the order.\n" * 30
BODY = "The plant consists of screening, an aerated lagoon, a clarifier, a sand filter, chlorination and ponds."


def of(spark, texts, many=False, **distances):
    docs = spark.createDataFrame([(i, t, many) for i, t in enumerate(texts)], "doc int, raw string, many boolean")
    rows = passages.extracted(docs, "doc", "raw", passages.rules_of(TERMS, **distances), many="many").collect()
    return {r.doc: r for r in rows}


def test_runs_against_a_plain_loop(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["ab", "BA", "😀", "-" * rng.choice([3, 480, 499, 501, 700])]) for _ in range(30)) for _ in range(40)] + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc int, text string")
    hits = passages.occurrences(docs, "doc", "text", {"terms": "(?i)ab|ba", "dash": "-{400,}"})
    want = {(i, kind, m.start(), m.end()) for i, t in enumerate(texts) for kind, p in (("terms", "(?i)ab|ba"), ("dash", "-{400,}")) for m in re.finditer(p, t or "")}
    assert {(r.doc, r.kind, r.start, r.end) for r in hits.collect()} == want
    groups = []
    for i, t in enumerate(texts):
        mine = []
        for m in re.finditer("(?i)ab|ba", t or ""):
            if mine and m.start() - mine[-1][-1][1] <= 500:
                mine[-1].append((m.start(), m.end(), m.group().lower()))
            else:
                mine.append([(m.start(), m.end(), m.group().lower())])
        groups += [(i, g[0][0], g[-1][1], len(g), len({x[2] for x in g})) for g in mine if len(g) > 1]
    got = passages.runs(hits.filter("kind = 'terms'"), "doc", 500)
    assert sorted(tuple(r) for r in got.select("doc", "start", "end", "n", "kinds").collect()) == groups


def test_description_and_changes(spark):
    pages = ["ORDER NO. R5-2007-0090\nFindings", FILLER + "\n\n2. Facility Description\n" + BODY + "\n\n" + FILLER, "Planned changes: a new clarifier and chlorination will be built.\n\n" + FILLER + "Secondary Treatment Regulations\nscreening chlorination " * 2]
    raw = "\n".join(f"[Page {i}]\n{p}" for i, p in enumerate(pages))
    toc = "screening ..... 1\nchlorination ..... 2\nclarifier ..... 3\n"
    denied = "There are no planned changes. " + BODY
    two = BODY + "\n\n" + FILLER * 8 + "\n\n" + BODY.replace("lagoon", "LAGOON")
    got = of(spark, [raw, "[Page 0]\nnothing here", denied, None, "words " * 40, toc + FILLER + BODY, two])
    assert got[0].order_number == "R5-2007-0090" and got[0].description.startswith("[Page 1]\n2. Facility Description") and BODY in got[0].description
    assert got[0].changes.startswith("Planned changes: a new clarifier") and got[0].changes_phrase == "Planned changes" and "Regulations" not in got[0].description
    assert got[1].description == "" and got[1].unreadable and got[2].changes == "" and BODY[10:] in got[2].description
    assert got[3].unreadable and not got[4].unreadable and got[4].description == ""
    assert "....." not in got[5].description and BODY[10:] in got[5].description
    assert got[6].description.count("consists of") == 1  # the other one is too far on
    assert of(spark, [two], many=True)[0].description.count("consists of") == 2


def test_snapping_prefers_numbered_headers_then_paragraphs_then_lines(spark):
    run = "screening and chlorination, a clarifier, an aerated lagoon, a sand filter, sludge drying"
    texts = ["x\nIV. Plant\nOther Line\n\nplain " + run, "A line here\n\nplain " + run, "y\nA line here\nplain " + run, "plain " + run, "1. Header\n" + "-" * 2100 + run]
    got = of(spark, texts)
    assert [got[i].description for i in range(4)] == [texts[0][2:], "plain " + run, texts[2][2:], run]
    assert got[4].description == run


def test_pages_and_titles(spark):
    pages = spark.createDataFrame([("a", i, "p") for i in range(11)] + [("a", 11, "Contents ATTACHMENT F - FACT SHEET ..... a ..... b ..... c")] + [("a", i, "p") for i in range(12, 16)] + [("a", 16, "Attachment F – Fact Sheet\n"), ("b", 0, "x"), ("b", 1, None)], "doc string, page int, text string")
    kept = passages.fact_sheet_pages(pages, "doc", "page", "text")
    assert sorted((r.doc, r.page) for r in kept.collect()) == [("a", 14), ("a", 15), ("a", 16), ("b", 0), ("b", 1)]
    assert {r.doc: r.raw for r in passages.of_pages(pages.filter("doc = 'b'"), "doc", "page", "text").collect()} == {"b": "[Page 0]\nx\n[Page 1]\n"}
    titles = ["[Page 0]\nR5-2007-0090 then ORDER NO. R1-2010-0001", "x 2011-0123 y", "none", "order 2014-0153 dwq"]
    d = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r[0] for r in d.select(passages.order_number(F.col("t"))).collect()] == ["R1-2010-0001", "2011-0123", "", "2014-0153-DWQ"]
    assert spark.createDataFrame([("a \t b  \n  c ",)], "t string").select(passages.tidied(F.col("t"))).first()[0] == "a b\n c"


@pytest.mark.parametrize("width", [1.0, 7.0, 1e6])
def test_as_of_by_brute_force(spark, width):
    rng = random.Random(4)
    key = lambda: rng.choice([None, "hot", "hot", "hot", "b", "c"])
    right = [(key(), rng.choice([None, *range(-40, 60)]), i) for i in range(150)]
    left = [(key(), rng.choice([None, *range(-60, 90)]), i) for i in range(200)]
    got = rel.as_of(spark.createDataFrame(left, "k string, t int, i int"), spark.createDataFrame(right, "k string, since int, v int"), ["k"], "t", "since", width)
    for r in got.collect():
        before = [x for x in right if x[0] == r.k is not None and x[1] is not None and r.t is not None and x[1] <= r.t]
        best = max(before, key=lambda x: (x[1], x[2]), default=None)
        assert (None if best is None else best) == (None if r.found is None else (r.found.k, r.found.since, r.found.v)), r
    assert got.count() == 200


def test_intervals_by_brute_force(spark):
    rng = random.Random(5)
    points = [(rng.choice([None, "hot", "hot", "b"]), rng.choice([None, rng.randint(-500, 500)]), i) for i in range(400)]
    ranges = []
    for i in range(400):
        low = rng.randint(-500, 500)
        ranges.append((rng.choice([None, "hot", "hot", "b"]), low, rng.choice([None, low, low + 1, low + rng.randint(-3, 9), low + rng.randint(0, 900)]), i))
    found = rel.inside(spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame(ranges, "k string, low int, high int, r int"), ["k"], "at", "low", "high", 4.0)
    got = [(x.p, x.r) for x in found.collect()]
    want = {(p, r) for k, at, p in points for k2, low, high, r in ranges if k == k2 is not None and at is not None and high is not None and low <= at < high}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert rel.inside(spark.createDataFrame(points, "k string, at int, p int"), spark.createDataFrame([], "k string, low int, high int, r int"), ["k"], "at", "low", "high").count() == 0


def test_queries_look_for_the_kinds_they_use(spark, sf_dir):
    from factlattice.plans import places

    kinds = {r.kind for r in places._places(spark, sf_dir, "terms", "changes", "paragraph")[1].select("kind").distinct().collect()}
    assert "terms" in kinds and kinds <= {"terms", "changes", "paragraph"}


def test_places_where_texts_hold_the_mark(spark):
    """Matches at both ends, side by side, beyond the basic plane, none at all, and in texts that hold the mark itself."""
    import re

    texts = ["", "x", "aba", "aa", "\U0001f600ab\U0001f600b", f"a{passages.MARK}b", f"{passages.MARK}$0a", "a\\$1b", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    got = {(r.k, r.kind, r.start, r.end, r.match) for r in passages.occurrences(docs, "k", "t", {"one": "a", "two": "(b)|x"}).collect()}
    assert got == {(k, kind, m.start(), m.end(), m[0]) for k, t in enumerate(texts) if t for kind, p in (("one", "a"), ("two", "b|x")) for m in re.finditer(p, t)}
