"""Sources, sinks and incremental work on small files."""

import datetime
import json
import urllib.error
import zipfile

import pytest
from pyspark.sql import functions as F

from factlattice.sinks import files
from factlattice.sources import extraction, fetch, pages, tables
from factlattice.streaming import incremental


def at(path):
    return f"file://{path}"


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_typed_and_lenient_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v,t\n007,1.5,NA\n008,,x\n")
    got = tables.read_typed(spark, at(tmp_path / "a.csv"), {"v": "double"})
    assert as_set(got) == {("007", 1.5, None), ("008", None, "x")} and got.schema["id"].dataType.simpleString() == "string"
    (tmp_path / "b.csv").write_bytes("id,name\n1,caf\xe9\n2,a,b,c\n3\n4,\"x,y\"\n".encode("latin-1"))
    rows, bad = tables.read_lenient(spark, at(tmp_path / "b.csv"))
    assert as_set(rows) == {("1", "café"), ("3", None), ("4", "x,y")} and [r.line for r in bad.collect()] == ["2,a,b,c"]
    rows, bad = tables.read_tsv(spark, "k\tv\na\t1\nb\t2\t3\nc\té\n".encode("latin-1"), at(tmp_path / "landed"))
    assert as_set(rows) == {("a", "1"), ("c", "é")} and bad.count() == 1
    keyed = tables.indexed(rows, "v")
    assert keyed.columns == ["key", "k"] and as_set(keyed) == {("1", "a"), ("é", "c")}


def test_documents_by_jobs(spark, tmp_path):
    (tmp_path / "one two.txt").write_text("the plant\n\n===PLANNED CHANGES===\n\nnew things")
    jobs = spark.createDataFrame([("one two.pdf", 1), ("none.pdf", 2), (" ", 3)], "document string, k int")
    found, missing = tables.read_documents(spark, at(tmp_path), jobs)
    assert [(r.k, r.description, r.changes) for r in found.collect()] == [(1, "the plant", "new things")] and as_set(missing) == {("none.pdf", 2)}


def test_excel(spark, tmp_path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = lambda rows: f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>area</t></si><si><r><t>MW</t></r><r><t>h</t></r></si></sst>')
        z.writestr("xl/worksheets/s1.xml", sheet("<row><c r=\"A1\"><v>1</v></c></row>"))
        z.writestr("xl/worksheets/s2.xml", sheet('<row><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row><c r="A2" t="inlineStr"><is><t>p1</t></is></c><c r="B2"><v>2.5</v></c></row><row><c r="B3"><v>3</v></c></row>'))
    got = tables.read_excel(spark, at(tmp_path / "a.xlsx"), "Two", {"MWh": "double"})
    assert as_set(got) == {("p1", 2.5), (None, 3.0)} and got.columns == ["area", "MWh"]
    with pytest.raises(ValueError, match="no sheet"):
        tables.sheet_rows((tmp_path / "a.xlsx").read_bytes(), "Three")


PAGE = """<table><tr><td><table><tr><th>x</th></tr></table> layout</td></tr></table>
<table><tr><td colspan=5>Orders</td></tr><tr><th>Reg Type</th><th>Order No.</th><th>Status</th><th>Date</th><th>Program</th></tr>
<tr><td>WDR</td><td><a href="/o?id=1&amp;regMeasID=7">R5-1</a></td><td>Active</td><td>1/2/2010</td></tr><tr><td>NPDES</td><td>R5-2<td>Old<td>x<td>P</tr></table>
<table><tr><th>Reg Type</th><th>Order No.</th><th>a</th><th>b</th><th>c</th></tr><tr><td>no</td></tr></table>"""


def test_page_tables_links_and_parameters(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "<p>none</p>"), (3, None)], "id int, html string")
    got = pages.tables(df, "id", "html", ["Reg Type", "Order No"], ["Reg Type", "Order No.", "Program"], ["Order No."])
    assert as_set(got) == {(1, "WDR", "R5-1", "", "/o?id=1&regMeasID=7"), (1, "NPDES", "R5-2", "P", None)}
    assert as_set(pages.links(df, "id", "html")) == {(1, "/o?id=1&regMeasID=7", "R5-1")}
    broken = spark.createDataFrame([("/x?a=1®MeasID=5",)], "u string").select(pages.mended(F.col("u")).alias("u"))
    assert broken.first().u == "/x?a=1&regMeasID=5"
    urls = spark.createDataFrame([("http://h/p?a=1&Enrollee=Y&b=",), ("http://h/p",), (None,)], "u string")
    assert [r[0] for r in urls.select(pages.without_parameter(F.col("u"), "enrollee", {"x": "Y"})).collect()] == ["http://h/p?a=1&b=&x=Y", "http://h/p?x=Y", None]
    assert [r[0] for r in urls.select(pages.parameter(F.col("u"), "a")).collect()] == ["1", None, None]
    found = spark.createDataFrame([(1, "drill?place=1"), (1, "drill?q"), (2, "drill?place=2"), (3, "other")], "k int, href string")
    assert as_set(pages.first_link(found, "k", ["drill"], ["place="])) == {(1, "drill?q"), (2, "drill?place=2")}
    form = "<input type=hidden name='t' value='1'><input type='hidden' name='t' value='9'><select name='p'><option value='7'>Seven</option><option>Eight</option></select>"
    assert pages.form_values(form, {"p": "Seven"}) == {"t": "9", "p": "7"} and pages.form_values(form, {"p": "Eight"})["p"] == "Eight"
    with pytest.raises(ValueError, match="Nine"):
        pages.form_values(form, {"p": "Nine"})


def test_fetching(tmp_path):
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError
        return b"x"

    assert fetch.retried(flaky, wait=waits.append) == b"x" and waits == [3.0, 6.0]
    with pytest.raises(urllib.error.HTTPError):
        fetch.retried(lambda: (_ for _ in ()).throw(urllib.error.HTTPError("u", 404, "no", None, None)), wait=waits.append)
    got = []
    get = lambda url: got.append(url) or b"body"
    assert fetch.cached("http://h/v1", "d/a.csv", tmp_path, get) == fetch.cached("http://h/v1", "d/a.csv", tmp_path, get) == b"body" and got == ["http://h/v1/d/a.csv"]
    seen: dict = {}

    def work(job):
        seen[job] = seen.get(job, 0) + 1
        if job == "bad" or (job == "late" and seen[job] < 2):
            raise ValueError(job)
        return job.upper()

    done, failed = fetch.all_of(["a", "late", "bad", "a"], work)
    assert done == {"a": "A", "late": "LATE"} and list(failed) == ["bad"] and seen["a"] == 1


def test_extractors(spark):
    run = extraction.stub({"Aeration": ["aerated"]})
    docs = spark.createDataFrame([(1, "It is aerated. A planned aerated pond"), (2, None)], "id int, text string")
    rows = {r.id: json.loads(r.body)["items"] for r in extraction.extracted(docs, "id", "text", run).collect()}
    assert [i["Implementation"] for i in rows[1]] == ["present", "future"] and rows[2] == []

    def fails(text):
        raise ValueError("no answer")

    assert {r.failure for r in extraction.extracted(docs, "id", "text", fails).collect()} == {"ValueError: no answer"}
    envelope = json.dumps({"is_error": False, "total_cost_usd": 0.5, "result": 'Here: {"items": []} done'})
    assert extraction.command(lambda t: ["printf", "%s", envelope])("x") == ('{"items": []}', 0, 0, 0.5)
    with pytest.raises(ValueError, match="failed"):
        extraction.command(lambda t: ["false"])("x")
    reply = {"choices": [{"finish_reason": "stop", "message": {"content": "{}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}
    assert extraction.completion(lambda p: reply, "m", "s")("x") == ("{}", 3, 2, None)
    reply["choices"][0]["finish_reason"] = "length"
    with pytest.raises(ValueError, match="stopped"):
        extraction.completion(lambda p: reply, "m", "s")("x")


def test_table_writers(spark, tmp_path):
    df = spark.createDataFrame([("b", None, 2), ("a", 'x"y', 1)], "k string, t string, n int")
    files.write_csv(df, at(tmp_path / "csv"), ["n", "k", "t"], ["n"])
    assert [tuple(r) for r in tables.read_csv(spark, at(tmp_path / "csv")).collect()] == [("1", "a", 'x"y'), ("2", "b", None)]
    rows = lambda r: spark.createDataFrame(r, "file string, name string, state string, n int")
    log = at(tmp_path / "log")
    files.append_rows(rows([("f1", "x", "True", 1), (None, "y", "FAILED", 2), ("f3", "z", "FAILED", 3)]), log, 1)
    files.append_rows(rows([("f1", "x", "FAILED", 4), (None, "y", "False", 5), ("f3", "z", "FAILED", 6)]), log, 2)
    assert {r.n for r in files.compacted(spark, log, ["file", "name"], "state").collect()} == {1, 5, 6}
    files.compact(spark, log, at(tmp_path / "log2"), ["file", "name"], "state")
    assert {r.n for r in files.compacted(spark, at(tmp_path / "log2"), ["file", "name"], "state").collect()} == {1, 5, 6}
    kind = "place_id string, measure_id string, order_no string, document string, agency string"
    for day, rows_ in (("2022-06-01", [("1", "m", "o", "d", "A")]), ("2023-06-01", [("1", "m", "o", "d", "B")]), ("2023-06-01", [("1", "m", "o", "d", "C")])):
        files.write_snapshot(spark.createDataFrame(rows_, kind), at(tmp_path / "snap"), day)
    assert not files.promote(spark, at(tmp_path / "snap"), at(tmp_path / "all"), False) and not (tmp_path / "all").exists()
    files.promote(spark, at(tmp_path / "snap"), at(tmp_path / "all"), True)
    assert [(r.agency, r.as_of_dates) for r in spark.read.parquet(at(tmp_path / "all")).collect()] == [("C", "2022-06-01;2023-06-01")]
    assert files.checkpoint(df, at(tmp_path / "cp")).count() == 2


def test_single_file_writers(spark, tmp_path):
    found = spark.createDataFrame([("a_1", '[{"Process": ["x"], "Sentence": "s}"}, {}]')], "stem string, raw string")
    trig = spark.createDataFrame([("a_1", 0, ["P", "Q"])], "stem string, item int, trigger_process array<string>")
    assert files.write_records(found, trig, "stem", at(tmp_path / "json")) == 1
    assert json.loads((tmp_path / "json/a_1.json").read_text()) == {"items": [{"Process": ["x"], "Sentence": "s}", "trigger_process": ["P", "Q"]}, {"trigger_process": []}]}
    texts = spark.createDataFrame([("a.pdf", "now", "then")], "document string, description string, changes string")
    assert files.write_sections(texts, "document", at(tmp_path / "txt")) == 1 and (tmp_path / "txt/a.txt").read_text() == "now\n\n===PLANNED CHANGES===\n\nthen"
    triples = spark.createDataFrame([("7", "ex:a", "rdf:type", "ex:B"), ("7", "ex:a", "ex:c", '"d"'), ("8", "ex:x", "ex:y", "ex:z")], "place_id string, s string, p string, o string")
    names = spark.createDataFrame([("7", "Big, Town (North)"), ("8", "x")], "place_id string, name string")
    ttl = files.triple_files(triples, names, {"ex": "http://e/"})
    assert files.write_zip(ttl, at(tmp_path / "z.zip")) == 2
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.namelist() == ["7_Big_Town_North.ttl", "8_x.ttl"] and z.read("7_Big_Town_North.ttl").decode() == '@prefix ex: <http://e/> .\n\nex:a a ex:B .\nex:a ex:c "d" .\n'
    assert files.write_triples(triples, names, {}, at(tmp_path / "ttl")) == 2 and (tmp_path / "ttl/8_x.ttl").exists()
    assert files.report("{n} of {m}", spark.createDataFrame([(3,)], "n int"), m=5) == "3 of 5"
    with pytest.raises(ValueError, match="one row"):
        files.report("{n}", spark.createDataFrame([(3,), (4,)], "n int"))
    with pytest.raises(ValueError, match="mounted"):
        files.write_sections(texts, "document", "s3a://b/x")


def test_frames_behind_figures(spark, tmp_path):
    df = spark.createDataFrame([("x", "N2O", 2.0), ("x", "CH4", 1.0), ("x", "CH4", 0.5), ("y", "N2O", 4.0), ("y", "odd", 9.0)], "bar string, part string, v double")
    assert as_set(files.stacked(df, "bar", "part", "v", ["CH4", "N2O"])) == {("x", "CH4", 1.5, 0.0), ("x", "N2O", 2.0, 1.5), ("y", "N2O", 4.0, 0.0)}
    assert files.write_figure(df, at(tmp_path / "f.svg"), "bar", "part", "v", ["CH4", "N2O"]).count(b"<rect") == 3 and (tmp_path / "f.svg").exists()
    box = files.boxes(spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 4, 100)], "k string, v double"), ["k"], "v").first()
    assert (box.q1, box.median, box.q3, box.low, box.high, box.n) == (2.0, 3.0, 4.0, 1.0, 4.0, 5)


def test_incremental_work(spark, tmp_path):
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    done = spark.createDataFrame([("a", "True"), ("b", "FAILED"), ("x", None)], "k string, state string")
    assert as_set(incremental.undone(jobs, done, ["k"], "state")) == {("b",), ("c",)} and as_set(incremental.undone(jobs, done, ["k"])) == {("c",)}
    cache = spark.createDataFrame([("a", "1:1", "old a"), ("b", "1:1", "old b"), ("gone", "1", "g")], "name string, fp string, kind string")
    now = spark.createDataFrame([("a", "1:1"), ("b", "2:1"), ("c", "1:1")], "name string, fp string")
    made = incremental.refreshed(now, cache, "name", lambda todo: todo.select("name", F.concat(F.lit("new "), "name").alias("kind")))
    assert as_set(made) == {("a", "1:1", "old a"), ("b", "2:1", "new b"), ("c", "1:1", "new c"), ("gone", "1", "g")}
    (tmp_path / "f").mkdir()
    (tmp_path / "f/one.bin").write_bytes(b"abc")
    first = incremental.files_of(spark, at(tmp_path / "f")).first()
    assert first.name == "one.bin" and first.fp.startswith("3:")
    seen = []
    for n in (1, 2, 2):
        if n > len(seen):
            jobs.limit(n).write.mode("append").parquet(at(tmp_path / "in"))
        incremental.new_files(spark, at(tmp_path / "in"), "k string", at(tmp_path / "check"), lambda df, i: seen.append(df.count()))
    assert sum(seen) == 3


def test_windows_of_a_stream(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1)
    rows = [("u", day + datetime.timedelta(minutes=m), s) for m, s in ((1, "PRESENT"), (8, "FUTURE"), (12, "PAST"), (50, "OFFSITE"))]
    events = spark.createDataFrame(rows, "k string, ts timestamp, status string")
    got = [(r.window.start.minute, r.status) for r in incremental.windowed(events, "k", "ts", "status", "10 minutes", "1 hour").orderBy("window").collect()]
    assert got == [(0, "PRESENT_AND_FUTURE"), (10, "PAST"), (50, "OFFSITE")]
    assert [(r.events, r.status) for r in incremental.sessions(events, "k", "ts", "status", "15 minutes", "1 hour").orderBy("window").collect()] == [(3, "PRESENT_AND_FUTURE"), (1, "OFFSITE")]
    for name, part in (("l", events.limit(2)), ("r", events.select(F.col("k"), F.col("ts").alias("ts2"), F.col("status").alias("s2")))):
        part.coalesce(1).write.parquet(at(tmp_path / name))
    stream = lambda name, kind: spark.readStream.schema(kind).parquet(at(tmp_path / name))
    joined = incremental.paired(stream("l", "k string, ts timestamp, status string"), stream("r", "k string, ts2 timestamp, s2 string"), "k", "ts", "ts2", "10 minutes", "1 hour")
    query = joined.writeStream.format("memory").queryName("paired_rows").option("checkpointLocation", at(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.ts.minute, r.ts2.minute) for r in spark.table("paired_rows").collect()} == {(1, 1), (1, 8), (8, 8), (8, 12)}
