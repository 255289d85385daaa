"""Spelling variants, filter audit and personal data against brute force, and on odd tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from factlattice.llm import common, filter_audit, personal_data, spelling

LONG = "lorem ipsum dolor " * 60_000
BLOB = "x" * 200_000
ODD = [None, None, "", " \t", "one", "one", LONG, LONG + "more", BLOB, BLOB, "the same words again and again", "é日本 \x00 � a@b.co", "1.2.3.4 " * 3]
INSIDE = "row n word h mask size longer key nth near part digest good toxic own least rule kind match base more spans".split()


def odd_rows():
    return [(None if i % 4 == 0 else i % 7, t, None if i % 3 == 0 else "en", None if i % 5 == 0 else "s") for i, t in enumerate(ODD)] * 2


@pytest.fixture(scope="module")
def odd(spark):
    d = spark.createDataFrame(odd_rows(), "doc_id long, text string, lang string, source string").repartition(3)
    return common.cut(d.select("*", *(F.lit(i).alias(c) for i, c in enumerate(INSIDE))), "odd")


LABELS = [(1, 1, 0), (1, None, 1), (2, 0, None), (None, 1, 1), (5, 7, 1), (6, 1, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


# spelling


def words_of(rows):
    out = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i:] == b[i + 1 :] or (len(a) == len(b) and a[i + 1 :] == b[i + 1 :])


def spelled(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), words.get(form[w]))
    return out


def found(frame):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect()}


def test_spelling_by_brute_force(spark):
    rng = random.Random(3)
    stems = ["".join(rng.choice("abcdeéßö") for _ in range(rng.randint(7, 11))) for _ in range(40)]

    def bent(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcÿ") + w[i:], w[:i] + rng.choice("abcÀ") + w[i + 1 :], w, w, w.upper()])

    rows = []
    for i in range(300):
        text = " ".join(bent(stems[int(rng.random() ** 3 * 40)]) for _ in range(30)) + " " + stems[0] * rng.randint(1, 2)
        rows.append((i if i % 9 else None, text))
    want = spelled(words_of(rows))
    assert sum(v[0] is not None for v in want.values()) > 20
    assert found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_spelling_follows_chains_and_ties(spark):
    """A form's form, several steps on; equally frequent near words; words of one letter more at either end."""
    words = [("abcdefg", 2), ("abcdefgh", 20), ("abcdefghi", 200), ("abcdefghij", 2000), ("xabcdefg", 20), ("zzzzzzz", 5), ("zzzzzzzz", 5)]
    table = spark.createDataFrame(words, "word string, n long")
    pairs = {(r.word, r.near) for r in spelling.near_pairs(table).collect()}
    assert pairs == {tuple(sorted((a, b), key=lambda w: (len(w), w))) for (a, _), (b, _) in itertools.combinations(words, 2) if one_edit(a, b)}
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(13)] + [("v", "w12")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots(links).collect()} == {**{f"w{i}": "w13" for i in range(13)}, "v": "w13"}
    text = "abcdefg abcdefg " + "abcdefgh " * 20 + "xabcdefg " * 20
    ids = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{w}".encode()) % 31 for w in ("abcdefg", "abcdefgh", "xabcdefg")))
    assert found(spelling.variants(spark.createDataFrame([(ids, text)], "doc_id long, text string")))["abcdefg"][:2] == ("abcdefgh", "abcdefgh")


def test_spelling_of_one_crowded_prefix(spark):
    """Many words with a common beginning: each pair once, all found."""
    rng = random.Random(5)
    words = {"international" + "".join(rng.choice("abc") for _ in range(rng.randint(3, 5))) for _ in range(220)}
    got = [(r.word, r.near) for r in spelling.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).collect()]
    assert len(got) == len(set(map(frozenset, got))) == sum(one_edit(a, b) for a, b in itertools.combinations(words, 2)) > 300


def test_spelling_on_odd_rows(odd):
    assert found(spelling.variants(odd)) == spelled(words_of(odd_rows()))
    assert spelling.variants(odd.limit(0)).count() == 0
    assert spelling.variants(odd.withColumn("text", F.lit(None).cast("string"))).count() == 0


# filter audit


def audited(rows, labels):
    texts = [(d, t or "", s or "") for d, t, _, s in rows]
    least = {}
    for d, t, _ in texts:
        if d is not None:
            least[t] = min(d, least.get(t, d))
    good, bad = ({d for d, *v in labels if d is not None and v[i] == 1} for i in (0, 1))
    fails = []
    for d, t, s in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        fails.append((s, {k for k in f if f[k]}, d in good, d in bad))
    out = {}
    for part in {s for s, *_ in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            for step in range(1, 6):
                now, before = order[step - 1], set(order[: step - 1])
                here = [f for f in mine if now in f[1] and not f[1] & before]
                out[part, order, step] = [
                    sum(not f[1] & (before | {now}) for f in mine), len(here), sum(now in f[1] and bool(f[1] & before) for f in mine),
                    sum(f[1] == {now} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here),
                ]
    total = Counter()
    for (part, order, step), v in out.items():
        total[part, order[step - 1]] += v[1]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_by_brute_force(odd, labels):
    got = filter_audit.audit(filter_audit.cells(odd, labels)).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == audited(odd_rows(), LABELS)
    assert len(got) == 2 * 600


def test_audit_of_empty_tables(odd, labels):
    assert filter_audit.audit(filter_audit.cells(odd.limit(0), labels)).count() == 0
    assert filter_audit.audit(filter_audit.cells(odd, labels.limit(0))).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_of_fewer_filters(spark):
    cell = spark.createDataFrame([("p", 0, 5, 1, 0), ("p", 1, 3, 0, 1), ("p", 3, 2, 1, 1)], "part string, mask int, n long, good long, toxic long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant) for r in filter_audit.audit(cell, "AB").collect()}
    assert got == {("AB", 1): (5, 5, 0), ("AB", 2): (5, 0, 2), ("BA", 1): (8, 2, 0), ("BA", 2): (5, 3, 2)}
    with pytest.raises(ValueError, match="eight"):
        filter_audit.audit(cell, "ABCDEFGHI")


@pytest.mark.parametrize("op", [spelling, filter_audit], ids=["op11", "op12"])
def test_matches_sql(spark, sf_dir, op):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = op.query(spark, sf_dir)
    columns = sorted(got.columns)
    assert Counter(tuple(r) for r in got.select(columns).collect()) == Counter(con.execute(f"SELECT {', '.join(columns)} FROM ({op.ORACLE})").fetchall())


# personal data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base(text):
    out = []
    for nth, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text or "") if kind != "email" or "@" in (text or "") else ():  # else quadratic here
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else None,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), nth, m.end(), kind))
    return [(k, s, e) for s, _, e, k in sorted(out)]


def found_in(rows):
    return [[(s.kind, s.start, s.end) for s in r.spans if s.base] for r in rows]


def test_base_spans_by_brute_force(spark):
    """Random strings over the characters of the rules, with emoji before them."""
    rng = random.Random(8)
    pieces = ["a", "b.c", "@", "a@b.c", "_d@e.f", ".", "..", "-", " ", "  ", "1", "25", "255", "300", "1.2.3.4", "10.0.0.1", "+1", "+", "(555) 123-4567", "4111 1111 1111 1111", "4111111111111111", "é", "😀", "\n", ",", "00", "x@y", "0123456789"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data.find(d).collect()}
    for i, t in enumerate(texts):
        assert found_in([got[i]])[0] == base(t), t
        assert all(t[s.start : s.end] == s.text for s in got[i].spans)


def test_spans_that_the_method_adds(spark):
    """Numbers that run together, which the base rules drop, in a corpus of plain ones; nothing else."""
    rng = random.Random(9)

    def card():
        head = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(head + d for d in "0123456789" if luhn(head + d))

    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    prose = lambda: " ".join(rng.choice("river stone walk blue house tree".split()) for _ in range(8))
    texts = [f"{prose()} {rng.choice([card, phone, lambda: 'a.b%d@mail.example.com' % rng.randint(1, 99)])()} {prose()}" for _ in range(150)]
    one, two, tel = card(), card(), phone()
    texts += [f"{prose()} {one} {two} end", f"{prose()} {tel} {one} end", f"{prose()} version 123 456-7890 {prose()}", f"{prose()} 4111111111111112 {prose()}", "write to jane.doe [at] example [dot] com now"]
    got = {r.doc_id: r.spans for r in personal_data.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(len(got[i]) == 1 and got[i][0].base for i in range(150))
    assert [s.text for s in got[150]] == [one, two] and not any(s.base for s in got[150])
    assert [(s.kind, s.text) for s in got[151]] == [("phone", tel), ("card", one)]
    assert got[152] == [] and got[153] == []
    assert [(s.kind, s.text) for s in got[154]] == [("email", "jane.doe [at] example [dot] com")]


def test_personal_data_query(spark, sf_dir):
    rows = {r.doc_id: r for r in personal_data.query(spark, sf_dir).collect()}
    texts = {r.doc_id: r.text for r in common.table(spark, sf_dir, "documents").collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        spans = base(t)
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert rows[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in PLAIN] == [sum(k == s[0] for s in spans) for k in PLAIN]
        assert set(joined.split(",")) - {""} <= set(rows[i].spans.split(","))


def test_personal_data_on_odd_rows(odd):
    got = personal_data.find(odd).collect()
    assert len(got) == 26 and sorted(map(str, found_in(got))) == sorted(str(base(t)) for t in ODD * 2)
    assert personal_data.find(odd.limit(0)).count() == 0


def test_personal_data_in_linear_time(spark):
    """Runs of each rule's characters, a megabyte each, end in seconds."""
    runs = ["a" * 10**6, "a." * 500_000, "a@" * 500_000, "1" * 10**6, "1." * 500_000, "1 " * 500_000, "+1" * 500_000, "(1) " * 250_000, "ab:" * 300_000, "[at]" * 250_000, "a@b.c " * 20_000, "1.2.3.4," * 20_000]
    d = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    got = {r.doc_id: len(r.spans) for r in personal_data.find(d).collect()}
    assert got[10] == got[11] == 20_000
