"""Personal data in texts, by weak supervision, with DataFrame functions alone.

Candidates are found by regular expressions: the base rules of each kind (``BASE``), whose valid matches always
stay, and rules for forms that the base rules miss (``MORE``: numbers that run together, which the base
rules take for one number and drop, written-out addresses, letters outside ASCII, IPv6). Labelers vote on
each candidate: regular expressions on its layout and check digits, gazetteers (domains, dialling codes,
card issuers, reserved nets), and its context (cue words, its neighbours). Votes are counted by pattern; a
generative model estimates each labeler's reliability by expectation-maximisation over these counts, and a
logistic span classifier is trained on the posteriors by Newton steps. A candidate of ``MORE`` becomes a
span if the classifier says so, it passes its kind's exact check, has its kind's layout or a cue word before it,
and it overlaps no base span.

One pass reads the texts and writes, per row, the candidates with their gaps; the texts are not read again
and never shuffled. There are at most 3^7 * 2^3 patterns a kind, whatever the input: only they are read in
the steps of the two models, and a few sums a kind reach the driver. All patterns are written so that
each starts once per run of its characters and never backtracks over a run: linear in any text.

Defined results: null text counts as empty; texts of any length are read whole; every row is a document of
its own, whatever its doc_id; repeated rows get the same spans; an empty table gives an empty result; further
columns are ignored. Places are code points, the end exclusive. The context of a candidate ends at the
neighbouring match of the same rule. Of added spans that overlap, those stay that no earlier one reaches into.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: The base rules; equal in matches to the plain forms of the contract (see the tests).
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_WIDE = r"\p{L}\p{N}._%+-"
_OPEN, _SHUT = r" ?[\[({] ?", r" ?[\])}] ?"
MORE = {
    "email": rf"(?<![{_WIDE}])[{_WIDE}]++(?:@|{_OPEN}(?:at|AT){_SHUT})[\p{{L}}\p{{N}}-]++(?:(?:\.|{_OPEN}(?:dot|DOT){_SHUT})[\p{{L}}\p{{N}}-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?:(?<![0-9+])\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)|(?<![0-9+.-])\+[0-9]{1,3}[ .-][0-9]{3}|(?<![0-9+][ .-]?)\([0-9]{3}\)|(?<![0-9+.-])(?<![0-9+.-] )[0-9]{3})[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
#: What a text must hold for a rule to match at all (cheaper to look for); base rule, other rule.
_HINTS = {
    "email": ("@", r"@|[\[({] ?(?:at|AT) ?[\])}]"),
    "ip": (r"[0-9]\.[0-9]", r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:"),
    "card": (r"[0-9](?:[ -]?[0-9]){13}", r"[0-9](?:[ -]?[0-9]){13}"),
    "phone": (r"\+[0-9]", r"[0-9][ .-][0-9]{4}"),
}
#: Gazetteers (fixed values): ends of domains, dialling codes, first digits of card issuers, nets of no host.
DOMAINS = "com org net edu gov mil int info biz io co dev app me tv eu uk de fr es it nl be ch at pl pt se no dk fi ie cz gr hu ro ru ua tr il in cn jp kr au nz ca us mx br ar cl za"
DIALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 358 359 370 371 372 380 385 386 420 421 852 880 886 966 971 972"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|6011|65|64|62|35)"
RESERVED = r"^0*(?:0|127|2(?:2[4-9]|[34][0-9]|5[0-5]))\."
#: Cue words before a candidate (fixed values), for and against personal data.
CUES = {
    "email": "mail e-mail email courriel correo contact write kontakt contacto",
    "ip": "ip host server address addr login from client adresse dirección",
    "card": "card visa mastercard amex credit debit payment pay carte karte tarjeta",
    "phone": "phone tel telephone call mobile cell fax whatsapp telefon téléphone teléfono",
}
AGAINST = "version release build isbn issn order invoice ref serial figure fig section chapter theorem sha hash token key id no nr commit example"
#: Code points of context on either side; probability from which a candidate of MORE is a span.
CONTEXT, THRESHOLD = 40, 0.5
VOTES = ("v_check", "v_layout", "v_gazetteer", "v_cue", "v_against", "v_edge", "v_variety")
MARKS = ("x_apart", "x_lead", "x_first")
#: The label model starts from, and leans on, these shares of (yes, no) votes on true and on false candidates, worth
#: LEAN candidates. Cue words only ever vote one way, and seldom.
LEAN = 8.0
_START = {v: ((0.70, 0.08), (0.15, 0.55)) for v in VOTES} | {"v_cue": ((0.30, 0.01), (0.05, 0.01)), "v_against": ((0.01, 0.01), (0.01, 0.30))}
_TRUE, _FALSE = ([_START[v][i] for v in VOTES] for i in (0, 1))

_FOUND = "array<struct<rule:string,nth:int,gap:int,match:string,before:string,opens:string>>"


def _matches(text: Column, rule: str, pattern: str, hint: str) -> Column:
    """rule, nth, gap (code points before the match since the one before), match, and the ends of the gap. The
    last entry has no match: it is the rest of the text."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"))
    entry = lambda z, i: F.struct(
        F.lit(rule).alias("rule"),
        i.alias("nth"),
        F.char_length(z["gap"]).alias("gap"),
        z["match"].alias("match"),
        F.right(z["gap"], F.lit(CONTEXT)).alias("before"),
        F.left(z["gap"], F.lit(CONTEXT)).alias("opens"),
    )
    found = F.filter(F.transform(zipped, entry), lambda e: e["match"].isNotNull() | (e["nth"] > 0))
    return F.when(text.contains(hint) if hint == "@" else text.rlike(hint), found).otherwise(F.array().cast(_FOUND))


def _case(of) -> Column:
    """``of(kind)`` for each row's kind."""
    return reduce(lambda rest, k: F.when(F.col("kind") == k, of(k)).otherwise(rest), KINDS, F.lit(None))


def _luhn(digits: Column) -> Column:
    turned = F.split(F.reverse(digits), "")
    each = F.transform(F.filter(turned, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _checked(kind: str) -> Column:
    """The exact check of a kind."""
    match, digits = F.col("match"), F.char_length("digits")
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return {
        "email": F.lit(True),
        "ip": match.rlike(rf"^{part}(?:\.{part}){{3}}$") | match.contains(":"),
        "card": digits.between(14, 19) & F.when(digits.between(14, 19), _luhn(F.col("digits"))),
        "phone": digits.between(10, 15),
    }[kind]


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out.otherwise(-1) if no is None else out.when(no, -1).otherwise(0)).cast("tinyint")


def _words(words: str) -> str:
    return "(?:" + "|".join(words.replace("-", r"\-").split()) + ")"


def _votes(kind: str) -> dict[str, Column]:
    match, digits, before = F.col("match"), F.col("digits"), F.lower("before")
    layout = {
        "email": r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.))*+(?<!\.)@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*+(?<!-))?\.)++[A-Za-z]{2,}$|^[\w.+-]++ ?[\[({][^@]*[\])}] ?[A-Za-z]{2,}$",
        "ip": r"^(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$|:.*:",
        "card": r"^(?:[0-9]{15,16}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})$",
        "phone": r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}$|^\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}$",
    }[kind]
    code = F.regexp_extract(match, r"^\+([0-9]{1,3})", 1)
    codes = DIALLING.split()
    gazetteer = {
        "email": _vote(F.lower(F.regexp_extract(match, r"([^.)\]} ]*)$", 1)).isin(DOMAINS.split())),
        "ip": _vote(~match.rlike(RESERVED)),
        "card": _vote(digits.rlike(ISSUERS)),
        "phone": _vote(reduce(lambda a, n: a | F.left(code, F.lit(n)).isin(codes), (2, 3), F.left(code, F.lit(1)).isin(codes)), code != ""),
    }[kind]
    body = F.lower(F.regexp_extract(match, r"^([^@\[({ ]*)", 1)) if kind == "email" else digits
    kinds_of = F.size(F.array_distinct(F.split(body, "")))
    return {
        "v_check": _vote(F.coalesce(_checked(kind), F.lit(False))),
        "v_layout": _vote(match.rlike(layout)),
        "v_gazetteer": gazetteer,
        "v_cue": _vote(before.rlike(rf"(?<!\p{{L}}){_words(CUES[kind])}(?!\p{{L}})"), F.lit(False)),
        "v_against": _vote(F.lit(False), before.rlike(rf"(?<!\p{{L}}){_words(AGAINST)}[^\p{{L}}]{{0,6}}$")),
        "v_edge": _vote(~F.col("before").rlike(r"[\p{L}\p{N}_]$") & ~F.col("after").rlike(r"^[\p{L}\p{N}_]")),
        "v_variety": _vote(kinds_of >= {"email": 2, "ip": 2, "card": 5, "phone": 4}[kind]),
    }


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs`` (doc_id, text) as (row, doc_id), and their candidates: row, kind, base (a valid
    match of a base rule), more (a match of the other rules that passes the check), start, end, text, votes and marks."""
    text = F.col("text")
    rules = [(f"{kind}{i}", p, _HINTS[kind][i]) for i, group in enumerate((BASE, MORE)) for kind, p in group.items()]
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    found = found.select("doc_id", F.monotonically_increasing_id().alias("row"), F.flatten(F.array(*(_matches(text, *r) for r in rules))).alias("found"))
    found = common.cut(found, "private-matches")
    one = found.filter(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    rule = Window.partitionBy("row", "rule").orderBy("nth")
    one = one.repartition("row").select(
        "row",
        "match",
        "before",
        F.expr("left(rule, length(rule) - 1)").alias("kind"),
        (F.right("rule", F.lit(1)) == "1").alias("other"),
        F.lead("opens").over(rule).alias("after"),
        F.sum(F.col("gap") + F.coalesce(F.char_length("match"), F.lit(0))).over(rule.rowsBetween(Window.unboundedPreceding, 0)).alias("end"),
    )
    one = one.filter("match IS NOT NULL").withColumns({"start": F.col("end") - F.char_length("match"), "digits": F.regexp_replace("match", "[^0-9]+", "")})
    every = {k: _votes(k) for k in KINDS}
    one = one.withColumns({v: _case(lambda k, v=v: every[k][v]) for v in VOTES}).withColumns({
        "x_apart": F.col("match").rlike(r"[ ()]").cast("tinyint"),
        "x_lead": F.col("before").rlike(r"[:=<\"(] ?$").cast("tinyint"),
        "x_first": (F.col("before") == "").cast("tinyint"),
    })
    valid = F.col("v_check") == 1
    one = one.select("row", "kind", (valid & ~F.col("other")).alias("base"), (valid & F.col("other") & ((F.col("v_layout") == 1) | (F.col("v_cue") == 1))).alias("more"), "start", "end", F.col("match").alias("text"), *VOTES, *MARKS)
    return found.select("row", "doc_id"), common.cut(one, "private-candidates")


@dataclass
class Model:
    """Per kind the share of true candidates, the labelers' shares of (yes, no) votes on true and on false
    ones, and the span classifier's weights."""

    prior: dict = field(default_factory=lambda: dict.fromkeys(KINDS, 0.5))
    true: dict = field(default_factory=lambda: {k: list(_TRUE) for k in KINDS})
    false: dict = field(default_factory=lambda: {k: list(_FALSE) for k in KINDS})
    weights: dict = field(default_factory=dict)

    def posterior(self) -> Column:
        """The label model's probability, from the votes. Its numbers stand in one array, so that Spark
        compiles the steps of a fit once."""
        odds = []
        for k in KINDS:
            odds.append(math.log(self.prior[k] / (1 - self.prior[k])))
            for (y1, n1), (y0, n0) in zip(self.true[k], self.false[k]):
                odds += [math.log(n1 / n0), math.log((1 - y1 - n1) / (1 - y0 - n0)), math.log(y1 / y0)]
        start = _nth_kind() * (1 + 3 * len(VOTES)) + 1
        parts = (F.element_at(F.lit(odds), start + 2 + 3 * i + F.col(v).cast("int")) for i, v in enumerate(VOTES))
        return _sigmoid(sum(parts, F.element_at(F.lit(odds), start)))

    def score(self) -> Column:
        """The span classifier's probability, from votes and marks."""
        size = len(_inputs())
        weights = [float(w) for k in KINDS for w in self.weights.get(k, np.zeros(size))]
        return _sigmoid(sum((x * F.element_at(F.lit(weights), _nth_kind() * size + i + 1) for i, x in enumerate(_inputs())), F.lit(0.0)))


def _nth_kind() -> Column:
    return F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int") - 1


def _sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), x))))


def _inputs() -> list[Column]:
    return [*(F.col(c).cast("double") for c in (*VOTES, *MARKS)), F.lit(1.0)]


def fit(found: DataFrame, steps: int = 20, newton: int = 6, ridge: float = 1.0) -> Model:
    """The two models from ``candidates``. Their patterns of votes and marks, of bounded number, are counted
    once; each step is one aggregation over these counts."""
    patterns = common.cut(found.groupBy("kind", *VOTES, *MARKS).agg(F.count(F.lit(1)).cast("double").alias("n")), "private-patterns")
    model = Model()
    votes = F.array(*(F.col(v).cast("int") for v in VOTES))
    hits = F.concat(F.transform(votes, lambda v: (v == 1).cast("double")), F.transform(votes, lambda v: (v == -1).cast("double")), F.array(F.lit(1.0)))
    one, m = F.col("n") * F.col("q"), len(VOTES)
    for step in range(steps):
        q = model.posterior() if step else _sigmoid(sum((F.col(v).cast("double") for v in VOTES), F.lit(0.0)))
        # Per vote: how many candidates cast it, in all and by the posterior true ones; last all candidates.
        each = F.concat(F.transform(hits, lambda x: x * F.col("n")), F.transform(hits, lambda x: x * one))
        terms = patterns.withColumn("q", q).select("kind", F.posexplode(each).alias("place", "term"))
        sums = {(r.kind, r.place): r.term for r in terms.groupBy("kind", "place").agg(F.sum("term").alias("term")).collect()}
        moved = 0.0
        for k in {k for k, _ in sums}:
            every, true = (np.array([sums[k, i + at] for i in range(2 * m + 1)]) for at in (0, 2 * m + 1))
            prior = float((true[-1] + 1) / (every[-1] + 2))
            moved = max(moved, abs(prior - model.prior[k]))
            model.prior[k] = prior
            for group, got, lean in ((model.true, true, _TRUE), (model.false, np.maximum(every - true, 0), _FALSE)):
                share = (np.stack([got[:m], got[m : 2 * m]], 1) + LEAN * np.array(lean)) / (got[-1] + LEAN)
                group[k] = [(float(y), float(n)) for y, n in share]
        if step and moved < 1e-4:
            break
    size = len(_inputs())
    soft = patterns.select("kind", "n", *VOTES, *MARKS, model.posterior().alias("q"), F.array(*_inputs()).alias("x"))
    model.weights = {k: np.zeros(size) for k in KINDS}
    p, least = F.col("p"), np.r_[np.full(size - 1, ridge), 1e-3]
    for _ in range(newton):
        # The slope's terms, then those of the bend, row by row: a sum for each place.
        slope = F.transform("x", lambda a: F.col("n") * (p - F.col("q")) * a)
        bend = F.flatten(F.transform("x", lambda a: F.transform("x", lambda b: F.col("n") * p * (1 - p) * a * b)))
        terms = soft.withColumn("p", model.score()).select("kind", F.posexplode(F.concat(slope, bend)).alias("place", "term"))
        sums = {(r.kind, r.place): r.term for r in terms.groupBy("kind", "place").agg(F.sum("term").alias("term")).collect()}
        for k in {k for k, _ in sums}:
            of = np.array([sums[k, i] for i in range(size + size * size)])
            model.weights[k] = model.weights[k] - np.linalg.solve(of[size:].reshape(size, size) + np.diag(least), of[:size] + model.weights[k] * least)
    return model


def spans(found: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """row, kind, start, end, text, base, score: the base spans and those that the classifier adds."""
    kept = found.withColumn("score", model.score()).filter(F.col("base") | (F.col("more") & (F.col("score") >= threshold)))
    kept = kept.select("row", "kind", "start", "end", "text", "base", "score")
    # Frames that end with the row at hand grow as the rows go by; one that begins there would be summed anew each time.
    up, down = (Window.partitionBy("row").orderBy(o).rangeBetween(Window.unboundedPreceding, 0) for o in (F.asc("start"), F.desc("start")))
    hit = (F.max(F.when(F.col("base"), F.col("end"))).over(up) > F.col("start")) | (F.min(F.when(F.col("base"), F.col("start"))).over(down) < F.col("end"))
    kept = kept.repartition("row").withColumn("hit", F.coalesce(hit, F.lit(False))).filter(F.col("base") | ~F.col("hit"))
    earlier = Window.partitionBy("row", "base").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(earlier) > F.col("start"), F.lit(False))
    return kept.withColumn("reached", reached).filter(F.col("base") | ~F.col("reached")).drop("hit", "reached")


def find(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id and spans, an array of (start, kind, end, text, base,
    score) by start, then kind as listed in ``KINDS``."""
    rows, found = candidates(docs)
    place = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    span = F.struct("start", place.alias("nth"), "end", "kind", "text", "base", "score")
    per = spans(found, fit(found)).groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast(per.schema["spans"].dataType)
    return rows.join(per, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    out = find(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return out.select(
        "doc_id",
        *(F.size(F.array_remove(F.transform(base, lambda s: s["kind"] == F.lit(k)), False)).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size(base)).cast("long").alias("n_added"),
    )
