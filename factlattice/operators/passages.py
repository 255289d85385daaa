"""The parts of documents that describe a facility and its planned changes, as plans over offsets.

A text is read once: the matches of each pattern become rows (key, kind, start, end). All later steps are joins,
windows and aggregates over these narrow rows, per document: mentions with small gaps between them are a
run (islands by a running sum), what stands around a run is counted by a join of places with ranges, runs
near the best one are merged by a second pass of islands, headers and paragraph ends are found by an
as-of join of places. Texts are joined again at the end alone, to be cut.

A match counts for a window if it lies in it whole. Places are code points, ends exclusive. Documents are known by
a unique key; null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlattice.functions import text as tx

from . import relational as rel
from .keywords import SEPARATOR

# Patterns, and distances in characters.
DOTS = r"\.{5,}"
FACT_SHEET = r"(?i)ATTACHMENT\s+F\s*[-–—‐]\s*FACT\s+SHEET"
ORDER = r"(?:R\d{1,2}[A-Z]?[-\s])?(?:WQ[-\s])?(?:20\d{2}|9\d)[-\s]\d{3,4}(?:[-\s](?:DWQ|EXEC))?"
ORDER_LABELLED = r"(?i)ORDER\s*(?:NO\.?|NUMBER)?\s*[:\s]\s*(" + ORDER + ")"
ORDER_ANY = r"(?i)\b(" + ORDER + r")\b"
CUES = r"treatment process|consists of|leach\s*field|comprised of|upgraded|headworks|preliminary treatment|primary treatment|secondary treatment"
BOILERPLATE = (
    r"(?i)pursuant to|shall comply|must be \w+|shall be \w+|inter-tidal|intertidal|tide gate|kayak|interpretive center"
    r"|RPA for Discharge|WQBELs|Endpoint \d+\s+is established|133\.10|Construction, Operation, and Maintenance Specifications"
)
STRONG_CUES = r"(?i)consist of|consists of|consisting of|comprised of|comprising"
LINE = r"(?m)^[A-Z\d][^\n]{2,79}$"
NUMBERED = r"(?m)^(?:\d+|[IVX]{2,5})\.\s+[A-Z]"
REGULATION = r"(?i)applicable plans,?\s+policies|other plans,?\s+policies\s+and\s+regulations|secondary treatment regulations"
CHANGES = r"(?i)planned\s+changes|planned\s+upgrade|proposed\s+upgrade"
#: Document types that are searched whole; of others the fact sheet is.
WHOLE_TYPES = ("ENROLLEE - NPDES", "ENROLLEE - WDR", "WDR", "INDIVIDUAL MONITORING REQUIREM")
#: Set around matches, so that one search gives them and what lies between; a text that has it is searched twice.
MARK = "\ue000"
HEAD, LEAST_PAGE, PAGES_BACK, CONTENTS = 2500, 10, 2, 20_000


@dataclass(frozen=True)
class Rules:
    """Patterns of a vocabulary's mentions and of what speaks for and against a description, and distances."""

    terms: str
    cues: str = rf"(?i){CUES}"
    strong: str = STRONG_CUES
    boilerplate: str = BOILERPLATE
    changes: str = CHANGES
    stop: str = REGULATION
    denial: str = r"(?i)\bno\s+$"
    gap: int = 500
    around: int = 600
    diverse: int = 6
    joined: int = 2500
    far: int = 10_000
    tail: int = 1000
    back: int = 2000
    trail: int = 400
    near: int = 1000
    reach: int = 5000


def rules_of(terms: Sequence[str], **distances) -> Rules:
    """The rules for a list of terms: these, the cues, and ponds."""
    escaped = [r"\Q" + t.replace(r"\E", r"\E\\E\Q") + r"\E" for t in sorted(terms, key=len, reverse=True)]
    return Rules("(?i)" + "|".join([*escaped, CUES, r"\bponds?\b"]), **distances)


# Pages and titles


def of_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """key, raw: the pages (key, page, text) of each document in order, each under its mark [Page N]; numbers
    begin at 0."""
    listed = pages.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(page).alias("p"), F.coalesce(text, F.lit("")).alias("t")))).alias("l"))
    marked = F.transform("l", lambda x, i: F.concat(F.lit("[Page "), i.cast("string"), F.lit("]\n"), x["t"]))
    return listed.select(key, F.array_join(marked, "\n").alias("raw"))


def fact_sheet_pages(pages: DataFrame, key: str, page: str, text: str) -> DataFrame:
    """The pages (key, page from 0, text) of each document from its fact sheet on: from two pages before the first
    page, from page 10 on, that has the title among fewer than three dot leaders; all pages of a
    document without one."""
    hit = (F.col(page) >= LEAST_PAGE) & F.col(text).rlike(FACT_SHEET) & (F.size(F.regexp_extract_all(F.col(text), F.lit(DOTS), F.lit(0))) < 3)
    first = pages.filter(hit).groupBy(key).agg((F.min(page) - PAGES_BACK).alias("__first"))
    return pages.join(first, key, "left").filter(F.col("__first").isNull() | (F.col(page) >= F.col("__first"))).drop("__first")


def tidied(raw: Column) -> Column:
    """Runs of blanks as one, none at line ends or around."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, r"[^\S\n]+", " "), r"(?m) +$", ""))


def order_number(raw: Column) -> Column:
    """The order number in a document's title block: a labelled one before any other; else empty."""
    head = F.left(F.regexp_replace(raw, r"\[Page \d+\]\n?", ""), F.lit(HEAD))
    found = F.coalesce(F.nullif(F.regexp_extract(head, ORDER_LABELLED, 1), F.lit("")), F.regexp_extract(head, ORDER_ANY, 1))
    return F.replace(F.upper(found), F.lit(" "), F.lit("-"))


# Places


def occurrences(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """key, kind, start, end, match: the matches of each pattern (none may be empty), leftmost first, in one pass."""
    each = []
    for kind, p in patterns.items():
        apart = F.arrays_zip(F.split(F.col(text), p, -1).alias("gap"), F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0)).alias("match"))
        parts = F.split(F.regexp_replace(F.col(text), F.lit(p), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        every = lambda ps, n: F.filter(ps, lambda _, i: i % 2 == n)
        once = F.transform(F.array(parts), lambda ps: F.arrays_zip(every(ps, 0).alias("gap"), every(ps, 1).alias("match")))[0]
        each.append(_entries(F.when(F.contains(F.col(text), F.lit(MARK)), apart).otherwise(once), kind))
    rows = docs.filter(F.col(text).isNotNull()).select(key, F.explode(F.flatten(F.array(*each))).alias("e")).select(key, "e.*")
    so_far = Window.partitionBy(key, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.char_length("match")).over(so_far).cast("int"))
    return placed.select(key, "kind", (F.col("end") - F.char_length("match")).alias("start"), "end", "match")


def _entries(zipped: Column, kind: str) -> Column:
    entry = F.transform(zipped, lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), F.char_length(z["gap"]).alias("gap"), z["match"].alias("match")))
    return F.filter(entry, lambda e: e["match"].isNotNull())


def islands(rows: DataFrame, key: str, start: str, end: str, gap: int, also: Column | None = None) -> DataFrame:
    """``rows`` with ``island``, a number: rows of a key, by start, belong together while at most ``gap`` lies between
    a row's start and the furthest end before it. ``also``: a flag of rows that begin one anyway."""
    order = Window.partitionBy(key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col(start) - reach > gap, F.lit(True)) | (F.lit(False) if also is None else also)
    marked = rows.withColumn("__new", new.cast("int"))
    return marked.withColumn("island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def runs(hits: DataFrame, key: str, gap: int) -> DataFrame:
    """key, start, end, n, kinds: runs of two or more mentions (key, start, end, match) with at most ``gap`` characters
    between them, and how many different ones they hold."""
    grouped = islands(hits, key, "start", "end", gap).groupBy(key, "island")
    made = grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n"), F.count_distinct(F.lower("match")).alias("kinds"))
    return made.filter("n > 1").drop("island")


def described(every: DataFrame, places: DataFrame, sizes: DataFrame, key: str, rules: Rules) -> DataFrame:
    """``every`` (runs) with ``worth`` and ``good``: whether a run looks like a description: no table of contents
    before it or in it; many different terms or a strong phrase, else a cue and at most one piece of boilerplate
    around. ``sizes``: key, size of the text."""
    ends = lambda more: (F.greatest(F.col("start") - rules.around, F.lit(0)).alias("__low"), (F.col("end") + more + 1).alias("__high"))
    every, found = rel.saved(every), None  # asked three times
    for kinds, more in ((("dots", "strong", "cues"), 0), (("boilerplate",), rules.around)):
        wanted = places.filter(F.col("kind").isin(*kinds)).select(key, "kind", F.col("start").alias("__from"), F.col("end").alias("__to"))
        window = every.select(key, F.col("start").alias("__run"), *ends(more))
        some = rel.inside(wanted, window, [key], "__from", "__low", "__high", 1024.0).filter(F.col("__to") < F.col("__high"))
        found = some if found is None else found.unionByName(some)
    of = lambda kind: F.count_if(F.col("kind") == kind).alias(kind)
    counts = found.groupBy(key, F.col("__run").alias("start")).agg(*(of(k) for k in ("dots", "strong", "cues", "boilerplate")))
    known = every.join(counts, [key, "start"], "left").fillna(0, ["dots", "strong", "cues", "boilerplate"]).join(sizes, key)
    good = (F.col("dots") < 3) & ((F.col("kinds") >= rules.diverse) | (F.col("strong") > 0) | ((F.col("cues") > 0) & (F.col("boilerplate") < 2)))
    worth = F.col("kinds") / (1 + F.col("start") / F.col("size"))
    return known.select(key, "start", "end", "kinds", worth.alias("worth"), good.alias("good"), "size")


def spans(scored: DataFrame, places: DataFrame, asked: DataFrame, key: str, rules: Rules) -> DataFrame:
    """key, start, end, stop: the merged passages of each document. Around the best run: back through runs close to one
    another, on to all that begin near it, up to the first mark of a part that never describes. ``asked``: key,
    many; documents of many facilities keep all runs, each with the short ones right after it. Without
    a good run the densest one counts."""
    rows = scored.join(asked, key)
    any_good = F.max("good").over(Window.partitionBy(key))
    dense = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("worth"), "start")) == 1
    rows = rows.withColumn("__any", any_good).withColumn("good", F.when(any_good, F.col("good")).otherwise(dense))
    # A good run of a document of many takes in the others that follow it closely.
    joined = islands(rows, key, "start", "end", rules.tail, F.col("good"))
    taken = joined.groupBy(key, "island").agg(F.min_by(F.struct("start", "end", "worth", "good", "many", "__any", "size"), "start").alias("f"), F.max("end").alias("__last"))
    kept = taken.select(key, "f.*", "__last").filter("good").withColumn("end", F.when(F.col("many") & F.col("__any"), F.col("__last")).otherwise(F.col("end")))
    kept = rel.saved(islands(kept, key, "start", "end", rules.joined).withColumnRenamed("island", "__near"))
    best = F.max_by(F.struct("start", "__near"), F.struct("worth", (-F.col("start")).alias("less"))).over(Window.partitionBy(key))
    kept = kept.withColumn("__best", best).withColumn("anchor", F.when(F.col("many"), F.min("start").over(Window.partitionBy(key))).otherwise(F.col("__best.start")))
    back = (F.col("start") < F.col("anchor")) & (F.col("__near") == F.col("__best.__near"))
    on = F.col("start").between(F.col("anchor"), F.col("anchor") + rules.far)
    kept = kept.filter(F.col("many") | back | on)
    stops = kept.select(key, "anchor").distinct().join(places.filter("kind = 'stop'").select(key, F.col("start").alias("__at")), key)
    stops = stops.filter(F.col("__at") > F.col("anchor")).groupBy(key).agg(F.min("__at").alias("stop"))
    kept = kept.join(stops, key, "left").withColumn("stop", F.coalesce("stop", "size")).filter(F.col("start") < F.col("stop"))
    merged = islands(kept, key, "start", "end", rules.joined).groupBy(key, "island")
    merged = merged.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("stop").alias("stop"), F.first("size").alias("size"))
    return rel.saved(merged.drop("island"))


def snapped(found: DataFrame, places: DataFrame, key: str, rules: Rules) -> DataFrame:
    """``found`` (key, start, ...) with ``head``: back to the last numbered header, else the last paragraph, else the last
    line that begins with a capital or digit, within ``rules.back`` characters; else the start itself."""
    # Each start asks once per kind, all in one as-of join.
    at = F.when(F.col("kind") == "paragraph", F.col("end")).otherwise(F.col("start"))
    marks = places.filter(F.col("kind").isin("numbered", "paragraph", "line")).select(key, "kind", F.col("end").alias("__until"), at.alias("__at"))
    asked = found.select(key, "start", F.explode(F.array(*map(F.lit, ("numbered", "paragraph", "line")))).alias("kind"))
    near = rel.as_of(asked, marks, [key, "kind"], "start", "__until", 65_536.0)
    near = near.filter(F.col("found.__at") >= F.col("start") - rules.back).groupBy(key, "start")
    best = near.agg(*(F.max(F.when(F.col("kind") == k, F.col("found.__at"))).alias(f"__{k}") for k in ("numbered", "paragraph", "line")))
    out = found.join(best, [key, "start"], "left")
    return out.withColumn("head", F.coalesce("__numbered", "__paragraph", "__line", "start")).drop("__numbered", "__paragraph", "__line")


def extended(found: DataFrame, places: DataFrame, key: str, end: str, size: str, rules: Rules) -> DataFrame:
    """``found`` with ``end`` moved on to the end of its paragraph, at most ``rules.trail`` characters."""
    minus = places.filter("kind = 'paragraph'").select(key, (-F.col("start")).alias("__at"))
    near = rel.as_of(found.withColumn("__minus", -F.col(end)), minus, [key], "__minus", "__at", 65_536.0)
    most = F.least(F.col(end) + rules.trail, F.col(size))
    after = -F.col("found.__at")
    return near.withColumn(end, F.when(after + 2 <= most, after + 2).otherwise(most).cast("int")).drop("found", "__minus")


def change_starts(places: DataFrame, key: str, context: DataFrame, rules: Rules) -> DataFrame:
    """key, start, end, match: mentions of planned changes at a boundary, not denied, with two or more mentions of the
    vocabulary in the characters from it on. ``context``: key, text."""
    asked = places.filter("kind = 'changes'")
    near = rel.inside(
        places.filter("kind = 'terms'").select(key, F.col("start").alias("__from"), F.col("end").alias("__to")),
        asked.select(key, "start", (F.col("start") + rules.near + 1).alias("__high")), [key], "__from", "start", "__high", 1024.0,
    ).filter(F.col("__to") < F.col("__high"))
    enough = near.groupBy(key, "start").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    before = F.substring(F.col("__text"), F.greatest(F.col("start") - 9, F.lit(1)), F.least(F.col("start"), F.lit(10)))
    seen = asked.join(enough, [key, "start"]).join(context.toDF(key, "__text"), key).withColumn("__before", before).drop("__text")
    return seen.filter(((F.col("start") == 0) | F.col("__before").rlike(r"[\n.:( ]$")) & ~F.col("__before").rlike(rules.denial)).drop("__before", "kind")


def changes(starts: DataFrame, places: DataFrame, key: str, sizes: DataFrame, rules: Rules) -> DataFrame:
    """key, start, end, match: each part on planned changes, from its mention (``starts``) to the end of the paragraph of
    the last mention of the vocabulary that follows without a large gap, within ``rules.reach`` characters."""
    terms = islands(places.filter("kind = 'terms'"), key, "start", "end", rules.gap).select(key, F.col("start").alias("__from"), F.col("end").alias("__to"), "island")
    window = starts.select(key, "start", "end", "match", (F.col("start") + rules.reach + 1).alias("__high"))
    held = rel.inside(terms, window, [key], "__from", "start", "__high", 4096.0).filter(F.col("__to") < F.col("__high"))
    first = F.min("island").over(Window.partitionBy(key, "start"))
    last = held.withColumn("__first", first).filter(F.col("island") == F.col("__first")).groupBy(key, "start", "end", "match").agg(F.max("__to").alias("until"))
    return extended(last.join(sizes, key), places, key, "until", "size", rules).select(key, "start", F.col("until").alias("end"), "match")


def places_of(docs: DataFrame, key: str, text: str, rules: Rules) -> DataFrame:
    """All places that the steps ask for, written once."""
    patterns = {"terms": rules.terms, "dots": DOTS, "strong": rules.strong, "cues": rules.cues, "boilerplate": rules.boilerplate, "stop": rules.stop, "changes": rules.changes, "numbered": NUMBERED, "paragraph": r"\n\n", "line": LINE, "page": r"\[Page \d+\]"}
    return rel.saved(occurrences(docs, key, text, patterns))


def extracted(docs: DataFrame, key: str, text: str, rules: Rules, many: str | None = None) -> DataFrame:
    """key, description, changes, changes_phrase, order_number, unreadable: one row per document. ``many`` names a flag of
    documents of several facilities. A description begins with the mark of its page; it ends where the planned
    changes in it begin. Unreadable: no description, and less than 100 characters besides page marks."""
    docs = docs.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    places = places_of(docs, key, text, rules)
    sizes = docs.select(key, F.char_length(text).alias("size"))
    asked = docs.select(key, F.coalesce(F.col(many), F.lit(False)).alias("many") if many else F.lit(False).alias("many"))
    scored = described(runs(places.filter("kind = 'terms'"), key, rules.gap), places, sizes, key, rules)
    found = snapped(spans(scored, places, asked, key, rules), places, key, rules)
    found = extended(found, places, key, "end", "size", rules).withColumn("end", F.least("end", "stop"))
    # A passage that begins inside the one before it is part of that.
    before = F.max("end").over(Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1))
    found = rel.saved(found.withColumn("__done", before).filter(F.col("__done").isNull() | (F.col("start") >= F.col("__done"))).select(key, "start", "head", "end"))
    parts = rel.saved(changes(change_starts(places, key, docs.select(key, text), rules), places, key, sizes, rules))
    first = found.groupBy(key).agg(F.min("head").alias("__begin"))
    after = F.col("start") >= F.col("__begin") + 100
    chosen = parts.join(first, key).groupBy(key).agg(F.min_by(F.struct("start", "end", "match"), F.struct((~after).alias("o"), "start")).alias("c"))
    chosen = chosen.select(key, F.col("c.start").alias("__change"), F.col("c.end").alias("__change_end"), F.trim("c.match").alias("changes_phrase"))
    pages = places.filter("kind = 'page'").select(key, F.col("end").alias("__until"), F.col("match").alias("__page"))
    found = rel.as_of(found, pages, [key], "head", "__until", 65_536.0).withColumn("__page", F.col("found.__page")).drop("found")
    listed = found.join(chosen, key, "left").withColumn("end", F.when(F.col("__change").between(F.col("head"), F.col("end") - 1), F.col("__change")).otherwise(F.col("end")))
    listed = listed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("head", "end", "__page"))).alias("__parts"))
    whole = docs.join(listed, key, "left").join(chosen, key, "left")
    piece = lambda p: F.trim(F.substring(F.col(text), p["head"] + 1, p["end"] - p["head"]))
    body = F.transform("__parts", lambda p: F.concat(F.when(p["__page"].isNotNull() & ~F.startswith(piece(p), F.lit("[Page")), F.concat(p["__page"], F.lit("\n"))).otherwise(""), piece(p)))
    out = whole.select(
        key,
        F.coalesce(F.array_join(F.filter(body, lambda b: b != ""), "\n\n"), F.lit("")).alias("description"),
        F.coalesce(F.trim(F.substring(F.col(text), F.col("__change") + 1, F.col("__change_end") - F.col("__change"))), F.lit("")).alias("changes"),
        F.coalesce("changes_phrase", F.lit("")).alias("changes_phrase"),
        order_number(F.col(text)).alias("order_number"),
        F.char_length(F.trim(F.regexp_replace(F.col(text), r"\[Page \d+\]\n?", ""))).alias("__rest"),
    )
    return out.withColumn("unreadable", (F.col("description") == "") & (F.col("__rest") < 100)).drop("__rest")


def as_text(description: Column, changes: Column) -> Column:
    """Both parts as one text with the mark between them."""
    return F.concat(description, F.lit(SEPARATOR), changes)


def page_of(text: Column) -> Column:
    """The number of the page that an excerpt begins on; NULL if it doesn't say."""
    return F.regexp_extract(text, r"^\[Page (\d+)\]", 1).try_cast("int")


def phrase_counts(found: DataFrame) -> DataFrame:
    """How often each phrase begins the planned changes."""
    return found.filter("changes_phrase <> ''").groupBy(F.lower(tx.one_spaced(F.col("changes_phrase"))).alias("phrase")).agg(F.count(F.lit(1)).alias("n"))
