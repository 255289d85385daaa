"""Documents of facilities: which orders govern, which documents are in force, and tables over both.

Columns: place_id (the facility), document (a file's name), document_order (the order number printed in
it), order_no (the order that the source lists), as_of_dates (;-joined days on which it was listed).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions import dates
from factlattice.functions import status as st
from factlattice.functions import text as tx

from . import relational as rel

#: Which type of order governs a facility: the lowest rank, then the newest day (fixed values).
TYPE_RANK = {"NPDES PERMIT": 0, "CO-PERMITTEE": 1, "ENROLLEE - NPDES": 2, "WDR": 3, "ENROLLEE - WDR": 4}
#: Programs under which an order of type WDR counts (fixed values).
WDR_PROGRAMS = ("WDRMUNILRG", "WDRMUNIOTH")
#: Parts of file names of what is no permit (fixed values): short words between separators, phrases
#: anywhere, words that count unless a keep-word stands alone, and the keep-words.
SKIP_WORDS = ("rpts", "rowd", "memo", "nov", "map", "rwd", "gwmp", "mgo")
SKIP_PHRASES = (
    "report", "financial", "response to", "study", "addendum", "registration", "adoption",
    "letter", "covltr", "cover_l", "cover l", "volumetric",
    "form200", "form 200", "management zone", "management_zone", "management plan",
)
CONTINGENT_WORDS = ("amendment", "mrp")
KEEP_WORDS = ("noa", "wdr", "wdrs", "order", "npdes")
#: Phrases by which a document's type is told, in squashed text (fixed values).
WDR_PHRASES = ("wastedischargerequirements", "wdrs", "waterrecyclingrequirements", "informationsheet")
SENTENCE = ("thefollowing", "subjectto", "setforthinthis", "order")


def name_skipped(name: Column) -> Column:
    """Whether a file's name looks like a report, letter or map."""
    lower = F.lower(name)
    spaced = F.concat(F.lit(" "), F.translate(lower, "._-", "   "))
    return tx.contains_any(spaced, [f" {w} " for w in SKIP_WORDS]) | tx.contains_any(lower, SKIP_PHRASES)


def name_kept(name: Column) -> Column:
    """Whether a keep-word stands alone in a file's name."""
    return F.arrays_overlap(F.split(F.regexp_replace(F.lower(name), "[^a-z]+", " "), " "), F.array(*(F.lit(w) for w in KEEP_WORDS)))


def name_wanted(name: Column, on_page: Column) -> Column:
    """Whether a file is to be taken: the only one of its page always, else by its name."""
    contingent = tx.contains_any(F.lower(name), CONTINGENT_WORDS) & ~name_kept(name)
    return (on_page <= 1) | ~(name_skipped(name) | contingent)


def is_general_order(text: Column) -> Column:
    """A statewide general order: its title names general requirements, its first page the state's board
    and no notice of applicability. Page marks don't count."""
    head = F.regexp_replace(F.substring(text, 1, 1800), r"===PAGE \d+===\n?|\[Page \d+\]\n?", "")
    title, first = (F.lower(tx.one_spaced(F.substring(head, 1, n))) for n in (300, 900))
    yes = F.contains(title, F.lit("general waste discharge requirements")) & F.contains(first, F.lit("state water resources control board"))
    return F.coalesce(yes & ~F.contains(first, F.lit("notice of applicability")), F.lit(False))


def document_type(text: Column, pages: Column, least_pages: int = 10) -> Column:
    """NPDES, NOA, WDR or NULL, from the text of a document's first pages; the first rule wins."""
    lower, squashed = F.lower(text), tx.squashed(text)
    sentence = r"(?isu)" + r"(.{1,600}?)".join("".join(c + r"[\s\-]*" for c in phrase) for phrase in SENTENCE)
    none = F.lit(None).cast("string")
    return (
        F.when(pages < least_pages, none)
        .when(is_general_order(lower), none)
        .when(F.contains(text, F.lit("NOA")) | F.contains(squashed, F.lit("noticeofapplicability")), "NOA")
        .when(F.regexp_like(lower, F.lit(r"(?iU)\bca\s*g\d+")), none)
        .when(F.contains(squashed, F.lit("table1.dischargerinformation")) | F.regexp_like(lower, F.lit(sentence)), "NPDES")
        .when(tx.contains_any(squashed, WDR_PHRASES), "WDR")
        .otherwise(none)
    )


def accepted_documents(documents: DataFrame, listed: DataFrame) -> DataFrame:
    """``documents`` (document, type, pages) with accepted: types are overridden by what facilities list
    them (``listed``: place_id, document, order_type), and a facility's only document is kept anyway.

    A name that says report or letter, without a keep-word, clears the type; so does being listed by
    enrollees only, for types NPDES and WDR, and for a NOA if it is on more than one facility's list."""
    of = listed.groupBy("document").agg(
        F.count_distinct("place_id").alias("__places"), F.bool_and(F.startswith("order_type", F.lit("ENROLLEE"))).alias("__enrollee")
    )
    only = listed.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"), F.max("document").alias("document")).filter("n = 1")
    only = only.select("document", F.lit(True).alias("__only")).distinct()
    both = documents.join(of, "document", "left").join(only, "document", "left")
    name, enrollee = tx.stem(F.col("document")), F.coalesce("__enrollee", F.lit(False))
    cleared = (name_skipped(name) & ~name_kept(name)) | (F.col("type").isin("WDR", "NPDES") & enrollee) | ((F.col("type") == "NOA") & enrollee & (F.col("__places") > 1))
    kind = F.when(~F.coalesce(cleared, F.lit(False)), F.col("type"))
    accepted = kind.isNotNull() | (F.coalesce("__only", F.lit(False)) & (F.col("pages") >= 3))
    return both.withColumn("type", kind).withColumn("accepted", accepted).drop("__places", "__enrollee", "__only")


def governing_orders(orders: DataFrame, as_of: str | None = None) -> DataFrame:
    """One order per place_id of ``orders`` (place_id, type, status, effective, program, order_no, link): of
    the active ones, or of those in effect by ``as_of`` and ever active, the best type, then the newest,
    then one with a link, then the smallest number."""
    type_ = F.upper("type")
    rank = F.element_at(F.create_map(*(F.lit(x) for kv in TYPE_RANK.items() for x in kv)), type_)
    day = dates.parsed(F.col("effective"))
    standing = F.lower("status") == "active" if as_of is None else (F.lower("status") != "never active") & (day <= F.lit(as_of).cast("date"))
    counts = rank.isNotNull() & ((type_ != "WDR") | F.upper("program").isin(*WDR_PROGRAMS))
    open_ = orders.filter(day.isNotNull() & standing & counts)
    return rel.best_of(open_, ["place_id"], [rank, -F.unix_date(day), F.col("link").isNull().cast("int"), F.col("order_no")])


def _normal(order: Column) -> Column:
    """An order number's letters and digits without a leading WQ, unless nothing else is left."""
    text = tx.letters_digits(order)
    short = tx.without_prefix(text, "WQ")
    return F.when(short != "", short).otherwise(text)


def in_force(documents: DataFrame, listed: DataFrame, statuses: DataFrame, as_of: str | None = None) -> DataFrame:
    """The rows of ``documents`` (place_id, document, document_order, order_no) that are in force.

    A document's tier is 0 if its order number contains or is contained in one that ``listed`` (place_id,
    order_no, as_of_dates) holds for the place on the day (or in its own order_no, if it holds none), 1 if
    none can be read, else 2; 3 more if ``statuses`` (place_id, document, status) shows nothing in it. Each
    place keeps its best tier; where even that is superseded, only the newest adoption year's."""
    day = as_of or dates.newest_day(listed, "as_of_dates")
    held = listed.filter(~tx.blank(F.col("order_no")) & dates.held_on(F.col("as_of_dates"), F.lit(day)))
    held = held.groupBy(tx.plain_id(F.col("place_id")).alias("__pid")).agg(F.collect_set(_normal(F.trim("order_no"))).alias("__held"))
    shown = statuses.filter(st.parse(F.col("status"), strict=False).isNotNull()).select("place_id", "document", F.lit(True).alias("__shows")).distinct()
    rows = documents.withColumn("__pid", tx.plain_id(F.col("place_id"))).join(held, "__pid", "left").join(shown, ["place_id", "document"], "left")
    own = F.when(~tx.blank(F.col("order_no")), F.array(_normal(F.trim("order_no")))).otherwise(F.array().cast("array<string>"))
    number = _normal(F.trim("document_order"))
    listed_now = F.exists(F.coalesce("__held", own), lambda o: F.contains(o, number) | F.contains(number, o))
    tier = F.when(tx.blank(F.col("document_order")), 1).when(listed_now, 0).otherwise(2) + F.when(F.col("__shows"), 0).otherwise(3)
    kept = rel.newest_tier(rows.withColumn("__tier", tier), "place_id", F.col("__tier"), dates.adoption_year(F.col("document_order")), superseded=2)
    return kept.select(*documents.columns)


def collapsed(statuses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, process, status merged over the lattice; a NULL key is a group of its own."""
    return statuses.groupBy(*keys, "process").agg(st.merge(F.col("status")).alias("status")).filter("status IS NOT NULL")


def facility_table(documents: DataFrame, listed: DataFrame, statuses: DataFrame, metadata: Sequence[str], order: str, as_of: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per facility from the documents in force: its metadata (each column's first that isn't blank, by
    ``order``), and place_id, process, status."""
    now = in_force(documents, listed, statuses, as_of)
    about = rel.first_present(now, ["place_id"], metadata, order)
    return about, collapsed(statuses.join(now.select("place_id", "document").distinct(), ["place_id", "document"], "left_semi"), ["place_id"])


def survey_facilities(survey: DataFrame, crosswalk: DataFrame, places: DataFrame) -> DataFrame:
    """place_id, process, status of a survey (survey_id, process, status): merged per survey id, carried to
    the places that the cross-walk (place_id, survey_id) links with it, merged per place."""
    linked = crosswalk.filter(~tx.blank(F.col("survey_id")) & (F.upper("survey_id") != "NA")).select("place_id", "survey_id")
    linked = linked.join(places.select("place_id").distinct(), "place_id", "left_semi")
    return collapsed(linked.join(collapsed(survey, ["survey_id"]), "survey_id"), ["place_id"])


def snapshot_union(snapshots: dict[str, DataFrame] | DataFrame, collective: str = "organizations under") -> DataFrame:
    """All dated snapshots (or one table with a column as_of) as one: a row per place_id, order (its measure_id,
    else order_no) and document, the newest snapshot's, with as_of_dates and n_snapshots. Places of a
    collective agency are left out."""
    if isinstance(snapshots, dict):
        parts = [df.withColumn("as_of", F.lit(day)) for day, df in sorted(snapshots.items())]
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part, allowMissingColumns=True)
    else:
        every = snapshots
    names = [c for c in every.columns if c != "as_of"]
    every = every.filter(~F.contains(F.lower(F.coalesce("agency", F.lit(""))), F.lit(collective)))
    key = F.when(~tx.blank(F.col("measure_id")), F.col("measure_id")).otherwise(F.coalesce("order_no", F.lit("")))
    row = F.struct(*(F.col(f"`{c}`") for c in names))
    days = F.sort_array(F.collect_set("as_of"))
    grouped = every.withColumn("__order", key).groupBy("place_id", "__order", "document").agg(F.max_by(row, "as_of").alias("r"), days.alias("days"))
    return grouped.select("r.*", F.array_join("days", ";").alias("as_of_dates"), F.size("days").cast("long").alias("n_snapshots"))


def relevant_sites(facilities: DataFrame, accepted: DataFrame, about: DataFrame, collective: str = "organizations under") -> DataFrame:
    """A row per facility and accepted document, or one with a blank document: ``facilities`` (place_id,
    facility_id, name, documents: array, order_no) with the first row of ``about`` (facility_id, name, agency,
    order_no, place), and shared: whether the document is on more than one list."""
    lists = facilities.select("place_id", F.explode("documents").alias("document")).join(accepted.select("document").distinct(), "document", "left_semi")
    shared = lists.groupBy("document").agg((F.count(F.lit(1)) > 1).alias("shared"))
    first = rel.best_of(about.withColumn("facility_id", F.trim("facility_id")).withColumn("name", F.trim("name")), ["facility_id", "name"], [F.col("place")])
    own = facilities.withColumnRenamed("order_no", "__own").join(first.drop("place"), ["facility_id", "name"], "left")
    own = own.filter(~F.contains(F.lower(F.coalesce("agency", F.lit(""))), F.lit(collective)))
    rows = own.drop("documents").join(lists.join(shared, "document"), "place_id", "left")
    order = tx.first_filled(F.col("__own"), F.col("order_no"))
    return rows.withColumn("order_no", order).drop("__own").fillna({"document": "", "shared": False})


def region(order: Column, document: Column, listed: Column) -> Column:
    """R1 to R9 by the prefix of an order number or file name, else by the listed region's first digit,
    else Unspecified."""
    prefix = F.regexp_extract(F.concat_ws(" ", F.coalesce(order, F.lit("")), F.coalesce(document, F.lit(""))), r"(?i)\bR([1-9])[-_ ]", 1)
    digit = F.regexp_extract(F.coalesce(listed, F.lit("")), r"^(\d)", 1)
    return F.when(prefix != "", F.concat(F.lit("R"), prefix)).when(digit != "", F.concat(F.lit("R"), digit)).otherwise("Unspecified")


def with_county(df: DataFrame, sources: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """``df`` with county: the first that isn't blank of several lookups, each a column of ``df`` and a table
    (key, county, place) whose first row per key counts; else blank."""
    found = []
    for i, (column, table) in enumerate(sources):
        one = table.filter(~tx.blank(F.col("key")) & ~tx.blank(F.col("county"))).groupBy(F.trim("key").alias(f"__k{i}")).agg(F.min_by("county", "place").alias(f"__c{i}"))
        df = df.join(one, tx.plain_id(F.col(column)) == F.col(f"__k{i}"), "left").drop(f"__k{i}")
        found.append(f"__c{i}")
    return df.withColumn("county", F.coalesce(*found, F.lit(""))).drop(*found)


def by_name(left: DataFrame, right: DataFrame, name: str, other: str) -> DataFrame:
    """Every row of ``left`` with the rows of ``right`` whose name is the same but for case and outer spaces;
    several matches all stay, rows without one too."""
    return left.withColumn("__n", F.upper(F.trim(name))).join(right.withColumn("__n", F.upper(F.trim(other))), "__n", "left").drop("__n")
