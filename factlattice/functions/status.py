"""The status lattice: PAST < OFFSITE < FUTURE < PRESENT, with PRESENT_AND_FUTURE as a join.

Inside the library a status is a bit mask, so merging is ``bit_or``: associative, with map-side partial
aggregation. Absent is NULL everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of the statuses (fixed values).
BITS = {"PAST": 1, "OFFSITE": 2, "FUTURE": 4, "PRESENT": 8, "PRESENT_AND_FUTURE": 12}
#: Spellings of an absent status, upper case (fixed values).
ABSENT = ("", "0", "0.0", "NAN", "NONE")


def parse(value: Column, strict: bool = True) -> Column:
    """Trimmed upper-case status; absent spellings are NULL; another word raises (or is NULL)."""
    word = F.upper(F.trim(value))
    known = F.when(word.isNull() | word.isin(*ABSENT), F.lit(None).cast("string")).when(word.isin(*BITS), word)
    return known.otherwise(F.raise_error(F.concat(F.lit("unknown status: "), word)).cast("string")) if strict else known


def bits(status: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, bit in BITS.items():
        out = F.when(status == name, F.lit(bit)).otherwise(out)
    return out


def decode(mask: Column) -> Column:
    """Both future and present bits join; otherwise the highest bit stands."""
    return (
        F.when(mask.bitwiseAND(F.lit(12)) == 12, "PRESENT_AND_FUTURE")
        .when(mask.bitwiseAND(F.lit(8)) != 0, "PRESENT")
        .when(mask.bitwiseAND(F.lit(4)) != 0, "FUTURE")
        .when(mask.bitwiseAND(F.lit(2)) != 0, "OFFSITE")
        .when(mask.bitwiseAND(F.lit(1)) != 0, "PAST")
    )


def merge(status: Column) -> Column:
    """Aggregate: the join of a column of statuses."""
    return decode(F.bit_or(bits(status)))


def is_present(status: Column, wide: bool = False) -> Column:
    """Present now; ``wide`` counts FUTURE and OFFSITE too (as scoring does). PAST never counts."""
    names = ["PRESENT", "PRESENT_AND_FUTURE"] + (["FUTURE", "OFFSITE"] if wide else [])
    return F.coalesce(status.isin(*names), F.lit(False))


#: Rank of a status where one process gets several within a document (fixed values); the join isn't made there.
RANK = {"PAST": 1, "OFFSITE": 2, "FUTURE": 3, "PRESENT": 4}
#: Words that say a unit stands elsewhere, lower case with underscores (fixed values).
OFFSITE_WORDS = ("off_site", "third_party", "offsite")


def rank(status: Column) -> Column:
    out = F.lit(0)
    for name, value in RANK.items():
        out = F.when(status == name, F.lit(value)).otherwise(out)
    return out


def of_implementation(implementation: Column, location: Column, offsite: tuple[str, ...] = OFFSITE_WORDS) -> Column:
    """The status of an item that says when and where: a present unit elsewhere is OFFSITE, a planned or
    past one elsewhere has none; NULL where nothing is said."""
    said = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), "-", "_")
    when, elsewhere = said(implementation), said(location).isin(*offsite)
    return (
        F.when(when.isin(*offsite) | ((when == "present") & elsewhere), "OFFSITE")
        .when(when.isin("present", "future", "past") & ~elsewhere, F.upper(when))
        .otherwise(F.lit(None).cast("string"))
    )


def best(status: Column) -> Column:
    """Aggregate: the status of the highest rank, NULL if there is none."""
    return F.max_by(status, F.when(rank(status) > 0, rank(status)))
