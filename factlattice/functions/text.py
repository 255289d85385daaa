"""Text and id normalisation. All but NFKC are built-in functions; Spark has none for that."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of no width that are deleted (fixed values).
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\ufeff"


def nfkc(text: Column) -> Column:
    """Unicode NFKC; NULL stays NULL."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")

    return run(text)


def normalised(text: Column, lower: bool = False) -> Column:
    """NFKC without characters of no width, runs of Unicode white space as one space, trimmed."""
    out = F.trim(F.regexp_replace(F.translate(nfkc(text), ZERO_WIDTH, ""), r"(?U)\s+", " "))
    return F.lower(out) if lower else out


def plain_id(value: Column) -> Column:
    """Trimmed, without the trailing .0 of a number read as a float."""
    return F.regexp_replace(F.trim(value), r"\.0$", "")


def one_zero(value: Column, width: int = 11) -> Column:
    """One leading zero if shorter than ``width``; not a fill."""
    text = F.trim(value)
    return F.when(F.length(text) < width, F.concat(F.lit("0"), text)).otherwise(text)


def zero_filled(value: Column, width: int = 11) -> Column:
    """The whole number as text, filled with zeros; longer ones stay whole, other text is NULL."""
    text = value.try_cast("double").cast("bigint").cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def before(text: Column, mark: str) -> Column:
    """What stands before the first ``mark``; the whole text if there is none."""
    return F.substring_index(text, mark, 1)


def after(text: Column, mark: str) -> Column:
    """What stands after the first ``mark``; empty if there is none."""
    return F.when(F.contains(text, F.lit(mark)), F.substring(text, F.locate(mark, text) + len(mark), F.length(text))).when(text.isNotNull(), F.lit(""))


def last_part(text: Column, mark: str) -> Column:
    """What stands after the last ``mark``; the whole text if there is none."""
    return F.substring_index(text, mark, -1)


def without_prefix(text: Column, prefix: str) -> Column:
    return F.when(F.startswith(text, F.lit(prefix)), F.substring(text, F.lit(len(prefix) + 1), F.length(text))).otherwise(text)


def without_suffix(text: Column, suffix: str) -> Column:
    return F.when(F.endswith(text, F.lit(suffix)), F.substring(text, F.lit(1), F.length(text) - len(suffix))).otherwise(text)


def decoded(name: Column) -> Column:
    """A file's name as Spark reports it, with its escapes undone."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def stem(name: Column) -> Column:
    """A file's name without its last suffix."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def letters_digits(text: Column) -> Column:
    """ASCII letters and digits only, upper case."""
    return F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))


def slug(text: Column) -> Column:
    """Letters and digits of any script, runs of anything else as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


def squashed(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def one_spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def count_of(text: Column, mark: str) -> Column:
    """How many parts ``mark`` cuts a text into."""
    return F.size(F.split(text, re.escape(mark), -1))


def fixed(value: Column, digits: int) -> Column:
    """A number as text with so many decimals; NULL stays NULL."""
    return F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.format_string(f"%.{digits}f", value.cast("double")))


def contains_any(text: Column, parts: Sequence[str]) -> Column:
    """Whether any of the literal ``parts`` is in the text; NULL has none. A chain of compiled tests."""
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(text, F.lit(part))
    return F.coalesce(out, F.lit(False))


def blank(text: Column) -> Column:
    """NULL or white space only."""
    return F.coalesce(F.trim(text) == "", F.lit(True))


def first_filled(*texts: Column) -> Column:
    """The first that isn't blank; else the empty text."""
    return F.coalesce(*(F.when(~blank(t), t) for t in texts), F.lit(""))


def found(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """All matches with their offsets: array of (start, end, match) in characters."""
    flags = re.I if ignore_case else 0

    @F.pandas_udf("array<struct<start: int, end: int, match: string>>")
    def run(texts: pd.Series) -> pd.Series:
        search = re.compile(pattern, flags).finditer
        return texts.map(lambda t: [{"start": m.start(), "end": m.end(), "match": m.group()} for m in search(t)], na_action="ignore")

    return run(text)
