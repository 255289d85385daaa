"""Processes named in documents: a taxonomy's terms searched in the description and the planned changes.

One Arrow pass normalises each text (NFKC, no characters of no width, single spaces) and finds all terms at
once with an automaton, whatever their number; everything after is joins and windows on the few hits.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factlattice.functions import text as tx

from . import priority
from .relational import saved, small

#: What stands between a document's description and its planned changes (a fixed value).
SEPARATOR = "\n\n===PLANNED CHANGES===\n\n"

#: Unicode's white space, and the deletion of characters of no width.
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_DELETED = {ord(c): None for c in tx.ZERO_WIDTH}


class Terms:
    """Finds the leaves that a text names: ``alt_names`` as parts of the lower-cased text; cased names that
    are upper-case letters and digits as whole tokens, also with a plural s; other cased names as parts."""

    def __init__(self, leaves: list[tuple[str, list[str], list[str]]]):
        import ahocorasick

        parts: dict[str, set[str]] = {}
        self.cased: dict[str, set[str]] = {}
        self.tokens: dict[str, set[str]] = {}
        self.always: set[str] = set()  # an empty term is part of every text
        for leaf, names, cased in leaves:
            for name in names:
                (parts.setdefault(name.lower(), set()) if name else self.always).add(leaf)
            for name in map(str.strip, cased):
                if name.isalnum() and name.isupper():
                    for form in (name, name + "s"):
                        self.tokens.setdefault(form, set()).add(leaf)
                else:
                    (self.cased.setdefault(name, set()) if name else self.always).add(leaf)
        self.automaton = ahocorasick.Automaton()
        for name, of in parts.items():
            self.automaton.add_word(name, of)
        self.any = bool(parts)
        if self.any:
            self.automaton.make_automaton()

    def of(self, text: str) -> set[str]:
        out = set(self.always)
        if self.any:
            for _, leaves in self.automaton.iter(text.lower()):
                out |= leaves
        if self.tokens:
            for token in set("".join(c if c.isascii() and c.isalnum() else " " for c in text).split()) & self.tokens.keys():
                out |= self.tokens[token]
        for name, leaves in self.cased.items():
            if name in text:
                out |= leaves
        return out


def search(text: Column, taxonomy: DataFrame) -> Column:
    """The leaves that a normalised text names, sorted; NULL counts as empty."""
    terms = [tuple(r) for r in taxonomy.select("leaf", "alt_names", "cased_names").collect()]  # bounded: a taxonomy

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Terms(terms)
        for texts in batches:
            yield texts.map(lambda t: sorted(own.of(t or "")))

    return run(text)


def parts_of(text: Column, mark: str = SEPARATOR) -> tuple[Column, Column]:
    """A document's description and its planned changes, normalised with their case kept."""
    return tx.normalised(tx.before(text, mark)), tx.normalised(tx.after(text, mark))


def _plain(text: str) -> str:
    """``tx.normalised`` for one text at hand."""
    return _SPACES.sub(" ", unicodedata.normalize("NFKC", text).translate(_DELETED)).strip(" ")


def named(docs: DataFrame, key: str, taxonomy: DataFrame, mark: str = SEPARATOR) -> DataFrame:
    """key, process, status: PRESENT in the description, FUTURE in the changes, PRESENT_AND_FUTURE in both.
    Documents without a description give nothing. One pass: a text is split, normalised and searched where it is."""
    terms = [tuple(r) for r in taxonomy.select("leaf", "alt_names", "cased_names").collect()]  # bounded: a taxonomy

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Terms(terms)
        for batch in batches:
            keys, processes, statuses = [], [], []
            for k, text in zip(batch[key], batch.text):
                description, _, changes = text.partition(mark)
                description = _plain(description)
                if not description:
                    continue
                now, then = own.of(description), own.of(_plain(changes))
                for process in now | then:
                    keys.append(k)
                    processes.append(process)
                    statuses.append("FUTURE" if process not in now else "PRESENT_AND_FUTURE" if process in then else "PRESENT")
            yield pd.DataFrame({key: pd.Series(keys, dtype=batch[key].dtype), "process": pd.Series(processes, dtype=object), "status": pd.Series(statuses, dtype=object)})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").filter(F.col("text").isNotNull()).mapInPandas(run, f"`{key}` {kind}, process string, status string")


def table(docs: DataFrame, key: str, taxonomy: DataFrame, mark: str = SEPARATOR) -> DataFrame:
    """``named``, siblings pruned by priority and empty secondary categories filled. The hits are written once;
    pruning and filling read them several times."""
    known = taxonomy.select(F.col("leaf").alias("process"), F.col("grp").alias("__grp"), F.col("priority").alias("__pr"))
    rows = saved(named(docs, key, taxonomy, mark)).join(small(known), "process")
    rows = priority.prune(rows, [key], F.col("__grp"), F.col("__pr")).select(key, "process", "status")
    return priority.backfill(rows, [key], taxonomy)


def queries_for(docs: DataFrame, key: str, taxonomy: DataFrame, most: int = 8, opening: int = 1_500, catch_all: int = 1_000, suffix: str = " wastewater treatment") -> DataFrame:
    """key, place, query: up to ``most`` processes that a document names, in the taxonomy's order and
    without catch-alls, each with ``suffix``; then the description's opening on one line."""
    cut = docs.select(key, tx.one_spaced(tx.before(F.col("text"), SEPARATOR)).alias("d"))
    leaf = small(taxonomy.filter(F.col("priority") != catch_all).select(F.col("leaf").alias("process"), "place"))
    hits = cut.select(key, F.explode(search(F.col("d"), taxonomy)).alias("process")).join(leaf, "process")
    first = hits.groupBy(key).agg(F.slice(F.sort_array(F.collect_list(F.struct("place", "process"))), 1, most).alias("p"))
    asked = first.select(key, F.posexplode("p").alias("place", "p")).select(key, "place", F.concat(F.col("p.process"), F.lit(suffix)).alias("query"))
    return asked.unionByName(cut.select(key, F.lit(most).alias("place"), F.substring("d", 1, opening).alias("query")))
