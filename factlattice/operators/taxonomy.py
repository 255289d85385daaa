"""A taxonomy of processes as a table: nested JSON (category, groups, leaves) flattened to one row per leaf.

A leaf is an object with ``alt_names``; its group is the key right above it (none directly under the
category), its category the key at the top. A taxonomy is configuration of bounded size: it is read on
the driver, and ``MOST`` leaves are the bound up to which its table may be broadcast.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leaves that a taxonomy may have.
MOST = 20_000
SCHEMA = (
    "place int, leaf string, grp string, category string, priority int, global_priority int, secondary array<string>, alt_names array<string>,"
    " cased_names array<string>, survey_names array<string>, codes array<string>, clauses array<array<string>>, excluded_by array<string>, multi string"
)


def leaves(tree: dict, group: str | None = None, without: Sequence[str] = ()) -> Iterator[tuple[str, dict, str | None]]:
    """(name, details, group) of all leaves in order; keys in ``without`` are left out with all below."""
    for name, inner in tree.items():
        if name in without:
            continue
        if "alt_names" in inner:
            yield name, inner, group
        else:
            yield from leaves(inner, name, without)


def rows(tree: dict, without: Sequence[str] = ()) -> list[tuple]:
    out, seen = [], set()
    for category, inner in tree.items():
        for name, details, group in leaves({category: inner}, without=without):
            if name in seen:
                raise ValueError(f"leaf {name!r} stands in the taxonomy twice")
            seen.add(name)
            clauses = details.get("ontology_triggers") or []
            clauses = [clauses] if clauses and isinstance(clauses[0], str) else clauses
            multi = details.get("ontology_triggers_multi") or []
            names = [details.get(k) or [] for k in ("alt_names", "alt_names_case_sensitive", "cwns_processes", "werf_codes")]
            out.append(
                (len(out), name, group, category, details.get("priority", 1), details.get("global_priority", 1), details.get("secondary_category") or [], *names, clauses,
                 details.get("exclude_if_any") or [], json.dumps(multi if isinstance(multi, list) else [multi]))
            )
    if len(out) > MOST:
        raise ValueError(f"{len(out)} leaves; a taxonomy may have {MOST}")
    return out


def read(spark: SparkSession, path: str) -> dict:
    """The JSON of a taxonomy (or of another configuration) at a path that Spark reads."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def table(spark: SparkSession, tree: dict, without: Sequence[str] = ()) -> DataFrame:
    """place (order), leaf, grp, category, priorities, names, rules: one row per leaf."""
    return spark.createDataFrame(rows(tree, without), SCHEMA)


def scored(taxonomy: DataFrame, units_only: bool = False) -> DataFrame:
    """The leaves that are scored; ``units_only`` leaves the unspecified ones out."""
    return taxonomy.filter(~F.startswith(F.lower("leaf"), F.lit("unspecified"))) if units_only else taxonomy


def named_leaves(taxonomy: DataFrame) -> DataFrame:
    """name (a survey's process name, lower case, trimmed), leaf: a name may stand for several leaves."""
    return taxonomy.select(F.explode("survey_names").alias("name"), "leaf").select(F.lower(F.trim("name")).alias("name"), "leaf").distinct()


def codes_of(codes: DataFrame, name: str) -> DataFrame:
    """The distinct codes of one process name in a table name, code."""
    return codes.filter(F.col("name") == name).select("code").distinct()


def leaf_codes(taxonomy: DataFrame, looked_up: DataFrame | None = None) -> DataFrame:
    """leaf, codes (sorted): the curated ones, or those that ``looked_up`` (name, code) has for the leaf's
    survey names, curated ones only where it has none."""
    curated = taxonomy.select("leaf", F.sort_array(F.array_distinct("codes")).alias("codes"))
    if looked_up is None:
        return curated
    by_name = looked_up.filter("code IS NOT NULL").select(F.lower(F.trim("name")).alias("name"), "code")
    found = named_leaves(taxonomy).join(by_name, "name").groupBy("leaf").agg(F.sort_array(F.collect_set("code")).alias("found"))
    return curated.join(found, "leaf", "left").select("leaf", F.coalesce("found", "codes").alias("codes"))
