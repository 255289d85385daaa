"""Extraction records: JSON documents of items, checked against a schema, coerced to one shape, and read
into columns.

A document should be {"items": [item, ...]}. What weaker writers make of it is mended: a bare list, a list
or an object under another name, a single item without a list, empty lists for NULL, a list for a single
value. What can't be mended is a failure with its reason, kept in its own column.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.functions import text as tx

LISTS, SINGLES = ("Process", "Role", "Substance"), ("Equipment", "Implementation", "Location")
FIELDS = {*LISTS, *SINGLES, "Sentence"}
#: Names under which items are also found (fixed values).
WRAPPERS = ("output", "result", "results", "data", "extractions")
ITEM = "struct<Equipment: array<string>, Process: array<string>, Role: array<string>, Substance: array<string>, Implementation: string, Location: string, Sentence: string>"


def schema(lists_only: bool = False, web: bool = False) -> dict:
    """The JSON schema of a document: of processes by name alone, or with equipment, roles and substances."""
    texts = {"type": "array", "items": {"type": "string"}}
    maybe = lambda kind: {"anyOf": [{"type": "null"}, kind]}
    if lists_only:
        fields, more = {"Process": {**texts, "minItems": 1}}, {}
    else:
        fields = {"Equipment": {"type": ["string", "null"]}, "Process": maybe({**texts, "minItems": 1}), "Role": maybe(texts), "Substance": maybe(texts)}
        nothing = {name: {"type": "null"} for name in ("Equipment", "Process")}
        more = {"not": {"properties": nothing, "required": list(nothing)}}
    fields["Implementation"] = {"type": "string", "enum": ["present", "future", "past"]}
    fields["Location"] = {"type": ["string", "null"], "enum": ["on-site", "off-site", None]}
    fields["Sentence"] = {"type": "string"}
    required = list(fields)
    if web:
        fields["Source"] = {"type": "string", "enum": ["permit_text", "web_search", "both"]}
        fields["Website"] = {"type": ["string", "null"]}
        required.append("Source")
    item = {"type": "object", "properties": fields, "required": required, "additionalProperties": False, **more}
    return {"type": "object", "properties": {"items": {"type": "array", "items": item}}, "required": ["items"], "additionalProperties": False}


#: JSON Schema's names of kinds as ``schema_of_variant`` spells them.
_KINDS = {"object": ("OBJECT",), "array": ("ARRAY",), "string": ("STRING",), "null": ("VOID",), "boolean": ("BOOLEAN",), "number": ("BIGINT", "DECIMAL", "DOUBLE")}
_MAP, _LIST = "map<string, variant>", "array<variant>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def parsed(body: Column) -> Column:
    """The VARIANT of a text that is one JSON value; NULL if it isn't JSON, if more text follows, if a name occurs
    twice in an object, or if it is larger than a VARIANT may be. The parser stops after the first value, so
    the text must also stand alone in a list and in an object."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", _LIST)
    named = F.try_parse_json(F.concat(F.lit('{"v":'), body, F.lit("}")))
    return F.when((F.size(listed) == 1) & named.isNotNull(), listed[0])


def meets(value: Column, rule: dict) -> Column:
    """Whether a VARIANT meets a JSON schema, of the words that ``schema`` uses; a value that isn't there doesn't."""
    tests, kinds = [value.isNotNull()], rule.get("type", [])
    if kinds:
        tests.append(_kind(value).isin([k for name in ([kinds] if isinstance(kinds, str) else kinds) for k in _KINDS[name]]))
    if "enum" in rule:
        texts = [e for e in rule["enum"] if e is not None]
        same = (_kind(value) == "STRING") & F.try_variant_get(value, "$", "string").isin(texts)
        tests.append(same | F.is_variant_null(value) if None in rule["enum"] else same)
    if "anyOf" in rule:
        tests.append(reduce(Column.__or__, [meets(value, r) for r in rule["anyOf"]]))
    if "not" in rule:
        tests.append(~meets(value, rule["not"]))
    if "items" in rule or "minItems" in rule:
        enough = lambda items: items.isNull() | (F.size(items) >= rule.get("minItems", 0)) & F.forall(items, lambda i: meets(i, rule.get("items", {})))
        tests.append(_let(F.try_variant_get(value, "$", _LIST), enough))
    if "properties" in rule:
        tests.append(_let(F.try_variant_get(value, "$", _MAP), lambda fields: fields.isNull() | _fields_meet(fields, rule)))
    return F.coalesce(reduce(Column.__and__, tests), F.lit(False))


def _fields_meet(fields: Column, rule: dict) -> Column:
    known = rule["properties"]
    tests = [F.map_contains_key(fields, name) for name in rule.get("required", [])]
    tests += [fields[name].isNull() | meets(fields[name], own) for name, own in known.items()]
    if rule.get("additionalProperties") is False:
        tests.append(F.forall(F.map_keys(fields), lambda name: name.isin(list(known))))
    return reduce(Column.__and__, tests)


def mended(value: Column) -> Column:
    """The items of a parsed document, each a map of its fields; NULL if there is no list of objects to be found."""
    at = lambda path: F.try_variant_get(value, path, _LIST)
    wrapped = [F.coalesce(at(f"$.{name}"), at(f"$.{name}.items")) for name in WRAPPERS]
    itself = reduce(Column.__or__, [F.try_variant_get(value, f"$.{name}", "variant").isNotNull() for name in sorted(FIELDS)])
    single = F.try_variant_get(value, "$.items", "variant")
    items = F.coalesce(at("$"), at("$.items"), *wrapped, F.when(itself, F.array(value)), F.when(_kind(single) == "OBJECT", F.array(single)))
    objects = F.transform(items, lambda i: F.try_variant_get(i, "$", _MAP))
    return F.when(F.forall(objects, lambda i: i.isNotNull()), F.transform(objects, lambda i: F.transform_values(i, _field)))


def _field(name: Column, value: Column) -> Column:
    """Nothing for an empty list; the first of a list where a single value belongs."""
    nothing, first = F.parse_json(F.lit("null")), F.coalesce(F.try_variant_get(value, "$[0]", "variant"), F.parse_json(F.lit("null")))
    listed = _kind(value) == "ARRAY"
    empty = listed & F.try_variant_get(value, "$[0]", "variant").isNull()
    return F.when(name.isin(*LISTS) & empty, nothing).when(name.isin(*SINGLES) & listed, first).otherwise(value)


def as_texts(value: Column) -> Column:
    """A VARIANT that is a value, a list or nothing as trimmed texts that aren't blank; inner lists and objects as JSON."""
    each = F.coalesce(F.try_variant_get(value, "$", _LIST), F.array(value))
    texts = F.transform(each, lambda v: F.regexp_replace(F.try_variant_get(v, "$", "string"), r"(?U)^\s+|\s+$", ""))
    return F.filter(texts, lambda t: t != "")


def _shaped(item: Column) -> Column:
    several = [as_texts(item[name]).alias(name) for name in ("Equipment", *LISTS)]
    return F.struct(*several, *(F.try_variant_get(item[name], "$", "string").alias(name) for name in ("Implementation", "Location", "Sentence")))


def read(body: Column, rule: dict | None = None) -> Column:
    """struct(valid as it came, failure or NULL, raw: the mended items as JSON, items: their fields). A text of any
    kind gives a row; NULL and blank ones aren't JSON."""
    rule = schema() if rule is None else rule

    def judged(value: Column) -> Column:
        return _let(mended(value), lambda items: F.struct(meets(value, rule).alias("valid"), _failure(value, items).alias("failure"), F.to_json(items).alias("raw"), F.transform(items, _shaped).cast(f"array<{ITEM}>").alias("items")))

    return _let(parsed(body), judged)


def _failure(value: Column, items: Column) -> Column:
    shape = F.when(~_kind(value).isin("OBJECT", "ARRAY"), "not an object").when(items.isNull(), "no list of items")
    return F.when(value.isNull(), "not JSON").otherwise(shape)


def outermost(text: Column) -> Column:
    """The part from the first { to the last }; NULL if there is none."""
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def scan(spark: SparkSession, path: str, failed: str = "_FAILED") -> DataFrame:
    """One row per JSON file: document (stem before the last underscore), place_id (after it), body. Files
    of failed extractions, by the end of their stem, are left out."""
    files = spark.read.text(path, wholetext=True).select(tx.stem(tx.decoded(F.col("_metadata.file_name"))).alias("stem"), F.col("value").alias("body"))
    files = files.filter(~F.endswith(F.col("stem"), F.lit(failed)))
    return files.select("stem", F.regexp_extract("stem", "^(.*)_[^_]*$", 1).alias("document"), tx.last_part(F.col("stem"), "_").alias("place_id"), "body")


def file_key(document: Column, place: Column) -> Column:
    """The key under which a document's extraction is filed: stem and place, lower case, spaces as underscores."""
    return F.regexp_replace(F.lower(F.concat(tx.stem(document), F.lit("_"), place)), " ", "_")


def attributed(found: DataFrame, sites: DataFrame, key: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Extractions joined with the first site row (by ``place``) that files them, and those no row claims."""
    lower = F.regexp_replace(F.lower(F.col(key)), " ", "_")
    first = sites.withColumn("__key", file_key(F.col("document"), F.col("place_id"))).groupBy("__key").agg(F.min_by(F.struct(*sites.columns), "place").alias("site"))
    joined = found.withColumn("__key", lower).join(first, "__key", "left")
    return joined.filter("site IS NOT NULL").drop("__key"), joined.filter("site IS NULL").drop("__key", "site")


def pinned(found: DataFrame, labelled: DataFrame) -> DataFrame:
    """The extraction of each place's labelled document (place_id, document)."""
    wanted = labelled.select("place_id", tx.stem(F.col("document")).alias("document"))
    return found.join(wanted, ["place_id", "document"], "left_semi")


def exploded(found: DataFrame, key: str, rule: dict | None = None) -> DataFrame:
    """key, item (its place from 0) and its fields, one row per item of ``found`` (key, body)."""
    return found.select(key, F.posexplode(read(F.col("body"), rule).getField("items")).alias("item", "i")).select(key, "item", "i.*")
