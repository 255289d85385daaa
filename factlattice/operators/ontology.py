"""Ontologies as tables of triples: a reader for Turtle, classes, what classes do, and lines of text.

A module is a file of bounded size that the driver parses; from there on everything is a table (s, p, o).
Names are kept as prefixed names (watr:Tank); ``local`` is the part after the colon.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.functions import text as tx

from . import relational as rel

_TOKEN = re.compile(
    r'#[^\n]*|"""(?P<long>(?:[^"\\]|\\.|"(?!""))*)"""|"(?P<short>(?:[^"\\\n]|\\.)*)"|(?P<iri><[^>]*>)|(?P<mark>\^\^|[;,.\[\]()](?=\s|$|[\[\]();,.])|[\[\]();,])|@(?P<at>[A-Za-z][\w-]*)|(?P<name>[^\s;,\[\]()"<>]+)',
    re.S,
)


def triples_of(text: str, edits: Sequence[tuple[str, str]] = ()) -> Iterator[tuple[str, str, str]]:
    """(s, p, o) of a Turtle text, after literal replacements. Blank nodes get numbers; ``a`` is rdf:type;
    texts are their plain value; full names whose prefix is declared are written with it."""
    for old, new in edits:
        text = text.replace(old, new)
    prefixes: dict[str, str] = {}
    tokens = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup == "long" or m.lastgroup == "short":
            value = re.sub(r"\\(.)", lambda e: {"n": "\n", "t": "\t", "r": "\r"}.get(e.group(1), e.group(1)), m.group(m.lastgroup))
            tokens.append(("text", value))
        elif m.lastgroup:
            value = m.group(m.lastgroup)
            if m.lastgroup == "name" and len(value) > 1 and value.endswith("."):
                tokens += [("name", value[:-1]), ("mark", ".")]
            else:
                tokens.append((m.lastgroup, value))
    at, blank = 0, 0
    out: list[tuple[str, str, str]] = []

    def term() -> str:
        nonlocal at, blank
        kind, value = tokens[at]
        at += 1
        if kind == "mark" and value == "[":
            blank += 1
            own = f"_:b{blank}"
            if tokens[at] != ("mark", "]"):
                properties(own)
            at += 1
            return own
        if kind == "mark" and value == "(":
            items = []
            while tokens[at] != ("mark", ")"):
                items.append(term())
            at += 1
            blank += 1
            own = f"_:b{blank}"
            out.extend((own, "rdf:member", i) for i in items)
            return own
        if kind == "text":
            if at < len(tokens) and tokens[at][0] == "at":
                at += 1
            elif at < len(tokens) and tokens[at] == ("mark", "^^"):
                at += 2
            return value
        if kind == "iri":
            full = value[1:-1]
            for prefix, start in prefixes.items():
                if start and full.startswith(start):
                    return f"{prefix}:{full[len(start):]}"
            return full
        return "rdf:type" if value == "a" else value

    def properties(subject: str) -> None:
        nonlocal at
        while True:
            predicate = term()
            while True:
                out.append((subject, predicate, term()))
                if at < len(tokens) and tokens[at] == ("mark", ","):
                    at += 1
                    continue
                break
            while at < len(tokens) and tokens[at] == ("mark", ";"):
                at += 1
            if at >= len(tokens) or tokens[at] in (("mark", "."), ("mark", "]")):
                return

    while at < len(tokens):
        kind, value = tokens[at]
        if (kind == "at" and value in ("prefix", "base")) or (kind == "name" and value.upper() in ("PREFIX", "BASE")):
            if value.lower() == "prefix":
                prefixes[tokens[at + 1][1].rstrip(":")] = tokens[at + 2][1][1:-1]
                at += 3
            else:
                at += 2
        elif (kind, value) != ("mark", "."):
            properties(term())
        at += tokens[at : at + 1] == [("mark", ".")]
    return iter(out)


def read(spark: SparkSession, paths: dict[str, str], edits: dict[str, Sequence[tuple[str, str]]] | None = None) -> DataFrame:
    """module, s, p, o of Turtle files by module, each after its edits. Blank nodes are a module's own."""
    rows = []
    for module, path in paths.items():
        (text,) = spark.read.text(path, wholetext=True).first()
        own = lambda x, m=module: f"_:{m}-{x[2:]}" if x.startswith("_:") else x
        rows += [(module, own(s), p, own(o)) for s, p, o in triples_of(text, (edits or {}).get(module, ()))]
    return spark.createDataFrame(rows, "module string, s string, p string, o string")


def local(name: Column) -> Column:
    """The part of a name after its prefix."""
    return F.regexp_extract(name, r"([^:#/]*)$", 1)


def classes(triples: DataFrame, kind: str) -> DataFrame:
    """module, s of everything of a class."""
    return triples.filter((F.col("p") == "rdf:type") & (F.col("o") == kind)).select("module", "s").distinct()


def parents(triples: DataFrame) -> DataFrame:
    """child, parent: local names of subclass edges, an edge to itself left out."""
    edges = triples.filter("p = 'rdfs:subClassOf'").select(local(F.col("s")).alias("child"), local(F.col("o")).alias("parent"))
    return edges.filter("child <> parent").distinct()


def closure(triples: DataFrame) -> DataFrame:
    """node, ancestor over all classes, each its own ancestor too."""
    return rel.ancestors(parents(triples), "child", "parent")


def does(triples: DataFrame, prefix: str = "watr") -> DataFrame:
    """equipment, process: what a class's own shapes say it does, by a value or by the class of a shape."""
    of = lambda p: triples.filter(F.col("p") == p)
    shapes = of("sh:property").select(F.col("s").alias("cls"), F.col("o").alias("shape"))
    shapes = shapes.join(of("sh:path").filter(F.col("o") == f"{prefix}:hasProcess").select(F.col("s").alias("shape")), "shape", "left_semi")
    values = of("sh:hasValue").select(F.col("s").alias("shape"), F.col("o").alias("process"))
    inner = of("sh:qualifiedValueShape").select(F.col("s").alias("shape"), F.col("o").alias("q")).join(of("sh:class").select(F.col("s").alias("q"), F.col("o").alias("process")), "q").select("shape", "process")
    return shapes.join(values.unionByName(inner), "shape").select(local(F.col("cls")).alias("equipment"), local(F.col("process")).alias("process")).distinct()


def lines(triples: DataFrame, kind: str, label: str, ignored: Sequence[str] = (), definitions: bool = True, doing: DataFrame | None = None, skip: Sequence[str] = (), skip_parents: Sequence[str] = (), foreign: Sequence[str] = ()) -> DataFrame:
    """name, line: "name | definition | <label>: parents | Process: what it does" per class of a kind. Classes in
    ``skip``, or with a parent that ends in one of ``skip_parents``, are left out, parents in ``ignored`` or
    with a prefix in ``foreign`` aren't named. Process- and Role- go from names."""
    own = lambda c: F.regexp_replace(local(c), "^(Process-)?(Role-)?", "")
    cls = classes(triples, kind).filter(~local(F.col("s")).isin(*skip) if skip else F.lit(True)).select("s").distinct()
    up = triples.filter("p = 'rdfs:subClassOf'").select("s", "o").distinct()
    if skip_parents:
        ends = F.lit(False)
        for end in skip_parents:
            ends = ends | F.endswith(local(F.col("o")), F.lit(end))
        cls = cls.join(up.filter(ends).select("s"), "s", "left_anti")
    for prefix in foreign:
        up = up.filter(~F.startswith("o", F.lit(prefix + ":")))
    above = up.filter(~local(F.col("o")).isin(*ignored) if ignored else F.lit(True)).groupBy("s").agg(F.array_join(F.sort_array(F.collect_set(own(F.col("o")))), ", ").alias("parents"))
    said = triples.filter("p = 'rdfs:comment'").groupBy("s").agg(F.min("o").alias("definition"))
    out = cls.join(above, "s", "left").join(said, "s", "left")
    parts = [own(F.col("s")), F.col("definition") if definitions else F.lit(None).cast("string"), F.concat(F.lit(label + ": "), F.col("parents"))]
    if doing is not None:
        listed = doing.groupBy("equipment").agg(F.array_join(F.sort_array(F.collect_set("process")), ", ").alias("done"))
        out = out.join(listed, local(F.col("s")) == F.col("equipment"), "left")
        parts.append(F.concat(F.lit("Process: "), F.col("done")))
    return out.select(local(F.col("s")).alias("name"), F.concat_ws(" | ", *parts).alias("line"))


def prompt_text(sections: dict[str, DataFrame]) -> str:
    """The lines of each section under its header, sorted by name (a prompt: bounded)."""
    body = lambda df: "".join(r.line + "\n" for r in df.orderBy("name").collect())
    return "\n########################\n".join(f"{name}:\n{body(df)}" for name, df in sections.items())


def item_triples(items: DataFrame, known: DataFrame, metadata: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Triples (place_id, s, p, o) of facilities, documents and items, and the terms (field, name) that
    aren't ``known`` (name) with their counts, which are left out.

    ``items``: place_id, document, doc (its number), item (its number) and the fields of ``records``; other columns
    named in ``metadata`` (column -> predicate) are the facility's. An item of which nothing is known is left out."""
    facility, doc = F.concat(F.lit("ex:facility-"), F.col("place_id")), F.concat_ws("-", F.lit("ex:document"), F.col("place_id"), F.col("doc").cast("string"))
    item = F.concat_ws("-", F.lit("ex:item"), F.col("place_id"), F.col("doc").cast("string"), F.col("item").cast("string"))
    named = None
    for field, predicate, prefix in (("Process", "watr:hasProcess", "Process-"), ("Role", "s223:hasRole", "Role-"), ("Substance", "s223:hasMedium", ""), ("Equipment", "rdf:type", "")):
        term = F.concat(F.lit(prefix), tx.without_prefix(F.col("name"), prefix)) if prefix else F.col("name")
        part = items.select("place_id", "doc", "item", F.explode(field).alias("name")).select("place_id", "doc", "item", F.lit(field).alias("field"), F.lit(predicate).alias("p"), "name", term.alias("term"))
        named = part if named is None else named.unionByName(part)
    marked = named.join(rel.small(known.select(F.col("name").alias("term"), F.lit(True).alias("known")).distinct()), "term", "left")
    dropped = marked.filter("known IS NULL").groupBy("field", "name").agg(F.count(F.lit(1)).alias("n"))
    links = marked.filter("known").select("place_id", "doc", "item", "p", F.concat(F.lit("watr:"), F.col("term")).alias("o"))
    shown = items.join(links.select("place_id", "doc", "item").distinct(), ["place_id", "doc", "item"], "left_semi")
    typed = links.filter("p = 'rdf:type'").select("place_id", "doc", "item").distinct()
    plain = shown.join(typed, ["place_id", "doc", "item"], "left_anti").select("place_id", item.alias("s"), F.lit("rdf:type").alias("p"), F.lit("watr:UnitProcess").alias("o"))
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"'))
    triple = lambda df, s, p, o: df.select("place_id", s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    out = links.select("place_id", item.alias("s"), "p", "o").unionByName(plain)
    out = out.unionByName(triple(shown, doc, "ex:hasItem", item))
    for column, predicate in (("Implementation", "ex:implementation"), ("Location", "ex:location")):
        out = out.unionByName(triple(shown.filter(F.col(column).isNotNull()), item, predicate, quoted(F.col(column))))
    documents = items.select("place_id", "doc", "document").distinct()
    out = out.unionByName(triple(documents, facility, "ex:hasDocument", doc)).unionByName(triple(documents, doc, "rdf:type", F.lit("ex:Document"))).unionByName(triple(documents, doc, "ex:file", quoted(F.col("document"))))
    places = items.select("place_id", *metadata).distinct()
    out = out.unionByName(triple(places, facility, "rdf:type", F.lit("ex:Facility")))
    for column, predicate in metadata.items():
        out = out.unionByName(triple(places.filter(~tx.blank(F.col(column))), facility, predicate, quoted(F.col(column))))
    return out.distinct(), dropped
