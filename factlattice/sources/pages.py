"""Web pages as sources: tables by their header, links, and parameters of addresses."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a header row: at least so many, none longer than that (layout tables are otherwise).
LEAST_CELLS, LONGEST_CELL, HEADER_ROWS = 5, 80, 4


class _Tables(HTMLParser):
    """The rows of each table of a page: cells as (text, first link), a nested table's cells also in its own."""

    def __init__(self) -> None:
        super().__init__()
        self.tables: list[list[list[tuple[str, str | None]]]] = []
        self.open: list[int] = []
        self.cells: list[list] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif tag == "tr" and self.open:
            self._close(len(self.open))
            self.tables[self.open[-1]].append([])
        elif tag in ("td", "th") and self.open:
            self._close(len(self.open))
            if not self.tables[self.open[-1]]:
                self.tables[self.open[-1]].append([])
            self.cells.append([len(self.open), [], None])
        elif tag == "a":
            link = dict(attrs).get("href")
            for cell in self.cells:
                cell[2] = cell[2] or link

    def _close(self, depth: int) -> None:
        while self.cells and self.cells[-1][0] >= depth:
            level, parts, link = self.cells.pop()
            self.tables[self.open[level - 1]][-1].append(("".join(parts).strip(), link))

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table") and self.open:
            self._close(len(self.open))
            if tag == "table":
                self.open.pop()

    def handle_data(self, data):
        for cell in self.cells:
            cell[1].append(data.strip())


def rows_of(page: str, required: Sequence[str], links: Sequence[str] = (), many: bool = False) -> list[dict[str, str | None]]:
    """The rows below the first header that names all ``required`` texts, as dictionaries by header text; with a
    column "<name> link" for each of ``links``. ``many``: of every such table of the page."""
    parser = _Tables()
    parser.feed(page)
    parser.close()
    parser._close(1)
    out: list[dict[str, str | None]] = []
    for table in parser.tables:
        for i, row in enumerate(table[:HEADER_ROWS]):
            header = [text for text, _ in row]
            if len(header) < LEAST_CELLS or any(len(h) > LONGEST_CELL for h in header) or not all(any(r in h for h in header) for r in required):
                continue
            for cells in table[i + 1 :]:
                named = {h: text for h, (text, _) in zip(header, cells)}
                named |= {f"{h} link": link for h, (_, link) in zip(header, cells) if h in links}
                out.append(named)
            if not many:
                return out
            break
    return out


def tables(pages: DataFrame, key: str, html: str, required: Sequence[str], columns: Sequence[str], links: Sequence[str] = ()) -> DataFrame:
    """key and the named columns, one row per table row of each page; a cell that isn't there is empty."""
    names = [*columns, *(f"{c} link" for c in links)]

    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [[r.get(n) if n.endswith(" link") else r.get(n) or "" for n in names] for r in rows_of(t or "", required, links)])

    rows = pages.select(key, F.explode(run(html)).alias("r"))
    return rows.select(key, *(F.col("r")[i].alias(n) for i, n in enumerate(names)))


def mended(link: Column) -> Column:
    """A link in which &reg, read as a sign, is put back."""
    return F.replace(link, F.lit("®MeasID"), F.lit("&regMeasID"))


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, href, text of every anchor, entities of the address decoded and mended."""
    pattern = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a>", re.I | re.S)

    @F.pandas_udf("array<struct<href: string, text: string>>")
    def run(texts: pd.Series) -> pd.Series:
        from html import unescape

        one = lambda m: {"href": unescape(m[1] or m[2] or m[3] or ""), "text": " ".join(unescape(re.sub(r"<[^>]*>", "", m[4])).split())}
        return texts.map(lambda t: [one(m) for m in pattern.finditer(t or "")])

    return pages.select(key, F.explode(run(html)).alias("a")).select(key, mended(F.col("a.href")).alias("href"), F.col("a.text").alias("text"))


def parameter(url: Column, name: str) -> Column:
    """A parameter of an address; NULL if it has none."""
    return F.try_parse_url(url, F.lit("QUERY"), F.lit(name))


def without_parameter(url: Column, name: str, add: dict[str, str] | None = None) -> Column:
    """An address without a parameter (whatever its case), with others added."""

    @F.pandas_udf("string")
    def run(urls: pd.Series) -> pd.Series:
        def one(u: str) -> str:
            parts = urlsplit(u)
            kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k.lower() != name.lower()]
            return urlunsplit(parts._replace(query=urlencode([*kept, *(add or {}).items()])))

        return urls.map(one, na_action="ignore")

    return run(url)


def first_link(found: DataFrame, key: str, has: Sequence[str], rather_without: Sequence[str] = ()) -> DataFrame:
    """key, href: each page's first link that has all of some parts, rather one without others."""
    wanted = found.withColumn("__at", F.monotonically_increasing_id())
    for part in has:
        wanted = wanted.filter(F.contains("href", F.lit(part)))
    worse = F.lit(False)
    for part in rather_without:
        worse = worse | F.contains(F.lower("href"), F.lit(part))
    return wanted.groupBy(key).agg(F.min_by("href", F.struct(worse, F.col("__at"))).alias("href"))


def form_values(page: str, choices: dict[str, str]) -> dict[str, str]:
    """What a search form posts: its hidden inputs, and for each dropdown the value of the option with that
    text or value. A choice the form doesn't offer is an error."""
    attrs = lambda tag: {k.lower(): a or b for k, a, b in re.findall(r"([\w-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", tag)}
    inputs = [attrs(t) for t in re.findall(r"<input\b[^>]*>", page, re.I)]
    out = {a["name"]: a.get("value", "") for a in inputs if a.get("type", "").lower() == "hidden" and a.get("name")}
    for name, wanted in choices.items():
        select = next((body for tag, body in re.findall(r"(<select\b[^>]*>)(.*?)</select>", page, re.I | re.S) if attrs(tag).get("name") == name), None)
        if select is None:
            raise ValueError(f"the form has no dropdown {name!r}")
        options = [(attrs(tag).get("value", text.strip()), text.strip()) for tag, text in re.findall(r"(<option\b[^>]*>)([^<]*)", select, re.I)]
        found = next((value for value, text in options if wanted in (value, text)), None)
        if found is None:
            raise ValueError(f"dropdown {name!r} has no {wanted!r}; it offers {[t for _, t in options]}")
        out[name] = found
    return out
