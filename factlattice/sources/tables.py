"""Tables from files: CSV with an explicit list of missing-value tokens, typed columns, lines that don't
fit kept apart, tab-separated text, spreadsheets, and one-file text documents."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factlattice.functions import text as tx
from factlattice.operators import keywords

#: Spellings of a missing value in a CSV cell (fixed values).
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(spark: SparkSession, path: str, na: Sequence[str] = NA_TOKENS, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    """A CSV with a header, every column a string (leading zeros stay). Cells spelled as in ``na`` are
    NULL; with an empty ``na`` the text NA survives and a blank cell is the empty text."""
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, quote='"', escape='"', multiLine=True)
    return _cells(raw, raw.columns, na)


def _cells(raw: DataFrame, columns: Sequence[str], na: Sequence[str]) -> DataFrame:
    cells = {c: F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in columns}
    return raw.select(*(F.when(~v.isin(*na), v).alias(c) if na else v.alias(c) for c, v in cells.items()))


def read_typed(spark: SparkSession, path: str, types: dict[str, str], na: Sequence[str] = NA_TOKENS, **options) -> DataFrame:
    """``read_csv`` with some columns of another type (name -> type); all others stay strings. A cell that
    isn't of its type is an error."""
    raw = read_csv(spark, path, na, **options)
    return raw.select(*(F.col(f"`{c}`").cast(types[c]).alias(c) if c in types else F.col(f"`{c}`") for c in raw.columns))


def read_lenient(spark: SparkSession, path: str, na: Sequence[str] = NA_TOKENS, sep: str = ",", encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines): lines with more cells than the header are kept apart as text, shorter ones are filled."""
    header = spark.read.csv(path, header=True, sep=sep, encoding=encoding, quote='"', escape='"').columns
    # cells beyond the header land in a column of their own; the line as it came is kept beside them
    kind = T.StructType([T.StructField(c, T.StringType()) for c in [*header, "__more", "__line"]])
    raw = spark.read.csv(path, schema=kind, header=True, sep=sep, encoding=encoding, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="__line")
    over = F.col("__more").isNotNull()
    return _cells(raw.filter(~over), header, na), raw.filter(over).select(F.coalesce("__line", F.concat_ws(sep, *(F.col(f"`{c}`") for c in [*header, "__more"]))).alias("line"))


def read_tsv(spark: SparkSession, body: bytes, landing: str, encoding: str = "ISO-8859-1") -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of tab-separated text fetched into memory: it is landed at a path that all machines
    see, then read as a file."""
    spark.createDataFrame([(line,) for line in body.decode(encoding).splitlines()], "value string").coalesce(1).write.mode("overwrite").text(landing)
    return read_lenient(spark, landing, sep="\t", encoding="UTF-8")


def indexed(table: DataFrame, key: str) -> DataFrame:
    """A table known by one of its columns: that column first, named key; rows without it are left out."""
    return table.filter(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), *(F.col(f"`{c}`") for c in table.columns if c != key))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: stem (the file's name without its last suffix), text."""
    files = spark.read.text(path, wholetext=True)
    return files.select(tx.stem(tx.decoded(F.col("_metadata.file_name"))).alias("stem"), F.col("value").alias("text"))


def read_documents(spark: SparkSession, path: str, jobs: DataFrame, document: str = "document") -> tuple[DataFrame, DataFrame]:
    """(documents, jobs without a file): the text of each job's file, cut into description and changes. Jobs with
    a blank name aren't jobs."""
    wanted = jobs.filter(~tx.blank(F.col(document))).withColumn("stem", tx.stem(F.trim(document)))
    files = read_texts(spark, path)
    found = wanted.join(files, "stem").withColumn("description", tx.before(F.col("text"), keywords.SEPARATOR)).withColumn("changes", tx.after(F.col("text"), keywords.SEPARATOR))
    return found, wanted.join(files.select("stem"), "stem", "left_anti").select(*jobs.columns)


_SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def sheet_rows(workbook: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of a sheet of an .xlsx workbook (the first unless named) as texts, row by row."""
    with zipfile.ZipFile(io.BytesIO(workbook)) as z:
        names = set(z.namelist())
        tree = lambda name: ElementTree.fromstring(z.read(name))
        shared = ["".join(t.text or "" for t in si.iter(_SHEET + "t")) for si in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target") for r in tree("xl/_rels/workbook.xml.rels")}
        sheets = {s.get("name"): targets[s.get(_REL)] for s in tree("xl/workbook.xml").iter(_SHEET + "sheet")}
        if sheet is not None and sheet not in sheets:
            raise ValueError(f"no sheet {sheet!r}; there are {sorted(sheets)}")
        target = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
        out = []
        for row in tree("xl/" + target.lstrip("/").removeprefix("xl/")).iter(_SHEET + "row"):
            cells: dict[int, str | None] = {}
            for i, c in enumerate(row.iter(_SHEET + "c")):
                letters = "".join(x for x in c.get("r", "") if x.isalpha())
                at = 0
                for x in letters:
                    at = at * 26 + ord(x) - 64
                value = c.find(_SHEET + "v")
                text = None if value is None else value.text
                if c.get("t") == "s" and text is not None:
                    text = shared[int(text)]
                elif c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(_SHEET + "t"))
                cells[at - 1 if letters else i] = text
            out.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
        return out


def read_excel(spark: SparkSession, path: str, sheet: str | None = None, types: dict[str, str] | None = None) -> DataFrame:
    """The workbooks at a path, one after the other: the first row of a sheet names its columns, all are
    strings but for ``types``. Workbooks are read where they lie, by tasks; a file is one task."""
    files = spark.read.format("binaryFile").load(path).select("content")
    header = sheet_rows(files.first().content, sheet)[0]
    width = len(header)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column("content").to_pylist():
                rows = [[*r, *[None] * width][:width] for r in sheet_rows(content, sheet)[1:]]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(width)], names=header)

    out = files.mapInArrow(run, T.StructType([T.StructField(h, T.StringType()) for h in header]))
    return out.select(*(F.col(f"`{h}`").cast((types or {}).get(h, "string")).alias(h) for h in header))
