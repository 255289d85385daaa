"""Writers of tables, records, snapshots, texts, triples and reports. Paths are Spark's; a writer that makes
one file per row writes from tasks, through the file system of its path."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.functions import text as tx
from factlattice.operators import relational as rel
from factlattice.operators.passages import as_text

FAILED = "FAILED"


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None, order: Sequence | None = None) -> None:
    """Overwrite a folder of CSV with a header, columns in the given order; with ``order`` rows are sorted
    across its files."""
    out = df.select(*columns) if columns else df
    (out.orderBy(*order) if order else out).write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue="")


def append_rows(df: DataFrame, path: str, seq: int) -> None:
    """Append a batch of rows to a table; ``seq`` is the batch's number, later ones win in ``compacted``."""
    df.withColumn("__seq", F.lit(seq).cast("long")).withColumn("__at", F.monotonically_increasing_id()).write.mode("append").parquet(path)


def compacted(spark: SparkSession, path: str, keys: Sequence[str], state: str) -> DataFrame:
    """One row per key (the first of ``keys`` that isn't NULL): the latest whose ``state`` isn't FAILED, else the
    latest."""
    rows = spark.read.parquet(path)
    marked = rows.withColumn("__key", F.coalesce(*keys))
    failed = F.coalesce(F.col(state).cast("string") == FAILED, F.lit(False)).cast("int")
    one = rel.best_of(marked, ["__key"], [failed, -F.col("__seq"), -F.col("__at")])
    return one.drop("__key", "__seq", "__at")


def compact(spark: SparkSession, path: str, to: str, keys: Sequence[str], state: str) -> None:
    """Write the compacted table beside the appended one; readers switch to it when it is whole."""
    compacted(spark, path, keys, state).withColumn("__seq", F.lit(0).cast("long")).withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(to)


def _each_file(df: DataFrame, name: str, body: str, folder: str) -> int:
    """Write each row's body to a file of its own; how many. Tasks write through the Hadoop file system only
    where ``folder`` is a mounted path (file://...), which all machines must see."""
    if not folder.startswith("file://"):
        raise ValueError("single files are written to a folder that all machines have mounted (file://...)")
    root = folder.removeprefix("file://")

    def run(batches):
        import os

        import pyarrow as pa

        for batch in batches:
            n = 0
            for file, text in zip(batch.column("name").to_pylist(), batch.column("body").to_pylist()):
                at = os.path.join(root, file)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                with open(f"{at}.part", "w", encoding="utf-8") as f:
                    f.write(text)
                os.replace(f"{at}.part", at)  # a task that runs again writes the same file
                n += 1
            yield pa.RecordBatch.from_pydict({"n": [n]})

    return df.select(F.col(name).alias("name"), F.col(body).alias("body")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_records(found: DataFrame, triggers: DataFrame, key: str, folder: str) -> int:
    """One JSON file per document, its items with the processes that each showed (trigger_process). ``found``: key,
    raw (the items as JSON); ``triggers``: key, item, trigger_process."""
    items = found.select(key, F.posexplode(F.from_json("raw", "array<string>")).alias("item", "body"))
    shown = F.coalesce("trigger_process", F.array().cast("array<string>"))
    joined = items.join(triggers, [key, "item"], "left")
    body = F.concat(F.regexp_replace("body", r"\}\s*$", ""), F.when(F.regexp_like("body", F.lit(r"^\{\s*\}$")), F.lit("")).otherwise(F.lit(", ")), F.lit('"trigger_process": '), F.to_json(shown), F.lit("}"))
    listed = joined.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("item", body.alias("b")))).alias("l"))
    files = listed.select(F.concat(F.col(key), F.lit(".json")).alias("name"), F.concat(F.lit('{"items": ['), F.array_join(F.transform("l", lambda x: x["b"]), ", "), F.lit("]}")).alias("body"))
    return _each_file(files, "name", "body", folder)


def write_snapshot(df: DataFrame, path: str, day: str) -> None:
    """Write a dated snapshot: only that day's partition is replaced."""
    df.withColumn("as_of", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of").parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("as_of", F.col("as_of").cast("string"))


def promote(spark: SparkSession, path: str, to: str, wanted: bool) -> bool:
    """Make the union of all snapshots the shared table, if ``wanted``; else it stays as it is."""
    from factlattice.operators.permits import snapshot_union

    if wanted:
        snapshot_union(snapshots(spark, path)).write.mode("overwrite").parquet(to)
    return wanted


def checkpoint(df: DataFrame, path: str) -> DataFrame:
    """Write an intermediate table and read it again: a run restarts from here."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_sections(found: DataFrame, document: str, folder: str) -> int:
    """One text file per document: its description, the mark, its planned changes."""
    files = found.select(F.concat(tx.stem(F.col(document)), F.lit(".txt")).alias("name"), as_text(F.col("description"), F.col("changes")).alias("body"))
    return _each_file(files, "name", "body", folder)


def triple_files(triples: DataFrame, names: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """name, body: a Turtle file per place, <place>_<name as letters and digits>.ttl. ``names``: place_id, name."""
    line = F.concat_ws(" ", F.when(F.col("p") == "rdf:type", F.concat_ws(" ", "s", F.lit("a"))).otherwise(F.concat_ws(" ", "s", "p")), "o", F.lit("."))
    head = "".join(f"@prefix {p}: <{iri}> .\n" for p, iri in prefixes.items())
    bodies = triples.groupBy("place_id").agg(F.concat(F.lit(head + "\n"), F.array_join(F.sort_array(F.collect_set(line)), "\n"), F.lit("\n")).alias("body"))
    return bodies.join(names, "place_id").select(F.concat(F.col("place_id"), F.lit("_"), tx.slug(F.col("name")), F.lit(".ttl")).alias("name"), "body")


def write_zip(files: DataFrame, path: str) -> int:
    """All files in one zip, streamed through the driver in order of their names, one at a time."""
    n = 0
    with open(path.removeprefix("file://"), "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for row in files.orderBy("name").toLocalIterator():
            z.writestr(row["name"], row["body"])
            n += 1
    return n


def write_triples(triples: DataFrame, names: DataFrame, prefixes: dict[str, str], folder: str) -> int:
    """One Turtle file per place in a folder."""
    return _each_file(triple_files(triples, names, prefixes), "name", "body", folder)


def report(template: str, counts: DataFrame, **more) -> str:
    """A template with {names} filled from a table of one row and other values."""
    rows = counts.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a report is made from one row of counts")
    return template.format(**rows[0].asDict(), **more)


def stacked(df: DataFrame, bar: str, part: str, value: str, order: Sequence[str]) -> DataFrame:
    """The table behind a stacked bar chart: each part's value and where it begins, parts in the given order."""
    from pyspark.sql import Window

    w = Window.partitionBy(bar).orderBy(rel.in_order(part, order)).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.filter(F.col(part).isin(*order)).groupBy(bar, part).agg(F.sum(value).alias(value))
    return sums.withColumn("bottom", F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def boxes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The table behind a box plot: quartiles, whiskers (1.5 times their distance, within the data), mean, n."""
    q = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")
    )
    q = q.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "n")
    far = 1.5 * (F.col("q3") - F.col("q1"))
    inside = df.join(q, list(by)).filter((F.col(value) >= F.col("q1") - far) & (F.col(value) <= F.col("q3") + far))
    return q.join(inside.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high")), list(by))


def write_figure(df: DataFrame, path: str, bar: str, part: str, value: str, order: Sequence[str]) -> bytes:
    """A stacked bar chart of ``stacked`` as SVG (bounded: bars times parts), written and returned."""
    rows = stacked(df, bar, part, value, order).orderBy(bar).collect()
    bars = sorted({r[bar] for r in rows})
    top = max((r["bottom"] + r[value] for r in rows), default=0) or 1
    out = io.StringIO()
    out.write(f'<svg xmlns="http://www.w3.org/2000/svg" width="{60 * len(bars) + 40}" height="260">\n')
    for r in rows:
        x, h, y = 30 + 60 * bars.index(r[bar]), 200 * r[value] / top, 210 - 200 * (r["bottom"] + r[value]) / top
        out.write(f'<rect x="{x}" y="{y:.2f}" width="40" height="{h:.2f}" fill="hsl({360 * list(order).index(r[part]) // max(1, len(order))},50%,60%)"><title>{r[part]}: {r[value]:g}</title></rect>\n')
    for b in bars:
        out.write(f'<text x="{50 + 60 * bars.index(b)}" y="230" font-size="10" text-anchor="middle">{b}</text>\n')
    out.write("</svg>\n")
    body = out.getvalue().encode()
    with open(path.removeprefix("file://"), "wb") as f:
        f.write(body)
    return body
