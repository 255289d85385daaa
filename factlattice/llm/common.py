"""Shared pieces of the operators: shared-folder tables, size-checked joins, word patterns."""

from __future__ import annotations

import ctypes
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the contracts, as the inside of a character class.
SPACE = r"\x20\x09-\x0D"
#: Bytes up to which a table may be broadcast: its counted rows times the bytes of a row in a hash table.
BROADCAST_BYTES = 32 << 20
#: Bytes of an Arrow batch: whole texts go to Python a few MB at a time, in whatever plan they are read.
ARROW_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key with more than one HOT-th of a table's rows is hot; fewer than HOT keys can be. Rows of a hot key
#: that one salt takes, at least.
HOT, SALT_ROWS = 10_000, 1_024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, and bound the Arrow batches of the
    session's plans by bytes (a smaller bound of the user's stays)."""
    if int(spark.conf.get(_BATCH).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(_BATCH, str(ARROW_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_factlattice_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    to = tempfile.mkdtemp(prefix="factlattice-code-")
    copy = shutil.copytree(package, f"{to}/code/factlattice", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{to}/factlattice", "zip", os.path.dirname(copy)))
    sc._factlattice_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir; only where
    that is unset and all runs in one process (tests) a temporary folder."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="factlattice-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/factlattice/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: later stages survive lost executors, and the
    plan restarts from a table whose size Spark knows."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow or an iterator UDF: when a task's batches are done, the worker, which Spark
    keeps for later tasks, gives the memory that it has freed back to the machine."""

    def go(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if _libc() is not None:
                _libc().malloc_trim(0)

    return go


def release(spark: SparkSession) -> None:
    """Remove every intermediate table of this library from the shared folder. Call it when no
    result of an operator is to be read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/factlattice")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, row_bytes: int = 128) -> DataFrame:
    """A broadcast hint if ``rows``, counted before, are within the bound; else Spark shuffles."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def lookup(left: DataFrame, right: DataFrame, key: str, spread: str, like: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row per ``key``, perhaps a large one. A hot key's rows
    in ``left`` are dealt by ``spread`` to salts, and its row of ``right`` goes to each of them. The table
    of hot keys has fewer than HOT rows, so it may be broadcast. ``like`` is a table to count the keys
    of ``left`` in, if that itself is costly to make."""
    like = left if like is None else like
    n = like.count()
    if n <= SALT_ROWS:
        return left.join(right, key)
    many = like.groupBy(F.col(key).alias("__fl_k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(SALT_ROWS, n // HOT))
    hot = cut(many.select("__fl_k", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("__fl_salts")), "hot-keys")
    if not hot.limit(1).count():
        return left.join(right, key)
    salts = F.coalesce("__fl_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), F.col(key) == F.col("__fl_k"), "left").withColumn("__fl_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    sent = right.join(F.broadcast(hot), F.col(key) == F.col("__fl_k"), "left").withColumn("__fl_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("__fl_k", "__fl_salts").join(sent.drop("__fl_k", "__fl_salts"), [key, "__fl_salt"]).drop("__fl_salt")


def free(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes to differ from ``taken`` (Spark's
    names differ in more than case)."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def crc_mod(doc_id: Column | str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null ids count as the empty text (crc 0)."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(mod)


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
