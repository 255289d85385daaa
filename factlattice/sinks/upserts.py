"""A table with one row per key that batches are merged into, by buckets of the key's hash.

A batch rewrites only the buckets that its keys fall into. The rewritten buckets lie beside the ones they replace,
in a folder of the merge's own number, and readers take each bucket's newest version; so no file is changed or
removed while it may be read, and a merge that broke off is simply made again. A version bears the name of the
writer and the number of its batch: the last batch, merged again, gives the same files under the same number, and
an earlier one of the same writer is left out. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factlattice.operators import relational as rel

FAILED = "FAILED"
_PLACES = ["merge", "writer", "batch", "bucket"]
_KEY = "__key"


def _versions(spark: SparkSession, path: str) -> list:
    """(merge, writer, batch, bucket) of all buckets' versions; as many rows as buckets and their kept versions."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return rows.select(*_PLACES).distinct().collect()


def _newest(versions: Sequence) -> dict:
    """bucket -> its newest version."""
    out = {}
    for v in sorted(versions, key=lambda v: v.merge):
        out[v.bucket] = v
    return out


def _read(spark: SparkSession, path: str, versions: Sequence) -> DataFrame:
    """The rows of some versions of buckets; other files aren't read."""
    by_merge = {}
    for v in versions:
        by_merge.setdefault(v.merge, []).append(v.bucket)
    wanted = [(F.col("merge") == m) & F.col("bucket").isin(buckets) for m, buckets in by_merge.items()]
    return spark.read.parquet(path).filter(reduce(Column.__or__, wanted, F.lit(False)))


def _best(df: DataFrame, by: Sequence[str], state: str, order: Sequence[Column]) -> DataFrame:
    """A row per key: those that didn't fail first, then the latest batch's, then by ``order``; of equal rows any."""
    failed = F.coalesce(F.col(state).cast("string") == FAILED, F.lit(False)).cast("int")
    content = F.to_json(F.struct(*sorted(c for c in df.columns if c not in ("bucket", "__seq"))))
    return rel.best_of(df, by, [failed, -F.col("__seq"), *order, F.xxhash64(content), content])


def upsert(batch: DataFrame, path: str, keys: Sequence[str], state: str, writer: str, number: int, order: Sequence[Column] = (), buckets: int = 64) -> int:
    """Merge a batch into the table at ``path``; how many buckets were written.

    A row's key is the first of ``keys`` that isn't NULL (rows without any are one key). Of a key's rows one stays: the
    latest whose ``state`` isn't FAILED, else the latest. Within a batch that with the smallest values of ``order`` counts as the latest. ``buckets`` is
    fixed by the first batch: a bucket, not the table, must fit a task. ``number`` grows with each batch of a ``writer``."""
    spark = batch.sparkSession
    versions = _versions(spark, path)
    newest = max(versions, key=lambda v: v.merge, default=None)
    name, again = f"w-{writer}", False
    if newest is not None:
        done = max((v.batch for v in versions if v.writer == name), default=-1)
        again = newest.writer == name and newest.batch == number
        if number <= done and not again:
            return 0
    merge = 0 if newest is None else newest.merge + (0 if again else 1)
    texts = F.coalesce(*(F.col(k).cast("string") for k in keys), F.lit(""))
    keyed = batch.withColumn(_KEY, texts).withColumn("__seq", F.lit(merge).cast("long")).withColumn("bucket", F.pmod(F.xxhash64(_KEY), F.lit(buckets)).cast("int"))
    fresh = _best(keyed, [_KEY], state, order).persist()  # a row per key, before anything is moved
    try:
        touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
        if touched:
            before = _newest([v for v in versions if v.merge < merge])
            old = [before[b] for b in touched if b in before]
            rows = fresh.unionByName(_read(spark, path, old).select(*fresh.columns)) if old else fresh
            merged = _best(rows.repartition("bucket"), ["bucket", _KEY], state, order)  # keeps to the buckets' partitions: a file each
            placed = merged.withColumn("merge", F.lit(merge)).withColumn("writer", F.lit(name)).withColumn("batch", F.lit(number))
            placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_PLACES).parquet(path)
    finally:
        fresh.unpersist()
    return len(touched)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table's rows as the last merge left them."""
    versions = list(_newest(_versions(spark, path)).values())
    return _read(spark, path, versions).drop(_KEY, "__seq", *_PLACES)


def clear_replaced(spark: SparkSession, path: str) -> int:
    """Remove versions of buckets that nothing needs any more: older than what the last merge replaced. How many."""
    versions = _versions(spark, path)
    last = max((v.merge for v in versions), default=0)
    needed = {(v.merge, v.bucket) for v in versions if v.merge == last} | {(v.merge, v.bucket) for v in _newest([v for v in versions if v.merge < last]).values()}
    gone = [v for v in versions if (v.merge, v.bucket) not in needed]
    for v in gone:  # at most buckets x versions folders
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join([path, *(f"{place}={v[place]}" for place in _PLACES)]))
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)
