"""Work that goes on where it stopped: what is done is skipped, what changed is done again, and statuses of a
stream of events merged over windows of time."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factlattice.functions import status as st


def undone(jobs: DataFrame, results: DataFrame, keys: Sequence[str], state: str | None = None, failed: str = "FAILED") -> DataFrame:
    """The jobs without a result; those that failed count as undone."""
    done = results if state is None else results.filter(F.coalesce(F.col(state).cast("string") != failed, F.lit(True)))
    return jobs.join(done.select(*keys).distinct(), list(keys), "left_anti")


def fingerprint(size: Column, changed: Column) -> Column:
    """What tells whether a file is still the same: its size and time of change."""
    return F.concat_ws(":", size.cast("string"), F.unix_micros(changed.cast("timestamp")).cast("string"))


def stale(files: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """The files (key, fp) that the cache (key, fp, ...) doesn't hold as they are now."""
    return files.join(cache.select(key, "fp"), [key, "fp"], "left_anti")


def refreshed(files: DataFrame, cache: DataFrame, key: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The cache (key, fp, value columns) brought up to date: entries of files that are the same stay, ``work``
    makes those of new and changed ones; files that are gone stay too."""
    todo = stale(files, cache, key)
    fresh = work(todo).join(files.select(key, "fp"), key)
    return cache.join(todo.select(key), key, "left_anti").unionByName(fresh.select(*cache.columns))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """name, fp, pages of the files at a path (contents aren't read)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.substring_index("path", "/", -1).alias("name"), fingerprint(F.col("length"), F.col("modificationTime")).alias("fp"), "path")


def new_files(spark: SparkSession, path: str, schema: str, checkpoint: str, handle: Callable[[DataFrame, int], None], fmt: str = "parquet") -> StreamingQuery:
    """Hand each batch of files that haven't been seen yet to ``handle`` and stop when none is left; which have
    been is kept in the checkpoint, so a file is handled once however often this runs."""
    query = spark.readStream.schema(schema).format(fmt).load(path).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def windowed(events: DataFrame, key: str, time: str, status: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """key, window, status: statuses merged over windows of event time (tumbling, or sliding). In a stream, events
    later than ``late`` are dropped and windows that can't change any more are let go."""
    by = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(key, by.alias("window")).agg(st.merge(F.col(status)).alias("status"))


def sessions(events: DataFrame, key: str, time: str, status: str, gap: str, late: str) -> DataFrame:
    """key, window, events, status per session: events of a key with less than ``gap`` between them."""
    by = F.session_window(time, gap).alias("window")
    return events.withWatermark(time, late).groupBy(key, by).agg(F.count(F.lit(1)).alias("events"), st.merge(F.col(status)).alias("status"))


def paired(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, within: str, late: str) -> DataFrame:
    """Two streams joined by key where the right event comes within a span after the left one; both have
    watermarks, so state is bounded. Columns but the key must differ."""
    a, b = left.withWatermark(left_time, late), right.withWatermark(right_time, late).withColumnRenamed(key, "__key")
    soon = (F.col(right_time) >= F.col(left_time)) & (F.col(right_time) <= F.col(left_time) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("__key")) & soon).drop("__key")
