"""Statuses that hold for a while, kept per key by a stateful stream, and the feed of their changes.

An event says that a key has a status from its time on, for a time to live; said again, it holds longer. The
key's status is the join of those that hold. The stream takes events out of order: they wait in the key's
state until the watermark has passed them, then event-time timers apply them, and their ends, in the order of
event time. So the feed does not depend on the order or the batches in which events came in, and equals
``changes`` over the same events. Events behind the watermark are not dropped: they come out as late rows,
which ``split`` takes to a table of their own. State is bounded: what waits is as much as comes within the
watermark's delay, and of what holds one end per status.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from factlattice.functions import status as st

#: The single bits of the lattice; PRESENT_AND_FUTURE sets two.
_BITS = [b for b in sorted(set(st.BITS.values())) if b & (b - 1) == 0]
_ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Held(StatefulProcessor):
    """Waiting events (time -> mask), ends of what holds (bit -> time), and the mask last told."""

    def __init__(self, keys: Sequence[str], ttl: int) -> None:
        self.keys, self.ttl = list(keys), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long", "mask int")
        self.ends = handle.getMapState("ends", "bit int", "at long")
        self.told = handle.getValueState("told", "mask int")

    def _row(self, key: tuple, at: int, before: int, after: int, late: bool) -> Row:
        return Row(**dict(zip(self.keys, key)), at=at, before=before, after=after, late=late)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        fresh: dict[int, int] = {}
        for row in rows:
            if row.at <= passed:
                yield self._row(key, row.at, 0, row.mask, True)
            else:
                fresh[row.at] = fresh.get(row.at, 0) | row.mask
        for at, mask in fresh.items():
            if self.waiting.containsKey((at,)):
                mask |= self.waiting.getValue((at,))[0]
            self.waiting.updateValue((at,), (mask,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All that the watermark has passed, in order; a timer whose work is done finds nothing."""
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = {at: mask for (at,), (mask,) in self.waiting.iterator() if at <= passed}
        ends = {bit: at for (bit,), (at,) in self.ends.iterator()}
        if not waiting and all(at > passed for at in ends.values()):
            return
        told = self.told.get()[0] if self.told.exists() else 0
        before, known = told, dict(ends)
        while due := [at for at in (*waiting, *ends.values()) if at <= passed]:
            now = min(due)
            mask = waiting.pop(now, None)
            if mask is not None:
                self.waiting.removeKey((now,))
                ends |= {bit: now + self.ttl for bit in _BITS if mask & bit}
            ends = {bit: at for bit, at in ends.items() if at > now}
            held = sum(ends)
            if held != told:
                yield self._row(key, now, told, held, False)
                told = held
        for bit in _BITS:
            if bit in ends and ends[bit] != known.get(bit):
                self.ends.updateValue((bit,), (ends[bit],))
                self.handle.registerTimer(ends[bit])
            elif bit in known and bit not in ends:
                self.ends.removeKey((bit,))
        if not told and before:
            self.told.clear()
        elif told != before:
            self.told.update((told,))

    def close(self) -> None:
        pass


def _masks(events: DataFrame, keys: Sequence[str], time: str, status: str) -> DataFrame:
    known = events.withColumn("mask", st.bits(F.col(status))).filter(F.col("mask").isNotNull() & F.col(time).isNotNull())
    return known.select(*keys, F.unix_millis(F.col(time).cast("timestamp")).alias("at"), "mask")


def feed(events: DataFrame, keys: Sequence[str], time: str, status: str, ttl_ms: int, late: str) -> DataFrame:
    """keys, at, before, after (masks; 0 for none), late, from a stream of ``events``. At least one key; ``late``: the
    watermark's delay. The session must keep state in RocksDB (see ``split``)."""
    rows = _masks(events.withWatermark(time, late), keys, time, status)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keys)
    return rows.groupBy(*keys).transformWithState(Held(keys, ttl_ms), f"{kinds}, at long, before int, after int, late boolean", "append", "EventTime")


def split(events: DataFrame, keys: Sequence[str], time: str, status: str, ttl_ms: int, late: str, changes_at: str, late_at: str, checkpoint: str) -> StreamingQuery:
    """Read what is there of a stream to its end, then stop: changes are appended to one table, late events to
    another. A batch that is done again after a failure replaces its own files (a folder per batch)."""
    spark = events.sparkSession
    before = {k: spark.conf.get(k, None) for k in _ROCKS}
    for k, v in _ROCKS.items():
        spark.conf.set(k, v)

    def write(batch: DataFrame, nth: int) -> None:
        batch = batch.persist()
        for rows, path in ((batch.filter("NOT late"), changes_at), (batch.filter("late"), late_at)):
            rows.drop("late").write.mode("overwrite").parquet(f"{path}/batch={nth}")
        batch.unpersist()

    try:
        out = feed(events, keys, time, status, ttl_ms, late).writeStream.foreachBatch(write).outputMode("append")
        query = out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def changes(events: DataFrame, keys: Sequence[str], time: str, status: str, ttl_ms: int) -> DataFrame:
    """The same feed over a finished table: keys, at, before, after. Each event adds one to its statuses at its time and
    takes one away at its end; partial sums per moment come before the exchange, running sums tell what holds."""
    rows = _masks(events, keys, time, status)
    add = [F.when(F.col("mask").bitwiseAND(b) != 0, F.col("sign")).otherwise(0) for b in _BITS]
    both = rows.select(*keys, "mask", F.explode(F.array(F.struct("at", F.lit(1).alias("sign")), F.struct((F.col("at") + ttl_ms).alias("at"), F.lit(-1).alias("sign")))).alias("e"))
    moments = both.select(*keys, "mask", "e.*").groupBy(*keys, "at").agg(*(F.sum(a).alias(f"d{i}") for i, a in enumerate(add)))
    order = Window.partitionBy(*keys).orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    held: Column = sum((F.when(F.sum(f"d{i}").over(running) > 0, b).otherwise(0) for i, b in enumerate(_BITS)), F.lit(0))
    told = moments.select(*keys, "at", held.alias("after"))
    told = told.withColumn("before", F.coalesce(F.lag("after").over(order), F.lit(0)))
    return told.filter("before <> after").select(*keys, "at", "before", "after")
