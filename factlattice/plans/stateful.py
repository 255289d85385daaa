"""The feed of status changes, what the stateful stream tells, over a finished table; batches merged into a bucketed
table."""

from __future__ import annotations

from pyspark.sql import functions as F

from factlattice.functions import status as st
from factlattice.operators import relational as rel
from factlattice.session import table
from factlattice.sinks import upserts
from factlattice.streaming import statuses

from .catalogue import _BIT, _DECODE, _event_status, query

#: How long a status holds.
TTL_MS = 6 * 3_600_000


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) // 1000 AS t, {_BIT} AS mask FROM events), m AS (SELECT user_id, t FROM e UNION SELECT user_id, t + {TTL_MS} FROM e),
  held AS (SELECT m.user_id, m.t, coalesce(bit_or(e.mask), 0) AS after FROM m LEFT JOIN e ON e.user_id = m.user_id AND e.t <= m.t AND m.t < e.t + {TTL_MS} GROUP BY 1, 2),
  told AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY user_id ORDER BY t), 0) AS before FROM held)
  SELECT user_id, t AS "at", coalesce({_DECODE.format('before')}, '') AS before, coalesce({_DECODE.format('after')}, '') AS after FROM told WHERE before <> after""")
def status_changes(spark, sf_dir):
    """When each user's joined status changes, if an event's status holds for six hours."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", _event_status().alias("status"))
    told = statuses.changes(e, ["user_id"], "ts", "status", TTL_MS)
    return told.select("user_id", "at", *(F.coalesce(st.decode(F.col(c)), F.lit("")).alias(c) for c in ("before", "after")))


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type, value FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY event_type = 'error', CASE WHEN event_type IN ('view', 'click') THEN 0 WHEN event_type IN ('signup', 'error') THEN 1 ELSE 2 END DESC, ts DESC, event_id DESC) = 1""")
def merged_batches(spark, sf_dir):
    """All events in three batches by their types, the second of them twice, merged by user and day: the last batch's latest event that
    isn't an error."""
    events = table(spark, sf_dir, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_id", "event_type", "value", "ts")
    kept = events.withColumn("key", F.concat_ws(" ", F.col("user_id").cast("string"), "day")).withColumn("source", F.when(F.col("event_type").isin("view", "click"), 0).when(F.col("event_type").isin("signup", "error"), 1).otherwise(2)).withColumn("state", F.when(F.col("event_type") == "error", upserts.FAILED))
    path = rel.folder(spark, "merged")
    for number in (0, 1, 1, 2):
        upserts.upsert(kept.filter(F.col("source") == number), path, ["key"], "state", "events", number, [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")], buckets=8)
    return upserts.current(spark, path).select("user_id", "day", "event_id", "event_type", "value")
