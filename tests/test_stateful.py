"""The stateful stream of statuses: out-of-order files, restarts, late events, and its batch twin."""

import random

from pyspark.sql import functions as F

from factlattice.functions import status as st
from factlattice.streaming import statuses

TTL, SCHEMA = 60_000, "facility string, process string, ts timestamp, status string"
KEYS = ["facility", "process"]


def events(spark, rows):
    return spark.createDataFrame(rows, "facility string, process string, s double, status string").select("facility", "process", F.timestamp_seconds("s").alias("ts"), "status")


def told(frame):
    return sorted((r.facility, r.process, r.at, r.before, r.after) for r in frame.collect())


def by_hand(rows):
    out = []
    for key in {r[:2] for r in rows}:
        mine = [(int(s * 1000), st.BITS[status]) for f, p, s, status in rows if (f, p) == key and status in st.BITS]
        last = 0
        for at in sorted({t for a, _ in mine for t in (a, a + TTL)}):
            held = 0
            for a, bit in mine:
                held |= bit if a <= at < a + TTL else 0
            if held != last:
                out.append((*key, at, last, held))
            last = held
    return sorted(out)


def made(rng, n, low, high):
    return [(rng.choice("AB"), rng.choice(["x", "y"]), float(rng.randint(low, high)), rng.choice([*st.BITS, None])) for _ in range(n)]


def test_changes_by_hand(spark):
    rows = made(random.Random(1), 150, 1000, 2500)
    assert told(statuses.changes(events(spark, rows), KEYS, "ts", "status", TTL)) == by_hand(rows)
    assert statuses.changes(events(spark, rows).limit(0), KEYS, "ts", "status", TTL).count() == 0


def test_stream_with_restarts_and_late_events(spark, tmp_path):
    """Four files, each read by a query that stops and a new one that goes on from its checkpoint. Events come up to 200 s
    out of order; the last file brings events far behind the watermark and one far ahead that passes all others."""
    at = lambda name: f"file://{tmp_path}/{name}"
    rng = random.Random(7)
    rows, every = sorted(made(rng, 120, 1000, 2500), key=lambda r: r[2]), []
    jumbled = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 200))
    late = [("A", "x", 20.0, "PRESENT"), ("B", "y", 30.0, "PAST")]
    files = [jumbled[:50], jumbled[50:90], jumbled[90:], [*late, ("Z", "z", 99_999.0, "PAST")], [("Z", "z", 100_000.0, "PAST")]]
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(at("in"))
    for n, part in enumerate(files):
        events(spark, part).coalesce(1).write.mode("append").parquet(at("in"))
        every += part
        statuses.split(stream(), KEYS, "ts", "status", TTL, "300 seconds", at("changes"), at("late"), at("checkpoint"))
    got = told(spark.read.parquet(at("changes")))
    assert [r for r in got if r[0] != "Z"] == by_hand(rows)
    assert told(spark.read.parquet(at("changes")).filter("facility <> 'Z'").drop("batch")) == told(statuses.changes(events(spark, rows), KEYS, "ts", "status", TTL))
    behind = spark.read.parquet(at("late")).collect()
    assert sorted((r.facility, r.at) for r in behind) == [("A", 20_000), ("B", 30_000)]
