"""Batches merged into a bucketed table: replays, files rewritten, streams, odd rows."""

import random

from pyspark.sql import functions as F

from factlattice.sinks import upserts
from factlattice.streaming import incremental

KIND = "file string, name string, state string, n int"


def at(path):
    return f"file://{path}"


def files_of(path):
    return {f.relative_to(path).as_posix(): f.stat().st_mtime_ns for f in path.rglob("*.parquet")} if path.exists() else {}


def shown(spark, path):
    return sorted((str(r.file), str(r.name), str(r.state), r.n) for r in upserts.current(spark, at(path)).collect())


def by_hand(batches):
    """The last that didn't fail, else the last, of each key."""
    kept = {}
    for number, rows in enumerate(batches):
        for r in rows:
            key = next((k for k in r[:2] if k is not None), "")
            rank = (r[2] != "FAILED", number, r[3])
            if key not in kept or rank > kept[key][0]:
                kept[key] = (rank, r)
    return sorted((str(a), str(b), str(c), n) for _, (a, b, c, n) in kept.values())


def test_batches_merge_as_by_hand(spark, tmp_path):
    rng = random.Random(5)
    batches, n = [], 0
    for _ in range(4):
        rows = []
        for _ in range(60):
            n += 1
            key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}"
            rows.append((*rng.choice([(key, "x"), (None, key), (None, None)]), rng.choice(["True", "False", "FAILED", None]), n))
        batches.append(rows)
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, KIND)
        assert upserts.upsert(df, at(tmp_path / "t"), ["file", "name"], "state", "a", i, [-F.col("n")], buckets=5) == 5
        assert shown(spark, tmp_path / "t") == by_hand(batches[: i + 1])
    removed = upserts.clear_replaced(spark, at(tmp_path / "t"))
    assert removed == 10 and shown(spark, tmp_path / "t") == by_hand(batches)
    df = spark.createDataFrame(batches[3], KIND)  # what the last merge replaced is still there
    upserts.upsert(df, at(tmp_path / "t"), ["file", "name"], "state", "a", 3, [-F.col("n")], buckets=5)
    assert shown(spark, tmp_path / "t") == by_hand(batches)


def test_only_touched_buckets_are_written(spark, tmp_path):
    put = lambda rows, number, writer="a": upserts.upsert(spark.createDataFrame(rows, KIND), at(tmp_path / "t"), ["file"], "state", writer, number, buckets=16)
    assert put([(f"k{i}", "", "True", i) for i in range(200)], 0) == 16 and len(files_of(tmp_path / "t")) == 16
    first = files_of(tmp_path / "t")
    assert put([("k1", "", "False", 1000), ("k1", "", "FAILED", 1001), ("new", "", "FAILED", 1002)], 1) in (1, 2)
    second = files_of(tmp_path / "t")
    assert first.items() <= second.items() and len(second) - len(first) in (1, 2)
    state = shown(spark, tmp_path / "t")
    assert len(state) == 201 and ("k1", "", "False", 1000) in state and ("new", "", "FAILED", 1002) in state
    written = put([("k1", "", "False", 1000), ("k1", "", "FAILED", 1001), ("new", "", "FAILED", 1002)], 1)  # the same batch again
    again = files_of(tmp_path / "t")
    assert written == len(second) - len(first) and len(again) == len(second) and first.items() <= again.items() and shown(spark, tmp_path / "t") == state
    assert put([("k0", "", "False", -1)], 0) == 0 and files_of(tmp_path / "t") == again  # a batch from before that
    assert put([("k0", "", "False", 7)], 0, "b") == 1 and ("k0", "", "False", 7) in shown(spark, tmp_path / "t")  # another writer's
    assert put([("k1", "", "False", 8)], 2) == 1 and put([], 3) == 0


def test_a_stream_is_merged_once(spark, tmp_path):
    handle = lambda df, number: upserts.upsert(df, at(tmp_path / "t"), ["file"], "state", "stream", number, [-F.col("n")], buckets=4)
    run = lambda: incremental.new_files(spark, at(tmp_path / "in"), KIND, at(tmp_path / "cp"), handle)
    spark.createDataFrame([("a", "", "True", 1), ("b", "", "FAILED", 2)], KIND).write.parquet(at(tmp_path / "in"))
    run()
    run()
    spark.createDataFrame([("a", "", "FAILED", 3), ("b", "", "False", 4), ("c", "", None, 5)], KIND).write.mode("append").parquet(at(tmp_path / "in"))
    run()
    assert shown(spark, tmp_path / "t") == [("a", "", "True", 1), ("b", "", "False", 4), ("c", "", "None", 5)]
    (commit,) = [f for f in (tmp_path / "cp/commits").iterdir() if f.name == "1"]
    commit.unlink()  # as if the driver had died after the merge and before it was noted
    (tmp_path / "cp/commits/.1.crc").unlink(missing_ok=True)
    before = files_of(tmp_path / "t").keys()
    run()
    after = files_of(tmp_path / "t").keys()
    assert {f.rpartition("/")[0] for f in before} == {f.rpartition("/")[0] for f in after} and len(after) == len(before)
    assert shown(spark, tmp_path / "t") == [("a", "", "True", 1), ("b", "", "False", 4), ("c", "", "None", 5)]
