"""Exact deduplication by a stateful stream.

A batch pass appends one narrow row per document (digest, doc_id, batch, row) to a spool in a folder. A
Structured Streaming query reads the spool into keyed state that never expires, kept on disk by RocksDB
and checkpointed to the folder: per digest the stable identifier (smallest doc_id), the content locator
(batch and row) of the row that stays and the number of copies. Map-side partial aggregation comes
before the only exchange, so a digest with a third of all rows arrives as one row per task. The state is
read back as a table with Spark's state data source. A hit (a digest seen before) is then checked on
the full normalised bytes against the row that stays.

The folder is ``state``, or a new one in the shared folder. With ``state`` given, later batches meet
earlier ones: the stream goes on where it stopped, and the texts of the rows that stay are kept in the
folder by their locator, so that a hit on an earlier batch is checked on its bytes too.

Defined results: null text counts as empty; texts that differ only in runs of ASCII white space are
equal; texts of any length are compared whole; rows that repeat a doc_id and its text are copies of
which one stays (``drop_exact_copies``: the first by a digest of all columns); a null doc_id sorts last;
an empty table gives an empty result; other columns are ignored by ``exact_dedup`` and carried unchanged
by ``drop_exact_copies``. A result tells about all batches up to its own: a later batch may bring a
smaller doc_id, which then stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Memory is bounded for all stores of an executor together, and stores take no disk in advance.
_ROCKS_CONF = {
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Copies of one text that one salt of the byte check takes.
SALT_ROWS = 256
_SPOOL = "digest binary, doc_id long, batch int, row long"
_GROUPS = "digest binary, keep_id long, keep_batch int, keep_row long, group_size long"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(common.text_of(text), f"[{common.SPACE}]++", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the folder, empty if there is none yet."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _state_of(home: str, spark: SparkSession, max_bytes: int) -> DataFrame:
    """Run the stream over the spool to its end and return the state as a table."""
    conf = {_PROVIDER: _ROCKS, **_ROCKS_CONF}
    before = {k: spark.conf.get(k, None) for k in conf}
    for key, value in conf.items():
        spark.conf.set(key, value)
    try:
        stream = spark.readStream.schema(_SPOOL).option("maxBytesPerTrigger", str(max_bytes)).parquet(f"{home}/spool")
        state = stream.groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "row")).alias("first"),
            F.count(F.lit(1)).alias("group_size"),
        )
        query = (
            state.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", f"{home}/stream")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        if query.lastProgress is None:
            return spark.createDataFrame([], _GROUPS)
        rows = spark.read.format("statestore").load(f"{home}/stream")
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    first, size = (F.col("value").getField(f.name) for f in rows.schema["value"].dataType.fields)
    return rows.select(
        F.col("key.digest").alias("digest"),
        first.getField("doc_id").alias("keep_id"),
        first.getField("batch").alias("keep_batch"),
        first.getField("row").alias("keep_row"),
        size.alias("group_size"),
    )


def exact_dedup(docs: DataFrame, digest: Column | None = None, max_bytes: int = 64 << 30, state: str | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, digest.

    ``state`` is a folder that driver and executors share; batches with the same folder are deduplicated
    against each other. ``digest`` may name another digest of the column ``norm`` (tests use a weak one,
    so that different texts meet in one state entry); ``max_bytes`` bounds what one micro-batch reads.
    """
    spark = docs.sparkSession
    home = state.rstrip("/") if state else common.new_path(spark, "dedup")
    spool = _read(spark, f"{home}/spool", _SPOOL)
    batch = (spool.agg(F.max("batch")).first()[0] or 0) + 1 if state else 1
    digest = (digest_of(F.col("norm")) if digest is None else digest).cast("binary")
    norm = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm")).withColumn("digest", digest)
    if state:  # the rows' numbers are locators: they must be those of the texts that are kept
        norm = common.cut(norm.withColumn("row", F.monotonically_increasing_id()), "dedup-texts")
    else:
        norm = norm.withColumn("row", F.monotonically_increasing_id())
    norm.select("digest", "doc_id", F.lit(batch).alias("batch"), "row").write.mode("append").parquet(f"{home}/spool")
    rows = _read(spark, f"{home}/spool", _SPOOL).filter(F.col("batch") == batch)
    groups = common.cut(_state_of(home, spark, max_bytes), "dedup-groups")
    kept = F.col("keep_batch") == batch
    if state:
        stays = norm.join(groups.filter(kept).select("digest", F.col("keep_row").alias("row")), ["digest", "row"])
        stays.select("digest", F.lit(batch).alias("batch"), "row", "norm").write.mode("append").parquet(f"{home}/texts")
    # Of groups of one row all is known. Groups of more than one HOT-th of all rows are fewer than HOT: they
    # are broadcast, so that no task of the other groups' join gets many rows of one key.
    many = groups.filter("group_size > 1")
    n, total = groups.agg(F.count_if(F.col("group_size") > 1), F.coalesce(F.sum("group_size"), F.lit(0))).first()
    is_hot = F.col("group_size") > max(SALT_ROWS, total // common.HOT)
    found = _with_groups(rows, many, n, is_hot, "left")
    bad = _unequal(norm.drop("row"), many, n, is_hot, f"{home}/texts" if state else None)
    single = F.col("group_size").isNull()
    out = found.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | ((F.col("row") == F.col("keep_row")) & kept)).alias("kept"),
        "digest",
    )
    if bad is None:
        return out
    # Digests that different texts share (a collision): these alone are grouped by their bytes.
    bad = common.small(bad, bad.count())
    apart = norm.withColumn("row", F.monotonically_increasing_id()).join(bad, "digest", "left_semi")
    apart = common.cut(apart, "dedup-apart")
    by_text = apart.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("group_size"))
    exact = apart.join(by_text, ["digest", "norm"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("first.row")).alias("kept"), "digest"
    )
    return out.join(bad, "digest", "left_anti").unionByName(exact)


def _with_groups(rows: DataFrame, many: DataFrame, n: int, is_hot: Column, how: str) -> DataFrame:
    """``rows`` joined with ``many`` (n groups, a row per digest; ``is_hot`` of its group_size). Rows of hot groups
    never shuffle: either all groups are broadcast or the hot ones, which are fewer than HOT."""
    if n * 128 <= common.BROADCAST_BYTES:
        return rows.join(F.broadcast(many), "digest", how)
    hot = many.filter(is_hot)
    rest = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    return rest.join(many.filter(~is_hot), "digest", how).unionByName(rows.join(F.broadcast(hot), "digest"))


def _unequal(norm: DataFrame, many: DataFrame, n: int, is_hot: Column, texts: str | None) -> DataFrame | None:
    """The digests under which two different texts lie, or None. Only texts that hit are moved; copies
    of one text are spread over salts, to each of which the text that stays is sent. ``texts``: the
    folder with the texts of rows that stay; without it they are among ``norm``."""
    if not n:
        return None
    many = many.withColumn("salts", F.ceil(F.col("group_size") / SALT_ROWS).cast("int"))
    hits = _with_groups(norm, many, n, is_hot, "inner").drop("group_size").withColumn("salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("salts")).cast("int"))
    hits = common.cut(hits, "dedup-hits")
    if texts is None:
        of = hits.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).dropDuplicates(["digest"])
    else:
        own = _read(norm.sparkSession, texts, "digest binary, batch int, row long, norm string").toDF("digest", "keep_batch", "keep_row", "norm")
        of = own.join(common.small(many, n), ["digest", "keep_batch", "keep_row"])
    stay = of.select("digest", F.col("norm").alias("stay"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    bad = hits.join(stay, ["digest", "salt"]).filter(F.col("norm").cast("binary") != F.col("stay").cast("binary")).select("digest").distinct()
    bad = common.cut(bad, "dedup-unequal")
    return bad if bad.limit(1).count() else None


def drop_exact_copies(docs: DataFrame, state: str | None = None) -> DataFrame:
    """``docs`` without the copies, all columns kept. What goes is looked up by (doc_id, digest)."""
    own, its, other = common.free(docs.columns, "__fl_digest", "__fl_id", "__fl_of")
    found = exact_dedup(docs.select("doc_id", "text"), state=state)
    # Rows that repeat a doc_id and its text: ``twice`` where one of them stays.
    gone = found.groupBy("doc_id", "digest").agg(F.max("kept").alias("twice"), F.count_if(~F.col("kept")).alias("rows")).filter("rows > 0")
    gone = common.cut(gone.drop("rows"), "dedup-gone")
    n, again = gone.agg(F.count(F.lit(1)), F.count_if("twice")).first()
    marked = docs.withColumn(own, digest_of(normalised()))
    keys = gone.select(F.col("doc_id").alias(its), F.col("digest").alias(other), "twice")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(its)) & (F.col(own) == F.col(other))
    rest = marked.join(common.small(keys.drop("twice"), n), same, "left_anti").drop(own)
    if not again:
        return rest
    one = marked.join(common.small(keys.filter("twice").drop("twice"), again), same, "left_semi")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    one = one.groupBy("doc_id", own).agg(F.min_by(row, F.sha2(F.to_json(row), 256)).alias("r"))
    return rest.unionByName(one.select("r.*"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
