"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

1. Rows are written once with a key of their own. Each text becomes its set of word shingles and a
   sketch of ``bands * rows`` coordinates (Arrow batches). Texts with the same sequence of words (a
   128-bit digest) form one class; the row of its smallest doc_id stands for it.
2. Classes that agree on a band share a bucket. With 48 bands of 6 rows a pair at similarity 0.8 is
   missed with probability (1 - 0.8**6)**48 < 5e-7, a likelier one with far less.
3. Pairs of a bucket are verified on their full sets: shared * 100 >= 80 * union, first on hashes of
   shingles, and what passes on the words themselves. A bucket is not expanded into all its pairs: in
   each of a few rounds one member (chosen by hash) is compared with the members of other components,
   then components are joined. Buckets whose members are all in one component are done, and so are
   classes too few of whose shingles occur in other components. What is left after the rounds, pairs
   of different components, is found by an exact bound (see ``_rest``) and verified, so no link that
   could join two components is lost.
4. Components are found by label propagation with pointer jumping; the smallest doc_id names each.

Every exchange moves one row per document, band or pair, or the texts of pairs; no group is gathered
in one task. Buckets and their chosen members are written tables: the latter are broadcast if they are
few, else Spark splits a hot bucket's join; a text that many pairs need is sent to salts (``common.lookup``). Defined results: null text or
no words: empty set, linked with nothing; fewer words than a shingle: one shingle; repeated rows and
equal texts are one class; rows that share a doc_id or have none are compared as documents of their
own; of each component one row is kept, of its smallest doc_id (null last); texts of any length are
read whole; an empty table gives an empty result; other columns are ignored by ``near_dedup`` and
carried by ``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, shingles

BANDS, ROWS = 48, 6
#: Rounds that compare one member of each bucket with the others before what is left is verified; the
#: first PRUNE take a member by chance, the others the one whose shingles are the most common.
ROUNDS, PRUNE = 4, 2
#: After the rounds: a shingle of more than RARE members of a block counts as one that the block's
#: texts have in common; those are counted in PARTS parts by hash.
RARE, PARTS = 64, 32
#: Bytes of texts whose sets a worker holds at a time (a longer text alone).
RUN = 1 << 19


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _sketcher(k: int, n_bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("text"))
            for start, end in shingles.runs(texts, RUN):
                found = shingles.sets(texts[start:end], k)
                full = [s for s in found if len(s)]
                hashed = shingles.bands(np.stack([shingles.sketch(s, n_bands * rows) for s in full]), rows) if full else np.empty((0, n_bands), np.uint64)
                sizes = np.array([len(s) for s in found], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, n_bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").slice(start, end - start),
                        batch.column("doc_id").slice(start, end - start),
                        pa.array(sizes),
                        pa.array([shingles.same(shingles.words_of(t)) if n else None for t, n in zip(texts[start:end], sizes)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(hashed.view(np.int64).ravel())),
                    ],
                    names=["row", "doc_id", "n_shingles", "same", "bands"],
                )

    return common.tidy(run)


def _verifier(k: int, percent: int):
    def near(n: int, m: int, shared: int) -> bool:
        return shared > 0 and 100 * shared >= percent * (n + m - shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, dtype=bool)
            ids_a, ids_b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts_a, texts_b = _texts(batch.column("text_a")), _texts(batch.column("text_b"))
            for start, end in shingles.runs([max(x or b"", y or b"", key=len) for x, y in zip(texts_a, texts_b)], RUN):
                own = dict(zip(ids_a[start:end], texts_a[start:end])) | dict(zip(ids_b[start:end], texts_b[start:end]))
                of = dict(zip(own, shingles.sets(list(own.values()), k)))
                for i, (x, y) in enumerate(zip(ids_a[start:end], ids_b[start:end]), start):
                    if near(len(of[x]), len(of[y]), shingles.overlap(of[x], of[y])):
                        linked[i] = near(*shingles.exact(shingles.words_of(own[x]), shingles.words_of(own[y]), k))
            keep = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return common.tidy(run)


def _shingle_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch.column("text"))
            for start, end in shingles.runs(texts, RUN):
                found = shingles.sets(texts[start:end], k)
                at = np.repeat(np.arange(start, end), [len(s) for s in found])
                columns = [batch.column(c).take(pa.array(at)) for c in ("rep", "n", "comp", "block")]
                flat = np.concatenate(found) if len(at) else np.empty(0, np.uint64)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flat.view(np.int64))], names=["rep", "n", "comp", "block", "shingle"])

    return common.tidy(run)


def _undecided(open_: DataFrame) -> DataFrame:
    """The buckets whose members lie in several components."""
    split = open_.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    split = common.cut(split, "near-open")
    return common.cut(open_.join(common.small(split, split.count()), "key").select("key", "rep", "n", "c", "w", "comp"), "near-buckets")


def _able(open_: DataFrame, docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The open buckets with c, how many of a set's shingles occur in another component of its block
    (components that buckets connect), without the classes that can't be linked any more. Two sets share
    at most the smaller c; a link needs (100 + percent) * shared >= percent * (n + m), so c alone shows
    for most pairs that they aren't linked. Exact, and found without looking at pairs. w, how often a
    class's shingles occur in its block, is largest for the text that a family of copies stems from.
    Returns the open buckets and the shingles (rep, n, block, shingle) of their members."""
    low = open_.groupBy("key").agg(F.min("comp").alias("a"))
    block = components(open_.join(low, "key").filter("comp <> a").select("a", F.col("comp").alias("b")).distinct())
    members = open_.select("rep", "n", "comp").distinct().join(block.toDF("comp", "block"), "comp")
    members = common.cut(members.select("rep", "n", "comp", "block"), "near-members")
    texts = docs.join(common.small(members, members.count()), F.col("row") == F.col("rep"))
    kind = "rep long, n long, comp long, block long, shingle long"
    rows = common.cut(texts.select("rep", "n", "comp", "block", "text").mapInArrow(_shingle_rows(k), kind), "near-shingles")
    across = rows.groupBy("block", "shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("in")).filter("lo < hi").select("block", "shingle", "in")
    able = rows.join(across, ["block", "shingle"]).groupBy("rep", "n").agg(F.count(F.lit(1)).alias("c"), F.sum("in").cast("double").alias("w"))
    able = able.filter(100 * F.col("c") >= percent * F.col("n"))
    return _undecided(open_.drop("c", "w").join(able.select("rep", "c", "w"), "rep")), rows.drop("comp")


def _rest(open_: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) of different components left to verify: every one that may be linked, few others.

    Call a shingle common if more than RARE members of its block have it. Two sets share at most the sum,
    over PARTS parts of the common shingles, of the smaller of their two counts there, and the rare
    shingles that both have. So a linked pair passes the bound by common shingles alone, or shares a rare
    shingle; pairs of the second kind are at most RARE times the rows of rare shingles, whatever a
    family's size. Exact for any choice of RARE and PARTS."""
    members = common.cut(open_.select("rep", "comp").distinct(), "near-members")
    rows = rows.join(common.small(members, members.count()), "rep")
    many = rows.groupBy("block", "shingle").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("in")).filter("lo < hi")
    rows = common.cut(rows.join(many.select("block", "shingle", (F.col("in") > RARE).alias("shared")), ["block", "shingle"]), "near-shared")
    part = F.pmod(F.xxhash64("shingle", F.lit(1)), F.lit(PARTS))
    counts = [F.count(F.when(part == g, 1)).cast("short") for g in range(PARTS)]
    t = rows.filter("shared").groupBy("rep").agg(F.count(F.lit(1)).alias("t"), F.array(*counts).alias("p"))
    t = common.cut(t, "near-common")

    # pairs that their common shingles don't rule out, among the members of a bucket
    able = common.cut(open_.select("key", "rep", "n", "comp").join(t, "rep"), "near-able")
    least = common.cut(able.groupBy("key").agg(F.min("n").alias("least")), "near-least")
    able = able.join(common.small(least, least.count()), "key").filter((100 + percent) * F.col("t") >= percent * (F.col("n") + F.col("least"))).drop("least")
    able = common.cut(able, "near-able")
    split = able.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key")
    split = common.cut(split, "near-open")
    able = common.cut(able.join(common.small(split, split.count()), "key").select("key", "rep", "n", "comp", "t", "p"), "near-able")
    x, y = able.toDF("key", "x", "nx", "cx", "tx", "px"), able.toDF("key", "y", "ny", "cy", "ty", "py")
    need = percent * (F.col("nx") + F.col("ny"))
    most = F.aggregate(F.zip_with("px", "py", lambda a, b: F.least(a, b).cast("int")), F.lit(0), lambda total, v: total + v)
    near = (F.col("cx") < F.col("cy")) & ((100 + percent) * F.least("tx", "ty") >= need)
    alike = x.join(y, (x["key"] == y["key"]) & near & ((100 + percent) * most >= need)).select("x", "y")

    # pairs that share rare shingles
    rare = rows.filter("NOT shared").join(t.select("rep", "t"), "rep", "left").select("block", "shingle", "rep", "n", "comp", F.coalesce("t", F.lit(0)).alias("t"))
    x, y = rare.toDF("block", "shingle", "x", "nx", "cx", "tx"), rare.toDF("block", "shingle", "y", "ny", "cy", "ty")
    both = x.join(y, ["block", "shingle"]).filter("cx < cy").groupBy("x", "y", "nx", "ny", "tx", "ty").agg(F.count(F.lit(1)).alias("both"))
    both = both.filter((100 + percent) * (F.least("tx", "ty") + F.col("both")) >= need)
    return alike.union(both.select("x", "y"))


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts' full sets are similar enough. Moves texts of pairs only."""
    ids = common.cut(pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "near-ids")
    texts = docs.join(common.small(ids, ids.count()), "row", "left_semi")
    texts = common.cut(texts.select("row", "text"), "near-texts")
    a = texts.select(F.col("row").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("row").alias("b"), F.col("text").alias("text_b"))
    both = common.lookup(common.lookup(pairs.select("a", "b"), b, "b", "a"), a, "a", "b", like=pairs).select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_verifier(k, percent), "a long, b long")


def _stars(edges: DataFrame) -> DataFrame:
    """Fewer edges (a, b) with the same components: of the neighbours of a the smallest stands for it and for the others.
    An a has at most one b a band, so no window is large; a family whose members meet the same few b becomes a star."""
    first = F.min("b").over(Window.partitionBy("a"))
    return edges.groupBy("a").agg(F.min("b").alias("b")).union(edges.select(F.col("b").alias("a"), first.alias("b")).filter("a <> b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that each node of the edges (a, b) reaches."""
    both = common.cut(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "near-graph")
    labels = common.cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "near-labels")
    while True:
        around = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near"))
        lower = labels.join(around, F.col("node") == F.col("n")).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        to = labels.select(F.col("node").alias("up"), F.col("label").alias("jump"))
        step = lower.join(to, F.col("label") == F.col("up"), "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label"))
        step = common.cut(step, "near-labels")
        if not step.filter("label <> old").limit(1).count():
            return step.select("node", "label")
        labels = step.select("node", "label")


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` written with a key of each row, and the key's name."""
    (key,) = common.free(docs.columns, "__fl_row")
    return common.cut(docs.withColumn(key, F.monotonically_increasing_id()), "near-rows"), key


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    return _decided(*_numbered(docs.select("doc_id", "text")), **options).drop("row")


def _decided(docs: DataFrame, key: str, k: int = 5, percent: int = 80, n_bands: int = BANDS, rows: int = ROWS, rounds: int = ROUNDS) -> DataFrame:
    """row, doc_id, n_shingles, component_id, kept for ``_numbered`` docs. ``rounds`` is 1 or more."""
    common.ship(docs.sparkSession)
    docs = docs.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    sketched = common.cut(
        docs.mapInArrow(_sketcher(k, n_bands, rows), "row long, doc_id long, n_shingles long, same binary, bands array<long>"), "near-sketches"
    )
    docs = docs.select("row", "text")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = sketched.filter("same IS NOT NULL").groupBy("same").agg(first.alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    classes = common.cut(classes.withColumn("rep", F.col("first.row")), "near-classes")
    buckets = classes.select("rep", "n", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo < hi").select("key")
    open_ = common.cut(buckets.join(shared, "key").select("key", "rep", "n", F.col("n").alias("c"), F.lit(0.0).alias("w"), F.col("rep").alias("comp")), "near-buckets")
    label = None  # class -> component, for classes with a link
    tested = None
    for r in range(rounds + 1):
        if not open_.limit(1).count():
            break
        x = open_.select("key", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("c").alias("mx"), F.col("comp").alias("cx"))
        may = (100 + percent) * F.least("mx", "my") >= percent * (F.col("nx") + F.col("ny"))
        if r < rounds:  # one member against the others
            chance = F.pmod(F.xxhash64("rep", F.lit(r)), F.lit(1 << 20)) / float(1 << 20)
            order = F.when(F.col("w") == 0, chance).otherwise(-F.col("w") * (1 + 0.1 * (r - PRUNE) * chance))
            hub = open_.groupBy("key").agg(F.min(F.struct(order.alias("h"), "rep", "n", "c", "comp")).alias("hub"))
            hub = common.cut(hub.select("key", F.col("hub.rep").alias("y"), F.col("hub.n").alias("ny"), F.col("hub.c").alias("my"), F.col("hub.comp").alias("cy")), "near-hubs")
            pairs = x.join(common.small(hub, hub.count()), "key").filter((F.col("cx") != F.col("cy")) & may)
        else:  # the pairs of different components that are left
            pairs = _rest(open_, rest, percent)
        pairs = pairs.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.min("x").alias("a"))
        if tested is not None:
            pairs = pairs.join(tested, ["lo", "hi"], "left_anti")
        pairs = common.cut(pairs.select("a", F.when(F.col("a") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("b")), "near-pairs")
        met = pairs.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
        tested = met if tested is None else tested.union(met)
        edges = common.cut(verified(pairs, docs, k, percent), "near-links")
        if r < rounds:
            edges = _stars(edges)
        if label is not None:
            comp = label.select("node", "label")
            edges = (
                edges.join(comp.toDF("a", "la"), "a", "left")
                .join(comp.toDF("b", "lb"), "b", "left")
                .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
                .filter("a <> b")
            )
        fresh = components(edges)
        if label is None:
            label = fresh
        else:  # old labels move with their component; classes met for the first time are added
            moved = label.join(fresh.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            label = common.cut(moved.union(fresh.join(label, "node", "left_anti").select("node", "label")), "near-classes-linked")
        if r == rounds:
            break
        now = open_.drop("comp").join(label.toDF("rep", "l"), "rep", "left").withColumn("comp", F.coalesce("l", "rep")).drop("l")
        open_ = _undecided(now)
        if r == min(PRUNE, rounds) - 1 and open_.limit(1).count():
            open_, rest = _able(open_, docs, k, percent)
    found = classes.select("same", "rep", "first")
    if label is not None:
        linked = label.join(classes.select("rep", "first"), F.col("node") == F.col("rep")).select("node", "label", "first")
        lead = linked.groupBy("label").agg(F.min("first").alias("lead"))
        linked = linked.drop("first").join(lead, "label").select("node", "lead")
        found = found.join(linked, F.col("rep") == F.col("node"), "left").select("same", F.coalesce("lead", "first").alias("first"))
    found = common.cut(found.select("same", F.col("first.doc_id").alias("c"), F.col("first.row").alias("stays")), "near-found")
    plain = sketched.select("row", "doc_id", "n_shingles", "same")
    out = plain.join(found, "same").select("row", "doc_id", "n_shingles", F.col("c").alias("component_id"), (F.col("row") == F.col("stays")).alias("kept"))
    empty = plain.filter("same IS NULL").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(empty)


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each group (of the smallest doc_id), all columns kept."""
    rows, key = _numbered(docs)
    gone = _decided(rows, key, **options).filter(~F.col("kept")).select(F.col("row").alias(key))
    gone = common.cut(gone, "near-gone")
    return rows.join(common.small(gone, gone.count()), key, "left_anti").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_dedup(common.table(spark, sf_dir, "documents").select("doc_id", "text"), k=2)


#: All pairs that share a shingle, their exact similarity, and the smallest id that each reaches.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(doc_id, c) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT g.b, r.c FROM reach r JOIN g ON g.a = r.doc_id WHERE r.c < g.b
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, m.component_id = w.doc_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT doc_id, min(c) AS component_id FROM reach GROUP BY 1) m ON m.doc_id = w.doc_id
"""
