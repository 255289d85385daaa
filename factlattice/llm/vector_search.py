"""Approximate nearest neighbours by robust-pruned directed graphs, one per shard.

Vectors that are equal form one class; its smallest vec_id stands for it in the graph, and results are
expanded to members afterwards, so a vector that a third of all rows repeat is one node. Classes are
dealt to shards by hash; per shard a graph is built once and written: nodes are inserted in random
order, a greedy beam search from fixed entry points proposes neighbours, robust pruning (a candidate goes
if a kept neighbour is nearer to it by the factor ``ALPHA``) keeps diverse edges, and edges are made
mutual. Largest inner product is searched as smallest distance after adding a coordinate that gives all
vectors one length. Queries are packed into blocks, and each block is sent to every shard, where it
beam-searches the graph that comes before it in the stream; scores are inner products of the original
vectors in double precision, and the best over all shards are kept.

Memory per task: one shard (at most ``SHARD`` vectors and ``SHARD_BYTES``) and one block of queries; a
task searches a shard for ``LANE`` blocks. Defined results: vectors that are null, empty, zero, or hold a
null or non-finite component take no part, neither as queries nor as candidates; vectors of another
length than the commonest (of equally common ones the shortest) don't either; ties go to the smaller
vec_id; rows that repeat a vec_id and its vector count once, of a vec_id with several vectors the best score
counts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SHARD, SHARD_BYTES = 16_384, 32 << 20
DEGREE, BEAM, BEAM_QUERY, ALPHA = 24, 48, 96, 1.2
ENTRIES = 24
#: Queries in a block, and blocks that one task searches a shard for.
QUERY_BLOCK, LANE = 4_096, 8


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int, width: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and squared distances (less |q|**2) of the ``beam`` nearest nodes found, for a block of
    queries. edges: (n, degree), -1 where there is none."""
    m, n = len(q), len(x)
    norm = (x * x).sum(1)
    seen = np.zeros((m, n + 1), dtype=bool)
    seen[:, n] = True
    ids = np.full((m, beam), n)
    dist = np.full((m, beam), np.inf, dtype=np.float32)
    done = np.ones((m, beam), dtype=bool)
    fresh = np.tile(entries, (m, 1))
    rows = np.arange(m)[:, None]
    while True:
        fresh = np.where(seen[rows, fresh], n, fresh)
        fresh.sort(1)  # the same node twice among them counts once
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = n
        seen[rows, fresh] = True
        at = np.minimum(fresh, n - 1)
        d = norm[at] - 2 * np.einsum("mkd,md->mk", x[at], q)
        d = np.where(fresh == n, np.inf, d).astype(np.float32)
        ids, dist = np.concatenate([ids, fresh], 1), np.concatenate([dist, d], 1)
        done = np.concatenate([done, fresh == n], 1)
        top = np.argsort(dist, 1, kind="stable")[:, :beam]
        ids, dist, done = ids[rows, top], dist[rows, top], done[rows, top]
        first = np.argsort(done, 1, kind="stable")[:, :width]
        open_ = ~done[rows, first]
        if not open_.any():
            return ids, dist
        done[rows, first] = True
        fresh = np.where(open_[:, :, None], edges[np.minimum(ids[rows, first], n - 1)], -1).reshape(m, -1)
        fresh = np.where(fresh < 0, n, fresh)


def robust_prune(x: np.ndarray, node: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most ``degree`` candidates, nearest first, none much nearer to one kept before it."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != node)])
    v = x[candidates]
    d = ((v - x[node]) ** 2).sum(1)
    order = np.argsort(d, kind="stable")
    candidates, v, d = candidates[order], v[order], d[order]
    between = ((v * v).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * v @ v.T) * (alpha * alpha)
    alive = np.ones(len(candidates), dtype=bool)
    kept = []
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= between[i] > d
    return candidates[kept]


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Edges (n, 2 * degree) and entry points of the graph over the rows of x."""
    n, most = len(x), 2 * degree
    order = np.random.default_rng(n).permutation(n)
    edges = np.full((n, most), -1)
    used = np.zeros(n, dtype=int)
    middle = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    entries = np.unique(np.r_[middle, order[:ENTRIES]])
    done, step = 0, 32
    while done < n:
        batch = order[done : done + step]
        near, _ = beam_search(x, edges, entries, x[batch], beam)
        near[near == n] = -1
        inside = x[batch] @ x[batch].T * -2 + (x[batch] ** 2).sum(1)[None, :]  # nodes of one batch may meet too
        peers = batch[np.argsort(inside, 1)[:, : degree // 2]]
        for node, found in zip(batch.tolist(), np.concatenate([near, peers], 1)):
            kept = robust_prune(x, node, np.r_[found, edges[node]], degree, alpha)
            edges[node] = -1
            edges[node, : len(kept)] = kept
            used[node] = len(kept)
            for other in kept.tolist():
                if (edges[other] == node).any():
                    continue
                if used[other] == most:
                    fewer = robust_prune(x, other, np.r_[edges[other], node], degree, alpha)
                    edges[other] = -1
                    edges[other, : len(fewer)] = fewer
                    used[other] = len(fewer)
                else:
                    edges[other, used[other]] = node
                    used[other] += 1
        done += len(batch)
        step = min(1024, max(32, done // 2))
    return edges, entries


def _lifted(vectors: np.ndarray) -> np.ndarray:
    """The vectors in single precision, with a coordinate more that gives all one length."""
    length = np.sqrt((vectors * vectors).sum(1))
    scale = length.max()
    return np.column_stack([vectors, np.sqrt(np.maximum(scale**2 - length**2, 0))]).astype(np.float32) / np.float32(scale)


class Shard:
    """A shard's classes (ids and vectors) and the graph over them."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, graph: tuple[np.ndarray, np.ndarray] | None = None):
        self.ids, self.vectors, self.x = ids, vectors, _lifted(vectors)
        self.edges, self.entries = build_graph(self.x) if graph is None else graph

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, beam: int = BEAM_QUERY) -> pd.DataFrame:
        """For each query the k classes with the largest inner products found."""
        n = len(self.ids)
        q = queries / np.sqrt((queries * queries).sum(1, keepdims=True))
        q = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        out = []
        for s in range(0, len(q), 256):
            near, _ = beam_search(self.x, self.edges, self.entries, q[s : s + 256], min(max(beam, 2 * k), n))
            exact = np.einsum("mkd,md->mk", self.vectors[np.minimum(near, n - 1)], queries[s : s + 256])
            exact = np.where(near == n, -np.inf, exact)
            best = np.argsort(-exact, 1, kind="stable")[:, :k]
            rows = np.arange(len(best))[:, None]
            frame = pd.DataFrame({"query_id": np.repeat(qids[s : s + 256], best.shape[1]), "rep": self.ids[np.minimum(near[rows, best], n - 1)].ravel(), "score": exact[rows, best].ravel()})
            out.append(frame[np.isfinite(frame.score)])
        return pd.concat(out)


_PACKED = "ids binary, vectors binary, edges binary, entries binary"


def _packed(ids: pd.Series, vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(ids.to_numpy(), kind="stable")
    return ids.to_numpy(dtype=np.int64)[order], np.stack(vectors.to_numpy()).astype(np.float64)[order]


def _build(key, points: pd.DataFrame) -> pd.DataFrame:
    own = Shard(*_packed(points.rep, points.vec))
    return pd.DataFrame({"shard": [key[0]], "ids": [own.ids.tobytes()], "vectors": [own.vectors.tobytes()], "edges": [own.edges.astype(np.int32).tobytes()], "entries": [own.entries.astype(np.int32).tobytes()]})


def _pack(key, queries: pd.DataFrame) -> pd.DataFrame:
    ids, vectors = _packed(queries.vec_id, queries.vec)
    return pd.DataFrame({"block": [key[0]], "ids": [ids.tobytes()], "vectors": [vectors.tobytes()], "edges": [None], "entries": [None]})


def _searcher(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, of = None, -1
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=np.int64)
                vectors = np.frombuffer(row["vectors"], dtype=np.float64).reshape(len(ids), -1)
                if row["block"] < 0:  # a graph comes before its blocks
                    edges = np.frombuffer(row["edges"], dtype=np.int32).reshape(len(ids), -1)
                    shard, of = Shard(ids, vectors, (edges, np.frombuffer(row["entries"], dtype=np.int32))), row["shard"]
                elif row["shard"] == of:  # else no vector was dealt to this shard
                    yield pa.RecordBatch.from_pandas(shard.search(ids, vectors, k), preserve_index=False)

    return common.tidy(run)


def nearest(vectors: DataFrame, is_query, k: int = 20, shard: int = SHARD) -> DataFrame:
    """vectors: vec_id, embedding. Result: query_id, rank, vec_id, score."""
    common.ship(vectors.sparkSession)
    v = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda e: F.when(e == 0, F.lit(0.0)).otherwise(e)).alias("vec")
    )
    sound = F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("vec", lambda e: e != 0)
    rows = rows.filter(sound).dropDuplicates(["vec_id", "vec"]).withColumn("size", F.size("vec"))
    rows = common.cut(rows, "ann-rows")
    sizes = rows.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    kind = "query_id long, rep long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.col("size") == sizes["size"]).drop("size")
    classes = common.cut(rows.groupBy("vec").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("members")), "ann-classes")
    n = classes.count()
    shards = math.ceil(n / min(shard, max(1, SHARD_BYTES // (8 * sizes["size"]))))
    points = classes.select("rep", "vec", F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(shards)).cast("int").alias("shard"))
    graphs = common.cut(points.repartition(4 * shards, "shard").groupBy("shard").applyInPandas(_build, "shard int, " + _PACKED), "ann-graphs")
    queries = rows.filter(is_query)
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    dealt = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.lit(blocks)).cast("int"))
    asked = common.cut(dealt.groupBy("block").applyInPandas(_pack, "block int, " + _PACKED), "ann-queries")
    # Query blocks meet shards: a block is sent to each shard, a graph once to each of its lanes.
    lanes = math.ceil(blocks / LANE)
    asked = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("lane", F.floor(F.col("block") / LANE).cast("int"))
    sent = graphs.withColumn("block", F.lit(-1)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    met = sent.unionByName(asked.select(*sent.columns)).repartition(4 * shards * lanes, "shard", "lane").sortWithinPartitions("shard", "lane", "block")
    found = met.select("shard", "block", "ids", "vectors", "edges", "entries").mapInArrow(_searcher(k + 1), kind)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "rep")
    found = common.cut(found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1).drop("r"), "ann-found")
    # Members of classes: of many equal vectors the k + 1 smallest ids are all that any result can hold.
    many = classes.filter("members > 1").select("vec", "rep")
    own = Window.partitionBy("rep").orderBy("vec_id")
    members = rows.join(common.small(many, many.count(), 64 + 8 * sizes["size"]), "vec").withColumn("r", F.row_number().over(own)).filter(F.col("r") <= k + 1)
    members = common.cut(members.select(F.col("rep").alias("m_rep"), "vec_id"), "ann-members")
    every = found.join(members, F.col("rep") == F.col("m_rep"), "left").select("query_id", F.coalesce("vec_id", "rep").alias("vec_id"), "score")
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    every = every.filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
    return every.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
