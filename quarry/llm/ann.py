"""Nearest neighbours by inner product, over robust-pruned directed graphs, one for each shard.

Distinct vectors are dealt into shards by their length (to a factor of two) and then at random, so a shard's vectors are of
like magnitude, whatever outliers the table holds. A shard's graph is built in batches of points: a
greedy search from entry points that lie far apart proposes neighbours, and relaxed distance pruning keeps an edge only
if no kept neighbour is much nearer to its end than the point itself; edges are also added backwards and
pruned again where they are too many. What could not be reached from an entry in the end is linked from its nearest node that can. A query
walks the graph of each shard with a beam, which is widened until what it finds settles, or else meets all of the shard; what the beams hold is scored in double precision on the original vectors and merged.

Largest inner product becomes least distance by one more coordinate that gives all vectors of a shard
the same length, so vectors need not be normalised. Graphs are searched in single precision, after each shard and each query has
been divided by its largest component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.beams import mend, walk
from quarry.operators.graph_index import entries_of, settled, starts

from .common import store, table

#: Vectors in a shard, at least, and for each square root of the number of vectors (so that shards do not grow in number as the vectors do); edges from a point; width of the beams while building; how far pruning is relaxed; points added or searched at a time.
SHARD, SHARD_GROWTH, DEGREE, BUILD_BEAM, RELAX, BATCH = 16_000, 32, 28, 64, 1.2, 256
#: Queries in a block, at least; a block has as many queries as a shard has vectors, so that graphs are moved no more than queries are.
QUERY_BLOCK = 2048
#: More nodes than are asked for are scored in double precision, as single precision may tie them.
MORE = 4


class Graph:
    """A directed graph over the rows of `x`, searched with beams for many queries at once.

    Beams begin at the nearest of some nodes that lie far apart, and every node can be reached from these.
    """

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None, entries: np.ndarray | None = None):
        self.x = np.ascontiguousarray(x, np.float32)
        self.norm = (self.x * self.x).sum(1)
        self.edges = np.full((len(x), DEGREE), -1, np.int32) if edges is None else edges
        self.entries = entries_of(self.x) if entries is None else entries

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """Ids of the beams, nearest first; -1 where a beam is not full."""
        return walk(self.x, self.edges, queries, starts(self.x, self.entries, [], queries), beam)[0]

    def nearest(self, queries: np.ndarray, k: int) -> list[np.ndarray]:
        """The `k` nearest found for each query, by beams that are widened until they stay the same."""
        return [found for found, _ in settled(self.x, [self.edges], self.entries, queries, k)]

    def prune(self, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """At most DEGREE diverse neighbours of each point from its candidates (-1: none)."""
        c = np.where(candidates == points[:, None], -1, candidates)
        near = self.norm[c] + self.norm[points][:, None] - 2 * np.matmul(self.x[c], self.x[points][:, :, None])[:, :, 0]
        near[c < 0] = np.inf
        order = np.argsort(near, axis=1, kind="stable")
        c, near = np.take_along_axis(c, order, 1), np.take_along_axis(near, order, 1)
        alive = (c >= 0) & np.r_["1", np.ones((len(c), 1), bool), c[:, 1:] != c[:, :-1]]
        v, norm = self.x[c], self.norm[c]
        between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1))
        between *= np.float32(RELAX * RELAX)
        out = np.full((len(c), DEGREE), -1, np.int32)
        count = np.zeros(len(c), np.int64)
        for j in range(c.shape[1]):
            take = np.flatnonzero(alive[:, j] & (count < DEGREE))
            if len(take):
                out[take, count[take]] = c[take, j]
                count[take] += 1
                alive[take] &= between[take, j] > near[take]
                alive[take, j] = False
        return out

    def build(self, seed: int = 3) -> Graph:
        order = np.random.default_rng(seed).permutation(len(self.x))
        order = np.r_[self.entries, order[~np.isin(order, self.entries)]]
        for at in range(0, len(self.entries), 32):
            some = self.entries[at : at + 32]
            self.edges[some] = self.prune(some, np.tile(self.entries, (len(some), 1)))
        at, step = len(self.entries), 1
        while at < len(order):
            points = order[at : at + step]
            self.edges[points] = self.prune(points, np.concatenate([self.search(self.x[points], BUILD_BEAM), self.edges[points]], 1))
            self._backwards(points)
            at += step
            step = min(BATCH, 2 * step)
        self.edges = mend(self.x, self.edges, np.arange(len(self.x)), self.entries)
        return self

    def _backwards(self, points: np.ndarray) -> None:
        ends = self.edges[points]
        source = np.repeat(points, DEGREE)[ends.ravel() >= 0]
        target = ends.ravel()[ends.ravel() >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        width = int(count.max()) if len(count) else 0
        more = np.full((len(nodes), width), -1, np.int32)
        place = np.arange(len(target)) - np.repeat(first, count)
        more[np.repeat(np.arange(len(nodes)), count), place] = source
        both = np.concatenate([self.edges[nodes], more], 1)
        used = (both >= 0).sum(1)
        fits = used <= DEGREE
        packed = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :DEGREE]
        self.edges[nodes[fits]] = packed[fits]
        full = np.flatnonzero(~fits)
        for k in range(0, len(full), BATCH):
            some = full[k : k + BATCH]
            self.edges[nodes[some]] = self.prune(nodes[some], both[some])


def lifted(x: np.ndarray) -> np.ndarray:
    """`x`, scaled, with the coordinate that makes all rows equally long."""
    x = x / np.abs(x).max(initial=np.finfo(float).tiny)
    squares = (x * x).sum(1)
    return np.c_[x, np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0))].astype(np.float32)


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score) of the `k` nearest found for each id divisible by `query_every`.

    Vectors take no part if they or their ids are null, if they are zero, hold a null or a component that is not finite, or have not the
    most frequent length (of two as frequent, the smaller). Equal vectors tie and come by id; of a repeated id and vector, one row counts, and a query's own
    id is no candidate. With fewer than `k` candidates, all are given. An empty table gives no rows; other columns
    are not looked at.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(finite, F.lit(False)))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if not sizes:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.size("v") == sizes["d"]).dropDuplicates(["id", "v"])
    # of equal vectors, as many ids as could be among the nearest; the limit is applied before rows are exchanged
    few = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("place") <= k + 1)
    classes = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("_m", F.array_max(F.transform("v", lambda x: F.abs(x))))
    length = F.log2("_m") + F.log2(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / F.col("_m")) * (x / F.col("_m")))) / 2
    # vectors of length 1 are in the middle of their magnitude
    classes = store(classes.select("v", "ids", F.round(length).cast("int").alias("magnitude")), "vectors")
    # doubles have about 2100 magnitudes, so this is a bounded table
    sizes_by = {r.magnitude: r["count"] for r in classes.groupBy("magnitude").count().orderBy("magnitude").collect()}
    size = max(shard, int(SHARD_GROWTH * sum(sizes_by.values()) ** 0.5))
    plan, shards = [], 0
    for magnitude, n in sizes_by.items():
        plan.append((magnitude, shards, -(-n // size)))
        shards += -(-n // size)
    if not shards:
        return spark.createDataFrame([], schema)
    plan = spark.createDataFrame(plan, "magnitude int, first int, among int")
    dealt = classes.join(F.broadcast(plan), "magnitude").select("v", "ids", (F.col("first") + F.pmod(F.xxhash64(F.col("ids")[0]), F.col("among"))).cast("int").alias("shard"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda c: c.str[0], kind="stable")
        x = np.stack(pdf["v"].to_list())
        g = Graph(lifted(x)).build()
        counts = pdf["ids"].map(len).to_numpy()
        return pd.DataFrame([{"shard": key[0], "entries": g.entries.astype(np.int32).tobytes(), "edges": g.edges.tobytes(), "x": x.tobytes(), "ids": np.concatenate(pdf["ids"].to_list()).astype(np.int64).tobytes(), "counts": counts.astype(np.int64).tobytes()}])

    graphs = store(dealt.groupBy("shard").applyInPandas(build, "shard int, entries binary, edges binary, x binary, ids binary, counts binary"), "graphs")
    queries = store(rows.where(F.pmod("id", F.lit(query_every)) == 0), "queries")
    blocks = max(1, -(-queries.count() // max(size, QUERY_BLOCK)))
    blocked = queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def ask(key: tuple, graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(graph) and len(asked):
            g = graph.iloc[0]
            x = np.frombuffer(g["x"]).reshape(-1, sizes["d"])
            ids, counts = np.frombuffer(g["ids"], np.int64), np.frombuffer(g["counts"], np.int64)
            starts = np.cumsum(counts) - counts
            index = Graph(lifted(x), np.frombuffer(g["edges"], np.int32).reshape(len(x), -1), np.frombuffer(g["entries"], np.int32))
            for i in range(0, len(asked), BATCH):
                q = np.stack(asked["v"].iloc[i : i + BATCH].to_list())
                scaled = np.c_[q / np.abs(q).max(1, keepdims=True), np.zeros(len(q))]
                found = index.nearest(scaled.astype(np.float32), k + MORE)
                for own, f, vector in zip(asked["id"].iloc[i : i + BATCH], found, q, strict=True):
                    score = (x[f] * vector).sum(1)
                    mine = np.concatenate([ids[starts[j] : starts[j] + counts[j]] for j in f])
                    score = np.repeat(score, counts[f])
                    score, mine = score[mine != own], mine[mine != own]
                    best = np.lexsort((mine, -score))[:k]
                    out["query_id"] += [own] * len(best)
                    out["vec_id"] += mine[best].tolist()
                    out["score"] += score[best].tolist()
        return pd.DataFrame(out).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    # each block of queries meets each shard in a task of its own
    at_blocks = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = at_blocks.groupBy("shard", "block").cogroup(blocked.groupBy("shard", "block")).applyInPandas(ask, "query_id long, vec_id long, score double")
    found = found.dropDuplicates(["query_id", "vec_id", "score"])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_ann(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
