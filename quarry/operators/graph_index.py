"""Approximate nearest vectors: shards around centers, and in each shard a layered small-world graph, kept as a table.

Vectors go to the shard of their nearest center. A node's highest layer is drawn from its id, each layer having a fraction of the
nodes of the one below; nodes are inserted layer by layer, linked to spread-out neighbours that a beam finds, and whatever
could not be reached is linked to its nearest node that can. Entries that lie far apart are in all layers. A search opens the shards of the nearest centers, walks down the
layers, and scores what the beam holds exactly. It widens until the best settle: the beam within a shard, then the number of shards.

The graph is a row for each node, sorted by shard, so that the filter on shards reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.beams import exact, link_back, mend, spread_out, walk
from quarry.sources.tables import fingerprint, keep, table

#: Links of a node (twice as many in the lowest layer) the beam while building, and that of the layers above the lowest.
LINKS, BUILD_BEAM, DESCENT = 16, 64, 48
#: Entries of a graph: at least, at most (between them the root of its size), and how many a beam starts from.
LEAST_ENTRIES, MOST_ENTRIES, ENTERED = 16, 256, 4
#: Vectors in a shard, at least, and for each square root of the number of vectors, so that centers grow with the root only.
SHARD, SHARD_GROWTH = 4096, 16
#: Vectors for each center from which centers are made, and all in all; rounds.
SAMPLE_EACH, SAMPLE_MOST, ROUNDS = 64, 100_000, 10
#: The narrowest beam of a search, shards opened at first, and queries that walk a graph in one task.
BEAM, PROBES, QUERY_BLOCK = 64, 2, 8192
#: Results have settled when a beam twice as wide changes one in so many at most; so often beams are widened.
SETTLED, WIDENED = 20, 3
#: The largest top_k, and so how many copies of a vector are kept.
MOST_RESULTS = 1000
#: What single precision may take from a score.
NEAR = 1e-5


@dataclass
class GraphIndex:
    nodes: DataFrame  # shard, node, doc_id, vector, entry, links: a row for each distinct vector
    copies: DataFrame  # doc_id of a node, copy: other documents with the same vector
    centers: np.ndarray
    shards: list[list[int]]  # of each center
    size: int


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _vectors(column: pd.Series, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, size)


def _centers(sample: np.ndarray, n: int) -> np.ndarray:
    """Centers of a sample of unit vectors, by rounds of averaging; farthest points first, so that far groups get their own."""
    centers = sample[:1]
    far = 1 - sample @ centers[0]
    while len(centers) < min(n, len(sample)):
        centers = np.concatenate([centers, sample[[int(far.argmax())]]])
        far = np.minimum(far, 1 - sample @ centers[-1])
    for _ in range(ROUNDS):
        of = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, of, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centers)
    return centers.astype(np.float32)


def entries_of(x: np.ndarray) -> np.ndarray:
    """Nodes that lie far apart, each the farthest from those before it: whatever groups the vectors form, the larger gaps are crossed here."""
    n = min(len(x), MOST_ENTRIES, max(LEAST_ENTRIES, int(len(x) ** 0.5)))
    out, far = [0], np.full(len(x), np.inf, np.float32)
    while len(out) < n:
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(1))
        out.append(int(far.argmax()))
    return np.unique(out)


def starts(x: np.ndarray, entries: np.ndarray, layers: list[np.ndarray], queries: np.ndarray) -> np.ndarray:
    """Where beams begin below `layers` (the lowest first): at the nearest entries, and at what beams find that walk down the layers from there."""
    d = (x[entries] ** 2).sum(1) - 2 * queries @ x[entries].T
    nearest = seeds = entries[np.argsort(d, axis=1, kind="stable")[:, :ENTERED]].astype(np.int32)
    for edges in reversed(layers):
        seeds, _, _ = walk(x, edges, queries, seeds, DESCENT)
    return np.concatenate([nearest, seeds], 1)


def build_layers(x: np.ndarray, levels: np.ndarray, entries: np.ndarray, links: int = LINKS) -> list[np.ndarray]:
    """The edges of each layer, the lowest first; a layer links the entries and the nodes whose level is at least its number.

    Entries are inserted first, then the nodes of the layers above, so that beams can start at what these find.
    """
    levels = levels.copy()
    levels[entries] = levels.max(initial=0) + 1
    order, layers = np.lexsort((np.arange(len(x)), -levels)), []
    for layer in range(int(levels.max()) - 1, -1, -1):
        members = order[levels[order] >= layer]
        edges = np.full((len(x), links * (2 if layer == 0 else 1)), -1, np.int32)
        for at in range(0, len(entries), 32):
            some = entries[at : at + 32]
            edges[some, :links] = spread_out(x, some, np.tile(entries, (len(some), 1)), links)
        above = int((levels[members] > layer).sum())
        for at, past in ((len(entries), above), (max(len(entries), above), len(members))):
            step = 1
            while at < past:
                points = members[at : min(at + step, past)]
                found, _, _ = walk(x, edges, x[points], starts(x, entries, layers if at >= above else [], x[points]), BUILD_BEAM)
                edges[points, :links] = spread_out(x, points, found, links)
                link_back(x, edges, points)
                at += step
                step = min(256, 2 * step)
        layers.insert(0, mend(x, edges, members, entries))
    return layers


def _built(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id", kind="stable").reset_index(drop=True)
        x = _unit(_vectors(pdf["vector"], size))
        entries = entries_of(x)
        layers = build_layers(x, pdf["level"].to_numpy(), entries)
        width = np.array([e.shape[1] for e in layers], np.int32)
        is_entry = np.isin(np.arange(len(x)), entries)
        # a node has the links of its layers one after the other, each with its width before it
        blobs = [b"".join(width[k : k + 1].tobytes() + e[i].tobytes() for k, e in enumerate(layers) if k <= level or is_entry[i]) for i, level in enumerate(pdf["level"])]
        return pd.DataFrame({"shard": pdf["shard"], "node": np.arange(len(pdf), dtype=np.int32), "doc_id": pdf["doc_id"], "vector": pdf["vector"], "entry": is_entry, "links": blobs})

    return run


def _layers_of(blobs: list[bytes]) -> list[np.ndarray]:
    layers: list[np.ndarray] = []
    for i, blob in enumerate(blobs):
        a, at, k = np.frombuffer(blob, np.int32), 0, 0
        while at < len(a):
            if k == len(layers):
                layers.append(np.full((len(blobs), a[at]), -1, np.int32))
            layers[k][i] = a[at + 1 : at + 1 + a[at]]
            at, k = at + 1 + a[at], k + 1
    return layers


def build(vectors: DataFrame, shard: int = SHARD) -> GraphIndex:
    """The graphs of (doc_id, embedding), written.

    Vectors that are null, zero or hold a null or a component that is not finite take no part, nor do those that have not the most frequent length (of two
    as frequent, the smaller). Of a repeated id the row with the smallest vector counts.
    """
    spark = vectors.sparkSession
    v = F.col("embedding").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), v.alias("v")).where("doc_id is not null and v is not null").where(F.coalesce(good, F.lit(False)))
    found = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = "shard int, node int, doc_id long, vector binary, entry boolean, links binary"
    if not found:
        return GraphIndex(spark.createDataFrame([], empty), spark.createDataFrame([], "doc_id long, copy long"), np.zeros((0, 0), np.float32), [], 0)
    size = found["d"]
    rows = rows.where(F.size("v") == size).groupBy("doc_id").agg(F.min("v").alias("v"))
    # a vector is a node once; its other documents are few rows each, found again by the node's id
    same = Window.partitionBy("v").orderBy("doc_id")
    rows = keep(rows.withColumn("place", F.row_number().over(same)).where(F.col("place") <= MOST_RESULTS).withColumn("first", F.min("doc_id").over(same)), "vectors")
    copies = keep(rows.where("place > 1").select(F.col("first").alias("doc_id"), F.col("doc_id").alias("copy")), "copies", by=("doc_id", "copy"))
    distinct = rows.where("place = 1").select("doc_id", "v")

    n = distinct.count()
    each = max(shard, int(SHARD_GROWTH * n**0.5))
    wanted = -(-n // each)
    sample = distinct.orderBy(F.xxhash64("doc_id"), "doc_id").limit(min(SAMPLE_EACH * wanted, SAMPLE_MOST)).collect()
    centers = _centers(_unit(np.array([r.v for r in sample])), wanted)
    told = spark.sparkContext.broadcast(centers)

    def place(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_list()) if len(pdf) else np.zeros((0, size))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "vector": [r.tobytes() for r in x], "center": (_unit(x) @ told.value.T).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32)})

    placed = keep(distinct.mapInPandas(place, "doc_id long, vector binary, center int"), "placed")
    # a center with many vectors has several shards
    plan, shards, past = [], [[] for _ in range(len(centers))], 0
    for center, held in sorted((r.center, r["count"]) for r in placed.groupBy("center").count().collect()):
        among = -(-held // (2 * each))
        shards[center] = list(range(past, past + among))
        plan.append((center, past, among))
        past += among
    plan = F.broadcast(spark.createDataFrame(plan, "center int, first int, among int"))  # a row for each center
    chance = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 40)) + 1) / F.lit(float((1 << 40) + 1))
    dealt = placed.join(plan, "center").select((F.col("first") + F.pmod(F.xxhash64("doc_id"), F.col("among"))).cast("int").alias("shard"), "doc_id", "vector", F.floor(-F.log(chance) / float(np.log(LINKS))).cast("int").alias("level"))
    nodes = keep(dealt.groupBy("shard").applyInPandas(_built(size), empty), "graph", by=("shard", "node"))
    return GraphIndex(nodes, copies, centers, shards, size)


def _walked(size: int, k: int):
    """Tasks of a search: the best `k` of a shard for each query that opens it."""

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "doc_id": [], "score": [], "scored": []}
        if len(graph) and len(asked):
            graph = graph.sort_values("node")
            v, ids = _vectors(graph["vector"], size), graph["doc_id"].to_numpy()
            x, norm = _unit(v), np.linalg.norm(v, axis=1)
            layers = _layers_of(graph["links"].to_list())
            entries = np.flatnonzero(graph["entry"].to_numpy())
            step = max(1, min(256, 50_000_000 // len(x)))
            for at in range(0, len(asked), step):
                some = asked.iloc[at : at + step]
                q = _vectors(some["vector"], size)
                unit = _unit(q)
                for row, (best, scored) in enumerate(settled(x, layers, entries, unit, k)):
                    score = (v[best] * q[row]).sum(1) / (norm[best] * np.linalg.norm(q[row]))
                    out["query_id"] += [some["query_id"].iloc[row]] * len(best)
                    out["doc_id"] += ids[best].tolist()
                    out["score"] += score.tolist()
                    out["scored"] += [scored] * len(best)
        return pd.DataFrame(out).astype({"query_id": "int64", "doc_id": "int64", "score": "float64", "scored": "int64"})

    return run


def settled(x: np.ndarray, layers: list[np.ndarray], entries: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, int]]:
    """For each query the nearest `k` nodes that a beam finds which is widened until they stay the same (but for one in SETTLED), and how many nodes were met.

    Where WIDENED times are not enough, or a beam would hold much of the graph, the query is held against all nodes.
    """
    width = max(BEAM, 2 * k)
    seeds = starts(x, entries, layers[1:], queries)
    found, _, met = walk(x, layers[0], queries, seeds, width)
    out = [(f[:k][f[:k] >= 0], int(m)) for f, m in zip(found, met, strict=True)]
    open_ = np.arange(len(queries))
    for _ in range(WIDENED):
        width *= 2
        if not len(open_) or width * 8 > len(x):
            break
        wider, _, met = walk(x, layers[0], queries[open_], np.concatenate([seeds[open_], found[open_][:, :k]], 1), width)
        again = []
        for i, f, m in zip(open_.tolist(), wider, met, strict=True):
            best = f[:k][f[:k] >= 0]
            if len(np.setdiff1d(best, out[i][0], assume_unique=True)) > k // SETTLED:
                again.append(i)
            out[i] = best, int(m)
        open_ = np.array(again, np.int64)
    for i, best in zip(open_.tolist(), exact(x, queries[open_], k) if len(open_) else [], strict=True):
        out[i] = best, len(x)
    return out


def _checked(size: int, k: int):
    """Tasks of the exact check: the vectors of a shard that score no less than a query's k-th result, for each query that the shard can hold one for."""

    def run(graph: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = [], [], []
        if len(graph) and len(asked):
            v, ids = _vectors(graph["vector"], size), graph["doc_id"].to_numpy()
            x, norm = _unit(v), np.linalg.norm(v, axis=1)
            middle = _unit(x.mean(0, dtype=np.float64)[None] + 1e-12)[0]
            reach = np.arccos(np.clip((x @ middle).min(), -1, 1))
            q, least, own = _vectors(asked["vector"], size), asked["least"].to_numpy() - NEAR, asked["query_id"].to_numpy()
            unit = _unit(q)
            # no vector of the shard is nearer to a query than its middle, by more than the shard reaches
            may = np.flatnonzero(np.cos(np.maximum(0, np.arccos(np.clip(unit @ middle, -1, 1)) - reach)) >= least - NEAR)
            step = max(1, 20_000_000 // len(x))
            for at in range(0, len(may), step):
                some = may[at : at + step]
                near = unit[some] @ x.T >= least[some, None]
                for row, i in enumerate(some.tolist()):
                    best = np.flatnonzero(near[row])
                    score = (v[best] * q[i]).sum(1) / (norm[best] * np.linalg.norm(q[i]))
                    order = np.lexsort((ids[best], -score))[:k]
                    out[0].append(np.full(len(order), own[i]))
                    out[1].append(ids[best][order])
                    out[2].append(score[order])
        joined = [np.concatenate(o) if o else [] for o in out]
        return pd.DataFrame(dict(zip(("query_id", "doc_id", "score"), joined, strict=True))).astype({"query_id": "int64", "doc_id": "int64", "score": "float64"})

    return run


def _dealt(nodes: DataFrame, opened: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and the queries that open their shards (query_id, shard), both with the block of queries that a task takes."""
    opened = opened.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)))
    load = {r.shard: -(-r["count"] // QUERY_BLOCK) for r in opened.groupBy("shard").count().collect()}
    blocks = F.create_map(*[F.lit(x) for s, n in load.items() if n > 1 for x in (s, n)]) if any(n > 1 for n in load.values()) else None
    among = F.coalesce(F.try_element_at(blocks, F.col("shard")), F.lit(1)) if blocks is not None else F.lit(1)
    graph = nodes.where(F.col("shard").isin(list(load))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), (among - 1).cast("long"))))
    return graph, opened.withColumn("block", F.pmod("block", among.cast("long")))


def search(index: GraphIndex, queries: DataFrame, top_k: int = 20, probes: int = PROBES, check: bool = False) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, doc_id, score) of the `top_k` nearest found for each (query_id, query_vector), by exact cosine, and a report
    (query_id, shards, scored): how many shards each query has opened, and how many vectors it was held against.

    Queries without a usable vector have no results. A query opens `probes` shards, then twice as many for as long as its results change.
    With `check`, an exact pass follows: results are then those of a full scan. It holds each query against the shards that may have a vector
    nearer than its last result; where vectors lie evenly spread that is all of them, and the work grows as queries times vectors.
    """
    spark = queries.sparkSession
    if not 0 < top_k <= MOST_RESULTS:
        raise ValueError(f"top_k must be 1 to {MOST_RESULTS}")
    found_schema = "query_id long, doc_id long, score double, scored long"
    if not index.shards:
        return spark.createDataFrame([], "query_id long, rank int, doc_id long, score double"), spark.createDataFrame([], "query_id long, shards long, scored long")
    v = F.col("query_vector").cast("array<double>")
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0) & (F.size("v") == index.size)
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), v.alias("v")).where(F.coalesce(good, F.lit(False))).dropDuplicates(["query_id"])
    told, size = spark.sparkContext.broadcast(index.centers), index.size

    def near(batches):
        for pdf in batches:
            x = np.stack(pdf["v"].to_list()) if len(pdf) else np.zeros((0, size))
            order = np.argsort(-(_unit(x) @ told.value.T), axis=1, kind="stable").astype(np.int32) if len(x) else []
            yield pd.DataFrame({"query_id": pdf["query_id"], "vector": [r.tobytes() for r in x], "centers": [o.tolist() for o in order]})

    open_ = keep(asked.mapInPandas(near, "query_id long, vector binary, centers array<int>"), "asked")
    asked_all = open_
    shards_of = F.array(*[F.array(*map(F.lit, s)).cast("array<int>") for s in index.shards])
    walked, before, low, high = None, None, 0, probes
    best_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    while True:
        opened = open_.select("query_id", "vector", F.explode(F.flatten(F.transform(F.slice("centers", low + 1, high - low), lambda c: F.get(shards_of, c)))).alias("shard"))
        graph, opened = _dealt(index.nodes, opened)
        got = graph.groupBy("shard", "block").cogroup(opened.groupBy("shard", "block")).applyInPandas(_walked(index.size, top_k), found_schema)
        got = got.withColumn("shards", F.lit(1).cast("long")) if walked is None else walked.unionByName(got.withColumn("shards", F.lit(1).cast("long")))
        walked = keep(got, "walked")
        now = walked.withColumn("place", F.row_number().over(best_first)).where(F.col("place") <= top_k).groupBy("query_id").agg(F.sort_array(F.collect_list("doc_id")).alias("best"))
        now = keep(now, "best")
        low, high = high, 2 * high
        if low >= len(index.centers):
            break
        if before is not None:
            changed = now.alias("n").join(before.alias("b"), "query_id", "left").where("b.best is null or n.best <> b.best").select("query_id")
            open_ = keep(open_.join(changed, "query_id", "left_semi"), "open")
            if open_.isEmpty():
                break
        before = now
    ids = walked.select("query_id", "doc_id", "score")
    if check:
        place = F.row_number().over(best_first)
        last = ids.withColumn("place", place).where(F.col("place") <= top_k).groupBy("query_id").agg(F.when(F.count("*") == top_k, F.min("score")).otherwise(F.lit(-2.0)).alias("least"))
        told_all = asked_all.join(last, "query_id", "left").select("query_id", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        every = [s for held in index.shards for s in held]
        graph, opened = _dealt(index.nodes.select("shard", "doc_id", "vector"), keep(told_all, "told").withColumn("shard", F.explode(F.array(*map(F.lit, every)))))
        ids = keep(graph.groupBy("shard", "block").cogroup(opened.groupBy("shard", "block")).applyInPandas(_checked(index.size, top_k), "query_id long, doc_id long, score double"), "checked")
    with_copies = ids.unionByName(ids.join(index.copies, "doc_id").select("query_id", F.col("copy").alias("doc_id"), "score"))
    ranked = with_copies.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= top_k)
    return ranked.select("query_id", "rank", "doc_id", "score"), walked.groupBy("query_id", "scored").agg(F.first("shards").alias("one")).groupBy("query_id").agg(F.sum("one").alias("shards"), F.sum("scored").alias("scored"))


_open: dict[tuple[str, str], tuple[tuple, GraphIndex]] = {}


def open_graph(spark: SparkSession, sf_dir: str) -> GraphIndex:
    """The graphs of the `embeddings` table, built at their first use in a session and again when the table's files have changed."""
    key, now = (spark.sparkContext.applicationId, sf_dir), fingerprint(spark, f"{sf_dir}/embeddings.parquet")
    if key not in _open or _open[key][0] != now:
        _open[key] = now, build(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"))
    return _open[key][1]
