"""The layered graph and its table, against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions.beams import mend, reached, spread_out, squares, walk
from quarry.operators import graph_index as g


def recall(x, k=20, asked=80):
    r = np.random.default_rng(1)
    x = g._unit(x)
    entries = g.entries_of(x)
    layers = g.build_layers(x, np.floor(-np.log(r.random(len(x))) / np.log(g.LINKS)).astype(int), entries)
    queries = r.choice(len(x), asked, replace=False)
    found = g.settled(x, layers, entries, x[queries], k)
    hits = 0
    for q, (best, _) in zip(queries, found, strict=True):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(1)
        hits += (d[best] <= np.sort(d)[k - 1]).sum()
    return hits / (k * asked), np.mean([n for _, n in found]) / len(x)


def clusters(r, many, each, noise, size=64):
    centers = r.normal(size=(many, size))
    centers /= np.linalg.norm(centers, axis=1, keepdims=True)
    return np.concatenate([c + noise * r.normal(size=(each, size)) for c in centers])


@pytest.mark.parametrize(("many", "each", "noise"), [(20, 150, 0.001), (6, 500, 0.01), (6, 500, 0.001), (300, 10, 0.01)])
def test_clustered_vectors(many, each, noise):
    found, share = recall(clusters(np.random.default_rng(0), many, each, noise))
    assert found >= 0.95 and share < 0.5


def test_even_vectors():
    assert recall(np.random.default_rng(0).normal(size=(3000, 64)))[0] >= 0.95
    assert recall(np.random.default_rng(0).normal(size=(1500, 384)), asked=40)[0] >= 0.95


def test_all_nodes_are_reached():
    r = np.random.default_rng(3)
    x = clusters(r, 8, 60, 0.001).astype(np.float32)
    edges = np.full((len(x), 2), -1, np.int32)
    edges[:, 0] = (np.arange(len(x)) + 1) % 60 + np.arange(len(x)) // 60 * 60  # a ring in each cluster, none between them
    assert reached(edges, np.array([0])).sum() == 60
    mended = mend(x, edges, np.arange(len(x)), np.array([0]))
    assert reached(mended, np.array([0])).all() and (np.isin(edges[edges >= 0], mended)).all()
    assert all(set(a[a >= 0]) <= set(b[b >= 0]) for a, b in zip(edges, mended, strict=True))


def test_neighbours_lie_apart():
    x = np.array([[0, 0], [1, 0], [1.1, 0], [1.2, 0], [0, 3], [-5, 0]], np.float32)
    assert spread_out(x, np.array([0]), np.array([[1, 2, 3, 4, 5, 0, 1]]), 3).tolist() == [[1, 4, 5]]
    assert spread_out(x, np.array([0]), np.array([[1, 2, 3, 4, 5, -1]]), 4).tolist() == [[1, 4, 5, 2]]
    ids, far, met = walk(x, np.full((6, 2), -1, np.int32), x[:1], np.array([[3, 3, -1]]), 4)
    assert ids[0].tolist() == [3, -1, -1, -1] and met[0] == 1 and far[0, 0] == pytest.approx(1.44)
    assert np.isinf(squares(x, np.array([[-1]]), x[:1])).all()


def exact(rows, q, k):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    return [i for _, i in sorted((-round(float(unit(v) @ unit(q)), 9), i) for i, v in rows)[:k]]


def test_search_over_shards(spark, monkeypatch):
    monkeypatch.setattr(g, "SHARD_GROWTH", 1)
    r = np.random.default_rng(4)
    x = clusters(r, 12, 60, 0.05, 16)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, x[5].tolist()) for i in range(30)]
    odd = [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0] * 3), (None, [1.0] * 16), (3004, [None] * 16)]
    vectors = spark.createDataFrame(rows + odd, "doc_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("shard", "node", "center", "place")})
    index = g.build(vectors, shard=40)
    assert len(index.centers) == 18 and index.nodes.count() == 720
    asked = [(i, rows[i][1]) for i in range(0, 720, 24)] + [(5, x[5].tolist()), (9000, None), (9001, [0.0] * 16)]
    found, report = g.search(index, spark.createDataFrame(asked, "query_id long, query_vector array<double>"), 20)
    got = {}
    for f in found.orderBy("query_id", "rank").collect():
        got.setdefault(f.query_id, []).append(f.doc_id)
    want = {q: exact(rows, v, 20) for q, v in asked if q < 9000}
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 20 * len(want)
    assert got[5] == want[5] and got[5][0] == 5 and got[5][1] == 2000  # copies come by id
    told = report.agg(F.avg("scored"), F.avg("shards")).first()
    assert told[0] < 0.5 * len(x) and told[1] < 9
    assert "PushedFilters: [In(shard" in index.nodes.where(F.col("shard").isin([1, 2]))._jdf.queryExecution().toString()
    with pytest.raises(ValueError, match="top_k"):
        g.search(index, vectors, 0)


def test_search_in_blocks(spark, monkeypatch):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist()) for i in range(90)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<float>")
    queries = vectors.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    index = g.build(vectors)
    whole = sorted(map(tuple, g.search(index, queries, 5)[0].collect()))
    monkeypatch.setattr(g, "QUERY_BLOCK", 10)
    assert sorted(map(tuple, g.search(index, queries, 5)[0].collect())) == whole and len(whole) == 450
    empty = g.build(vectors.limit(0))
    assert g.search(empty, queries, 5)[0].count() == 0


def test_checked_results_are_exact(spark, monkeypatch):
    """The exact pass finds what the graphs have missed, copies included, whatever the beams give."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(900, 48)), r.normal(size=(30, 48)) * 0.01 + r.normal(size=48) * 5])
    x = np.concatenate([x, x[:40]]).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, embedding array<float>")
    index = g.build(rows, shard=100)
    asked = rows.where("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "embedding AS query_vector")
    # beams that find anything but the nearest
    monkeypatch.setattr(g, "settled", lambda x, layers, entries, queries, k: [(np.arange(min(k, len(x))), k)] * len(queries))
    got = {}
    for t in g.search(index, asked, 10, probes=1, check=True)[0].collect():
        got.setdefault(t.query_id, {})[t.rank] = t.doc_id
    d = x.astype(float)
    s = d @ d.T / np.linalg.norm(d, axis=1)[:, None] / np.linalg.norm(d, axis=1)
    assert len(got) == len(d) // 10
    for q, found in got.items():
        assert [found[k] for k in range(1, 11)] == np.lexsort((np.arange(len(d)), -s[q].round(12)))[:10].tolist(), q
