"""The Bloom filter of visited pages, and streams whose state expires."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import crawl, visited
from quarry.streaming import jobs, keyed

from .test_streaming import at, plain, put


def urls(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("https://example.org/page/"), "id").alias("url"))


def test_no_key_is_missed_and_few_are_taken_for_known(spark):
    n = 60_000
    blocks = visited.blocks_for(n)
    parts = [visited.filled(urls(spark, k * n // 3, (k + 1) * n // 3), blocks) for k in range(3)]
    known = visited.merged(parts)
    assert known.rows.count() <= blocks
    assert visited.asked(urls(spark, 0, n), known).where("not maybe").count() == 0
    wrong = visited.asked(urls(spark, n, 3 * n), known).where("maybe").count() / (2 * n)
    assert 0 < wrong <= 0.001
    whole = visited.filled(urls(spark, 0, n), blocks)
    assert plain(known.rows) == plain(whole.rows)
    with pytest.raises(ValueError, match="sizes"):
        visited.merged([known, visited.filled(urls(spark, 0, 3), 7)])


def test_frontier_is_exact(spark, monkeypatch):
    seen = urls(spark, 0, 3000).unionByName(urls(spark, 0, 10))
    candidates = urls(spark, 2000, 9000).unionByName(urls(spark, 2500, 3500)).select("url", F.lit(1).alias("depth")).unionByName(spark.createDataFrame([("nonsense", 0), (None, 0), ("https://example.org/page/8000", 0)], "url string, depth int"))
    want = plain(crawl.frontier(candidates, seen))
    assert len(want) == 6000
    for blocks in (visited.blocks_for(3000), 1):  # overfull filters know everything, and the result is the same
        known = visited.filled(seen, blocks)
        assert plain(crawl.bloom_frontier(candidates, seen, known)) == want
    monkeypatch.setattr(visited, "MOST_BROADCAST", 5)
    assert plain(crawl.bloom_frontier(candidates, seen, visited.filled(seen, 20))) == want
    empty = visited.filled(seen.limit(0), 4)
    assert crawl.bloom_frontier(candidates, seen.limit(0), empty).count() == 7000


def test_first_seen_with_a_small_filter(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    steps = [["a", "b", "a", None], ["b", "c", None], ["c", "d", "a"]]
    for k, step in enumerate(steps):
        put(spark, [(x,) for x in step], "q string", source)
        got = jobs.first_seen(jobs.stream_of(spark, source, files_a_batch=1), F.col("q"), "q", folder, expected=2)
        assert plain(got) == sorted({(x,) for s in steps[: k + 1] for x in s}, key=str)


REPORTS = "worker_id long, id long, ts timestamp, status string"


def test_reports_expire(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "job")
    run = lambda: plain(keyed.alive_workers(jobs.stream_of(spark, source, files_a_batch=1), seconds=600, folder=folder))
    put(spark, [(1, 1, at(0), "idle"), (2, 2, at(3), "busy"), (1, 3, at(2), "busy"), (1, 4, at(2), "last of a minute")], REPORTS, source)
    put(spark, [(3, 5, at(9), "idle"), (2, 6, at(5), "idle"), (2, 7, at(4), "older")], REPORTS, source)
    assert run() == [(1, 4, at(2), "last of a minute"), (2, 6, at(5), "idle"), (3, 5, at(9), "idle")]
    put(spark, [(3, 8, at(13), "busy"), (4, 9, at(1), "too late")], REPORTS, source)
    assert run() == [(2, 6, at(5), "idle"), (3, 8, at(13), "busy")]  # from another start; 1 has expired, and 4 was never seen
    put(spark, [(1, 10, at(30), "back")], REPORTS, source)
    assert run() == [(1, 10, at(30), "back")]
    assert run() == [(1, 10, at(30), "back")]  # nothing new


def test_repeats_within_a_watermark(spark, tmp_path):
    source, folder, schema = str(tmp_path / "in"), str(tmp_path / "job"), "id long, ts timestamp"
    stream = lambda: jobs.stream_of(spark, source, files_a_batch=1)
    run = lambda: plain(keyed.without_repeats(stream(), ["id"], "ts", "10 minutes", schema, folder))
    put(spark, [(1, at(0)), (2, at(1)), (1, at(2))], schema, source)
    put(spark, [(2, at(5)), (3, at(6))], schema, source)
    assert [r[0] for r in run()] == [1, 2, 3]
    put(spark, [(3, at(8)), (4, at(40))], schema, source)
    put(spark, [(5, at(41))], schema, source)
    assert [r[0] for r in run()] == [1, 2, 3, 4, 5]
    put(spark, [(1, at(42))], schema, source)  # long after the first, which has left the state
    assert [r[0] for r in run()] == [1, 1, 2, 3, 4, 5]
    assert spark.conf.get(keyed._PROVIDER).endswith("HDFSBackedStateStoreProvider")
