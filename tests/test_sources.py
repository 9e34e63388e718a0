"""Documents by id, archives of pages, and summaries of frequent keys."""

import gzip
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.operators import heavy
from quarry.sources import archive, store

PAGES = [
    (1, "http://a.b/c?d=1", "<p>é 漢</p>"), (2, None, ""), (None, "http://x/", None), (3, "http://a\r\nb/", "WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\n"), (4, "", "\r\n\r\n" * 3),
    *((k, f"http://p/{k}", "<p>" + "text " * (k % 50)) for k in range(5, 400)),
]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("zipped", [False, True])
def test_archive_comes_back(spark, tmp_path, zipped):
    df = spark.createDataFrame(PAGES, archive.SCHEMA).repartition(2)
    path = str(tmp_path / "pages")
    archive.write_archive(df, path, zipped)
    want = sorted(((i, u and u.replace("\r\n", ""), h) for i, u, h in PAGES), key=str)
    for split in (777, 1 << 20):
        got = archive.read_archive(spark, path, split)
        assert plain(got) == want
        assert plain(archive.read_archive(spark, f"file:{path}", split)) == want
    if not zipped:
        assert archive.read_archive(spark, path, 777).rdd.getNumPartitions() > 20
    (tmp_path / "none").mkdir()
    assert archive.read_archive(spark, str(tmp_path / "none")).count() == 0


def test_records_of_other_writers(spark, tmp_path):
    record = b"WARC/1.0\r\nContent-Type: text/html\r\nWARC-Target-URI: http://q/\r\ncontent-length:  4\r\n\r\n\xff<p>\r\n\r\n"
    (tmp_path / "one.warc").write_bytes(record * 3)
    (tmp_path / "two.warc.gz").write_bytes(gzip.compress(record) * 2)  # each record a member of its own
    (tmp_path / "_SUCCESS").write_bytes(b"x")
    got = archive.read_archive(spark, str(tmp_path), 50).collect()
    assert [tuple(r) for r in got] == [(None, "http://q/", "�<p>")] * 5


def test_archive_as_a_stream(spark, tmp_path):
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run():
        archive.stream_archive(spark, path, 500).writeStream.option("checkpointLocation", checkpoint).trigger(once=True).format("parquet").start(out).awaitTermination()
        return sorted(r.page_id for r in spark.read.parquet(out).collect())

    for k in range(2):
        archive.write_archive(spark.createDataFrame([(10 * k + i, "u", "h") for i in range(5)], archive.SCHEMA).coalesce(1), f"{path}{k}")
    (tmp_path / "in").mkdir()
    for k in range(2):
        for f in (tmp_path / f"in{k}").glob("part-*"):
            f.rename(tmp_path / "in" / f"{k}-{f.name}")
        assert run() == sorted(10 * j + i for j in range(k + 1) for i in range(5))


def test_lookups_read_little(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ROW_GROUP", 64 * 1024)
    r = random.Random(1)
    rows = [(k * 7, f"{r.random()} " * 40, None) for k in range(6000)]
    r.shuffle(rows)
    kept = store.build_store(spark.createDataFrame(rows, "doc_id long, text string, lang string"), str(tmp_path / "store"))
    wanted = spark.createDataFrame([(700,), (700,), (5,), (None,)], "doc_id long")
    got = kept.fetch(wanted)
    assert plain(got) == [x for x in rows if x[0] == 700] and kept.fetch(wanted, ["text"]).columns == ["doc_id", "text"]
    assert "In(doc_id" in got._jdf.queryExecution().toString()

    def read(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().collectLeaves().apply(0).metrics().apply("numOutputRows").value()

    # one row group of several holds the id
    assert read(kept.rows.where("doc_id in (700)")) < 2000
    monkeypatch.setattr(store, "MOST_LOOKED_UP", 1)
    assert plain(kept.fetch(spark.createDataFrame([(700,), (707,)], "doc_id long"))) == sorted((x for x in rows if x[0] in (700, 707)), key=str)
    assert kept.fetch(wanted.limit(0)).count() == 0


@pytest.mark.parametrize("counters", [5, 20, 1000])
def test_frequent_keys_are_in_the_summary(spark, counters):
    r = random.Random(counters)
    batches = [[f"k{int(r.paretovariate(0.7)) % 300}" for _ in range(3000)] + [None] * 5 for _ in range(3)]
    frames = [spark.createDataFrame([(x,) for x in b], "q string").repartition(3) for b in batches]
    whole = heavy.merged([heavy.summarise(f, "q", counters) for f in frames])
    true = Counter(x for b in batches for x in b if x)
    held = {x.key: x.n for x in whole.rows.collect()}
    assert len(held) <= counters and whole.total == 9000
    assert whole.lost <= 9000 * 3 / (counters + 1)
    assert all(true[k] - whole.lost <= held.get(k, 0) <= true[k] for k in true)
    share = max(0.02, 1.01 * whole.lost / 9000)
    every = frames[0].unionByName(frames[1]).unionByName(frames[2])
    assert {(x.key, x["count"]) for x in heavy.frequent(every, "q", whole, share).collect()} == {(k, n) for k, n in true.items() if n >= share * 9000}
    if whole.lost:
        with pytest.raises(ValueError, match="cannot tell"):
            heavy.candidates(whole, whole.lost / 9000)
    nothing = heavy.summarise(frames[0].limit(0), "q", counters)
    assert nothing.total == 0 and heavy.merged([nothing, whole]).lost == whole.lost
