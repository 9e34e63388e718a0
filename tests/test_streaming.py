"""Streams over several batches and restarts against the batch operators on the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from quarry.operators import index, suggest
from quarry.streaming import jobs

EVENTS = "id long, worker_id long, query string, ts timestamp, status string"


def at(minute):
    return dt.datetime(2024, 1, 1, 10 + minute // 60, minute % 60)


def event(i):
    return (i, i % 4, f" Key{i % 3} " if i % 5 else " ", at(i), "idle" if i % 2 else "processing")


def put(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def batches(spark, folder):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/checkpoint/commits")
    return len([f for f in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path) if not f.getPath().getName().startswith(".")])


def test_jobs_over_batches_and_a_restart(spark, tmp_path):
    source, rows = str(tmp_path / "events"), [event(i) for i in range(60)]
    for k in range(3):
        put(spark, rows[k * 10 : k * 10 + 10], EVENTS, source)
    stream = lambda: jobs.stream_of(spark, source, files_a_batch=1)
    folders = {n: str(tmp_path / n) for n in ("keywords", "seen", "status", "recent", "windows")}

    def run():
        return {
            "keywords": plain(jobs.keyword_counts(stream(), "query", folders["keywords"])),
            "seen": plain(jobs.first_seen(stream(), F.trim("query"), "q", folders["seen"])),
            "status": plain(jobs.last_status(stream(), folder=folders["status"])),
            "alive": plain(jobs.last_status(stream(), F.lit(at(60)), folder=folders["status"])),
            "recent": plain(jobs.recent(stream().select("id", "ts"), "id long, ts timestamp", ["ts", "id"], 7, folders["recent"])),
            "windows": [tuple(r)[::2] for r in plain(jobs.traffic_stream(stream(), "ts", "20 minutes", "1 hour", folders["windows"]))],
        }

    def want(rows):
        df = spark.createDataFrame(rows, EVENTS)
        last = {r[1]: (r[1], r[0], r[3], r[4]) for r in rows}
        windows = {}
        for r in rows:
            start = at(int((r[3] - at(0)).total_seconds()) // 1200 * 20)
            windows[start] = windows.get(start, 0) + 1
        return {
            "keywords": plain(suggest.keyword_counts(df, "query")),
            "seen": sorted({(r[2].strip(),) for r in rows}, key=str),
            "status": sorted(last.values(), key=str),
            "alive": sorted((x for x in last.values() if x[2] > at(59)), key=str),
            "recent": sorted(((r[0], r[3]) for r in rows[-7:]), key=str),
            "windows": sorted(windows.items(), key=str),
        }

    assert run() == want(rows[:30])
    assert batches(spark, folders["keywords"]) == 3
    assert run() == want(rows[:30])  # nothing new: nothing counts twice
    for k in range(3, 6):
        put(spark, rows[k * 10 : k * 10 + 10], EVENTS, source)
    assert run() == want(rows)  # from another start, as after a failure
    assert batches(spark, folders["keywords"]) == 6


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    log = jobs.BatchLog(spark, str(tmp_path / "log"), "k string, n long")
    assert log.read().count() == 0
    for number in (0, 1, 1):
        log.write(spark.createDataFrame([("a", number + 1)], "k string, n long"), number)
    assert sorted((r.n, r.batch) for r in log.read().collect()) == [(1, 0), (2, 1)]


def test_index_of_a_stream(spark, tmp_path):
    source, folder, schema = str(tmp_path / "docs"), str(tmp_path / "job"), "doc_id long, version long, text string"
    steps = [[(1, 1, "red bolt red"), (2, 1, "green nut")], [(2, 2, "red nut nut"), (2, 3, "blue nut"), (3, 1, None)], [(4, 1, "bolt ring"), (1, 4, "grey")], [(3, 2, "late word")]]
    last = {}
    for step in steps:
        put(spark, step, schema, source)
        i = jobs.indexed(jobs.stream_of(spark, source, files_a_batch=1), F.col("text"), ["version"], folder=folder)
        last |= {d: t for d, _, t in step}
        anew = index.build_index(spark.createDataFrame(list(last.items()), "doc_id long, text string"), F.col("text"))
        assert plain(i.postings) == plain(anew.postings) and plain(i.lengths) == plain(anew.lengths) and plain(i.stats) == plain(anew.stats)
        assert plain(i.terms.where("doc_frequency > 0")) == plain(anew.terms)
    assert batches(spark, folder) == 4


def test_documents_of_a_stream(spark, tmp_path):
    source, schema = str(tmp_path / "docs"), "doc_id long, url string, v long"
    for step in ([(1, "a", 1), (2, "b", 1), (3, None, 1)], [(4, "a", 2), (5, "a", 3)], [(6, "", 2), (7, "b", 0)]):
        put(spark, step, schema, source)
    got = plain(jobs.upserted(jobs.stream_of(spark, source, files_a_batch=1), schema, ["v"], str(tmp_path / "job")))
    # a later batch takes the place of an earlier one, whatever its order column says
    assert got == sorted([(3, None, 1), (5, "a", 3), (6, "", 2), (7, "b", 0)], key=str)
