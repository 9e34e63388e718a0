"""Streaming twins of the batch operators. Each ends in a table, and each equals its batch form on the same rows.

A job keeps its checkpoint and what its batches had to tell in a folder that the caller names; started again on that folder, it goes
on where it stopped. A batch writes what is new, in a folder of its own, so its cost follows the batch and not all that came before; a batch
that is run again after a failure writes the same folder again. Readers fold the batches together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import keyword
from quarry.operators import index as ix
from quarry.operators import segments, visited
from quarry.operators.analytics import latest, worker_states
from quarry.sources.tables import working_dir


def stream_of(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """A Parquet table as a stream of its files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else reader.parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def job_folder(spark: SparkSession, folder: str | None) -> str:
    """Where a job keeps its state: the caller's folder, or one that lasts as long as the session."""
    return folder or f"{working_dir(spark)}/job-{uuid.uuid4().hex[:8]}"


def run_to_end(stream: DataFrame, update, folder: str, mode: str = "append") -> None:
    """Take all that is there, batch by batch, and stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint")
    writer.trigger(availableNow=True).foreachBatch(update).start().awaitTermination()


class BatchLog:
    """What each batch of a stream had to tell, as a table with the batch's number."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.schema, self.root = spark, f"{schema}, batch long", root

    def write(self, df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/batch={number}")

    def read(self) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.root)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.root)


def keyword_counts(stream: DataFrame, query: str, folder: str | None = None) -> DataFrame:
    """(keyword, count) as the stream has told it so far."""
    folder = job_folder(stream.sparkSession, folder)
    log = BatchLog(stream.sparkSession, f"{folder}/keywords", "keyword string, count long")

    def update(batch: DataFrame, number: int) -> None:
        log.write(batch.select(keyword(F.col(query)).alias("keyword")).where("keyword is not null").groupBy("keyword").agg(F.count("*").alias("count")), number)

    run_to_end(stream, update, folder)
    return log.read().groupBy("keyword").agg(F.sum("count").alias("count"))


def first_seen(stream: DataFrame, key: Column, name: str, folder: str | None = None, expected: int = 10_000_000) -> DataFrame:
    """Distinct keys of a stream (null is one of them).

    The stream itself has no state. What has been seen is known by a Bloom filter for `expected` keys, of which each batch writes its own part, and by
    the table of keys itself, which only the doubtful ones are looked up in; beyond that number more keys are doubtful, and the result is the same.
    """
    spark = stream.sparkSession
    folder = job_folder(spark, folder)
    log = BatchLog(spark, f"{folder}/seen", f"{name} string")
    marks = BatchLog(spark, f"{folder}/filter", "block long, " + ", ".join(f"{w} long" for w in visited.WORDS))
    blocks = visited.blocks_for(expected)

    def update(batch: DataFrame, number: int) -> None:
        # of a batch that is run again, what it wrote before does not count
        seen = log.read().where(F.col("batch") < number).select(name)
        known = visited.Bloom(blocks, marks.read().where(F.col("batch") < number).drop("batch"))
        rows = batch.select(key.cast("string").alias(name)).distinct()
        new = visited.unvisited(rows.where(F.col(name).isNotNull()), seen, known, name)
        if not rows.where(F.col(name).isNull()).isEmpty() and seen.where(F.col(name).isNull()).isEmpty():
            new = new.unionByName(rows.where(F.col(name).isNull()))
        log.write(new, number)
        marks.write(visited.filled(spark.read.schema(f"{name} string").parquet(f"{log.root}/batch={number}"), blocks, name).rows, number)

    run_to_end(stream, update, folder)
    return log.read().select(name)


def last_status(stream: DataFrame, now: Column | None = None, folder: str | None = None) -> DataFrame:
    """(worker_id, id, ts, status) of each worker's last report in the stream; with `now`, only those that have not expired."""
    folder = job_folder(stream.sparkSession, folder)
    log = BatchLog(stream.sparkSession, f"{folder}/status", "worker_id long, id long, ts timestamp, status string")

    def update(batch: DataFrame, number: int) -> None:
        log.write(latest(batch.select("worker_id", "id", "ts", "status"), ["worker_id"], [F.desc("ts"), F.desc("id")]), number)

    run_to_end(stream, update, folder)
    return worker_states(log.read().drop("batch"), now)


def upserted(stream: DataFrame, schema: str, order: list[str], folder: str | None = None) -> DataFrame:
    """The document table after every batch of the stream has been upserted by URL; rows without a URL are always added."""
    folder = job_folder(stream.sparkSession, folder)
    log = BatchLog(stream.sparkSession, f"{folder}/documents", schema)
    with_url = F.coalesce(F.col("url"), F.lit("")) != ""

    def update(batch: DataFrame, number: int) -> None:
        log.write(latest(batch.where(with_url), ["url"], [F.desc(c) for c in order]).unionByName(batch.where(~with_url)), number)

    run_to_end(stream, update, folder)
    rows = log.read()
    return latest(rows.where(with_url), ["url"], [F.desc("batch")]).unionByName(rows.where(~with_url)).drop("batch")


def indexed(stream: DataFrame, content: Column, order: list[str], tokeniser: str = "regex", folder: str | None = None) -> ix.Index:
    """The index of the documents that a stream brings (doc_id and what `content` needs): the last row of an id counts.

    Each batch is an upsert of a segmented index in the job's folder, so it costs what it holds; a batch that is run again after a failure
    finds itself in the saved index, or is done anew.
    """
    spark = stream.sparkSession
    folder = job_folder(spark, folder)

    def update(batch: DataFrame, number: int) -> None:
        index = segments.load(spark, f"{folder}/index")
        if index.batch < number and not batch.isEmpty():
            index.upsert(latest(batch, ["doc_id"], [F.desc(c) for c in order]), content, tokeniser).save(number)

    run_to_end(stream, update, folder)
    return segments.load(spark, f"{folder}/index").as_index()


def recent(stream: DataFrame, schema: str, order: list[str], n: int = 100, folder: str | None = None) -> DataFrame:
    """The last `n` rows of a stream. The cap is the list's contract."""
    folder = job_folder(stream.sparkSession, folder)
    log = BatchLog(stream.sparkSession, f"{folder}/recent", schema)
    last = lambda df: df.orderBy(*[F.desc(c) for c in order]).limit(n)
    run_to_end(stream, lambda batch, number: log.write(last(batch), number), folder)
    return last(log.read().drop("batch"))


def traffic_stream(stream: DataFrame, ts: str, length: str, late: str, folder: str | None = None) -> DataFrame:
    """Counts in tumbling windows as a stream has told them so far; rows that come later than `late` are let go (an extension)."""
    folder = job_folder(stream.sparkSession, folder)
    log = BatchLog(stream.sparkSession, f"{folder}/windows", "window_start timestamp, window_end timestamp, searches long")
    run_to_end(traffic(stream, ts, length, late=late), log.write, folder, "update")
    # a window that went on has a later row
    return latest(log.read(), ["window_start"], [F.desc("batch")]).drop("batch")


def traffic(events: DataFrame, ts: str, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts in tumbling or sliding windows; with `late`, rows that come later than that are let go (an extension)."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if late else events
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    return rows.groupBy(w.alias("w")).agg(F.count("*").alias("searches")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "searches")


def sessions(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """Sessions of each user, parted by a gap without events (an extension)."""
    s = F.session_window(ts, gap)
    return events.groupBy(user, s.alias("w")).agg(F.count("*").alias("searches")).select(user, F.col("w.start").alias("session_start"), "searches")
