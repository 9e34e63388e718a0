"""Streams whose state expires: last reports of workers under a timer, and repeats within a watermark.

State is kept by RocksDB, which the session must be told before the stream starts (`with_rocksdb`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quarry.operators.analytics import STATUS_SECONDS, latest
from quarry.streaming.jobs import BatchLog, job_folder, run_to_end

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_REPORT = "worker_id long, id long, ts timestamp, status string"


class Expiring(StatefulProcessor):
    """Keeps the last report of a worker until so many seconds of event time have passed since; tells of each newer report, and of its end."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "id long, micros long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = self.last.get() if self.last.exists() else None
        before = best
        for batch in rows:
            for i, ts, status in zip(batch["id"], batch["ts"], batch["status"], strict=True):
                found = (int(i), pd.Timestamp(ts).value // 1000, status)
                if best is None or (found[1], found[0]) > (best[1], best[0]):
                    best = found
        if best is None or best == before:
            return
        self.last.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[1] // 1000 + self.seconds * 1000)
        yield self._row(key, best, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists():
            last = self.last.get()
            if last[1] // 1000 + self.seconds * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
                self.last.clear()
                yield self._row(key, last, False)

    def _row(self, key, last, alive: bool) -> pd.DataFrame:
        return pd.DataFrame({"worker_id": [key[0]], "id": [last[0]], "ts": [pd.Timestamp(last[1] * 1000)], "status": [last[2]], "alive": [alive]})

    def close(self) -> None:
        pass


class with_rocksdb:
    """Streams that are started within keep their state in RocksDB; the session's setting is put back afterwards."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(_PROVIDER)
        self.spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def __exit__(self, *_) -> None:
        self.spark.conf.set(_PROVIDER, self.before)


def alive_workers(stream: DataFrame, late: str = "0 seconds", seconds: int = STATUS_SECONDS, folder: str | None = None) -> DataFrame:
    """(worker_id, id, ts, status) of the workers whose last report has not expired when the stream's watermark stands where it does.

    A worker's state is dropped when it expires, so the state holds those alive and no others. Rows that come later than `late` are let go.
    """
    spark = stream.sparkSession
    folder = job_folder(spark, folder)
    log = BatchLog(spark, f"{folder}/reports", f"{_REPORT}, alive boolean")
    told = stream.select("worker_id", "id", F.col("ts").cast("timestamp").alias("ts"), "status").withWatermark("ts", late)
    with with_rocksdb(spark):
        kept = told.groupBy("worker_id").transformWithStateInPandas(Expiring(seconds), f"{_REPORT}, alive boolean", "append", "eventTime")
        run_to_end(kept, log.write, folder)
    last = latest(log.read(), ["worker_id"], [F.desc("batch"), F.asc("alive")])
    return last.where("alive").select("worker_id", "id", "ts", "status")


def without_repeats(stream: DataFrame, keys: list[str], ts: str, late: str, schema: str, folder: str | None = None) -> DataFrame:
    """The rows of a stream, of those that repeat within `late` of each other the first; older keys leave the state."""
    spark = stream.sparkSession
    folder = job_folder(spark, folder)
    log = BatchLog(spark, f"{folder}/rows", schema)
    with with_rocksdb(spark):
        once = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
        run_to_end(once, log.write, folder)
    return log.read().drop("batch")

