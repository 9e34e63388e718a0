"""Frequent keys from a summary of bounded size, which batches can be merged into.

A summary holds at most as many counters as it is made for, and `lost`, by how much any count may be too small: whenever there are too many counters, all sink by
the largest that has no place, and those at 0 go. Tasks summarise their rows, and summaries are summed by key. A key that comes more often than `lost` is surely
in it, and `lost` is at most a share 1 / (counters + 1) of the rows for each of the steps that a count goes through (one in a task, one in each merge).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.sources.tables import keep


@dataclass(frozen=True)
class Summary:
    counters: int
    rows: DataFrame  # key, n: at most `counters` rows
    lost: int  # counts are too small by this at most
    total: int  # rows that have been summarised


def _sunk(counts: dict, counters: int) -> tuple[dict, int]:
    """Counters that stay, and by how much they sank."""
    if len(counts) <= counters:
        return counts, 0
    by = sorted(counts.values(), reverse=True)[counters]
    return {k: n - by for k, n in counts.items() if n > by}, by


def summarise(df: DataFrame, key: str, counters: int) -> Summary:
    """The summary of a column of text; nulls are not counted."""

    def run(batches):
        counts, lost, total = {}, 0, 0
        for batch in batches:
            column = batch.column(0).drop_null()
            total += len(column)
            for pair in pc.value_counts(column):
                value = pair["values"].as_py()
                counts[value] = counts.get(value, 0) + pair["counts"].as_py()
            if len(counts) > 2 * counters:
                counts, by = _sunk(counts, counters)
                lost += by
        counts, by = _sunk(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array([*counts, None], pa.string()), pa.array([*counts.values(), total], pa.int64()), pa.array([0] * len(counts) + [lost + by], pa.int64())], names=["key", "n", "lost"])

    parts = keep(df.select(F.col(key).cast("string").alias("key")).mapInArrow(run, "key string, n long, lost long"), "counters")
    told = parts.where("key is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("lost"), F.lit(0))).first()
    return _bounded(parts.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")), counters, told[1], told[0])


def _bounded(sums: DataFrame, counters: int, lost: int, total: int) -> Summary:
    """A summary of summed counters: they sink by the first that has no place."""
    sums = keep(sums, "sums")
    over = sums.orderBy(F.desc("n"), "key").offset(counters).limit(1).collect()
    if over:
        sums = keep(sums.select("key", (F.col("n") - over[0].n).alias("n")).where("n > 0"), "summary")
    return Summary(counters, sums, lost + (over[0].n if over else 0), total)


def merged(summaries: list[Summary]) -> Summary:
    """The summary of all that any of the summaries has seen."""
    counters = min(s.counters for s in summaries)
    sums = reduce(DataFrame.unionByName, [s.rows for s in summaries]).groupBy("key").agg(F.sum("n").alias("n"))
    return _bounded(sums, counters, sum(s.lost for s in summaries), sum(s.total for s in summaries))


def candidates(summary: Summary, share: float) -> DataFrame:
    """(key, least, most): every key with at least this share of the rows, and perhaps some others; its count lies between the two."""
    if share * summary.total <= summary.lost:
        raise ValueError(f"a summary of {summary.counters} counters cannot tell shares of {summary.lost / max(1, summary.total):.2g} or less")
    return summary.rows.where(F.col("n") + summary.lost >= share * summary.total).select("key", F.col("n").alias("least"), (F.col("n") + summary.lost).alias("most"))


def frequent(df: DataFrame, key: str, summary: Summary, share: float) -> DataFrame:
    """(key, count) of the keys with at least this share of the rows of `df`, which `summary` has seen: the candidates are counted again, and nothing else."""
    asked = F.broadcast(candidates(summary, share).select("key"))  # at most as many rows as counters
    counts = df.select(F.col(key).cast("string").alias("key")).join(asked, "key").groupBy("key").agg(F.count("*").alias("count"))
    return counts.where(F.col("count") >= share * summary.total)
