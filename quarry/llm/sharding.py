"""Sharding by jump consistent hashing: no ring table, and an appended shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, store, table, text_or_empty

#: Rows that get their slots in one task, about.
ROWS_A_BLOCK = 50_000
#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 16


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key, from 0 (Lamping and Veach 2014), for all keys at once."""
    if shards < 1:
        raise ValueError("there must be a shard at least")
    state = mix64(keys.astype(np.uint64))
    out = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        now = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        state[live] = now
        # in doubles, as the paper has it: the next shard count at which this key moves
        step = (out[live] + 1).astype(float) * (float(1 << 31) / ((now >> np.uint64(33)).astype(float) + 1.0))
        moves = step < shards
        live = live[moves]
        out[live] = step[moves].astype(np.int64)
    return out


def _sharder(shards: int):
    @F.pandas_udf("int")
    def shard(ids: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(ids.fillna(0).to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return shard


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: id and shard count decide, so rows that repeat an id share a shard, and
    copies of a text under other ids are dealt on their own. A null id counts as key 0 and stays
    null; null text has no bytes. Slots are gapless from 0 in each shard, in an order fixed by
    (block, id, checksum); rows that tie in all of these are alike but for their slots. An empty table gives
    no rows, and no other column of `docs` is looked at.
    """
    spark = docs.sparkSession
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), (F.octet_length(text).cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(text).alias("text_crc32"))
    rows = rows.withColumns({"shard": _sharder(shards)("_id"), "grown_shard": _sharder(shards + 1)("_id")})
    rows = store(rows, "shards")
    blocks = max(1, -(-rows.count() // (shards * ROWS_A_BLOCK)))
    # copies of an id must not gather in one block, so the checksum of the text is dealt as well; rows without an id, which
    # all share a shard, are dealt by their place in the stored files
    place = F.when(F.col("_id").isNull(), F.monotonically_increasing_id())
    rows = rows.withColumn("_block", F.pmod(F.xxhash64("_id", "size", "text_crc32", place), F.lit(blocks)).cast("int"))
    counts = store(rows.groupBy("shard", "_block").agg(F.count("*").alias("_n")), "counts")
    before = counts.select("shard", "_block", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    numbered = rows.withColumn("_row", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("_id", "text_crc32", "size")))
    return numbered.join(before, ["shard", "_block"]).select(
        F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_row") - 1).alias("slot"), "grown_shard"
    )


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), 40)


#: The checksum byte by byte and the jumps key by key, with integers modulo 2 ** 64. Slots are those of one block, as it is below two million rows.
OP8_SQL = """
WITH RECURSIVE bit AS (SELECT range AS n, 0 AS k, range::UBIGINT AS c FROM range(256) UNION ALL SELECT n, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM bit WHERE k < 8),
crc AS (SELECT list(c ORDER BY n) AS t FROM bit WHERE k = 8),
d AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT + 16 AS size,
      xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::UBIGINT), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM documents, crc),
x AS (SELECT id, id::UHUGEINT AS x FROM (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents)),
y AS (SELECT id, xor(x, x >> 30) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS x FROM x),
z AS (SELECT id, xor(x, x >> 27) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS x FROM y),
walk(id, state, bucket) AS (SELECT id, xor(x, x >> 31), 0::BIGINT FROM z UNION ALL
  SELECT id, next, floor((bucket + 1) * (2147483648.0::DOUBLE / ((next >> 33)::DOUBLE + 1)))::BIGINT FROM (SELECT id, bucket, (state * 2862933555777941757::UHUGEINT + 1) % 18446744073709551616::UHUGEINT AS next FROM walk)
  WHERE (bucket + 1) * (2147483648.0::DOUBLE / ((next >> 33)::DOUBLE + 1)) < 41),
s AS (SELECT id, max(bucket) FILTER (bucket < 40)::INT AS shard, max(bucket)::INT AS grown_shard FROM walk GROUP BY id)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM d JOIN s ON coalesce(doc_id, 0) = id
"""
