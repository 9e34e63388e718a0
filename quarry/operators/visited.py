"""Which pages have been visited: a Bloom filter in blocks, kept as a table, with an exact check behind it.

A key belongs to one block of BLOCK_BITS bits and sets one bit in each of its words. A block is a row of a few whole numbers, so filters are
filled by a grouped `bit_or`, merged by another one, and asked by a join on the block's number. What a filter does not know is
new; only the rest, hardly more than what has been visited, is looked up.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block, in words of 64, and bits for each key: with 20, false positives stay below one in a thousand.
BLOCK_BITS, KEY_BITS = 512, 20
WORDS = [f"w{k}" for k in range(BLOCK_BITS // 64)]
#: As many doubtful keys are broadcast at most; beyond that they are joined by a shuffle.
MOST_BROADCAST = 1_000_000


@dataclass(frozen=True)
class Bloom:
    """A filter for `blocks` blocks; its rows are (block, w0, w1, ...), and may have several of a block."""

    blocks: int
    rows: DataFrame


def blocks_for(keys: int) -> int:
    """As many blocks as a filter of so many keys needs."""
    return max(1, -(-keys * KEY_BITS // BLOCK_BITS))


def _marks(key: Column, blocks: int) -> list[Column]:
    """The block of a key, and its bit in each word of it: six bits of a second hash name each."""
    bits = F.xxhash64(key, F.lit(1))
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63).cast("long")).cast("int")) for k in range(len(WORDS))]
    return [F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), *[w.alias(name) for w, name in zip(words, WORDS, strict=True)]]


def filled(keys: DataFrame, blocks: int, key: str = "url") -> Bloom:
    """A filter that knows the keys; nulls are no keys."""
    return merged([Bloom(blocks, keys.where(F.col(key).isNotNull()).select(*_marks(F.col(key), blocks)))])


def merged(filters: list[Bloom]) -> Bloom:
    """A filter that knows what any of the filters knows; they must have the same number of blocks."""
    if len({f.blocks for f in filters}) != 1:
        raise ValueError("filters of different sizes cannot be merged")
    rows = reduce(DataFrame.unionByName, [f.rows for f in filters])
    return Bloom(filters[0].blocks, rows.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS]))


def asked(keys: DataFrame, bloom: Bloom, key: str = "url") -> DataFrame:
    """`keys` with a column `maybe`: false where the filter surely does not know the key."""
    marks = _marks(F.col(key), bloom.blocks)
    mine = keys.select("*", marks[0].alias("_block"), *[m.alias(f"_w{k}") for k, m in enumerate(marks[1:])])
    known = merged([bloom]).rows.select(F.col("block").alias("_block"), *[F.col(w).alias(f"_k{k}") for k, w in enumerate(WORDS)])
    every = reduce(lambda a, b: a & b, [F.col(f"_k{k}").bitwiseAND(F.col(f"_w{k}")) == F.col(f"_w{k}") for k in range(len(WORDS))])
    return mine.join(known, "_block", "left").select(*keys.columns, F.coalesce(every, F.lit(False)).alias("maybe"))


def unvisited(keys: DataFrame, visited: DataFrame, bloom: Bloom, key: str = "url") -> DataFrame:
    """The rows of `keys` whose key is not in `visited`, which `bloom` knows (and perhaps more).

    Of `visited` only the doubtful keys are kept before anything is exchanged.
    """
    told = asked(keys, bloom, key)
    doubtful = told.where("maybe").select(key).distinct()
    few = doubtful.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    found = visited.select(key).join(F.broadcast(doubtful) if few else doubtful, key, "left_semi").distinct()
    sure = told.where("not maybe")
    return sure.unionByName(told.where("maybe").join(found, key, "left_anti")).select(*keys.columns)
