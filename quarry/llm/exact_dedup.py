"""Exact de-duplication by content sort, with DataFrame functions only.

The order is that of the normalised bytes: by their first characters, then by digest where these agree, then by all
of them, then by id. Sampled splitters cut it into ranges, and each range is a partition of its own, sorted externally. So equal texts
stand next to each other, each row is compared in full with its neighbour, and where they differ a new run begins. A
splitter holds the id as well, so a text of which there are very many copies is cut over as many ranges as its share of the
sample asks for, and no task gets a whole hot group. The last run of a range and the first of the next are one if their texts are
equal in full; only the runs that touch a border, two for each range, are merged.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shuffle_partitions, store, table, whole_rows

#: Characters of a text that come first in the order.
PREFIX = 64
#: Ranges for each shuffle partition, and rows sampled for each range.
RANGES_A_PARTITION, SAMPLED_A_RANGE = 2, 30


def normalised(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def _lead(text: Column) -> Column:
    """What comes first in the order of texts: some characters, and a digest that ends the ties of all but equal texts."""
    return F.concat(F.left(normalised(text), F.lit(PREFIX)), F.lit("\0"), F.sha2(normalised(text).cast("binary"), 256))


def _place(lead: Column, doc_id: Column) -> Column:
    return F.concat(lead, F.lpad(F.hex(F.coalesce(doc_id, F.lit(0)).cast("long")), 16, "0"))


def _splitters(rows: DataFrame, ranges: int) -> list[str]:
    """At most `ranges` - 1 strings of bounded length, from a sample of bounded size."""
    total, want = rows.count(), SAMPLED_A_RANGE * ranges
    sample = rows.sample(min(1.0, want / max(total, 1)), seed=7).select(_place(_lead(F.col("_text")), F.col("_id")))
    got = sorted(r[0].encode() for r in sample.collect())
    cuts = [got[len(got) * i // ranges] for i in range(1, ranges)] if got else []
    return [x.decode() for x in sorted(set(cuts))]


def _range_of(key: Column, splitters: list[str]) -> Column:
    """The number of splitters that are not above `key`, by binary search."""
    if not splitters:
        return F.lit(0)
    cuts = F.array(*[F.lit(x) for x in splitters])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(splitters).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= len(splitters)) & (F.get(cuts, low + step - 1) <= key), low + step).otherwise(low))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """One row for each row of `docs`: id, keep_id, group_size, kept, text_sha256.

    `keep` says whether the largest ("max") or the smallest ("min") id of a group stays. Null text
    is empty, and empty texts are equal to each other. Rows with a null id are never kept in favour of a row
    that has one; where none of a group has, keep_id is null and all say kept. Rows that repeat an id and text
    say the same, so whoever drops rows keeps one of them (`drop_copies`).
    An empty table gives no rows; other columns of `docs` play no part, whatever their names.
    """
    if keep not in ("max", "min"):
        raise ValueError("keep must be 'max' or 'min'")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    splitters = _splitters(rows, max(1, RANGES_A_PARTITION * shuffle_partitions(spark)))
    dealt = rows.select("_id", normalised(F.col("_text")).alias("_norm"), _lead(F.col("_text")).alias("_lead"))
    dealt = dealt.withColumn("_range", _range_of(_place(F.col("_lead"), F.col("_id")), splitters).cast("int"))
    # a range is a partition, which the windows take as it is
    near = Window.partitionBy("_range").orderBy("_lead", "_norm", "_id")
    marked = dealt.repartitionById(len(splitters) + 1, F.col("_range")).select(
        "_id", "_range", "_lead", "_norm", F.lag("_norm").over(near).alias("_before"), F.lead("_norm").over(near).isNull().alias("_last")
    )
    first = F.col("_before").isNull()
    begins = F.when(first | (F.col("_before") != F.col("_norm")), 1).otherwise(0)
    marked = marked.select("_id", "_range", "_lead", "_norm", first.alias("_first"), "_last", begins.alias("_new"), "_before")
    run = F.sum("_new").over(near.rowsBetween(Window.unboundedPreceding, 0)).alias("_run")
    border = F.when(F.col("_first") | F.col("_last"), F.col("_norm")).alias("_border")
    marked = store(marked.select("_id", "_range", run, "_first", "_last", border, F.unhex(F.right("_lead", F.lit(64))).alias("_sha")), "sorted")

    best = F.max if keep == "max" else F.min
    runs = store(marked.groupBy("_range", "_run").agg(best("_id").alias("_keep"), F.count("*").alias("_n")), "runs")
    chains = _chains(marked)
    linked = runs.join(F.broadcast(chains), ["_range", "_run"], "left")
    whole = linked.where("_chain is not null").groupBy("_chain").agg(best("_keep").alias("_all_keep"), F.sum("_n").alias("_all_n"))
    groups = linked.join(F.broadcast(whole), "_chain", "left").select("_range", "_run", F.when(F.col("_all_n").isNull(), F.col("_keep")).otherwise(F.col("_all_keep")).alias("_keep"), F.coalesce("_all_n", "_n").alias("_n"))
    groups = store(groups.where("_n > 1"), "groups")
    discard(runs, chains)
    return marked.drop("_border").join(groups, ["_range", "_run"], "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).alias("group_size"),
        F.when(F.col("_n").isNull(), True).otherwise(F.coalesce(F.col("_id") == F.col("_keep"), F.col("_keep").isNull())).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def _chains(marked: DataFrame) -> DataFrame:
    """(_range, _run, _chain) of the runs that go on over a border; runs of one text have one chain. Two rows for each range at most."""
    ends = marked.where("_first or _last").groupBy("_range").agg(F.max("_run").alias("_runs"), F.max(F.when(F.col("_first"), F.col("_border"))).alias("_head"), F.max(F.when(F.col("_last"), F.col("_border"))).alias("_tail"))
    ends = store(ends, "borders")
    order = Window.orderBy("_range")
    # one row for each range, without texts
    past = ends.select("_range", F.lag("_range").over(order).alias("_past"))
    tails = ends.select(F.col("_range").alias("_past"), F.col("_tail").alias("_past_tail"))
    joins = ends.join(past, "_range").join(tails, "_past", "left").select("_range", "_runs", F.coalesce(F.col("_past_tail") == F.col("_head"), F.lit(False)).alias("_joins"))
    opens = F.when(~F.col("_joins") | (F.col("_runs") > 1), F.col("_range"))
    # the range whose last run the first run of this one goes on, over any that hold nothing else
    chain = F.last(opens, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    going = joins.select("_range", "_runs", "_joins", chain.alias("_chain"))
    heads = going.where("_joins").select("_range", F.lit(1).cast("long").alias("_run"), "_chain")
    begun = going.where("_joins").select(F.col("_chain").alias("_range")).distinct().join(going.select("_range", F.col("_runs").alias("_run")), "_range")
    chains = store(heads.unionByName(begun.select("_range", "_run", F.col("_range").alias("_chain"))), "chains")
    discard(ends)
    return chains


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of `docs` that stay, with all their columns; one of those that repeat an id and text.

    Null and empty texts are equal to each other; an empty table gives an empty one. The digest only tells the texts of one id apart.
    """
    found = exact_dedup(docs, id_col, text_col, keep).where("kept").select(F.col(id_col).alias("_id"), F.unhex("text_sha256").alias("_sha")).distinct()
    rows = docs.select(whole_rows(docs), F.col(id_col).alias("_own"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("_digest"))
    on = rows["_own"].eqNullSafe(found["_id"]) & (rows["_digest"] == found["_sha"])
    return rows.join(found, on, "left_semi").dropDuplicates(["_own", "_digest"]).select("row.*")


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


_AZ = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
OP2_SQL = f"""
WITH d AS (SELECT doc_id, {_AZ} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM d
"""
