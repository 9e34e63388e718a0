"""Term search that skips blocks of postings which cannot hold a result.

Documents are dealt into slots of about BLOCK documents of like length, and a term's postings in a slot are a block: one row, with the largest
frequency and the smallest length beside the postings. Both give the most that the term can add to any score of the block, since BM25
grows with the frequency and falls with the length; the sum over the query's terms is the most that any document of a slot can
score. A search reads these few columns for its terms, scores the slots that promise most, and goes on with slots that promise no less
than the k-th best score so far, until there are none. The result is that of scoring everything.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.tokens import query_terms
from quarry.operators.index import Index, open_index
from quarry.operators.retrieve import idf, saturation, summed, top
from quarry.sources.tables import fingerprint, keep

#: Documents of a slot, on average; lengths whose logarithms (to 2) differ by less than a GRADE-th are alike.
BLOCK, GRADE = 256, 8
#: Slots that are scored first, by how much more later, and as many are pushed into the scan at most.
FIRST, MORE, MOST_PUSHED = 16, 8, 1000
#: What rounding may take from a bound, as a share.
SLACK = 1e-9


@dataclass
class Blocks:
    index: Index
    blocks: DataFrame  # term, slot, n, max_tf, min_length, postings: sorted by term and slot


def build_blocks(index: Index) -> Blocks:
    """The blocks of an index, written. A slot follows from a document's length and id, so no postings are joined for it."""
    grade = F.floor(F.log2("doc_length") * GRADE).cast("long")
    sizes = index.lengths.where("doc_length > 0").groupBy(grade.alias("grade")).agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("among"))
    sizes = F.broadcast(sizes)  # lengths have at most some hundred grades
    rows = index.rows.select("term", "doc_id", "tf", "doc_length", grade.alias("grade")).join(sizes, "grade")
    slot = F.col("grade") * (1 << 40) + F.pmod(F.xxhash64("doc_id"), F.col("among"))
    rows = rows.select("term", slot.alias("slot"), "doc_id", "tf", "doc_length")
    # a block's rows are exchanged once, and then lie together
    rows = rows.repartitionByRange("term", "slot").sortWithinPartitions("term", "slot")
    return Blocks(index, keep(rows.mapInArrow(_gathered, f"term string, slot long, n long, max_tf long, min_length long, postings array<struct<doc_id: {index.rows.schema['doc_id'].dataType.simpleString()}, tf: long, doc_length: long>>"), "blocks"))


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of postings that are sorted by term and slot; the last block of a batch may go on in the next."""

    def blocks(t: pa.Table, begins: np.ndarray) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        terms, slots, ids, tf, lengths = (t.column(k).chunk(0) for k in range(5))
        upto = np.append(begins, len(t))
        postings = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.StructArray.from_arrays([ids, tf, lengths], names=["doc_id", "tf", "doc_length"]))
        first = pa.array(begins)
        most, least = np.maximum.reduceat(tf.to_numpy(), begins), np.minimum.reduceat(lengths.to_numpy(), begins)
        yield pa.RecordBatch.from_arrays([terms.take(first), slots.take(first), pa.array(np.diff(upto)), pa.array(most), pa.array(least), postings], names=["term", "slot", "n", "max_tf", "min_length", "postings"])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        term, slot = t.column(0).combine_chunks().dictionary_encode(), t.column(1).to_numpy()
        code = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
        begins = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]) | (slot[1:] != slot[:-1])) + 1])
        if len(begins) > 1:
            yield from blocks(t.slice(0, begins[-1]), begins[:-1])
        held = t.slice(begins[-1]).combine_chunks()
    if held is not None:
        yield from blocks(held, np.array([0]))


@dataclass
class Report:
    """How many blocks the query's terms have, and in how many slots; how many of both were read."""

    blocks: int
    slots: int
    read_blocks: int
    read_slots: int


def search(built: Blocks, query: str, top_k: int = 10) -> tuple[DataFrame, Report]:
    """(doc_id, score) of the best, ties to the smaller id: the rows of `retrieve.bm25_search`; and what it took."""
    spark = built.blocks.sparkSession
    terms = query_terms(query)
    stats = built.index.stats.where("total_docs > 0 and avg_doc_length > 0").first()
    nothing = spark.createDataFrame([], "doc_id long, score double"), Report(0, 0, 0, 0)
    if not terms or not stats or top_k <= 0:
        return nothing
    frequencies = F.broadcast(built.index.terms.where(F.col("term").isin(terms)).select("term", "doc_frequency"))  # a row for each query term

    def part(tf: Column, length: Column) -> Column:
        return idf(F.lit(stats.total_docs), F.col("doc_frequency")) * saturation(tf, length, F.lit(stats.avg_doc_length))

    mine = built.blocks.where(F.col("term").isin(terms))
    bounds = mine.select("term", "slot", "max_tf", "min_length").join(frequencies, "term").groupBy("slot").agg(F.sum(part(F.col("max_tf"), F.col("min_length"))).alias("bound"), F.count("*").alias("blocks"))
    bounds = keep(bounds, "bounds")
    report = Report(bounds.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0], bounds.count(), 0, 0)
    best, least, wanted, past = None, None, FIRST, None
    while True:
        # slots come by what they promise, so those that have been scored are the ones before the last of them
        left = bounds if past is None else bounds.where((F.col("bound") < past[0]) | ((F.col("bound") == past[0]) & (F.col("slot") > past[1])))
        left = left if least is None else left.where(F.col("bound") >= least * (1 - SLACK))
        chosen = left.orderBy(F.desc("bound"), "slot").limit(wanted)
        told = chosen.collect() if wanted <= MOST_PUSHED else None
        if (not told) if told is not None else chosen.isEmpty():
            return (best, report) if best is not None else nothing
        if told is None:
            chosen = keep(chosen, "chosen")
            blocks, read = chosen.agg(F.sum("blocks"), F.count("*")).first()
            rows, last = mine.join(chosen.select("slot"), "slot", "left_semi"), chosen.orderBy("bound", F.desc("slot")).first()
        else:
            blocks, read, last = sum(r.blocks for r in told), len(told), told[-1]
            rows = mine.where(F.col("slot").isin([r.slot for r in told]))
        past = last.bound, last.slot
        report.read_blocks, report.read_slots = report.read_blocks + blocks, report.read_slots + read
        hits = rows.select("term", F.explode("postings").alias("p")).join(frequencies, "term").select("term", "p.*", "doc_frequency")
        scored = summed(hits, terms, part(F.col("tf"), F.col("doc_length")))
        # a document is in one slot, so its score is whole
        best = keep(top(scored if best is None else best.unionByName(scored), top_k), "best")
        kept = best.agg(F.count("*"), F.min("score")).first()
        least = kept[1] if kept[0] == top_k else None
        wanted *= MORE


_open: dict[tuple[str, str], tuple[tuple, Blocks]] = {}


def open_blocks(spark: SparkSession, sf_dir: str) -> Blocks:
    """The blocks of the `documents` table's index, made at their first use in a session and again when the table's files have changed."""
    key, now = (spark.sparkContext.applicationId, sf_dir), fingerprint(spark, f"{sf_dir}/documents.parquet")
    if key not in _open or _open[key][0] != now:
        _open[key] = now, build_blocks(open_index(spark, sf_dir))
    return _open[key][1]
