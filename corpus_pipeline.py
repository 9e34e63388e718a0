"""A corpus from raw documents to packed windows; each stage's result is written and read again.

All stages take an empty table and give an empty one, look at no column but doc_id and text, and return the columns of `documents`
only, whatever others the table has (the last stage returns pieces). What they do with nulls, ties and repeated rows stands with each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import DOCUMENT_COLUMNS, store, table
from quarry.llm.exact_dedup import drop_copies
from quarry.llm.minhash import near_duplicates
from quarry.llm.packing import pack_documents
from quarry.llm.suffix_dedup import without_repeats
from quarry.llm.toxicity import toxicity


#: Words in a row that are a passage: over 50. Passages of 400 bytes with fewer, longer words are cut as well.
PASSAGE_WORDS = 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the models do not call toxic.

    The text alone decides, so equal texts go or stay together; null and empty texts are scored like a text without evidence, and
    rows with a null id like any others. Repeated rows stay repeated.
    """
    scored = toxicity(docs, table(spark, sf_dir, "labels"), carried=("text", "lang", "source", "n_chars"))
    return scored.where("predicted = 0").select(*DOCUMENT_COLUMNS)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, null as empty) the row with the largest id.

    Of rows that repeat an id and text one stays. A row with a null id stays only where no other row has its text.
    """
    return drop_copies(docs).select(*DOCUMENT_COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id.

    Texts without words are like nothing, so they stay, as do rows with a null id. An id that several rows share is one document: it
    stays or goes with all its rows.
    """
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_id"]), "left_semi").select(*DOCUMENT_COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the passages that repeat; n_chars says what is left.

    Null texts become empty. The text alone decides, so repeated rows and rows with a null id fare like any others: the copies of a
    long text become empty.
    """
    return without_repeats(docs, words=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT_COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens.

    Null and empty texts are a piece of the end id alone; rows that repeat are packed as often as they come; null ids are kept.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

#: No SQL says what a trained score or the packing decides; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
