"""Search over blocks against scoring every posting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import block_max, index, retrieve


@pytest.fixture(scope="module")
def built(spark):
    r = np.random.default_rng(1)
    words = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(200)]
    share = 1 / np.arange(1, 201)
    rows = [(int(i) * 1009, " ".join(r.choice(words, int(r.pareto(1.5) * 20) + 1, p=share / share.sum()))) for i in range(4000)] + [(-1, None), (-2, "")]
    return block_max.build_blocks(index.build_index(spark.createDataFrame(rows, "doc_id long, text string"), F.col("text")))


@pytest.mark.parametrize(("query", "k"), [("waa", 10), ("waa wab wac", 5), ("wha wdz waa", 20), ("wha", 5000), ("nothing here", 10), ("", 10)])
def test_equals_scoring_everything(built, monkeypatch, query, k):
    monkeypatch.setattr(block_max, "FIRST", 2)
    monkeypatch.setattr(block_max, "MOST_PUSHED", 20)  # the later rounds join
    got, _ = block_max.search(built, query, k)
    plain = lambda df: sorted((r.doc_id, round(r.score, 9)) for r in df.collect())
    assert plain(got) == plain(retrieve.bm25_search(built.index, query, k))


def test_blocks_are_skipped(built):
    assert built.blocks.count() < 0.5 * built.index.postings.count()
    _, report = block_max.search(built, "wha waa", 10)
    assert report.slots >= 20 and report.read_blocks < 0.9 * report.blocks
    scan = built.blocks.where(F.col("term").isin("waa") & F.col("slot").isin(1, 2))._jdf.queryExecution().toString()
    assert "In(slot" in scan
    heads = built.blocks.where(F.col("term") == "waa").select("slot", "max_tf")._jdf.queryExecution().toString()
    assert "postings" not in heads.split("ReadSchema")[-1]


def test_empty_index(spark):
    empty = block_max.build_blocks(index.build_index(spark.createDataFrame([], "doc_id long, text string"), F.col("text")))
    assert block_max.search(empty, "waa", 3)[0].count() == 0
