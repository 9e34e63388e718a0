"""What a task holds while it works, and after."""

import tracemalloc

import pyarrow as pa

from quarry.llm import packing, quality
from quarry.llm.common import by_bytes, released
from quarry.llm.text_statistics import measure


def test_statistics_of_a_slice_are_small():
    texts = ["Ab c, d1. " * 4] * 60_000  # 2.4 MB of short texts, as one batch may bring them
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    part = next(by_bytes(batch, 0, quality.SLICE_BYTES)).column(0).to_pylist()
    tracemalloc.start()
    measure(part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6, peak


def test_packing_takes_a_batch_in_slices(spark, monkeypatch):
    """Slices of a batch give the same pieces as the whole batch, in the same order."""
    import public_tokenizers

    docs = spark.createDataFrame([(i, None if i % 7 == 3 else f"word{i} " * (i * 5)) for i in range(60)], "doc_id long, text string").coalesce(1)
    pieces = lambda: [tuple(r) for r in packing.piece_rows(docs, public_tokenizers.path("byte_bpe_50k.json"), 64, 1, 8, "doc_id", "text", False).collect()]
    whole = pieces()
    monkeypatch.setattr(packing, "SLICE_BYTES", 100)
    assert pieces() == whole


def test_released_tasks_give_the_same_batches():
    assert list(released(lambda batches: (b + 1 for b in batches))(iter([1, 2]))) == [2, 3]
