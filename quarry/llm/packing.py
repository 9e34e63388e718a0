"""Packing token pieces into windows by multiway differencing (Karmarkar and Karp).

A document's ids and an end id are cut into pieces: whole windows first, then of what is left a half, a quarter and an
eighth of a window where they fit, and the rest as it is. Pieces are dealt at random into groups of bounded size; in each,
partial partitions are merged two at a time, those with the largest spread first, heaviest
window on lightest. If a window then holds more than its capacity, the group is done again with one
window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import Vocabulary, encoder
from .common import by_bytes, released, store, table

CAPACITY, END_ID = 2048, 1
#: The cuts of bpe.PRETOKENS, written so that a regular expression engine never goes back over a long run.
POSSESSIVE = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: The shortest of the halved pieces, and how many pieces share a group, about.
LEAST_HALF, PIECES_A_GROUP = 256, 1500
#: Bytes of text that are encoded together.
SLICE_BYTES = 2_000_000


class LibraryEncoder:
    """Whole texts to ids by a library, for what counts tokens and does not need the pair index."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        ranked = all(m - rank == 256 for rank, (_, _, m) in enumerate(vocab.merges))
        if ranked:  # then ids are ranks, and tiktoken gives the same ids, only sooner
            special = set(vocab.special.values())
            own = tiktoken.Encoding("packing", pat_str=POSSESSIVE, mergeable_ranks={b: i for i, b in enumerate(vocab.bytes) if i not in special}, special_tokens={})
            self.library = own.encode_ordinary
        else:
            own = Tokenizer.from_file(vocab.path)
            own.no_truncation()
            own.no_padding()
            own.encode_special_tokens = True
            self.library = lambda text: own.encode(text, add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as the tokenizers library gives them without special tokens added."""
        special = self.vocab.special
        for text in texts:
            if not any(s in text for s in special):
                yield np.array(self.library(text), "<u4")
                continue
            ids: list[int] = []
            for k, piece in enumerate(self.vocab.cut_special.split(text)):
                ids += [special[piece]] if k % 2 else self.library(piece)
            yield np.array(ids, "<u4")


def cut(tokens: int, capacity: int, least_half: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of so many tokens.

    Halved pieces fit each other, and the rests, of all lengths below the shortest, level them out.
    """
    out = [(k * capacity, capacity) for k in range(tokens // capacity)]
    at, length = len(out) * capacity, capacity // 2
    while length >= least_half:
        if tokens - at >= length:
            out.append((at, length))
            at += length
        length //= 2
    if at < tokens:
        out.append((at, tokens - at))
    return out


def differencing(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, int]:
    """The window of each size, and the largest sum, by the largest differencing method."""
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # children of joined contents; the first n are the sizes themselves
    heap = []
    for i, s in enumerate(sizes.tolist()):
        sums, held = np.zeros(windows, np.int64), np.full(windows, -1)
        sums[0], held[0] = s, i
        heap.append((-s if windows > 1 else 0, i, sums, held))
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, a_held = heapq.heappop(heap)
        _, _, b, b_held = heapq.heappop(heap)
        sums, b_held = a + b[::-1], b_held[::-1]
        held = np.maximum(a_held, b_held)
        for k in np.flatnonzero((a_held >= 0) & (b_held >= 0)).tolist():
            left.append(int(a_held[k]))
            right.append(int(b_held[k]))
            held[k] = len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, held = sums[order], held[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), made, sums, held))
        made += 1
    _, _, sums, held = heap[0]
    window = np.zeros(n, np.int64)
    for k, top in enumerate(held.tolist()):
        stack = [top] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                window[x] = k
            else:
                stack += (left[x], right[x])
    return window, int(sums[0])


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each size (none above the capacity); there are as few windows as differencing fits."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window, most = differencing(sizes, windows)
        if most <= capacity:
            return window
        windows += 1


def piece_rows(docs: DataFrame, path: str, capacity: int, end_id: int, least_half: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        enc = encoder(path, LibraryEncoder)
        end = np.array([end_id], "<u4")
        for b in (part for batch in batches for part in by_bytes(batch, 1, SLICE_BYTES)):
            doc, start, length, crc, total, held = [], [], [], [], [], []
            for i, ids in enumerate(enc.encode([t or "" for t in b.column(1).to_pylist()])):
                ids = np.concatenate([ids, end])
                raw = ids.tobytes()
                for s, n in cut(len(ids), capacity, least_half):
                    doc.append(i)
                    start.append(s)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + n)]))
                    total.append(len(ids))
                    if with_ids:
                        held.append(ids[s : s + n].astype(np.int32))
            cols = [b.column(0).take(pa.array(doc, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(held, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return docs.select(id_col, text_col).mapInArrow(released(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, least_half: int = LEAST_HALF, pieces_a_group: int = PIECES_A_GROUP, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    Null text is empty: a piece of the end id alone. Null ids of documents are kept. Rows that
    repeat a document are packed as often as they come. Very long texts become whole windows and a
    rest. An empty table gives no rows; other columns of `docs` are not looked at.
    """
    if least_half < 1 or capacity < 1:
        raise ValueError("lengths must be positive")
    pieces = store(piece_rows(docs, path, capacity, end_id, least_half, id_col, text_col, with_ids), "pieces")
    rests = pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-rests // pieces_a_group))
    # the stored files fix the row numbers, so a task that runs again deals its rows as before
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        full = (pdf["length"] == capacity).to_numpy()
        window = np.zeros(len(pdf), np.int64)
        window[~full] = pack(pdf["length"].to_numpy()[~full], capacity)
        used = int(window[~full].max()) + 1 if (~full).any() else 0
        window[full] = used + np.arange(full.sum())
        pdf["sequence_id"] = (int(key[0]) << 32) + window
        pdf["offset"] = pdf.groupby("sequence_id")["length"].cumsum() - pdf["length"]
        return pdf.drop(columns="_group")

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    out = dealt.groupBy("_group").applyInPandas(pack_group, schema)
    return out.withColumnRenamed("doc_id", id_col)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
