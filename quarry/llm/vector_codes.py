"""Product codes of vectors: codebooks by Yinyang Lloyd, in whole numbers.

Each part of a vector has a codebook of its own. Its entries are clustered into groups once; for every vector and group the table
keeps one lower bound of the distance to the group's entries (without the assigned one). When entries move, the bounds of their
group sink by the largest of the moves, and only groups whose bound does not exceed the distance to the assigned entry are
scanned. Distances proposed in floating point are decided in whole numbers, ties included, so that the codes are those of plain Lloyd.

A round reads the stored table of the round before (whole numbers, entries, bounds), writes the next one, and with it the sums of each task
for each entry; Spark adds these up, and the driver gets one row for each entry and component.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import discard, store, table

#: Whole numbers are floor(UNIT * component); parts of a vector, entries of a codebook, and rounds.
UNIT, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a group, on average, and rounds in which they are grouped.
GROUPED, GROUPING_ROUNDS = 10, 5
#: What floating point may be wrong by, as a share.
EPSILON = 1e-12
#: Vectors that are assigned together.
SLICE_ROWS = 16_384


def group_entries(book: np.ndarray) -> np.ndarray:
    """The group of each entry of a codebook: a few Lloyd rounds over the entries themselves."""
    n = max(1, len(book) // GROUPED)
    x = book.astype(float)
    centers = x[np.linspace(0, len(x) - 1, n).astype(int)]
    for _ in range(GROUPING_ROUNDS):
        of = ((x[:, None, :] - centers[None]) ** 2).sum(2).argmin(1)
        centers = np.stack([x[of == g].mean(0) if (of == g).any() else centers[g] for g in range(n)])
    return of


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of whole numbers."""
    d = x - y
    return (d * d).sum(-1)


def assign(x: np.ndarray, held: np.ndarray, low: np.ndarray, book: np.ndarray, group_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the rows of `x` (ties to the lower index), new bounds, exact squared distances, and how many distances were computed.

    `held` is an entry of each row, and `low` holds, for each row and group, a lower bound of the distance to all of its entries but that one.
    """
    xf, bf = x.astype(float), book.astype(float)
    nx, nb = (xf * xf).sum(1), (bf * bf).sum(1)
    own = squared(x, book[held])
    best, best_far = held.copy(), own.copy()
    low = low.copy()
    scan = low <= (np.sqrt(own.astype(float)) * (1 + EPSILON))[:, None]
    met, computed = [], len(x)
    for g in range(low.shape[1]):
        entries, rows = np.flatnonzero(group_of == g), np.flatnonzero(scan[:, g])
        if not len(rows) or not len(entries):
            continue
        computed += len(rows) * len(entries)
        far = nx[rows, None] - 2 * (xf[rows] @ bf[entries].T) + nb[entries]
        wrong = EPSILON * (nx[rows] + nb[entries].max())
        place = far.argmin(1)
        least = far[np.arange(len(rows)), place]
        tied = np.flatnonzero((far <= (least + 2 * wrong)[:, None]).sum(1) > 1)
        if len(tied):  # several that floating point cannot tell apart: the first of the least, in whole numbers
            place[tied] = squared(x[rows[tied], None, :], book[entries][None]).argmin(1)
        entry = entries[place]
        exact = squared(x[rows], book[entry])
        far[np.arange(len(rows)), place] = np.inf
        second = far.min(1) - wrong
        met.append((g, rows, entry, exact, second))
        nearer = (exact < best_far[rows]) | ((exact == best_far[rows]) & (entry < best[rows]))
        best[rows[nearer]], best_far[rows[nearer]] = entry[nearer], exact[nearer]
    # an entry that is left behind is one of its group again
    moved = np.flatnonzero(best != held)
    low[moved, group_of[held[moved]]] = np.minimum(low[moved, group_of[held[moved]]], np.sqrt(own[moved].astype(float)) * (1 - EPSILON))
    for g, rows, entry, exact, second in met:
        bound = np.where(best[rows] == entry, second, exact.astype(float))
        low[rows, g] = np.sqrt(np.maximum(bound, 0)) * (1 - EPSILON)
    return best, low, best_far, computed


def moves(before: np.ndarray, after: np.ndarray, group_of: np.ndarray) -> np.ndarray:
    """How far the entries of each group have moved at most."""
    far = np.sqrt(squared(before, after).astype(float)) * (1 + EPSILON)
    return np.array([far[group_of == g].max(initial=0.0) for g in range(group_of.max() + 1)])


def limit_of(width: int) -> int:
    """The largest whole number whose distances surely fit into 64 bits, for parts of this width."""
    return isqrt(2**60 // width) // 2


def _down(low: np.ndarray) -> bytes:
    """Bounds in single precision, rounded downwards."""
    return np.nextafter(low.astype(np.float32), np.float32(-np.inf)).tobytes()


class _Round:
    """One assignment of all vectors, run in the tasks."""

    def __init__(self, books: list[np.ndarray], groups: list[np.ndarray], drift: list[np.ndarray] | None):
        self.books, self.groups, self.drift = books, groups, drift

    def state(self, batch: pa.RecordBatch) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
        """Whole numbers, new entries, bounds and squared distances of each part."""
        n, width = batch.num_rows, self.books[0].shape[1]
        x = np.frombuffer(b"".join(batch["q"].to_pylist()), np.int32).reshape(n, PARTS, width).astype(np.int64)
        sizes = [int(g.max()) + 1 for g in self.groups]
        if self.drift is None:
            held, low = np.zeros((n, PARTS), np.uint8), np.full((n, sum(sizes)), -1.0)
        else:
            held = np.frombuffer(b"".join(batch["code"].to_pylist()), np.uint8).reshape(n, PARTS)
            low = np.frombuffer(b"".join(batch["low"].to_pylist()), np.float32).reshape(n, sum(sizes)).astype(float)
            low = low - np.concatenate(self.drift)
        at = np.cumsum([0, *sizes])
        found = [assign(x[:, k], held[:, k].astype(np.int64), low[:, at[k] : at[k + 1]], self.books[k], self.groups[k]) for k in range(PARTS)]
        return [x[:, k] for k in range(PARTS)], [f[0] for f in found], [f[1] for f in found], [f[2] for f in found]


_STATE = ["q", "code", "low"]


def _as_batch(columns: dict, schema: T.StructType) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, kind)) for f, kind in zip(schema, _arrow_types(schema), strict=True)], names=schema.fieldNames())


def _arrow_types(schema: T.StructType) -> list[pa.DataType]:
    return list(to_arrow_schema(schema).types)


def _next(told, schema: T.StructType):
    """Tasks of a round: the next state, and at the end the sums of each entry."""

    def run(batches):
        work, sums = told.value, {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                x, code, low, _ = work.state(batch)
                for k in range(PARTS):
                    entries = len(work.books[k])
                    count = np.bincount(code[k], minlength=entries)
                    total = np.zeros((entries, x[k].shape[1]), np.int64)
                    order = np.argsort(code[k], kind="stable")
                    there = np.flatnonzero(count)
                    total[there] = np.add.reduceat(x[k][order], (np.cumsum(count) - count)[there], axis=0)
                    n, s = sums.get(k, (0, 0))
                    sums[k] = n + count, s + total
                codes = np.stack(code, 1).astype(np.uint8)
                bounds = np.concatenate(low, 1)
                columns = {"id": batch["id"], "label": batch["label"], "q": batch["q"], "code": pa.array([r.tobytes() for r in codes], pa.binary()), "low": pa.array([_down(r) for r in bounds], pa.binary())}
                yield _as_batch(columns, schema)
        slot, n, total = [], [], []
        for k, (count, s) in sums.items():
            for e in np.flatnonzero(count).tolist():
                slot.append(k * ENTRIES + e)
                n.append(int(count[e]))
                total.append(s[e].tolist())
        if slot:
            yield _as_batch({"slot": pa.array(slot, pa.int32()), "n": pa.array(n, pa.int64()), "total": pa.array(total, pa.list_(pa.int64()))}, schema)

    return run


def _last(told, schema: T.StructType):
    """Tasks of the last assignment: codes and errors."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                _, code, _, far = told.value.state(batch)
                codes = [r.tobytes().hex() for r in np.stack(code, 1).astype(np.uint8)]
                yield _as_batch({"id": batch["id"], "label": batch["label"], "code": pa.array(codes), "error": pa.array(np.sum(far, 0))}, schema)

    return run


def _whole(schema: T.StructType, size: int):
    """Whole numbers of vectors; null where they are too large for exact distances."""
    limit = limit_of(size // PARTS)

    def run(batches):
        for batch in batches:
            v = np.floor(batch["v"].flatten().to_numpy(zero_copy_only=False).astype(float) * UNIT).reshape(batch.num_rows, size)
            fits = (np.abs(v) <= limit).all(1)
            q = np.where(fits[:, None], v, 0).astype(np.int32)
            yield _as_batch({"id": batch["id"], "label": batch["label"], "q": pa.array([r.tobytes() if f else None for r, f in zip(q, fits, strict=True)], pa.binary())}, schema)

    return run


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(id, label, code, error) of each row with a vector, and the codebooks.

    Vectors that are null or hold a null or a component that is not finite are left out, as are those that have not the most frequent
    length (of two as frequent, the smaller) or whose length is no multiple of PARTS. A vector too large for exact distances in 64 bits (`limit_of`) keeps its row,
    without code and error, and takes no part in the codebooks. Repeated rows are rows; null ids come last where codebooks begin. With fewer than ENTRIES rows
    a codebook has as many entries as there are rows; equal entries tie, and the lower has all of their vectors. An empty table gives no rows and no codebooks;
    other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v")).where("v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    lengths = rows.where((F.size("v") > 0) & (F.size("v") % PARTS == 0)).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    label = T.StructField("label", rows.schema["label"].dataType)
    result = T.StructType([T.StructField("id", T.LongType()), label, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not lengths:
        return spark.createDataFrame([], result), []
    size = lengths["d"]
    binary = [T.StructField(c, T.BinaryType()) for c in _STATE]
    first = T.StructType([T.StructField("id", T.LongType()), label, binary[0]])
    whole = store(rows.where(F.size("v") == size).mapInArrow(_whole(first, size), first), "whole")
    fitting = whole.where("q is not null")
    begin = fitting.select("id", "q").orderBy(F.col("id").asc_nulls_last(), "q").limit(ENTRIES).collect()
    begin = np.array([np.frombuffer(r.q, np.int32) for r in begin], np.int64).reshape(len(begin), PARTS, size // PARTS)
    books = [begin[:, k] for k in range(PARTS)]
    state, drift = fitting, None
    if len(begin):
        groups = [group_entries(b) for b in books]
        sums = [T.StructField("slot", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType()))]
        schema = T.StructType([T.StructField("id", T.LongType()), label, *binary, *sums])
        held = []
        for _ in range(ROUNDS):
            told = spark.sparkContext.broadcast(_Round(books, groups, drift))
            after = store(state.mapInArrow(_next(told, schema), schema), "assigned")
            books, before = updated(after, books), books
            drift = [moves(b, a, g) for b, a, g in zip(before, books, groups, strict=True)]
            discard(*held)
            held, state = [after], after.where("slot is null").select("id", "label", *_STATE)
        told = spark.sparkContext.broadcast(_Round(books, groups, drift))
        coded = state.mapInArrow(_last(told, result), result)
    else:
        coded = spark.createDataFrame([], result)
        held = []
    too_large = whole.where("q is null").select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = store(coded.unionByName(too_large), "codes")
    discard(whole, *held)
    return out, books


def updated(assigned: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries as floor(sum / count) of their parts; unused ones stay. A row for each entry and component comes to the driver."""
    each = assigned.where("slot is not null").select("slot", "n", F.posexplode("total").alias("place", "x"))
    out = [b.copy() for b in books]
    for r in each.groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        out[r.slot // ENTRIES][r.slot % ENTRIES, r.place] = r.x // r.n
    return out


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    # labels may be few and frequent: their sums are small rows, and the join is by label and its missing
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    out = coded.alias("c").join(sums.alias("s"), F.col("c.label").eqNullSafe(F.col("s.label")))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """Plain Lloyd: every distance of every round. The key of an assignment is the distance and, below it, the entry."""
    out = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: floor({UNIT} * x::DOUBLE)) AS q
FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT r, k, x, list_inner_product(x, x) AS xx FROM (SELECT r, k, q[k * len(q) // {PARTS} + 1:(k + 1) * len(q) // {PARTS}] AS x FROM v, range({PARTS}) t(k))),
b0 AS MATERIALIZED (SELECT k, r AS e, x, xx FROM p WHERE r < {ENTRIES})"""
    ]
    for i in range(rounds + 1):
        out.append(f"a{i} AS MATERIALIZED (SELECT p.r, p.k, min(({ENTRIES} * (p.xx - 2 * list_inner_product(p.x, b.x) + b.xx))::BIGINT + b.e) AS key FROM p JOIN b{i} b ON p.k = b.k GROUP BY p.r, p.k)")
        if i < rounds:
            out.append(
                f"""s{i} AS (SELECT k, key % {ENTRIES} AS e, j, sum(x[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN p USING (r, k), range(1, (SELECT max(len(x)) + 1 FROM p)) t(j) GROUP BY ALL),
n{i} AS (SELECT k, e, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY j) AS x FROM s{i} GROUP BY k, e),
b{i + 1} AS MATERIALIZED (SELECT k, e, x, list_inner_product(x, x) AS xx FROM (SELECT b.k, b.e, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN n{i} n USING (k, e)))"""
            )
    out.append(
        f"""done AS (SELECT r, string_agg(printf('%02x', key % {ENTRIES}), '' ORDER BY k) AS code, sum(key // {ENTRIES})::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT coalesce(sha256(string_agg(array_to_string(list_transform(x, lambda c: c::BIGINT), ','), ',' ORDER BY k, e)), sha256('')) AS digest FROM b{rounds})"""
    )
    return "WITH " + ",\n".join(out) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, digest AS codebooks_sha256 FROM v JOIN done USING (r), book"


OP13_SQL = _sql()
