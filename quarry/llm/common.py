"""Helpers shared by the training-data operators: table access, shared storage, hashing."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the `documents` table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

_roots: dict[str, str] = {}
#: Where the tables are that `store` gave.
_stored: dict[int, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark's own reader (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """Folder that driver and executors share, below `spark.checkpoint.dir`.

    Only where that setting is absent on a local master (tests) a temporary folder is made.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = base or tempfile.mkdtemp(prefix="quarry-")
        _roots[app] = f"{base.rstrip('/')}/quarry-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def _remove(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: lineage ends here.

    Whatever executor is lost later, readers go back to these files and not to the plan.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _stored[id(out)] = path
    weakref.finalize(out, _stored.pop, id(out), None)
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables that `store` gave, once all that was made of them has been stored itself."""
    for df in stored:
        path = _stored.pop(id(df), None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def whole_rows(df: DataFrame, name: str = "row"):
    """All columns of `df` as one, so that none clashes with what an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of `batch` whose texts in `column` have at most `most` bytes together, or one row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(upto):
        past = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, past - at)
        at = past


def released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over Arrow batches that gives what it no longer uses back to the system when it ends: Python workers live on between tasks, and so would its peak."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
                libc.malloc_trim(0)

    return freed


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit words (xor-shift and multiply, bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
