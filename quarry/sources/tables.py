"""Reading input tables, and keeping derived tables in a folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_roots: dict[str, str] = {}

# The tables of the engine, as DDL: parsing it needs a session.
DOCUMENTS = (
    "doc_id long, title string, content string, url string, source_type string, doc_metadata map<string,string>, doc_length int, "
    "images array<struct<url: string, base64_data: string, alt_text: string, width: int, height: int>>, created_at timestamp, updated_at timestamp"
)
POSTINGS = "term string, doc_id long, tf long, positions array<int>"
TERMS = "term string, doc_frequency long, total_frequency long"
EMBEDDINGS = "doc_id long, embedding array<float>"
SEARCH_LOG = "id long, user_id long, query string, ts timestamp"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def working_dir(spark: SparkSession) -> str:
    """A folder of this session below `spark.checkpoint.dir`; a temporary one only where that is unset on a local master."""
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
    """Delete a folder."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def keep(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write a derived table once and read it from there; `by` sorts it so that row groups can be skipped."""
    return written(df, f"{working_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:8]}", by)


def written(df: DataFrame, path: str, by: tuple[str, ...] = (), **options: str) -> DataFrame:
    """Write a table to `path` and read it from there, sorted by the columns `by`.

    Ranges are cut by all columns of `by`, so a first column with few or very frequent values is no hot partition. The table is
    written before it is sorted as well: choosing the ranges reads it once more, and would otherwise make it once more.
    """
    spark = df.sparkSession
    if not by:
        df.write.options(**options).parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    unsorted = f"{path}-unsorted"
    df.write.parquet(unsorted)
    sorted_copy(spark.read.schema(df.schema).parquet(unsorted), path, by, **options)
    _remove(spark, unsorted)
    return spark.read.schema(df.schema).parquet(path)


def sorted_copy(df: DataFrame, path: str, by: tuple[str, ...], **options: str) -> DataFrame:
    """The same for rows that can be read twice at little cost, such as those of files: they are exchanged once and written once."""
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def moved(spark: SparkSession, path: str, to: str) -> None:
    """Give a finished folder its name, unless another has it."""
    source, target = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, to))
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) or not files.rename(source, target):
        _remove(spark, path)


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds, sorted; nothing where there is no folder."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in files.listStatus(root)) if files.exists(root) else []


def fingerprint(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """How many files a table has, their bytes, and when the last was written: another one means another table."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
    found = (0, 0, 0)
    while files.hasNext():
        f = files.next()
        found = (found[0] + 1, found[1] + f.getLen(), max(found[2], f.getModificationTime()))
    return found


def overwrite_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Clear a table: an empty one of the same schema takes its place."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(schema).parquet(path)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) of each table, from file footers where the source has them."""
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)


def active(rows: DataFrame, deleted: str = "deleted_at") -> DataFrame:
    """Rows that are not softly deleted."""
    return rows.where(F.col(deleted).isNull())


def public(users: DataFrame) -> DataFrame:
    """Users as others may see them: nothing that only the server may know."""
    return users.drop("password_hash", "deleted_at")


def recreate(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Drop all tables of a folder, whatever they held, and make them anew, empty."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)
    return {name: overwrite_empty(spark, f"{folder}/{name}", schema) for name, schema in schemas.items()}


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 8, driver: str | None = None) -> DataFrame:
    """A table of a relational database, read in ranges of `key` if one is given. The driver's jar must be on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if driver:
        reader = reader.option("driver", driver)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
