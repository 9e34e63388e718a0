"""Archives of fetched pages: records with a head and as many bytes of content as it says, in files that are read in splits.

`write_archive` writes a table of pages through Spark's text writer. The source `page_archive` reads any such files (plain, or .gz), as a batch or as
a stream of new files. A split begins at the first record at or after its first byte; heads say how long contents are, so records are found
by going from head to head, whatever their contents look like. A compressed file is one split.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

# The first line of a record, and what stands between records.
VERSION, BETWEEN = "WARC/1.0", "\r\n\r\n"
#: Bytes of a split, and rows of a batch.
SPLIT, ROWS = 64 * 1024 * 1024, 256
SCHEMA = "page_id long, url string, html string"


def write_archive(pages: DataFrame, path: str, compressed: bool = False) -> None:
    """Write (page_id, url, html) as records, a file for each task. Null urls and contents are told apart from empty ones."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), F.regexp_replace(c.cast("string"), r"[\r\n]", ""), F.lit("\r\n"))).otherwise("")
    head = F.concat(
        F.lit(f"{VERSION}\r\nWARC-Type: resource\r\n"), line("WARC-Record-ID", F.col("page_id")), line("WARC-Target-URI", F.col("url")),
        F.when(F.col("html").isNull(), "WARC-Truncated: unspecified\r\n").otherwise(""), F.lit("Content-Type: text/html\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"),
    )
    record = F.concat(head, F.coalesce("html", F.lit("")))
    writer = pages.select(record.alias("value")).write.option("lineSep", BETWEEN)
    (writer.option("compression", "gzip") if compressed else writer).text(path)


@dataclass
class Split(InputPartition):
    path: str
    low: int
    high: int


def _files(path: str) -> list[tuple[str, int]]:
    """The archive files of a folder (or the one file), and their sizes."""
    fs, root = pafs.FileSystem.from_uri(path) if ":" in path else (pafs.LocalFileSystem(), path)
    found = fs.get_file_info(root)
    infos = fs.get_file_info(pafs.FileSelector(root)) if found.type == pafs.FileType.Directory else [found]
    scheme = path.split(":", 1)[0] + "://" if ":" in path else ""
    return sorted((scheme + i.path, i.size) for i in infos if i.type == pafs.FileType.File and i.size and not i.base_name.startswith(("_", ".")))


def _splits(files: list[tuple[str, int]], size: int) -> list[Split]:
    return [Split(p, k, min(k + size, n)) for p, n in files for k in ([0] if p.endswith(".gz") else range(0, n, size))]


def records(source: io.RawIOBase, low: int, high: int | None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and contents of the records that begin in the bytes `low` to `high` of a source that can be sought; to its end if `high` is None."""
    at = 0
    while high is None or at < high:
        source.seek(at)
        if source.readline().strip() != VERSION.encode():
            return
        head, read = {}, source.readline()
        while read.strip():
            name, _, value = read.decode().partition(":")
            head[name.strip().lower()] = value.strip()
            read = source.readline()
        begin, length = source.tell(), int(head["content-length"])
        if at >= low:
            yield head, source.read(length)
        at = begin + length + len(BETWEEN)


def read_split(split: Split) -> Iterator[pa.RecordBatch]:
    fs, path = pafs.FileSystem.from_uri(split.path) if ":" in split.path else (pafs.LocalFileSystem(), split.path)
    rows: list[tuple] = []
    with fs.open_input_file(path) as opened:
        zipped = split.path.endswith(".gz")
        source = gzip.GzipFile(fileobj=opened) if zipped else io.BufferedReader(opened, 1 << 16)
        for head, content in records(source, split.low, None if zipped else split.high):
            number = head.get("warc-record-id")
            rows.append((int(number) if number else None, head.get("warc-target-uri"), None if "warc-truncated" in head else content.decode("utf-8", "replace")))
            if len(rows) == ROWS:
                yield _batch(rows)
                rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "url", "html"])


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Split]:
        return _splits(_files(self.path), self.size) or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from read_split(partition)


class ArchiveStream(DataSourceStreamReader):
    """A stream of files: an offset is the files that have been seen, by name."""

    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT))

    def initialOffset(self) -> dict:
        return {"files": []}

    def latestOffset(self) -> dict:
        return {"files": [p for p, _ in _files(self.path)]}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        new = set(end["files"]) - set(start["files"])
        return _splits([f for f in _files(self.path) if f[0] in new], self.size)

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        yield from read_split(partition)


class PageArchive(DataSource):
    """`spark.read.format("page_archive").option("splitBytes", n).load(path)`, and the same with `readStream`."""

    @classmethod
    def name(cls) -> str:
        return "page_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def streamReader(self, schema) -> ArchiveStream:
        return ArchiveStream(self.options)


def read_archive(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(page_id, url, html) of the archives in a folder."""
    spark.dataSource.register(PageArchive)
    return spark.read.format("page_archive").option("splitBytes", split).load(path)


def stream_archive(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """The same as a stream of the folder's new files."""
    spark.dataSource.register(PageArchive)
    return spark.readStream.format("page_archive").option("splitBytes", split).load(path)
