"""Documents by id: a table sorted by id, so that a few ids are looked up and not looked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import fingerprint, sorted_copy, table, working_dir

#: Ids that are looked up at a time; more of them are joined.
MOST_LOOKED_UP = 1000
#: Bytes of a row group: a lookup reads the column chunks of those that may hold an id.
ROW_GROUP = 4 * 1024 * 1024


@dataclass(frozen=True)
class DocumentStore:
    rows: DataFrame
    key: str = "doc_id"

    def fetch(self, wanted: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """The documents whose ids are in `wanted` (its column of the key's name). Up to MOST_LOOKED_UP ids become a filter of the scan."""
        rows = self.rows.select(self.key, *(columns or [c for c in self.rows.columns if c != self.key]))
        ids = wanted.select(self.key).distinct()
        few = [r[0] for r in ids.limit(MOST_LOOKED_UP + 1).collect() if r[0] is not None]
        return rows.where(F.col(self.key).isin(few)) if len(few) <= MOST_LOOKED_UP else rows.join(ids, self.key, "left_semi")


def build_store(docs: DataFrame, path: str, key: str = "doc_id") -> DocumentStore:
    """Write documents (of a table: they are read twice) in the order of their ids, in small row groups with Bloom filters on the id; one exchange and one copy."""
    options = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.block.size": str(ROW_GROUP)}
    return DocumentStore(sorted_copy(docs, path, (key,), **options), key)


_open: dict[tuple[str, str], tuple[tuple, DocumentStore]] = {}


def open_store(spark: SparkSession, sf_dir: str, name: str = "documents", key: str = "doc_id") -> DocumentStore:
    """A table as a store, made at its first use in a session and again when its files have changed."""
    at, now = (spark.sparkContext.applicationId, f"{sf_dir}/{name}"), fingerprint(spark, f"{sf_dir}/{name}.parquet")
    if at not in _open or _open[at][0] != now:
        _open[at] = now, build_store(table(spark, sf_dir, name), f"{working_dir(spark)}/store-{name}-{abs(hash((at, now))):x}", key)
    return _open[at][1]
