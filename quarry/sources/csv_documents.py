"""Documents from CSV files whose columns go by several names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The column names that are taken for each field, in order of preference.
TITLE_NAMES = ["title", "标题", "question", "问题", "query", "查询"]
CONTENT_NAMES = ["content", "内容", "answer", "回答", "text", "文本", "description", "描述"]
URL_NAMES = ["url", "link", "链接"]


def first_filled(df: DataFrame, names: list[str]) -> Column:
    """The first of these columns that is there and not empty, else null."""
    found = [F.nullif(F.col(f"`{n}`").cast("string"), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def coalesce_columns(df: DataFrame, number: Column, others: list[str] | None = None) -> DataFrame:
    """Title, content and url of each row; `number` counts rows from 1 and names those without a title.

    Content falls back on all filled values (of the columns `others`, or all) joined by a space. A title of over 100
    characters is replaced by the first 50 of the content and an ellipsis.
    """
    title = F.coalesce(first_filled(df, TITLE_NAMES), F.concat(F.lit("Document "), number.cast("string")))
    joined = F.concat_ws(" ", *[F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (others or df.columns)])
    content = F.coalesce(first_filled(df, CONTENT_NAMES), joined)
    title = F.when(F.length(title) > 100, F.concat(F.left(content, F.lit(50)), F.lit("..."))).otherwise(title)
    return df.select(number.cast("long").alias("row_number"), title.alias("title"), content.alias("content"), F.coalesce(first_filled(df, URL_NAMES), F.lit("")).alias("url"))


def read_csv_documents(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    """The first `limit` rows of a CSV file with a header line, as documents. The limit is the loader's contract."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).limit(limit)
    numbered = raw.withColumn("__row", F.monotonically_increasing_id() + 1)
    return coalesce_columns(numbered, F.col("__row"), raw.columns)
