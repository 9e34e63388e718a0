"""A handful of documents to try the engine on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TOPICS = [
    ("Search engines", "An inverted index maps each term to the documents that hold it and to the places where it stands."),
    ("Ranking", "Term frequency saturates, rare terms weigh more, and long documents are discounted."),
    ("Vectors", "Texts become points, and texts that mean the same lie close together."),
    ("Fusion", "Two rankings are brought to one scale and added with weights."),
    ("Crawling", "A frontier of addresses is worked off level by level, and none is visited twice."),
    ("Extraction", "Menus and adverts are left behind; what remains is the article."),
    ("Suggestions", "Words a few edits away from what was typed are offered with those that begin with it."),
    ("Streams", "Counts run on as events arrive, and late ones still find their window."),
    ("Columns", "A scan reads the columns it needs and skips what its filters rule out."),
    ("Shuffles", "Rows that share a key meet in one task; a hot key is split before they do."),
]


def sample_documents(spark: SparkSession) -> DataFrame:
    rows = [(k, t, c, f"https://samples.example.org/{k}", "web", {"topic": t.lower()}) for k, (t, c) in enumerate(_TOPICS, 1)]
    return spark.createDataFrame(rows, "doc_id long, title string, content string, url string, source_type string, doc_metadata map<string,string>")
