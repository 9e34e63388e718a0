"""Vectors of documents and of their images, by a model that the caller brings (functions.vectors.encoder)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import data_uri_payload
from quarry.functions.vectors import embedding_text, encoder

# Fixed value: images of a document that get a vector.
MOST_IMAGES = 4


def document_vectors(docs: DataFrame, encode: Callable[[list], np.ndarray]) -> DataFrame:
    """(doc_id, embedding) of title and content together, at length 1; documents that the model fails on have none."""
    return docs.select("doc_id", encoder(encode)(embedding_text(F.col("title"), F.col("content"))).alias("embedding")).where("embedding is not null")


def image_vectors(docs: DataFrame, encode: Callable[[list], np.ndarray]) -> DataFrame:
    """(doc_id, position, embedding) of the first images of each document that have data; those that the model fails on have none.

    The model gets the bytes of an image; what cannot be decoded is passed over like what the model fails on.
    """
    with_data = F.filter("images", lambda i: F.coalesce(i.base64_data, F.lit("")) != "")
    each = docs.select("doc_id", F.posexplode(F.slice(with_data, 1, MOST_IMAGES)).alias("position", "image"))
    payload = F.expr("try_to_binary(payload, 'base64')")
    each = each.select("doc_id", "position", data_uri_payload(F.col("image.base64_data")).alias("payload")).select("doc_id", "position", payload.alias("data"))
    return each.select("doc_id", "position", encoder(encode)("data").alias("embedding")).where("embedding is not null")
