"""Vector arithmetic in double precision."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return F.when(norm(v) == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / norm(v)))


def encoder(encode: Callable[[list], np.ndarray]):
    """A pandas UDF around a model: it gets the values of a batch and gives a row of numbers for each.

    Vectors are brought to length 1. A batch that the model fails on is tried value by value, and a value that it fails on is null, as is a null value.
    """

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(values: pd.Series) -> pd.Series:
        def one(batch: list) -> list:
            v = np.asarray(encode(batch), np.float64).reshape(len(batch), -1)
            return list(v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), np.finfo(float).tiny))

        there = values.notna()
        out = pd.Series([None] * len(values), index=values.index, dtype=object)
        given = values[there].tolist()
        try:
            found = one(given) if given else []
        except Exception:  # whatever a model raises: one bad value must not cost the others
            found = []
            for x in given:
                try:
                    found += one([x])
                except Exception:
                    found.append(None)
        for i, v in zip(values.index[there], found, strict=True):
            out[i] = v
        return out

    return embed


def embedding_text(title: Column, content: Column) -> Column:
    """What a document is embedded by."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(content, F.lit("")))


def letter_counts(letters: str) -> Callable[[list], np.ndarray]:
    """A stand-in for a model, to try the engine on: how often each of the letters comes."""
    return lambda texts: np.array([[t.count(c) for c in letters] for t in texts], float)
