"""Column expressions over arrays of numbers, and the codec of vectors in text."""

from __future__ import annotations

import base64
import io

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def vectors_from_base64(texts: pd.Series) -> pd.Series:
    """Vectors from the base64 of their ``.npy`` bytes; null and empty texts are null."""
    return texts.map(lambda x: np.load(io.BytesIO(base64.b64decode(x)), allow_pickle=False).astype(np.float32).ravel() if x else None)


@F.pandas_udf(T.StringType())
def vectors_to_base64(vectors: pd.Series) -> pd.Series:
    """The base64 of a vector's ``.npy`` bytes; null stays null."""

    def encode(v) -> str | None:
        if v is None:
            return None
        out = io.BytesIO()
        np.save(out, np.asarray(v, np.float32))
        return base64.b64encode(out.getvalue()).decode()

    return vectors.map(encode)
