"""Vector expressions in double precision, and the float32 blob codec."""

from __future__ import annotations

import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order of position; null for null vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot_constant(v: Column, query: list[float]) -> Column:
    """Dot product with a constant vector; no join is needed for the query."""
    return dot(v, F.array(*[F.lit(float(x)) for x in query]))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(v: Column) -> Column:
    """v over its length; a zero vector stays as it is. The length is computed once, inside a one-element lambda."""
    scaled = F.transform(F.array(norm(v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n)))
    return F.element_at(scaled, 1)


def normalize_eps(v: Column, eps: float = 1e-8) -> Column:
    """v over (its length + eps), the read-only client's variant."""
    return F.element_at(F.transform(F.array(norm(v) + eps), lambda n: F.transform(v, lambda x: x.cast("double") / n)), 1)


def similarity(dot_product: Column) -> Column:
    """Cosine of unit vectors mapped to 0..1."""
    return (dot_product + 1) / 2


def encode_blob(v: list[float]) -> bytes:
    return struct.pack(f"<{len(v)}f", *v)


def decode_blob(column: Column) -> Column:
    """Little-endian float32 blob -> array<float>, by an Arrow UDF (the JVM has no byte reinterpretation)."""
    import numpy as np
    import pandas as pd

    def decode(blobs):
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    # real classes, not names: Spark looks the hints up outside this function
    decode.__annotations__ = {"blobs": pd.Series, "return": pd.Series}
    return F.pandas_udf(decode, "array<float>")(column)
