"""Vector functions: similarity, distance, normal form, codecs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """Sum of products; products and sum in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for unlike sizes, empty vectors and zero norms."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length).otherwise(0.0)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine within 0 and 2; 2 for unlike sizes and (almost) zero norms."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (length > 1e-12), F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - dot(a, b) / length))).otherwise(2.0)


def normalized(v: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: (x / n).cast("float"))).otherwise(v)


def argmax(v: Column) -> Column:
    """Index of the first largest element, from 0; null for an empty vector."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)) - 1).cast("int")


def parse_csv(text: Column, strict: bool = True) -> Column:
    """Comma-separated numbers as array<float>.

    Strict: null when any part is no finite number. Lenient: such parts are dropped.
    """
    parts = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("float"))
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(F.forall(parts, ok), parts) if strict else F.filter(parts, ok)


def to_csv(v: Column) -> Column:
    """Six digits after the point, whatever the locale."""
    return F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ",")


def encode_blob(v: Column) -> Column:
    """Little-endian 32-bit floats; null when an element is not finite."""
    @F.pandas_udf("binary")
    def encode(vs: pd.Series) -> pd.Series:
        def one(x):
            a = None if x is None else np.asarray(x, "<f4")
            return a.tobytes() if a is not None and np.isfinite(a).all() else None

        return vs.map(one)

    return encode(v)


def decode_blob(b: Column) -> Column:
    """The vector of a blob; null when its size is no multiple of 4 or an element is not finite."""
    @F.pandas_udf("array<float>")
    def decode(bs: pd.Series) -> pd.Series:
        def one(x):
            if x is None or len(x) % 4:
                return None
            a = np.frombuffer(x, "<f4")
            return a if np.isfinite(a).all() else None

        return bs.map(one)

    return decode(b)
