"""Vector columns: dot product, cosine, norms and pooling, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def literal(values) -> Column:
    """A Python sequence as one array literal."""
    return F.lit([float(x) for x in values]) if len(values) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(doubles(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for different lengths or a zero norm, null for a null vector."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when((F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)


def relativity(cos: Column) -> Column:
    """A cosine in [-1, 1] on the [0, 1] scale of search thresholds."""
    return (cos + 1) / 2


def l2_normalize(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / n))


def parse_vector(text: Column) -> Column:
    """'[0.1,0.2]' to array<float>; null where it isn't one."""
    return F.from_json(text, "array<float>")


def format_vector(v: Column) -> Column:
    return F.to_json(v)
