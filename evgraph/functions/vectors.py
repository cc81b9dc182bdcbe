"""Vectors as arrays: cosine distance and the deterministic embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """0 to 2; 1 if either is zero; null, empty or unequally long vectors are an error."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    value = F.when(size == 0, F.lit(1.0)).otherwise(1 - F.least(F.greatest(dot(a, b) / size, F.lit(-1.0)), F.lit(1.0)))
    bad = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
    return F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("vectors must be of one length and not empty")).cast("double")).otherwise(value)


def embed(text: Column, dimension: int) -> Column:
    """Bytes of SHA-256 of the text, repeated, scaled to [-1, 1] and to unit length; blank texts give zeros."""
    h = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(min(dimension, 32) - 1)), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("float") / F.lit(255.0).cast("float") * 2 - 1)
    whole = F.flatten(F.array_repeat(raw, -(-dimension // 32))) if dimension > 32 else raw
    whole = F.slice(whole, 1, dimension)
    unit = F.element_at(F.transform(F.array(whole), lambda v: F.transform(v, lambda x: (x / norm(v)).cast("float"))), 1)
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", F.array_repeat(F.lit(0.0).cast("float"), dimension)).otherwise(unit)
