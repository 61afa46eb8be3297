"""Vectors as arrays: built-in higher-order functions on doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(v: Column, size: int | None = None) -> Column:
    """Not null, with finite components only and a length above 0."""
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(v) > 0)
    return fine & (F.size(v) == size) if size else fine


def cosine(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b))))


def average_hash(v: Column) -> Column:
    """A bit for each component: whether it reaches their mean."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)
    return F.array_join(F.transform(v, lambda x: F.when(x >= mean, "1").otherwise("0")), "")


def bits(text: Column) -> Column:
    """64 binary digits as a signed long."""
    return F.conv(text, 2, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))
