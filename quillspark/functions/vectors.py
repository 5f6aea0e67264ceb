"""Vector functions on array columns; in double precision, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(_double(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of unlike sizes or without length; null if one is null."""
    size = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when((F.size(a) != F.size(b)) | (size == 0), 0.0).otherwise(F.try_divide(dot(a, b), size))


def euclid(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def manhattan(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y)))


def valid(v: Column, size: int) -> Column:
    """Of this size and finite throughout."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) == size) & ~bad, F.lit(False))


def weighted_mean(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: (x * wa + y * wb) / (wa + wb))


def coerce(raw: Column) -> Column:
    """A vector from JSON: an array, {"embedding": [...]} or {"data": [{"embedding": [...]}]}; else an empty one."""
    numbers = "array<double>"
    plain = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, numbers))
    nested = F.from_json(F.get_json_object(raw, "$.embedding"), numbers)
    listed = F.from_json(F.get_json_object(raw, "$.data[0].embedding"), numbers)
    return F.coalesce(plain, nested, listed, F.array().cast(numbers))
