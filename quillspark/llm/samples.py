"""Bounded samples by a bound of hashes: rows are counted first, and only those below the bound are gathered, whatever the number of partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def smallest(n: float, rows: int) -> float:
    """The share of all hash values below which at least `rows` of n evenly hashed rows lie, but for a chance of one in 10^10; n may be off by a few per cent."""
    return 1.0 if n <= 0 else min(1.0, 1.15 * (rows + 7 * math.sqrt(rows)) / n)


def below(hashed: Column, share: float | Column) -> Column:
    """Whether a 64-bit hash lies in the lowest share of all values."""
    return hashed.cast("double") <= F.lit(-(2.0**63)) + F.lit(2.0**64) * share
