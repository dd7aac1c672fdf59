"""Rounding as of exact values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 2**27 + 1: parts a double into two halves of 26 bits.
SPLITTER = 134217729.0


def round_half_even(x: Column, digits: int = 2) -> Column:
    """X rounded by its exact binary value, exact halves to the even neighbour: 2.675, which
    is below its decimal name, gives 2.67, and 0.125 gives 0.12. (Spark's round and bround go by
    the shortest decimal name instead.) For abs(x) below 2**52 / 10**digits, and at most 6 digits;
    larger values, NaN and NULL are themselves."""
    if not 0 <= digits <= 6:
        raise ValueError("digits must be within 0 and 6")
    scale = float(10**digits)
    x = x.cast("double")
    size = F.abs(x)
    p = size * scale
    # what the product lost: both halves times the scale are exact
    high = size * SPLITTER - (size * SPLITTER - size)
    lost = (high * scale - p) + (size - high) * scale
    low = F.floor(p).cast("double")
    over = p - low - 0.5
    up = (over > 0) | ((over == 0) & ((lost > 0) | ((lost == 0) & (low % 2 != 0))))
    out = (low + F.when(up, 1.0).otherwise(0.0)) / scale
    return F.when(size < 2.0**52 / scale, F.when(x < 0, -out).otherwise(out)).otherwise(x)
