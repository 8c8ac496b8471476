"""Bit masks and combinations, on the driver and as Columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def mask_to_list(mask: int) -> list[int]:
    """Positions of the set bits, ascending."""
    return [i for i in range(mask.bit_length()) if mask >> i & 1]


def mask_to_array(mask: Column, bits: int) -> Column:
    """The same of a long, of which the lowest `bits` (64 at most) are looked at."""
    return F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.getbit(mask, i) == 1)


def next_mask(mask: int, n: int) -> int | None:
    """The next larger integer with as many set bits, or None if that needs more than n bits."""
    if mask == 0:
        return None
    low = mask & -mask
    high = mask + low
    after = high | ((mask ^ high) >> 2) // low
    return after if after < 1 << n else None


def masks_of_size(n: int, k: int) -> Iterator[int]:
    """All n-bit masks with k set bits, ascending."""
    mask: int | None = (1 << k) - 1
    while mask is not None and mask < 1 << n:
        yield mask
        mask = next_mask(mask, n)


def combinations_of(items: Sequence, k: int) -> list[tuple]:
    """The k-combinations, in the order of positions; one empty for k = 0, none for k > len(items)."""
    return list(combinations(items, k))


def masks(spark: SparkSession, n: int, k: int) -> DataFrame:
    """All n-bit masks with k set bits, as a table: mask, members."""
    ids = spark.range(1 << n).where(F.bit_count("id") == k)
    return ids.select(F.col("id").alias("mask"), mask_to_array(F.col("id"), n).alias("members"))
