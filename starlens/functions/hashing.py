"""Seeded, partition-independent pseudo-random values from md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(seed, *parts: Column) -> Column:
    """32 hex digits that depend only on the seed and the values; None where the first value holds the seed."""
    seeds = [] if seed is None else [F.lit(str(seed))]
    return F.md5(F.concat_ws(":", *seeds, *[p.cast("string") for p in parts]))


def hash_int(seed, *parts: Column) -> Column:
    """A whole number in 0 .. 2^60 - 1."""
    return F.conv(F.substring(hash_key(seed, *parts), 1, 15), 16, 10).cast("long")


def hash_share(seed, *parts: Column) -> Column:
    """A number from 0 up to 1, to be compared with a probability."""
    return hash_int(seed, *parts) / F.lit(float(2**60))
