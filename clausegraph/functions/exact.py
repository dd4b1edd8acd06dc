"""Order-independent arithmetic.

Sums of doubles depend on the order in which partitions and retried tasks
arrive.  Scores are therefore accumulated as scaled 64-bit integers: the same
input gives the same score, rank and tie on every run and cluster size.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 1_000_000_000


def to_fixed(c: Column, scale: int = SCALE) -> Column:
    return F.round(c * F.lit(float(scale)), 0).cast("bigint")


def from_fixed(c: Column, scale: int = SCALE) -> Column:
    return c.cast("double") / F.lit(float(scale))


def fixed_sum(c: Column, scale: int = SCALE) -> Column:
    return F.sum(to_fixed(c, scale))
