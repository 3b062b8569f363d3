"""Samples of records: each by chance, by a stable hash, or a fixed number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_of, unsigned_less

MAX = (1 << 64) - 1


def check(rate: float | None = None, n: int | None = None, stable: bool = False) -> None:
    if (rate is None) == (n is None or n < 0):
        raise ValueError("exactly one of rate and count is needed")
    if rate is not None and not 0 <= rate <= 1:
        raise ValueError("rate must be between 0 and 1")
    if stable and rate is None:
        raise ValueError("stable goes with a rate")


def threshold(rate: float) -> int:
    return min(int(rate * float(MAX)), MAX)


def by_chance(df: DataFrame, rate: float, seed: int | None = None) -> DataFrame:
    """Each row with probability ``rate``. A seed repeats the choice for the same partitions only."""
    check(rate)
    return df.filter((F.rand(seed or None) if seed else F.rand()) < rate)


def stable(df: DataFrame, item: str, rate: float, seed: int = 0) -> DataFrame:
    """Rows whose item's hash is below the rate's part of the range: the same on every run and partitioning."""
    check(rate, stable=True)
    if rate >= 1:
        return df
    return df.filter(unsigned_less(hash_of(F.col(item), seed), threshold(rate)))


def fixed(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """``n`` rows, or all if there are fewer, each set of n as likely: the n least of random keys."""
    check(n=n)
    return df.withColumn("_key", F.rand(seed) if seed else F.rand()).orderBy("_key").limit(n).drop("_key")
