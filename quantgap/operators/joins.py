"""Join helpers: NULL keys match each other, size decides the strategy (no forced broadcast)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal-or-both-NULL keys; the right keys are dropped.

    The strategy is left to the optimizer: a small right side is broadcast below the session's size threshold,
    a large one is shuffled, and a skewed key is split by AQE.
    """
    if not keys:
        raise ValueError("no keys to join on")
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    joined = left.join(renamed, condition, how)
    return joined.drop(*[f"__r_{k}" for k in keys])


def join_suffixed(left: DataFrame, right: DataFrame, keys: list[str], suffix: str, how: str = "left") -> DataFrame:
    """Equi-join in which the right table's other columns take a suffix when their name is taken."""
    taken = set(left.columns)
    names = {c: f"{c}{suffix}" for c in right.columns if c not in keys and c in taken}
    return left.join(right.withColumnsRenamed(names), keys, how)


def deflate(df: DataFrame, index: DataFrame, year: str = "annee") -> DataFrame:
    """Attach the yearly price index; years without index keep a NULL."""
    return df.join(index, year, "left")
