"""Tables as the report shows them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgap.functions.scalar import col


def fixed(x: str | Column, digits: int) -> Column:
    """Rounded number as text with a fixed number of decimals."""
    return F.format_string(f"%.{digits}f", F.round(col(x), digits))


def chart_tiles(estimates: DataFrame, keys: list[str], index: str = "w", low: str = "lo", high: str = "hi") -> DataFrame:
    """Index with two decimals and its interval ``[lo, hi]`` with three."""
    interval = F.concat(F.lit("["), fixed(low, 3), F.lit(", "), fixed(high, 3), F.lit("]"))
    return estimates.select(
        *keys,
        F.when(F.col(index).isNotNull(), fixed(index, 2)).alias("indice"),
        F.when(F.col(low).isNotNull() & F.col(high).isNotNull(), interval).alias("intervalle"),
    )


def share_tiles(compared: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of two distances with two decimals and the explained share as ``x%``."""
    return compared.select(
        *keys,
        F.when(F.col("delta").isNotNull(), fixed("delta", 2)).alias("indice"),
        F.when(F.col("share").isNotNull(), F.concat(fixed("share", 1), F.lit("%"))).alias("part"),
    )


def mean_tiles(gaps: DataFrame, keys: list[str], value: str = "diff_logsal") -> DataFrame:
    """Mean gap to the reference group per tile."""
    return gaps.select(*keys, (F.round(value, 3) + F.lit(0.0)).alias(value))
