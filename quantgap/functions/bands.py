"""Right-closed binning with ordered labels."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgap.functions.scalar import col
from quantgap.session import literal_table


def interval_labels(breaks: list[float], include_lowest: bool = False) -> list[str]:
    """Text of each bin, ``(a,b]``; digits grow from 3 until neighbouring breaks differ."""
    for digits in range(3, 13):
        texts = ["Inf" if math.isinf(b) and b > 0 else f"{float(b):.{digits}g}" for b in breaks]
        if all(a != b for a, b in zip(texts, texts[1:])):
            break
    labels = [f"({a},{b}]" for a, b in zip(texts, texts[1:])]
    if include_lowest:
        labels[0] = "[" + labels[0][1:]
    return labels


@dataclass(frozen=True)
class Bands:
    """Bins ``(b0,b1], (b1,b2], …``; the first is closed on both sides with ``include_lowest``; outside is NULL."""

    breaks: tuple
    labels: tuple = field(default=())
    include_lowest: bool = True

    def levels(self) -> list[str]:
        return list(self.labels) or interval_labels(list(self.breaks), self.include_lowest)

    def ordinal(self, x: str | Column) -> Column:
        """1-based bin number. ``Bucketizer`` and ``width_bucket`` close bins on the left, hence the plain comparisons."""
        x = col(x)
        number = reduce(lambda a, b: a + b, [(x > F.lit(b)).cast("int") for b in self.breaks])
        low, high = self.breaks[0], self.breaks[-1]
        inside = (x > F.lit(low)) & (x <= F.lit(high)) if not math.isinf(high) else x > F.lit(low)
        ordinal = F.when(inside, number)
        return ordinal.when(x == F.lit(low), F.lit(1)) if self.include_lowest else ordinal

    def label(self, x: str | Column) -> Column:
        return F.get(F.array(*[F.lit(v) for v in self.levels()]), self.ordinal(x) - 1)

    def level_ordinal(self, level: str) -> int:
        """Ordinal of a level, for ordered comparisons such as ``bands.ordinal(x) >= bands.level_ordinal('(1930,1935]')``."""
        return self.levels().index(level) + 1

    def table(self, spark: SparkSession) -> DataFrame:
        """Level table ``(ord, label, low, high)``."""
        rows = [
            (i + 1, label, float(a), float(b))
            for i, (label, a, b) in enumerate(zip(self.levels(), self.breaks, self.breaks[1:]))
        ]
        return literal_table(spark, [("ord", "int"), ("label", "string"), ("low", "double"), ("high", "double")], rows)


def period_labels(breaks: list[int]) -> list[str]:
    """Two-digit year ranges, 1982 and 1987 give ``82-87``."""
    short = [f"{b % 100:02d}" for b in breaks]
    return [f"{a}-{b}" for a, b in zip(short, short[1:])]


def decade_cohort(period_ordinal: Column, age_ordinal: Column, base: int = 1960) -> Column:
    """Birth decade implied by period and age band numbers."""
    return ((period_ordinal - age_ordinal) * 10 + base).cast("int")


# Bands used by the analyses.
AGE_BY_TEN = Bands((30, 40, 50, 60))
AGE_BY_FIVE = Bands((30, 35, 40, 45, 50, 55, 60))
PERIOD_BY_ELEVEN = Bands((1990, 2001, 2012, 2023), ("90-00", "01-11", "12-23"))
PERIOD_BY_FIVE = Bands(
    tuple(range(1982, 2018, 5)) + (2023,), tuple(period_labels(list(range(1982, 2018, 5)) + [2023]))
)
BIRTH_BY_FIVE = Bands(tuple(range(1880, 2011, 5)))
