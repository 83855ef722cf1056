"""Statistics of cells: conditional aggregates, shares, gaps to a reference, bracket percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions.scalar import odds_ratio, safe_log
from quantgap.operators.joins import join_null_safe


def mean_sd(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Mean and sample deviation, NULLs skipped; one row has no deviation."""
    return df.groupBy(*cell).agg(F.avg(value).alias(f"mean_{value}"), F.stddev_samp(value).alias(f"sd_{value}"))


def mean_count(df: DataFrame, cell: list[str], value: str, constant: str) -> DataFrame:
    """Cell mean, row count and a column that is constant in the cell (its minimum where it is not)."""
    return df.groupBy(*cell).agg(F.avg(value).alias(value), F.min(constant).alias(constant), F.count(F.lit(1)).alias("n"))


def geometric_mean(value: str | Column) -> Column:
    return F.exp(F.avg(safe_log(value)))


def group_stats(df: DataFrame, cell: list[str], group: str, value: str) -> DataFrame:
    """Mean, deviation and count per cell and group, long form."""
    return df.groupBy(*cell, group).agg(
        F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")
    )


def conditional_stats(df: DataFrame, cell: list[str], group: str, value: str, groups: dict[str, str]) -> DataFrame:
    """``m_k, sd_k, n_k`` columns per group; absent groups have a NULL mean and count 0."""
    stats = []
    for level, short in groups.items():
        mine = F.when(F.col(group) == level, F.col(value))
        stats += [
            F.avg(mine).alias(f"m_{short}"),
            F.stddev_samp(mine).alias(f"sd_{short}"),
            F.count_if(F.col(group) == level).alias(f"n_{short}"),
        ]
    return df.groupBy(*cell).agg(*stats)


def smaller_group(df: DataFrame, cell: list[str], group: str, first: str, second: str, name: str = "n_min") -> DataFrame:
    """Sizes of two groups per cell and the smaller of them."""
    counts = df.groupBy(*cell).agg(
        F.count_if(F.col(group) == first).alias("n_first"), F.count_if(F.col(group) == second).alias("n_second")
    )
    return counts.withColumn(name, F.least("n_first", "n_second"))


def missing_share(df: DataFrame, by: list[str], value: str, name: str = "missing") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.col(value).isNull().cast("double")).alias(name))


def moments(df: DataFrame, cell: list[str], value: str) -> DataFrame:
    """Moment skewness and kurtosis; the kurtosis of a normal sample is 3."""
    return df.groupBy(*cell).agg(F.skewness(value).alias("skew"), (F.kurtosis(value) + 3).alias("kurt"))


def conditional_rate(df: DataFrame, cell: list[str], group: str, status: str, hit: str, base: list[str], groups: dict[str, str]) -> DataFrame:
    """Rate of ``hit`` among the ``base`` states for each group of a cell."""
    rates = []
    for level, short in groups.items():
        mine = F.col(group) == level
        rates.append(
            F.try_divide(F.count_if(mine & (F.col(status) == hit)), F.count_if(mine & F.col(status).isin(*base))).alias(f"rate_{short}")
        )
    return df.groupBy(*cell).agg(*rates)


def rate_odds(rates: DataFrame, first: str, second: str, name: str = "odds") -> DataFrame:
    return rates.withColumn(name, odds_ratio(F.col(first), F.col(second)))


def pick(key: str, wanted, value: str) -> Column:
    """Value of the row whose key is the wanted one, as an aggregate."""
    return F.max(F.when(F.col(key) == F.lit(wanted), F.col(value)))


def pick_over(key: str, wanted, value: str, by: list[str]) -> Column:
    """The same beside every row of its group."""
    return pick(key, wanted, value).over(W.partitionBy(*by))


def share_in_group(counts: DataFrame, by: list[str], count: str = "n", name: str = "perc") -> DataFrame:
    """Percent of a count within its group (for aggregated tables)."""
    return counts.withColumn(name, 100 * F.col(count) / F.sum(count).over(W.partitionBy(*by)))


def gap_to_reference(stats: DataFrame, by: list[str], key: str, ref, value: str, name: str) -> DataFrame:
    """Difference between each row of a cell table and the reference row of its group."""
    return stats.withColumn(name, F.col(value) - pick_over(key, ref, value, by))


def reference_join(stats: DataFrame, cell: list[str], group: str, ref, value: str) -> DataFrame:
    """Other groups beside the reference group of the cell: ``<value>_ref`` and ``diff_<value>``."""
    reference = stats.where(F.col(group) == F.lit(ref)).select(*cell, F.col(value).alias(f"{value}_ref"))
    others = stats.where(F.col(group) != F.lit(ref))
    joined = join_null_safe(others, reference, cell, "left")
    return joined.withColumn(f"diff_{value}", F.col(value) - F.col(f"{value}_ref"))


def keep_varied_groups(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows of groups in which a column takes more than one value."""
    varied = df.groupBy(by).agg(F.min(value).alias("_a"), F.max(value).alias("_b")).where("_a <> _b").select(by)
    return df.join(varied, by, "left_semi")


def bracket_mid_percentile(df: DataFrame, year: str, bracket: str, order: str, name: str = "centile_moyen") -> DataFrame:
    """Middle percentile of each bracket in its year: half-way between the running shares before and after it."""
    counts = df.where(F.col(bracket).isNotNull()).groupBy(year, bracket, order).agg(F.count(F.lit(1)).alias("n"))
    by_year = W.partitionBy(year)
    ordered = by_year.orderBy(order)
    shares = counts.withColumn("prop", 100 * F.col("n") / F.sum("n").over(by_year))
    shares = shares.withColumn("cum", F.sum("prop").over(ordered.rowsBetween(W.unboundedPreceding, 0)))
    shares = shares.withColumn("cum_prec", F.lag("cum", 1, 0.0).over(ordered))
    return shares.select(year, bracket, order, "n", ((F.col("cum") + F.col("cum_prec")) / 2).alias(name))
