"""Composition weights, stratified sampling and non-response balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions.scalar import if_else, known_in
from quantgap.operators.joins import join_null_safe

ROWS_PER_PREFIX = 65_536


def composition_weights(df: DataFrame, cohort: str, origin: str, base, name: str = "w_origin") -> DataFrame:
    """Weight that gives every cohort the origin composition of the base cohort: base share over own share."""
    counts = df.groupBy(cohort, origin).count().where(F.col(cohort).isNotNull() & F.col(origin).isNotNull())
    shares = counts.withColumn("perc", 100 * F.col("count") / F.sum("count").over(W.partitionBy(cohort)))
    in_base = F.max(F.when(F.col(cohort) == F.lit(base), F.col("perc"))).over(W.partitionBy(origin))
    return shares.select(cohort, origin, "perc", (in_base / F.col("perc")).alias(name))


def stratified_sample(
    df: DataFrame, strata: list[str], quota: Column, row_key: str, seed: int = 42, constants: tuple | list = ()
) -> DataFrame:
    """Exactly ``quota(stratum size)`` rows of each stratum, without replacement, the first in the order of a hash.

    ``quota`` is an expression over ``_size``, the stratum columns and ``constants``, columns with one value per stratum.
    Rows are counted by hash prefixes, of as many digits as leave about ``ROWS_PER_PREFIX`` rows of the stratum to one;
    prefixes beyond the quota fall out in the join, and rows are ranked inside their prefix only.  A stratum holding most
    of the table therefore never meets in one task.
    """
    sizes = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"), *[F.max(c).alias(f"_{c}") for c in constants])
    digits = F.greatest(F.lit(1.0), F.ceil(F.log(16.0, F.col("_size") / F.lit(float(ROWS_PER_PREFIX))))).cast("int")
    sizes = sizes.withColumn("_digits", digits)
    digest = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(row_key)))
    hashed = join_null_safe(df, sizes.select(*strata, "_digits"), strata, "inner").withColumn("_hash", digest)
    hashed = hashed.withColumn("_prefix", F.col("_hash").substr(F.lit(1), F.col("_digits"))).drop("_digits")
    up_to = W.partitionBy(*strata).orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)
    counts = hashed.groupBy(*strata, "_prefix").agg(F.count(F.lit(1)).alias("count"))
    plan = join_null_safe(counts, sizes.withColumnsRenamed({f"_{c}": c for c in constants}), strata, "inner")
    plan = plan.withColumn("_left", quota - (F.sum("count").over(up_to) - F.col("count")))
    plan = plan.where("_left > 0").select(*strata, "_prefix", "_left")
    chosen = join_null_safe(hashed, plan, [*strata, "_prefix"], "inner")
    rank = F.row_number().over(W.partitionBy(*strata, "_prefix").orderBy("_hash", row_key))
    return chosen.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).select(*df.columns)


def missing_rate(df: DataFrame, by: list[str], value: str, name: str = "n_inconnu") -> DataFrame:
    """Share of rows without a value."""
    return df.groupBy(*by).agg(F.avg(F.col(value).isNull().cast("double")).alias(name))


def balance_nonresponse(
    df: DataFrame,
    year: str,
    status: str,
    wage: str,
    row_key: str,
    employed: str,
    unemployed: str,
    floor_wage: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Keep the unemployed as the bottom of the distribution, thinned as much as the employed lose to non-response.

    The unemployed without wage get ``floor_wage``; per year a share equal to the employed's share of missing wages is
    left out of them; the employed without wage are dropped.
    """
    rate = missing_rate(df.where(F.col(status) == employed), [year], wage)
    kept = df.where(known_in(status, [employed, unemployed]))
    kept = kept.withColumn(wage, if_else((F.col(status) != employed) & F.col(wage).isNull(), F.lit(floor_wage), F.col(wage)))
    kept = kept.join(rate, year, "left")
    thinned = stratified_by_rate(kept.where(F.col(status) == unemployed), [year, status], "n_inconnu", row_key, seed)
    both = kept.where(F.col(status) == employed).unionByName(thinned)
    return both.where(F.col(wage).isNotNull())


def stratified_by_rate(df: DataFrame, strata: list[str], rate: str, row_key: str, seed: int = 42) -> DataFrame:
    """Keep ``floor(n * (1 - rate))`` rows per stratum, the rate being a column that is constant within strata."""
    quota = F.floor(F.col("_size") * (1 - F.col(rate)))
    return stratified_sample(df, strata, quota, row_key, seed, [rate])
