"""Bootstrap replicates of the distances and their percentile intervals."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgap.operators.draws import replicate_distances, replicate_frame
from quantgap.operators.joins import join_null_safe
from quantgap.operators.samples import ROWS_PER_SLICE, Slicing, plan_slices
from quantgap.session import cut_lineage, literal_table

DRAWS_PER_HASH = 4
HEX_DIGITS = 8


def poisson_thresholds() -> list[str]:
    """Cumulative Poisson(1) probabilities on the scale of eight hexadecimal digits."""
    total, term, cuts = 0.0, math.exp(-1), []
    for k in range(12):
        total += term
        term /= k + 1
        cut = math.floor(total * 2 ** (4 * HEX_DIGITS))
        if cut < 2 ** (4 * HEX_DIGITS) - 1:
            cuts.append(f"{cut:0{HEX_DIGITS}x}")
    return cuts


def poisson_draw(digits: Column) -> Column:
    """Poisson(1) count from uniform hexadecimal digits; equal-length hex text sorts like the number it stands for."""
    cuts = poisson_thresholds()
    draw = F.when(digits < F.lit(cuts[0]), 0)
    for count, cut in enumerate(cuts[1:], start=1):
        draw = draw.when(digits < F.lit(cut), count)
    return draw.otherwise(len(cuts))


def poisson_replicates(df: DataFrame, row_key: str, replicates: int = 100, seed: int = 42, rep: str = "rep", draw: str = "draw") -> DataFrame:
    """Each row once per replicate in which it is drawn, with its number of draws.

    Draws depend on seed, replicate and row key only, so a recomputed task gives the same replicate.  One hash serves
    four replicates and rows that are not drawn are dropped before any shuffle.
    """
    blocks = math.ceil(replicates / DRAWS_PER_HASH)
    hashed = df.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hashed = hashed.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_block"), F.col(row_key))))
    spread = hashed.withColumn("_part", F.explode(F.array(*[F.lit(j) for j in range(DRAWS_PER_HASH)])))
    digits = F.substring(F.col("_hash"), F.col("_part") * HEX_DIGITS + 1, F.lit(HEX_DIGITS))
    drawn = spread.select(*df.columns, (F.col("_block") * DRAWS_PER_HASH + F.col("_part")).cast("int").alias(rep), digits.alias("_digits"))
    drawn = drawn.where((F.col("_digits") >= poisson_thresholds()[0]) & (F.col(rep) < replicates))
    return drawn.select(*df.columns, rep, poisson_draw(F.col("_digits")).alias(draw))


def draw_slices(replicates: int) -> int:
    """Rows of a slice whose draws in all replicates are as many numbers as a plain slice has rows."""
    return max(1, ROWS_PER_SLICE // replicates)


def bootstrap_wasserstein(
    df: DataFrame,
    cell: list[str],
    group: str,
    value: str,
    ref: str,
    targets: list[str],
    row_key: str,
    replicates: int = 100,
    seed: int = 42,
    p: float = 2,
    min_obs: int = 2,
    method: str = "poisson",
    slicing: Slicing | None = None,
) -> DataFrame:
    """Distance of every (cell, replicate, target); whole cells are resampled, so group sizes vary between replicates.

    Draws are made on the histogram of each cell (:mod:`quantgap.operators.draws`); with ``method="multinomial"`` a
    replicate has exactly as many draws as its cell has rows.
    """
    kept = df.select(*cell, group, value, row_key).where(F.col(value).isNotNull())
    # A task holds the draws of all replicates for a few slices, so slices are smaller than those of plain walks.
    slicing = slicing or plan_slices(kept, value, draw_slices(replicates))
    frame = replicate_frame(kept, cell, group, value, row_key, replicates, seed, method, slicing, [*targets, ref])
    return replicate_distances(frame, cell, group, ref, targets, replicates, p, min_obs)


def bootstrap_cases(
    df: DataFrame, cell: list[str], group: str, cases: dict[str, str], ref: str, targets: list[str], row_key: str, replicates: int = 100, seed: int = 42, p: float = 2, min_obs: int = 2,
    count: str | None = None,
) -> DataFrame:
    """``cell…, cas, rep, group, w``: several values of the same rows (real and counterfactual) on the same draws.

    What is drawn are the distinct combinations of values in a group; each case then walks along its own value.
    With ``count`` the rows stand for so many each, and ``row_key`` is the smallest of theirs.  The combinations are written,
    as they are read several times and what maps the values is costly.
    """
    values = list(cases.values())
    rows = df.select(*cell, group, row_key, *values, *([count] if count else [])).dropna(subset=values)
    number = F.sum(count) if count else F.count(F.lit(1))
    units = cut_lineage(rows.groupBy(*cell, group, *values).agg(number.alias("_count"), F.min(row_key).alias("_unit")), "units")
    entries = F.array(*[F.struct(F.lit(case).alias("cas"), F.col(column).cast("double").alias("_value")) for case, column in cases.items()])
    long = units.select(*cell, group, "_count", "_unit", F.inline(entries))
    slicing = plan_slices(long, "_value", draw_slices(replicates))
    frame = replicate_frame(long, [*cell, "cas"], group, "_value", "_unit", replicates, seed, "poisson", slicing, [*targets, ref], "_count")
    return replicate_distances(frame, [*cell, "cas"], group, ref, targets, replicates, p, min_obs)


def interval_constants(replicates: int, level: float = 0.95, least: int = 10) -> list[tuple]:
    """For every number of usable replicates: order-statistic index and interpolation share of both interval ends.

    The rank ``(R + 1) * alpha`` is interpolated on the normal scale; ranks below 1 or beyond R use the extreme value.
    """
    quantile = NormalDist().inv_cdf
    rows = []
    for r in range(least, replicates + 1):
        entry = [r]
        for alpha in ((1 - level) / 2, (1 + level) / 2):
            rank = (r + 1) * alpha
            k = math.floor(rank + 1e-9)
            if k <= 0:
                entry += [1, 0.0]
            elif k >= r:
                entry += [r, 0.0]
            elif abs(rank - k) < 1e-9:
                entry += [k, 0.0]
            else:
                below, above = quantile(k / (r + 1)), quantile((k + 1) / (r + 1))
                entry += [k, (quantile(alpha) - below) / (above - below)]
        rows.append(tuple(entry))
    return rows


def percentile_interval(
    replicates: DataFrame, keys: list[str], stat: str = "w", total: int | None = None, level: float = 0.95, least: int = 10
) -> DataFrame:
    """``keys…, reps, lo, hi``; missing replicates are dropped, fewer than ``least`` usable ones give NULL ends.

    A key's replicates fit an array.  ``total`` is their largest number where it is known; otherwise it is counted.
    """
    if total is None:
        replicates = cut_lineage(replicates.select(*keys, stat), "replicates")
        total = replicates.groupBy(*keys).agg(F.count(stat).alias("n")).agg(F.max("n")).first()[0] or 0
    constants = literal_table(
        replicates.sparkSession,
        [("reps", "int"), ("_k1", "int"), ("_s1", "double"), ("_k2", "int"), ("_s2", "double")],
        interval_constants(total, level, least),
    )
    gathered = replicates.groupBy(*keys).agg(
        F.sort_array(F.collect_list(stat)).alias("_t"), F.count(stat).cast("int").alias("reps")
    )
    joined = gathered.join(constants, "reps", "left")

    def end(k: str, share: str) -> Column:
        low = F.get("_t", F.col(k) - 1)
        high = F.coalesce(F.get("_t", F.col(k)), low)
        return low + F.col(share) * (high - low)

    return joined.select(*keys, "reps", end("_k1", "_s1").alias("lo"), end("_k2", "_s2").alias("hi"))


def with_interval(estimates: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Estimates with their interval; estimates without one stay."""
    return join_null_safe(estimates, intervals, keys, "left")
