"""Counterfactual values: every group is moved onto the distribution of a reference group, rank by rank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions.scalar import clamp, is_finite
from quantgap.operators.distance import interpolate
from quantgap.operators.joins import join_null_safe
from quantgap.operators.samples import Slicing, attach_by_value, plan_slices, ranked

LOWEST, HIGHEST = 0.001, 0.999


def counterfactual(
    df: DataFrame,
    cell: list[str],
    group: str,
    value: str,
    ref: str,
    carry: tuple | list = (),
    split: tuple | list = (),
    weight: str | None = None,
    slicing: Slicing | None = None,
    name: str = "counterfactual",
    unit: str | None = None,
) -> DataFrame:
    """Value of each row after mapping its group onto the reference group of the cell.

    A row at rank ``u`` of its own group takes the type-7 quantile of the reference group at ``u`` limited to
    ``[.001, .999]``.  Reference rows, and cells without reference rows, keep their value.  With ``weight`` ranks are
    weighted and quantiles interpolate on the cumulative share (see :func:`weighted_rank`).

    Output: ``cell…, group, value, counterfactual, freq`` with one row per distinct value and ``freq`` rows behind it, which
    is all that a measurement in a coarser cell needs.  ``split`` names categories that divide these rows further (the
    sex, where sexes are compared afterwards).  With ``carry`` the mapping is attached to the single rows and these
    columns of theirs are kept; with ``unit`` the smallest row key behind a distinct value is, which needs no single rows.
    """
    if unit and (carry or weight):
        raise ValueError("unit goes with distinct unweighted values")
    slicing = slicing or plan_slices(df, value)
    keys = [*cell, group]
    if split and weight:
        # Weighted interpolation runs between distinct values, so the mapping is made before rows are divided.
        mapping = map_to_reference(ranked(df, cell, group, value, weight, (), slicing), cell, group, value, ref, [], True, slicing, name)
        finite = df.withColumn(value, F.col(value).cast("double")).where(is_finite(value) & F.col(group).isNotNull())
        counts = finite.groupBy(*keys, *split, value).agg(F.count(F.lit(1)).alias("freq"))
        mapped = join_null_safe(counts, mapping.drop("freq"), [*keys, value], "inner")
        mapped = mapped.select(*keys, *split, value, name, "freq")
    else:
        rows = ranked(df, cell, group, value, weight, split, slicing, unit=unit)
        mapped = map_to_reference(rows, cell, group, value, ref, list(split), weight is not None, slicing, name, unit)
    if not carry:
        return mapped
    mapping = mapped.select(*keys, *split, F.col(value).alias("_v"), name, F.col("freq").alias("_w"))
    single = attach_by_value(df, [*cell, *split], group, value, list(carry), mapping, slicing)
    return single.select(*keys, *split, *carry, F.col("_v").alias(value), name, F.lit(1).cast("long").alias("freq"))


def map_to_reference(
    rows: DataFrame, cell: list[str], group: str, value: str, ref: str, split: list[str], weighted: bool, slicing: Slicing, name: str, unit: str | None = None
) -> DataFrame:
    """Mapping of ranked rows in one ordered walk along the rank axis of each cell.

    Reference rows hold a stretch of ranks and answer; the others ask at their rank.  The rank limits act on both sides:
    the reference row holding the low limit serves every rank below it, likewise at the top, and the rows beyond answer
    nothing.  Asking rows are placed by their unlimited rank, so those beyond the limits do not pile up in one slice.
    """
    is_ref = F.col(group) == F.lit(ref)
    before, after = (F.col("_cum") - F.col("_w")).cast("double"), F.col("_cum").cast("double")
    if weighted:
        own_rank = weighted_rank()
        low, high = before / F.col("_n"), after / F.col("_n")
        answers = (high >= LOWEST) & (low < HIGHEST)
        start = F.when(low < LOWEST, F.lit(0.0)).otherwise(low)
        end = F.when(high >= HIGHEST, F.lit(1.0)).otherwise(high)
        hit = F.struct("_v", "_prev", low.alias("_low"), high.alias("_high"))
    else:
        # In rank units a row holds [before, after); each limit falls in exactly one row.
        own_rank = F.col("_cum_tie") / F.col("_n")
        span = F.col("_n") - 1
        floor_at, ceil_at = F.floor(span * LOWEST), F.floor(span * HIGHEST)
        answers = (after > floor_at) & (before <= ceil_at)
        start = F.when(before <= floor_at, F.lit(0.0)).otherwise(F.try_divide(before, span))
        end = F.when(after > ceil_at, F.lit(1.0)).otherwise(F.try_divide(after, span))
        hit = F.struct("_v", "_next", "_cum", F.col("_n").alias("_ref_n"))
    placed = rows.select(
        *cell,
        group,
        *split,
        *(["_unit"] if unit else []),
        "_v",
        "_c",
        "_slices",
        F.when(is_ref, start).otherwise(own_rank).alias("_at"),
        F.when(is_ref & answers, end).otherwise(F.when(is_ref, start).otherwise(own_rank)).alias("_end"),
        F.when(is_ref, 0).otherwise(1).alias("_asks"),
        F.when(is_ref & answers, hit).alias("_hit"),
        clamp(own_rank, LOWEST, HIGHEST).alias("_p"),
    )
    top = F.col("_slices") - 1
    placed = placed.withColumn("_low", F.least(F.floor(F.col("_at") * F.col("_slices")), top))
    final = F.greatest(F.least(F.floor(F.col("_end") * F.col("_slices")), top), F.col("_low"))
    placed = placed.withColumn("_slice", F.explode(F.sequence(F.col("_low"), final)))
    # Weighted stretches are (low, high], unweighted ones [before, after): at equal place the asking row is first or last.
    order = W.partitionBy(*cell, "_slice").orderBy("_at", F.col("_asks").desc() if weighted else F.col("_asks").asc())
    found = placed.withColumn("_hit", F.last("_hit", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = found.where((F.col("_asks") == 1) | (F.col("_slice") == F.col("_low")))
    if weighted:
        share = F.try_divide(F.col("_p") - F.col("_hit._low"), F.col("_hit._high") - F.col("_hit._low"))
        below = F.coalesce(F.col("_hit._prev"), F.col("_hit._v"))
        mapped = below + clamp(share, 0.0, 1.0) * (F.col("_hit._v") - below)
    else:
        mapped = interpolate("_hit", F.col("_p") * (F.col("_hit._ref_n") - 1))
    own = F.col("_v")
    return found.select(
        *cell,
        group,
        *split,
        own.alias(value),
        F.when(F.col("_asks") == 1, F.coalesce(mapped, own)).otherwise(own).alias(name),
        F.col("_c").alias("freq"),
        *([F.col("_unit").alias(unit)] if unit else []),
    )


def weighted_rank():
    """Weighted rank; the lowest value takes half of its share.

    The distribution function starts from an added point (lowest value, 0), and two points at one value are averaged
    when it is read, which halves the rank of the lowest value.
    """
    share = F.col("_cum_tie") / F.col("_n")
    return F.when(F.col("_v") == F.col("_least"), share / 2).otherwise(share)
