"""Ranked samples: the shared first step of every distribution operator.

A cell may hold a large part of the whole table, so nothing here puts a cell into one task.  Rows are first collapsed
to ``(cell, group, value) -> weight`` with map-side aggregation.  The value axis is cut at
quantiles of the whole table, so that no ``(cell, group, slice)`` can exceed ``rows_per_slice`` distinct values by much
whatever the skew of cells and groups; running sums are taken inside slices and the slice totals, a table of
cells x groups x slices, supply the offsets.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions.scalar import is_finite
from quantgap.operators.joins import join_null_safe

ROWS_PER_SLICE = 1_000_000
GRID = 256  # boundaries found together with the count; a table of more slices gets finer ones inside each of these
LIMIT = GRID * GRID  # boundaries the driver holds at most; a table of more slices has larger ones


@dataclass(frozen=True)
class Slicing:
    """How the value axis is cut: number of rows seen and the inner boundaries, one at least."""

    rows: int
    splits: tuple
    rows_per_slice: int = ROWS_PER_SLICE


def plan_slices(df: DataFrame, value: str, rows_per_slice: int = ROWS_PER_SLICE) -> Slicing:
    """Count the sample and pick value boundaries, in one pass; a second one where many slices are wanted.

    Only the count and the boundaries reach the driver, ``LIMIT`` at most.  The boundaries need not be exact quantiles:
    they decide how work is divided, never the result.  Every table takes this path; a small one is cut in two at its
    median.  Finer boundaries are quantiles inside the coarse slices, found for all of these in parallel.
    """
    sample = df.select(F.col(value).cast("double").alias("_v")).where(is_finite("_v"))

    def quantiles(parts: int) -> Column:
        return F.percentile_approx("_v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts)

    rows, found = sample.agg(F.count("_v"), quantiles(GRID)).first()
    parts = min(max(2, math.ceil(rows / rows_per_slice)), LIMIT)
    splits = set(found or [0.0])
    if parts > GRID:
        coarse = Bucketizer(splits=[-math.inf, *sorted(splits), math.inf], inputCol="_v", outputCol="_cut").transform(sample)
        fine = coarse.groupBy("_cut").agg(quantiles(math.ceil(parts / GRID)).alias("inner")).collect()  # GRID rows
        splits.update(v for row in fine for v in row.inner)
    elif found:
        splits = {found[math.ceil(i * GRID / parts) - 1] for i in range(1, parts)}
    return Slicing(rows, tuple(sorted(splits)), max(rows_per_slice, math.ceil(rows / LIMIT)))


def ranked(
    df: DataFrame,
    cell: list[str],
    group: str,
    value: str,
    weight: str | None = None,
    carry: tuple | list = (),
    slicing: Slicing | None = None,
    frequency: bool = False,
    unit: str | None = None,
) -> DataFrame:
    """Distinct values of every group with running weight.

    Output: ``cell…, group, carry…`` and

    ``_v`` value, ``_w`` weight, ``_c`` rows, ``_cum`` running weight up to this row, ``_cum_tie`` running weight up to
    the last equal value, ``_n`` total weight, ``_obs`` total rows, ``_mean`` mean of the rows, ``_least`` smallest
    value of the group, ``_prev``/``_next`` neighbouring values in the group, ``_slices`` number of slices of the rank axis for the cell.

    ``carry`` columns split equal values into several rows (a row id keeps individuals apart).  ``frequency`` says that
    the weight counts rows (bootstrap draws), so that ``_c`` and ``_obs`` follow it.  ``unit`` names a row key whose smallest
    comes with each value as ``_unit``.
    """
    slicing = slicing or plan_slices(df, value)
    keys = [*cell, group]
    weighted = weight is not None
    # Adding zero makes one value of 0.0 and -0.0, which would fall on two sides of a boundary at zero.
    base = df.select(*keys, *carry, (F.col(value).cast("double") + 0.0).alias("_v"), *([F.col(weight).alias("_wt")] if weighted else []), *([F.col(unit).alias("_unit")] if unit else []))
    base = base.where(is_finite("_v") & F.col(group).isNotNull())
    if weighted:
        base = base.where(F.col("_wt") > 0)
        sums = [F.sum("_wt").alias("_w"), (F.sum("_wt") if frequency else F.count(F.lit(1))).alias("_c")]
    else:
        sums = [F.count(F.lit(1)).alias("_w")]
    if unit:
        sums.append(F.min("_unit").alias("_unit"))
    smallest = ["_unit"] if unit else []

    cutter = Bucketizer(splits=[-math.inf, *slicing.splits, math.inf], inputCol="_v", outputCol="_cut")
    rows = cutter.transform(base).withColumn("_cut", F.col("_cut").cast("int"))
    rows = rows.groupBy(*keys, *carry, "_cut", "_v").agg(*sums)
    rows = rows if weighted else rows.withColumn("_c", F.col("_w"))

    # The totals of a slice enter as its first row, so the running sums start from what lies before the slice and no
    # join of the rows is needed.
    totals = slice_totals(rows, cell, group, slicing.rows_per_slice)
    facts = ["_n", "_obs", "_mean", "_least", "_last_before", "_first_after", "_slices"]
    heads = totals.select(*keys, "_cut", F.col("_before").alias("_w"), F.struct(*facts).alias("_facts"), F.lit(0).alias("_row"))
    merged = heads.unionByName(rows.withColumn("_row", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*keys, "_cut").orderBy("_row", "_v")
    running = order.rowsBetween(W.unboundedPreceding, 0)
    ranked_rows = merged.select(
        *keys,
        *carry,
        *smallest,
        "_row",
        "_v",
        "_w",
        "_c",
        F.sum("_w").over(running).alias("_cum"),
        F.sum("_w").over(order).alias("_cum_tie"),
        F.first("_facts").over(running).alias("_facts"),
        F.lag("_v").over(order).alias("_lag"),
        F.lead("_v").over(order).alias("_lead"),
    ).where("_row = 1")
    return ranked_rows.select(
        *keys,
        *carry,
        *smallest,
        "_v",
        "_w",
        "_c",
        "_cum",
        "_cum_tie",
        *[F.col(f"_facts.{name}").alias(name) for name in ("_n", "_obs", "_mean", "_least")],
        F.coalesce("_lag", "_facts._last_before").alias("_prev"),
        F.coalesce("_lead", "_facts._first_after").alias("_next"),
        F.col("_facts._slices").alias("_slices"),
    )


def slice_totals(rows: DataFrame, cell: list[str], group: str, rows_per_slice: int) -> DataFrame:
    """Offsets, totals and neighbours per ``(cell, group, slice)``; at most one row per slice of each group."""
    keys = [*cell, group]
    per_slice = rows.groupBy(*keys, "_cut").agg(
        F.sum("_w").alias("_sw"),
        F.sum("_c").alias("_sc"),
        F.sum(F.col("_c") * F.col("_v")).alias("_sv"),
        F.count(F.lit(1)).alias("_sd"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        F.min("_w").alias("_wmin"),
    )
    whole = W.partitionBy(*keys)
    order = whole.orderBy("_cut")
    per_slice = per_slice.select(
        *keys,
        "_cut",
        F.coalesce(F.sum("_sw").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_sw").over(whole).alias("_n"),
        F.sum("_sc").over(whole).alias("_obs"),
        (F.sum("_sv").over(whole) / F.sum("_sc").over(whole)).alias("_mean"),
        F.min("_lo").over(whole).alias("_least"),
        F.sum("_sd").over(whole).alias("_distinct"),
        F.min("_wmin").over(whole).alias("_wmin"),
        F.lag("_hi").over(order).alias("_last_before"),
        F.lead("_lo").over(order).alias("_first_after"),
    )
    # A slice of the rank axis of width 1/K holds at most n / (K * smallest weight) distinct values of a group.
    # The second bound keeps the number of extra slice pieces small against the number of rows.
    by_weight = F.max(F.col("_n") / F.col("_wmin")).over(W.partitionBy(*cell))
    by_rows = F.max(F.col("_distinct")).over(W.partitionBy(*cell)) * 100
    wanted = F.ceil(F.least(by_weight, by_rows) / F.lit(rows_per_slice))
    return per_slice.withColumn("_slices", F.greatest(wanted, F.lit(1)).cast("long")).drop("_distinct", "_wmin")


def over_slices(rows: DataFrame, start: Column, end: Column, slicing: Slicing) -> DataFrame:
    """Repeat each rank interval once per slice it touches (``_slice``, and ``_first`` on its first piece).

    A heavy value spans many slices and is cut into as many pieces, so every slice is complete on its own and no slice
    needs its neighbours.
    """
    top = F.col("_slices") - 1
    low = F.least(F.greatest(F.floor(start * F.col("_slices")), F.lit(0)), top)
    high = F.least(F.greatest(F.ceil(end * F.col("_slices")) - 1, low), top)
    pieces = rows.withColumn("_low", low.cast("long")).withColumn("_slice", F.explode(F.sequence(F.col("_low"), high.cast("long"))))
    return pieces.withColumn("_first", F.col("_slice") == F.col("_low")).drop("_low")


def attach_by_value(
    df: DataFrame, cell: list[str], group: str, value: str, carry: list[str], mapping: DataFrame, slicing: Slicing
) -> DataFrame:
    """Rows with the columns of a ``(cell…, group, _v, _w, …)`` table of distinct values.

    A value shared by very many rows would send them all to one task.  The values heavier than a slice are known (they
    are at most ``rows / rows_per_slice``), so their entry is copied and the rows are spread over the copies.
    """
    rows = df.select(*cell, group, *carry, F.col(value).cast("double").alias("_v"))
    rows = rows.where(is_finite("_v") & F.col(group).isNotNull())
    keys = [*cell, group, "_v"]
    copies = mapping.withColumn("_copies", F.ceil(F.col("_w") / F.lit(slicing.rows_per_slice)).cast("int"))
    heavy = copies.where(F.col("_copies") > 1).select(*keys, "_copies")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in carry]), F.col("_copies"))
    salted = join_null_safe(rows, heavy, keys, "left").withColumn("_salt", F.coalesce(spread, F.lit(0)).cast("int"))
    copied = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_copies"), F.lit(1)) - 1)))
    return join_null_safe(salted.drop("_copies"), copied.drop("_w", "_copies"), [*keys, "_salt"], "inner").drop("_salt")


def ecdf(
    df: DataFrame,
    cell: list[str],
    group: str,
    value: str,
    weight: str | None = None,
    carry: tuple | list = (),
    slicing: Slicing | None = None,
    name: str = "ecdf",
) -> DataFrame:
    """Empirical distribution function of each group at its own values; equal values share the highest rank.

    One row per distinct value, or per row of the table where ``carry`` names its columns to keep.
    """
    slicing = slicing or plan_slices(df, value)
    rows = ranked(df, cell, group, value, weight, (), slicing)
    ranks = rows.select(*cell, group, "_v", F.col("_c").alias("_w"), (F.col("_cum_tie") / F.col("_n")).alias(name))
    if carry:
        ranks = attach_by_value(df, cell, group, value, list(carry), ranks, slicing)
    return ranks.select(*cell, group, *carry, F.col("_v").alias(value), name)


def running_total(
    df: DataFrame, by: list[str], order: str, ties: list[Column | str], amount: Column, name: str, slicing: Slicing | None = None,
    total: str | None = None,
) -> DataFrame:
    """Running sum of ``amount`` along ``order`` (ties in the order of ``ties``) inside ``by``, slice by slice.

    ``total`` names a column for the whole sum of ``by``.
    """
    slicing = slicing or plan_slices(df, order)
    valued = df.withColumn("_amount", amount)
    cutter = Bucketizer(splits=[-math.inf, *slicing.splits, math.inf], inputCol="_along", outputCol="_cut")
    cut = cutter.transform(valued.withColumn("_along", F.col(order).cast("double"))).withColumn("_cut", F.col("_cut").cast("int"))
    sizes = cut.groupBy(*by, "_cut").agg(F.sum("_amount").alias("_sum"))
    earlier = W.partitionBy(*by).orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)
    whole = [F.sum("_sum").over(W.partitionBy(*by)).alias(total)] if total else []
    offsets = sizes.select(*by, "_cut", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), *whole)
    walk = W.partitionBy(*by, "_cut").orderBy(order, *ties).rowsBetween(W.unboundedPreceding, 0)
    joined = join_null_safe(cut, offsets, [*by, "_cut"], "inner")
    return joined.withColumn(name, F.col("_before") + F.sum("_amount").over(walk)).drop("_amount", "_along", "_cut", "_before")


def row_id(df: DataFrame, key: str, name: str = "id", slicing: Slicing | None = None) -> DataFrame:
    """Dense ids 1..n in the order of a unique numeric key."""
    return running_total(df, [], key, [], F.lit(1).cast("long"), name, slicing)
