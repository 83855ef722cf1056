"""Distances between whole distributions of groups inside cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.operators.joins import join_null_safe
from quantgap.operators.samples import Slicing, over_slices, plan_slices, ranked
from quantgap.session import literal_table

MAX_GROUPS = 200


def group_levels(df: DataFrame, group: str, ref: str) -> list[str]:
    """Groups other than the reference, when the caller gives no list; refuses columns that are no category."""
    found = df.select(group).where(F.col(group).isNotNull()).distinct().limit(MAX_GROUPS + 1).collect()
    if len(found) > MAX_GROUPS:
        raise ValueError(f"{group} has more than {MAX_GROUPS} levels; pass the groups to compare")
    return sorted(r[0] for r in found if r[0] != ref)


def cell_summary(
    df: DataFrame,
    cell: list[str],
    group: str,
    value: str,
    ref: str,
    targets: list[str] | None = None,
    p: float = 2,
    weight: str | None = None,
    min_obs: int = 1,
    slicing: Slicing | None = None,
    frequency: bool = False,
) -> DataFrame:
    """Every target group against the reference group of its cell, in one pass.

    One row per cell and target: ``group, n, m, sd`` of the target, ``n_ref, m_ref, sd_ref`` of the reference and ``w``,
    the exact order-``p`` distance ``(integral of |Qa(u) - Qb(u)|^p du)^(1/p)``.  ``w`` is NULL where either side has
    fewer than ``min_obs`` rows.  Means and deviations are those of the rows; ``weight`` enters the distance.

    All groups of a cell share one ordering by rank ``u``: walking down from ``u = 1`` the last value seen of a group
    is its quantile at the current rank, so every pairwise integral is a sum over the same rows.
    """
    targets = list(targets) if targets is not None else group_levels(df, group, ref)
    slicing = slicing or plan_slices(df, value)
    groups = [*targets, ref]
    kept = df.where(F.col(group).isin(*groups))
    rows = ranked(kept, cell, group, value, weight, (), slicing, frequency)
    start, end = (F.col("_cum") - F.col("_w")) / F.col("_n"), F.col("_cum") / F.col("_n")
    pieces = over_slices(rows.withColumns({"_u0": start, "_u1": end}), F.col("_u0"), F.col("_u1"), slicing)
    by = [*cell, "_slice"]
    pieces = pieces.withColumn("_u1", F.least("_u1", (F.col("_slice") + 1) / F.col("_slices")))
    floor = F.col("_slice") / F.col("_slices")

    down = W.partitionBy(*by).orderBy(F.col("_u1").desc())
    seen = down.rowsBetween(W.unboundedPreceding, 0)
    quantiles = {
        f"_q{i}": F.last(F.when(F.col(group) == g, F.col("_v")), ignorenulls=True).over(seen) for i, g in enumerate(groups)
    }
    walked = pieces.select(
        *cell,
        group,
        "_v",
        "_c",
        "_obs",
        "_mean",
        "_first",
        *[q.alias(name) for name, q in quantiles.items()],
        (F.col("_u1") - F.coalesce(F.lead("_u1").over(down), floor)).alias("_du"),
    )
    r = len(targets)
    sums = []
    for i, g in enumerate(groups):
        mine = F.col(group) == g
        spread = F.when(mine & F.col("_first"), F.col("_c") * F.pow(F.col("_v") - F.col("_mean"), F.lit(2)))
        sums += [
            F.coalesce(F.max(F.when(mine, F.col("_obs"))), F.lit(0)).alias(f"_n{i}"),
            F.max(F.when(mine, F.col("_mean"))).alias(f"_m{i}"),
            F.sum(spread).alias(f"_ss{i}"),
        ]
        if i < r:
            gap = F.abs(F.col(f"_q{i}") - F.col(f"_q{r}"))
            sums.append(F.sum(F.pow(gap, F.lit(float(p))) * F.col("_du")).alias(f"_t{i}"))
    wide = walked.groupBy(*cell).agg(*sums)

    def deviation(i: int):
        return F.sqrt(F.when(F.col(f"_n{i}") > 1, F.col(f"_ss{i}") / (F.col(f"_n{i}") - 1)))

    entries = [
        F.struct(
            F.lit(g).alias(group),
            F.col(f"_n{i}").cast("long").alias("n"),
            F.col(f"_m{i}").alias("m"),
            deviation(i).alias("sd"),
            F.col(f"_n{r}").cast("long").alias("n_ref"),
            F.col(f"_m{r}").alias("m_ref"),
            deviation(r).alias("sd_ref"),
            F.when(
                F.least(F.col(f"_n{i}"), F.col(f"_n{r}")) >= min_obs, F.pow(F.greatest(F.col(f"_t{i}"), F.lit(0.0)), F.lit(1.0 / p))
            ).alias("w"),
        )
        for i, g in enumerate(targets)
    ]
    return wide.select(*cell, F.inline(F.array(*entries)))


def wasserstein(df: DataFrame, cell: list[str], group: str, value: str, ref: str, targets: list[str] | None = None, **options) -> DataFrame:
    """``cell…, group, n, n_ref, w``; options as in :func:`cell_summary`."""
    return cell_summary(df, cell, group, value, ref, targets, **options).select(*cell, group, "n", "n_ref", "w")


def translation_dispersion(summary: DataFrame) -> DataFrame:
    """Split of a summary into squared mean gap and squared deviation gap, with their shares of the sum."""
    parts = summary.withColumns(
        {
            "trans_sq": F.pow(F.col("m_ref") - F.col("m"), F.lit(2)),
            "disp_sq": F.pow(F.col("sd_ref") - F.col("sd"), F.lit(2)),
        }
    ).withColumn("total_sq", F.col("trans_sq") + F.col("disp_sq"))
    return parts.withColumns(
        {
            "part_translation": F.try_divide("trans_sq", "total_sq"),
            "part_dispersion": F.try_divide("disp_sq", "total_sq"),
        }
    )


def locate(rows: DataFrame, lookups: DataFrame, by: list[str], at: str, cell: list[str], slicing: Slicing) -> DataFrame:
    """For every lookup the sample row of the same keys whose rank interval holds it.

    ``rows`` carry ``_cum, _w, _v, _next``; ``lookups`` carry a rank position ``at`` (0-based, in weight units).  Both are
    cut on the rank axis into stretches of ``rows_per_slice`` weight units and merged in one ordered walk per stretch.
    """
    width = F.lit(slicing.rows_per_slice)
    sample = rows.select(*by, (F.col("_cum") - F.col("_w")).cast("double").alias("_pos"), "_cum", "_v", "_next")
    last = F.greatest(F.ceil(F.col("_cum") / width) - 1, F.floor(F.col("_pos") / width))
    sample = sample.withColumn("_slice", F.explode(F.sequence(F.floor(F.col("_pos") / width), last)))
    lookups = lookups.withColumn("_slice", F.floor(F.col(at) / width))
    by_slice = [*by, "_slice"]
    extra = [c for c in lookups.columns if c not in by_slice]
    found = sample.select(*by_slice, "_pos", F.lit(0).alias("_asks"), F.struct("_cum", "_v", "_next").alias("_hit"))
    asked = lookups.select(*by_slice, F.col(at).alias("_pos"), F.lit(1).alias("_asks"), *extra)
    merged = found.unionByName(asked, allowMissingColumns=True)
    walk = W.partitionBy(*by_slice).orderBy("_pos", "_asks").rowsBetween(W.unboundedPreceding, 0)
    merged = merged.withColumn("_hit", F.last("_hit", ignorenulls=True).over(walk)).where("_asks = 1")
    return merged.select(*by, *extra, "_hit")


def interpolate(hit: str, position) -> "F.Column":
    """Type-7 quantile at a 0-based position inside the located row: flat up to its last rank, then linear to the next value."""
    value, following = F.col(f"{hit}._v"), F.col(f"{hit}._next")
    step = F.least(F.greatest(position - (F.col(f"{hit}._cum") - 1), F.lit(0.0)), F.lit(1.0))
    return value + step * (F.coalesce(following, value) - value)


def quantiles(
    df: DataFrame,
    cell: list[str],
    group: str,
    value: str,
    probabilities: DataFrame,
    prob: str = "p",
    slicing: Slicing | None = None,
    name: str = "q",
) -> DataFrame:
    """Type-7 quantiles of every group at the probabilities of a table (its other columns are kept); ``n`` is the size."""
    slicing = slicing or plan_slices(df, value)
    rows = ranked(df, cell, group, value, None, (), slicing)
    by = [*cell, group]
    # The last row of a group knows its size.
    sizes = rows.where(F.col("_next").isNull()).select(*by, F.col("_n").alias("n"))
    lookups = sizes.crossJoin(probabilities).withColumn("_h", (F.col("n") - 1) * F.col(prob))
    hits = locate(rows, lookups, by, "_h", cell, slicing)
    return hits.withColumn(name, interpolate("_hit", F.col("_h"))).drop("_hit", "_h")


def slice_grid(spark, starts: list[int], width: int, points: int = 250) -> DataFrame:
    """``points`` equally spaced probabilities in each percent slice ``[start, start + width]``."""
    slices = literal_table(spark, [("quantile", "int")], [(s,) for s in starts])
    grid = slices.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    low = F.col("quantile") / 100
    high = (F.col("quantile") + width) / 100
    return grid.withColumn("p", F.least(low + F.col("i") * (high - low) / (points - 1), F.lit(1.0)))


def slice_distance(
    df: DataFrame,
    cell: list[str],
    group: str,
    value: str,
    ref: str,
    target: str,
    starts: list[int],
    width: int = 5,
    points: int = 250,
    min_obs: int = 10,
    slicing: Slicing | None = None,
    name: str = "w",
) -> DataFrame:
    """Root mean squared gap of two quantile functions over slices of the probability axis; NULL for small groups."""
    kept = df.where(F.col(group).isin(ref, target))
    grid = slice_grid(df.sparkSession, starts, width, points)
    found = quantiles(kept, cell, group, value, grid, "p", slicing)
    pairs = found.groupBy(*cell, "quantile", "i").agg(
        F.max(F.when(F.col(group) == target, F.col("q"))).alias("qa"),
        F.max(F.when(F.col(group) == ref, F.col("q"))).alias("qb"),
        F.max(F.when(F.col(group) == target, F.col("n"))).alias("na"),
        F.max(F.when(F.col(group) == ref, F.col("n"))).alias("nb"),
    )
    enough = (F.min("na") >= min_obs) & (F.min("nb") >= min_obs)
    rms = F.sqrt(F.avg(F.pow(F.col("qa") - F.col("qb"), F.lit(2))))
    return pairs.groupBy(*cell, "quantile").agg(F.when(enough, rms).alias(name))


def compare_cases(real: DataFrame, counterfactual: DataFrame, keys: list[str], name: str = "w") -> DataFrame:
    """Real against counterfactual distance: their difference and the share of squared distance explained."""
    tagged = real.select(F.lit("real").alias("cas"), *keys, name).unionByName(
        counterfactual.select(F.lit("counterfactual").alias("cas"), *keys, name)
    )
    pair = tagged.groupBy(*keys).agg(
        F.max(F.when(F.col("cas") == "real", F.col(name))).alias("w_real"),
        F.max(F.when(F.col("cas") == "counterfactual", F.col(name))).alias("w_counterfactual"),
    )
    real_sq, other_sq = F.pow("w_real", F.lit(2)), F.pow("w_counterfactual", F.lit(2))
    return pair.withColumns(
        {
            "delta": F.col("w_real") - F.col("w_counterfactual"),
            "share": F.try_divide(100 * (real_sq - other_sq), real_sq),
        }
    )


