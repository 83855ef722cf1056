"""Multiple imputation by predictive mean matching, and pooling of the fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.models.linear import cross_products, solve
from quantgap.models.tails import t_two_sided
from quantgap.operators.samples import Slicing, running_total
from quantgap.session import cut_lineage, literal_table, result_table

RIDGE = 1e-5


def posterior_draws(df: DataFrame, y: str, xs: list[str], imputations: int, seed: int):
    """Least-squares estimate and ``imputations`` draws of it from the posterior of a Bayesian linear model."""
    columns = [y, *xs]
    products = cross_products(df.where(F.col(y).isNotNull()), columns)[0]
    n, mean, centred = products.weight, products.mean, products.centred
    gram = np.zeros((len(columns) + 1, len(columns) + 1))
    full = centred + n * np.outer(mean, mean)
    gram[0, 0] = n
    gram[0, 1:] = gram[1:, 0] = n * mean
    gram[1:, 1:] = full
    design = [0, *range(2, len(columns) + 1)]
    xtx, xty, yty = gram[np.ix_(design, design)], gram[design, 1], gram[1, 1]
    # A column that is zero in all observed rows gets the coefficient zero.
    ridge = np.where(np.diag(xtx) > 0, np.diag(xtx) * RIDGE, 1.0)
    inverse = np.linalg.inv(xtx + np.diag(ridge))
    beta = inverse @ xty
    rss = max(yty - 2 * beta @ xty + beta @ xtx @ beta, 0.0)
    free = max(n - len(design), 1)
    root = np.linalg.cholesky((inverse + inverse.T) / 2)
    random = np.random.default_rng(seed)
    draws = []
    for _ in range(imputations):
        sigma = math.sqrt(rss / random.chisquare(free))
        draws.append(beta + sigma * (root @ random.standard_normal(len(design))))
    return beta, draws


def predictive_mean_matching(
    df: DataFrame, y: str, xs: list[str], row_key: str, imputations: int = 20, donors: int = 5, seed: int = 42, imp: str = "imp",
    slicing: Slicing | None = None,
) -> DataFrame:
    """The table once per imputation (``imp`` from 1); a missing ``y`` takes the value of a donor row.

    Observed rows are predicted with the estimate, missing ones with a posterior draw.  The ``donors`` observed rows of
    nearest prediction are found by rank: observed rows are numbered along the prediction and each missing row looks at
    the ``donors`` numbers on both sides of its place.  One donor is picked by hash, so results are repeatable.
    """
    beta, draws = posterior_draws(df, y, xs, imputations, seed)
    spark = df.sparkSession
    schema = [(imp, "int"), *[(f"_b{i}", "double") for i in range(len(beta))]]
    drawn = literal_table(spark, schema, [(m + 1, *map(float, d)) for m, d in enumerate(draws)])
    score = F.lit(float(beta[0]))
    drawn_score = F.col("_b0")
    for i, x in enumerate(xs, start=1):
        score = score + F.lit(float(beta[i])) * F.col(f"`{x}`")
        drawn_score = drawn_score + F.col(f"_b{i}") * F.col(f"`{x}`")
    # The pool is the same in every imputation, so it is ranked once, and only missing rows are asked per imputation.
    observed = F.col(y).isNotNull()
    donated = df.where(observed).select(F.lit(0).alias(imp), row_key, F.col(y).alias("_y"), score.alias("_s"), F.lit(1).alias("_o"))
    missing = df.where(~observed).crossJoin(F.broadcast(drawn))  # one row per imputation
    asked = missing.select(imp, row_key, F.col(y).alias("_y"), drawn_score.alias("_s"), F.lit(0).alias("_o"))
    # Scores are read by the slicing, the ranks and both sides of the donor join; donors by every pass over the result.
    placed = cut_lineage(donated.unionByName(asked).where(F.col("_s").isNotNull()), "scores")
    placed = running_total(placed, [], "_s", [F.col("_o").desc(), F.col(row_key), F.col(imp)], F.col("_o").cast("long"), "_at", slicing)
    pool = placed.where("_o = 1").select("_at", F.col("_s").alias("_ds"), F.col("_y").alias("_dy"))
    asking = placed.where("_o = 0").select(
        imp, row_key, "_s", F.explode(F.sequence(F.col("_at") - donors + 1, F.col("_at") + donors)).alias("_at")
    )
    near = asking.join(pool, "_at").withColumn("_far", F.abs(F.col("_s") - F.col("_ds")))
    by_row = W.partitionBy(imp, row_key)
    ranked = near.withColumn("_rank", F.row_number().over(by_row.orderBy("_far", "_at")))
    ranked = ranked.where(F.col("_rank") <= donors).withColumn("_found", F.count(F.lit(1)).over(by_row))
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(imp), F.col(row_key))), 1, 8), 16, 10).cast("long")
    chosen = ranked.where(F.col("_rank") == digits % F.col("_found") + 1).select(imp, row_key, F.col("_dy").alias("_filled"))
    chosen = cut_lineage(chosen, "donors")
    completed = df.crossJoin(F.broadcast(drawn.select(imp))).join(chosen, [imp, row_key], "left")
    return completed.withColumn(y, F.coalesce(F.col(y), F.col("_filled"))).select(
        imp, *[F.col(f"`{c}`") for c in df.columns]
    )


def pooled_ols(df: DataFrame, y: str, xs: list[str], imp: str = "imp") -> DataFrame:
    """One least-squares fit per imputation (a single pass), pooled by Rubin's rules and sorted by p-value."""
    columns = [y, *xs]
    fits = [solve(products, columns, y, xs) for products in cross_products(df, columns, [imp], measure=y)]
    m = len(fits)
    rows = []
    for i, term in enumerate(fits[0].terms):
        estimates = np.array([f.estimate[i] for f in fits])
        within = float(np.mean([f.covariance[i, i] for f in fits]))
        between = float(np.var(estimates, ddof=1)) if m > 1 else 0.0
        total = within + (1 + 1 / m) * between
        estimate, se = float(estimates.mean()), math.sqrt(total) if total >= 0 else math.nan
        df_pooled = pooled_df(m, within, between, fits[0].residual_df)
        stat = estimate / se if se and se > 0 else math.nan
        p = t_two_sided(stat, df_pooled)
        values = [None if math.isnan(v) else v for v in (estimate, se, stat, df_pooled, p)]
        rows.append((term, *values, within, between))
    rows.sort(key=lambda r: (r[5] is None, r[5]))
    schema = "term string, estimate double, se double, stat double, df double, p double, within double, between double"
    return result_table(df.sparkSession, schema, rows)


def pooled_df(m: int, within: float, between: float, complete_df: float) -> float:
    """Degrees of freedom of a pooled estimate, corrected for small samples."""
    total = within + (1 + 1 / m) * between
    if total <= 0 or math.isnan(total):
        return math.nan
    share = max((1 + 1 / m) * between / total, 1e-4)
    old = (m - 1) / share**2
    observed = (complete_df + 1) / (complete_df + 3) * complete_df * (1 - share)
    return old * observed / (old + observed)


