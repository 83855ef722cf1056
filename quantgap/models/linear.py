"""Linear models from one aggregation pass.

The table is reduced to cross-product sums per model (and per replicate or imputation); only these p x p numbers reach
the driver, where the normal equations are solved.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgap.models.tails import t_two_sided
from quantgap.session import result_table

INTERCEPT = "(Intercept)"
MAX_MODELS = 100_000


@dataclass
class CrossProducts:
    """Means and centred cross products of the columns over the rows of one model."""

    key: tuple
    rows: float
    weight: float
    mean: np.ndarray
    centred: np.ndarray


def cross_products(
    df: DataFrame,
    columns: list[str],
    by: list[str] = (),
    weight: str | None = None,
    center: dict[str, float] | None = None,
    frequency: bool = False,
    measure: str | None = None,
) -> list[CrossProducts]:
    """Cross products of complete rows, keyed by ``by``.

    ``measure`` names the one column that is a measurement when all others are codes: rows are then first summed per
    pattern of codes, which leaves few rows for the many products.  Products are made in long form, a row for each pair
    of columns that are not zero in a pattern, so that dozens of 0/1 columns stay one short plan.

    Measurements are shifted by their means first, so that large offsets do not eat the digits of the sums.  What
    reaches the driver are ``p * (p + 1) / 2`` numbers a model, of ``MAX_MODELS`` models at most; replicates and other
    keys without such a bound are solved on the executors (see ``paths.path_replicates``).
    """
    by = list(by)
    # Quoted, because names of contrast columns contain dots.
    complete = df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns]))
    if weight:
        complete = complete.where(F.col(weight) > 0)
    shifted_columns = [measure] if measure else list(columns)
    known = center or column_means(complete, shifted_columns)
    center = {c: known[c] if c in shifted_columns else 0.0 for c in columns}
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    shifted = complete.select(
        *by, w.alias("_w"), *[(F.col(f"`{c}`").cast("double") - F.lit(center[c])).alias(f"x{i}") for i, c in enumerate(columns)]
    )
    size = len(columns)
    rows = F.sum("_w") if frequency else F.count(F.lit(1)).cast("double")
    at = columns.index(measure) if measure else None
    codes = [i for i in range(size) if i != at]
    sums = [F.sum("_w").alias("_w"), rows.alias("_rows")]
    if measure:
        y = F.col(f"x{at}")
        sums += [F.sum(F.col("_w") * y).alias("_y"), F.sum(F.col("_w") * y * y).alias("_yy")]
    patterns = shifted.groupBy(*by, *[f"x{i}" for i in codes]).agg(*sums)

    def entry(i: Column, j: Column, value: Column) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), value.alias("v"))

    # Place -1 is the intercept, its product with itself the weight; place -2 counts rows.
    terms = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("x")) for i, x in [(-1, F.lit(1.0)), *[(i, F.col(f"x{i}")) for i in codes]]])
    patterns = patterns.withColumn("_terms", F.filter(terms, lambda t: t.x != 0))
    pairs = F.flatten(F.transform("_terms", lambda a: F.transform(F.filter("_terms", lambda b: b.i >= a.i), lambda b: entry(a.i, b.i, F.col("_w") * a.x * b.x))))
    entries = [pairs, F.array(entry(F.lit(-2), F.lit(-2), F.col("_rows")))]
    if measure:
        entries.append(F.transform("_terms", lambda t: entry(t.i, F.lit(at), F.col("_y") * t.x)))
        entries.append(F.array(entry(F.lit(at), F.lit(at), F.col("_yy"))))
    long = patterns.select(*by, F.explode(F.concat(*entries)).alias("e")).groupBy(*by, "e.i", "e.j").agg(F.sum("e.v").alias("v"))
    limit = MAX_MODELS * (size + 1) * (size + 2)
    collected = long.limit(limit + 1).collect()
    if len(collected) > limit:
        raise ValueError(f"more than {MAX_MODELS} models in one fit")
    models: dict[tuple, np.ndarray] = {}
    counts: dict[tuple, float] = {}
    for *key, i, j, value in collected:
        key = tuple(key)
        if i == -2:
            counts[key] = value
        else:
            matrix = models.setdefault(key, np.zeros((size + 1, size + 1)))
            matrix[i + 1, j + 1] = matrix[j + 1, i + 1] = value
    offset = np.array([center[c] for c in columns])
    results = []
    for key, matrix in models.items():
        total = matrix[0, 0]
        if total:
            mean = matrix[0, 1:] / total
            results.append(CrossProducts(key, counts[key], total, mean + offset, matrix[1:, 1:] - total * np.outer(mean, mean)))
    return sorted(results, key=lambda c: tuple(str(k) for k in c.key))


def column_means(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Mean of each column over the whole table."""
    means = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: means[f"m{i}"] or 0.0 for i, c in enumerate(columns)}


@dataclass
class Fit:
    terms: list[str]
    estimate: np.ndarray
    covariance: np.ndarray
    residual_df: float
    sigma2: float
    r2: float


def solve(products: CrossProducts, columns: list[str], y: str, xs: list[str]) -> Fit:
    """Least squares of one column on others; a regressor that depends on earlier ones is dropped (NaN)."""
    at = [columns.index(x) for x in xs]
    target = columns.index(y)
    sxx, sxy, syy = products.centred[np.ix_(at, at)], products.centred[at, target], products.centred[target, target]
    kept: list[int] = []
    for i in range(len(xs)):
        trial = kept + [i]
        block = sxx[np.ix_(trial, trial)]
        if kept:
            prior = sxx[np.ix_(kept, kept)]
            rest = sxx[i, i] - sxx[i, kept] @ np.linalg.solve(prior, sxx[kept, i])
        else:
            rest = block[0, 0]
        if sxx[i, i] > 0 and rest > 1e-7 * sxx[i, i]:
            kept = trial
    slopes = np.full(len(xs), math.nan)
    covariance = np.full((len(xs) + 1, len(xs) + 1), math.nan)
    inverse = np.linalg.inv(sxx[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
    slopes[kept] = inverse @ sxy[kept]
    means = products.mean[at][kept]
    intercept = products.mean[target] - means @ slopes[kept]
    rss = max(syy - sxy[kept] @ slopes[kept], 0.0)
    df = products.rows - len(kept) - 1
    sigma2 = rss / df if df > 0 else math.nan
    where = [0] + [k + 1 for k in kept]
    block = np.empty((len(kept) + 1, len(kept) + 1))
    block[1:, 1:] = inverse
    block[0, 1:] = block[1:, 0] = -inverse @ means
    block[0, 0] = 1 / products.weight + means @ inverse @ means
    covariance[np.ix_(where, where)] = sigma2 * block
    r2 = 1 - rss / syy if syy > 0 else math.nan
    return Fit([INTERCEPT, *xs], np.concatenate([[intercept], slopes]), covariance, df, sigma2, r2)


def coefficient_rows(fit: Fit, key: tuple = ()) -> list[tuple]:
    rows = []
    for i, term in enumerate(fit.terms):
        estimate, variance = fit.estimate[i], fit.covariance[i, i]
        se = math.sqrt(variance) if variance >= 0 else math.nan
        stat = estimate / se if se and se > 0 else math.nan
        p = t_two_sided(stat, fit.residual_df)
        rows.append((*key, term, *[None if math.isnan(v) else float(v) for v in (estimate, se, stat, p)]))
    return rows


def ols(df: DataFrame, y: str, xs: list[str], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """Coefficient table ``by…, term, estimate, se, stat, p, r2, residual_df`` of (weighted) least squares."""
    columns = [y, *xs]
    rows = []
    for products in cross_products(df, columns, by, weight, measure=y):
        fit = solve(products, columns, y, xs)
        rows += [(*r, float(fit.r2), float(fit.residual_df)) for r in coefficient_rows(fit, products.key)]
    key_schema = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by]
    numbers = "term string, estimate double, se double, stat double, p double, r2 double, residual_df double"
    return result_table(df.sparkSession, ", ".join([*key_schema, numbers]), rows)
