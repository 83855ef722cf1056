"""Generalised linear models through Spark ML, with their coefficient tables."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.errors import UnsupportedOperationException
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgap.models.linear import INTERCEPT
from quantgap.session import result_table

MAX_STEPS = 50
NEWTON_STEPS = 25  # taken where the likelihood has no maximum


def glm(df: DataFrame, y: str, xs: list[str], family: str = "gaussian", weight: str | None = None) -> DataFrame:
    """Coefficient table ``term, estimate, se, stat, p`` of a Gaussian or binomial model on complete rows.

    A binomial response that never varies, or that the regressors part without error, has no finite fit: the table is
    then that of ``NEWTON_STEPS`` Newton steps from zero, with wide errors (see :func:`newton_rows`).
    """
    complete = df.where(reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in [y, *xs]]))
    # Column names with dots would be read as struct fields.
    safe = {x: f"x{i}" for i, x in enumerate(xs)}
    named = complete.withColumnsRenamed(safe)
    columns = [*safe.values(), y, *([weight] if weight else [])]
    assembled = VectorAssembler(inputCols=list(safe.values()), outputCol="_features").transform(named.select(*columns))
    # The fit passes over the rows many times.
    assembled = assembled.drop(*safe.values()).persist()
    model = GeneralizedLinearRegression(family=family, featuresCol="_features", labelCol=y, maxIter=MAX_STEPS, tol=1e-10)
    if weight:
        model = model.setWeightCol(weight)
    fitted = model.fit(assembled)
    summary = fitted.summary
    try:
        errors = summary.coefficientStandardErrors
    except UnsupportedOperationException:  # the normal equations could not be solved
        if family != "binomial":
            raise
        errors = None
    if family == "binomial" and (errors is None or summary.numIterations >= MAX_STEPS):
        rows = newton_rows(assembled, y, xs, weight)
    else:
        estimates = [*fitted.coefficients.toArray(), fitted.intercept]
        rows = [
            (term, float(b), float(se), float(t), float(p))
            for term, b, se, t, p in zip([*xs, INTERCEPT], estimates, errors, summary.tValues, summary.pValues)
        ]
    assembled.unpersist()
    return result_table(df.sparkSession, "term string, estimate double, se double, stat double, p double", rows)


def newton_rows(rows: DataFrame, y: str, xs: list[str], weight: str | None) -> list[tuple]:
    """``(term, estimate, se, stat, p)`` after ``NEWTON_STEPS`` steps from zero; errors are those the last step was taken with.

    Each step is one aggregation to p x p sums.  Regressors are shifted by their means, so that large offsets do not eat
    the digits of the sums; one that depends on earlier ones is dropped (NULL).
    """
    size = len(xs)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    x = [F.get(vector_to_array("_features"), F.lit(i)) for i in range(size)]
    total, *sums = rows.agg(F.sum(w), *[F.sum(w * c) for c in x]).first()
    means = np.array([s / total for s in sums])
    terms = [F.lit(1.0), *[c - F.lit(float(m)) for c, m in zip(x, means)]]
    pairs = [(i, j) for i in range(size + 1) for j in range(i, size + 1)]
    beta, inverse, kept = np.zeros(size + 1), None, []
    for _ in range(NEWTON_STEPS):
        mu = 1 / (1 + F.exp(-reduce(lambda a, b: a + b, [F.lit(float(b)) * t for b, t in zip(beta, terms)])))
        scores = [F.sum(w * (F.col(y) - mu) * t) for t in terms]
        products = [F.sum(w * mu * (1 - mu) * terms[i] * terms[j]) for i, j in pairs]
        found = np.array(rows.agg(*scores, *products).first(), dtype=float)
        score, information = found[: size + 1], np.zeros((size + 1, size + 1))
        for (i, j), v in zip(pairs, found[size + 1 :]):
            information[i, j] = information[j, i] = v
        kept = kept or independent(information)
        try:
            inverse = np.linalg.inv(information[np.ix_(kept, kept)])
        except np.linalg.LinAlgError:  # fitted to the last digit: no row has a weight any more
            break
        beta[kept] += inverse @ score[kept]
    # Back from the shifted regressors: their intercept is the fit at the means.
    back = np.eye(len(kept))
    back[0, 1:] = [-means[k - 1] for k in kept[1:]]
    estimate, variance = back @ beta[kept], np.diag(back @ inverse @ back.T)
    found = {k: (float(b), math.sqrt(v)) for k, b, v in zip(kept, estimate, variance)}
    table = []
    for k, term in [*enumerate(xs, 1), (0, INTERCEPT)]:
        b, se = found.get(k, (None, None))
        stat = b / se if se else None
        table.append((term, b, se, stat, None if stat is None else math.erfc(abs(stat) / math.sqrt(2))))
    return table


def independent(information: np.ndarray) -> list[int]:
    """Places of the columns that do not depend on earlier ones."""
    kept = [0]
    for i in range(1, len(information)):
        own, prior = information[i, i], information[np.ix_(kept, kept)]
        if own > 0 and own - information[i, kept] @ np.linalg.solve(prior, information[kept, i]) > 1e-7 * own:
            kept.append(i)
    return kept
