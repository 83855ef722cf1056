import math

import numpy as np
import pandas as pd
import pytest

from quantgap.models.contrasts import polynomial_matrix
from quantgap.models.glm import glm
from quantgap.models.imputation import pooled_ols, predictive_mean_matching
from quantgap.models.linear import ols
from quantgap.models.paths import PathModel, group_differences, path_coefficients, path_effects, wald_each, wald_joint
from quantgap.models.tails import chi_square_upper, t_two_sided
from quantgap.operators.samples import Slicing


def test_tail_probabilities():
    # Published values of t and chi-square tables.
    assert t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert t_two_sided(1.959964, 1e7) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_upper(16.918978, 9) == pytest.approx(0.05, abs=1e-6)
    assert chi_square_upper(1.0, 4) == pytest.approx(0.909796, abs=1e-6)


def test_polynomial_contrasts():
    matrix = polynomial_matrix(3)
    assert np.allclose(matrix[:, 0], [-math.sqrt(0.5), 0, math.sqrt(0.5)])
    assert np.allclose(matrix[:, 1], np.array([1, -2, 1]) / math.sqrt(6))
    for levels in (4, 7):
        m = polynomial_matrix(levels)
        assert np.allclose(m.T @ m, np.eye(levels - 1)) and np.allclose(m.sum(axis=0), 0)


def test_weighted_least_squares(spark):
    rng = np.random.default_rng(0)
    x, w = rng.normal(50, 1, (200, 2)), rng.integers(1, 9, 200)
    y = x @ [1.0, -2.0] + rng.normal(size=200)
    frame = pd.DataFrame({"a": x[:, 0], "b.Q": x[:, 1], "twice": 2 * x[:, 0], "y": y, "w": w})
    frame.loc[len(frame)] = [1.0, 1.0, 1.0, 1.0, 0]
    fit = {r.term: r for r in ols(spark.createDataFrame(frame), "y", ["a", "b.Q", "twice"], weight="w").collect()}
    design = np.column_stack([np.ones(200), x])
    gram = design.T @ (design * w[:, None])
    beta = np.linalg.solve(gram, design.T @ (w * y))
    rest = y - design @ beta
    se = np.sqrt(np.diag(np.linalg.inv(gram)) * (w * rest**2).sum() / 197)
    for i, term in enumerate(["(Intercept)", "a", "b.Q"]):
        assert fit[term].estimate == pytest.approx(beta[i], rel=1e-6) and fit[term].se == pytest.approx(se[i], rel=1e-6)
    assert fit["twice"].estimate is None and fit["a"].residual_df == 197


def newton(x, y, steps=25):
    design, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        mu = 1 / (1 + np.exp(-design @ beta))
        inverse = np.linalg.inv(design.T @ (design * (mu * (1 - mu))[:, None]))
        beta = beta + inverse @ (design.T @ (y - mu))
    return beta, np.sqrt(np.diag(inverse))


@pytest.mark.parametrize("observed", [lambda x: np.ones(len(x)), lambda x: x >= 18])
def test_logistic_fit_without_a_maximum(spark, observed):
    """A response that never varies, or is parted by the regressor, ends after the steps; a dependent regressor is dropped."""
    x = np.random.default_rng(1).integers(15, 60, 450).astype(float)
    y = observed(x).astype(float)
    beta, se = newton((x - x.mean())[:, None], y)
    df = spark.createDataFrame(pd.DataFrame({"n.min": x, "twice": 2 * x, "y": y}))
    fit = {r.term: r for r in glm(df, "y", ["n.min", "twice"], "binomial").collect()}
    assert fit["n.min"].estimate == pytest.approx(beta[1], rel=1e-3, abs=1e-9) and fit["n.min"].se == pytest.approx(se[1], rel=1e-3)
    assert fit["(Intercept)"].estimate == pytest.approx(beta[0] - x.mean() * beta[1], rel=1e-3)
    assert fit["twice"].estimate is None and fit["twice"].se is None


@pytest.mark.parametrize("slicing", [None, Slicing(180, (0.0, 2.0), 50)])
def test_matching_takes_near_donors(spark, slicing):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 2, 180)
    y = 3 * x + rng.normal(0, 0.3, 180)
    rows = [(str(i), float(x[i]), None if i % 6 == 0 else float(y[i])) for i in range(180)]
    df = spark.createDataFrame(rows, "cell string, x double, y double")
    filled = predictive_mean_matching(df, "y", ["x"], "cell", 5, slicing=slicing).toPandas()
    assert len(filled) == 900 and filled.y.notna().all()
    observed = {v for _, _, v in rows if v is not None}
    assert set(filled.y) <= observed
    gaps = filled[filled.cell.astype(int) % 6 == 0]
    assert (gaps.y - 3 * gaps.x).abs().median() < 1.0
    again = predictive_mean_matching(df.repartition(3), "y", ["x"], "cell", 5, slicing=slicing).toPandas()
    key = ["imp", "cell"]
    assert filled.sort_values(key).y.tolist() == again.sort_values(key).y.tolist()
    pooled = {r.term: r for r in pooled_ols(spark.createDataFrame(filled), "y", ["x"]).collect()}
    assert pooled["x"].estimate == pytest.approx(3, abs=0.1)
    assert pooled["x"].se**2 == pytest.approx(pooled["x"].within + 1.2 * pooled["x"].between)


def simulated(n=6000, seed=2):
    rng = np.random.default_rng(seed)
    origin, sex = rng.choice(3, n), rng.integers(0, 2, n)
    cadre, ouvrier = (origin == 0).astype(int), (origin == 1).astype(int)
    d = 0.8 * cadre - 0.4 * ouvrier + rng.normal(size=n)
    p = 0.3 * cadre - 0.2 * ouvrier + 0.5 * d + 0.7 * rng.normal(size=n)
    y = 9 + 0.1 * cadre - 0.05 * ouvrier + 0.15 * d + 0.25 * p + 0.4 * rng.normal(size=n)
    return pd.DataFrame(
        {"id": range(n), "cadre": cadre, "ouvrier": ouvrier, "sex": sex, "dip": np.digitize(d, [-1, -0.3, 0.4, 1]), "occ": np.digitize(p, [-0.5, 0.3, 1]), "y": y}
    )


MODEL = PathModel({"Cadre": "cadre", "Ouvrier": "ouvrier"}, ("sex",), "dip", "occ", "y")


def test_path_scores_and_effects(spark):
    frame = simulated()
    fit = path_coefficients(spark.createDataFrame(frame), MODEL)
    found = {(r.outcome, r.term): r for r in fit.collect()}
    columns = [np.ones(len(frame)), frame.cadre, frame.ouvrier, frame.sex, frame.dip, frame.occ]
    beta = np.linalg.lstsq(np.column_stack(columns), frame.y, rcond=None)[0]
    for term, b in zip(["(Intercept)", "cadre", "ouvrier", "sex", "dip", "occ"], beta):
        assert found["y", term].estimate == pytest.approx(b, rel=1e-6, abs=1e-9)
    assert found["y", "dip"].standardized == pytest.approx(beta[4] * frame.dip.std() / frame.y.std(), rel=1e-6)
    effects = {r.effect: r.value for r in path_effects(fit, MODEL).collect()}
    assert effects["via_both_Cadre"] == pytest.approx(effects["a_Cadre"] * effects["c"] * effects["f"])
    # The total effect is the coefficient of origin when the mediators are left out.
    total = np.linalg.lstsq(np.column_stack(columns[:4]), frame.y, rcond=None)[0][1]
    assert effects["total_Cadre"] == pytest.approx(total, rel=1e-6)


def test_wald_tests(spark):
    rng = np.random.default_rng(0)
    point = spark.createDataFrame([("a", 0.0, 1.0, 1.0), ("b", 0.0, 0.1, 0.1)], "effect string, first double, second double, diff double")
    draws = rng.normal([1.0, 0.1], [0.2, 0.1], (400, 2))
    rows = [(i, e, float(v)) for i, d in enumerate(draws) for e, v in zip("ab", d)]
    repeated = spark.createDataFrame(rows, "rep int, effect string, diff double")
    tests = {r.effect: r for r in wald_each(point, repeated).collect()}
    assert tests["a"].chisq == pytest.approx(1 / draws[:, 0].var(ddof=1)) and tests["a"].p < 1e-4 and tests["b"].p > 0.2
    joint = wald_joint(point, repeated, ["a", "b"]).first()
    gap = np.array([1.0, 0.1])
    assert joint.df == 2 and joint.chisq == pytest.approx(gap @ np.linalg.inv(np.cov(draws.T)) @ gap)


def test_group_differences(spark):
    rows = [("H", "a", 1.0), ("F", "a", 1.5)]
    out = group_differences(spark.createDataFrame(rows, "sex string, effect string, value double"), "sex", "H", "F").first()
    assert out.diff == pytest.approx(0.5)
