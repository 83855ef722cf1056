import numpy as np
import pytest

from quantgap.operators.distance import compare_cases, wasserstein
from quantgap.operators.samples import plan_slices
from quantgap.operators.transport import counterfactual
from tests import reference


@pytest.mark.parametrize("rows_per_slice", [10**6, 110])
@pytest.mark.parametrize("weight", [None, "wt"])
def test_mapping_equals_brute_force(spark, rows_per_slice, weight):
    frame = reference.mixed_sample(3500, seed=3)
    frame.loc[frame.cell == "y", "g"] = frame.g.where(frame.g != "ref", "a")
    df = spark.createDataFrame(frame).cache()
    slicing = plan_slices(df, "v", rows_per_slice)
    out = counterfactual(df, ["cell"], "g", "v", "ref", carry=["id"], weight=weight, slicing=slicing).toPandas()
    assert len(out) == len(frame) and (out.freq == 1).all()
    out = out.set_index("id")
    for (cell, g), part in frame.groupby(["cell", "g"], dropna=False):
        target = frame[(frame.cell.isna() if cell is None or cell != cell else frame.cell == cell) & (frame.g == "ref")]
        if g == "ref" or target.empty:
            expected = part.v.to_numpy()
        elif weight:
            expected = reference.weighted_quantile_map(part.v.to_numpy(), part.wt, target.v, target.wt)
        else:
            expected = reference.quantile_map(part.v.to_numpy(), target.v)
        assert np.abs(out.loc[part.id].counterfactual - expected).max() < 1e-9


def test_collapsed_rows_measure_like_single_rows(spark):
    frame = reference.mixed_sample(1500, seed=5)
    frame["big"] = "all"
    df = spark.createDataFrame(frame).cache()
    collapsed = counterfactual(df, ["big", "cell"], "g", "v", "ref")
    single = counterfactual(df, ["big", "cell"], "g", "v", "ref", carry=["id"])
    a = wasserstein(collapsed, ["big"], "g", "counterfactual", "ref", ["a"], weight="freq", frequency=True).first()
    b = wasserstein(single, ["big"], "g", "counterfactual", "ref", ["a"]).first()
    assert a.w == pytest.approx(b.w, abs=1e-12) and a.n == b.n
    # Inside the cell the mapped groups nearly coincide with the reference group.
    assert a.w < wasserstein(df, ["big"], "g", "v", "ref", ["a"]).first().w + 0.05


@pytest.mark.parametrize("weight", [None, "wt"])
def test_split_divides_rows_but_not_the_mapping(spark, weight):
    frame = reference.mixed_sample(900, seed=7)
    frame["sex"] = np.where(frame.id % 2 == 0, "H", "F")
    df = spark.createDataFrame(frame).cache()
    whole = counterfactual(df, ["cell"], "g", "v", "ref", weight=weight).toPandas().set_index(["cell", "g", "v"])
    parts = counterfactual(df, ["cell"], "g", "v", "ref", split=["sex"], weight=weight).toPandas()
    assert parts.freq.sum() == whole.freq.sum() == len(frame)
    expected = whole.counterfactual.reset_index().merge(parts, on=["cell", "g", "v"])
    assert np.allclose(expected.counterfactual_x, expected.counterfactual_y)


def test_compare_cases(spark):
    real = spark.createDataFrame([("c", 0.5)], "cell string, w double")
    other = spark.createDataFrame([("c", 0.3)], "cell string, w double")
    r = compare_cases(real, other, ["cell"]).first()
    assert r.delta == pytest.approx(0.2) and r.share == pytest.approx(100 * (0.25 - 0.09) / 0.25)
