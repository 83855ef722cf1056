import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantgap.operators.distance import cell_summary, quantiles, slice_distance, slice_grid, translation_dispersion, wasserstein
from quantgap.operators.samples import Slicing, ecdf, plan_slices, row_id
from tests import reference


@pytest.fixture(scope="module")
def frame():
    return reference.mixed_sample()


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).cache()


def group(frame, cell, g):
    inside = frame.cell.isna() if cell is None else frame.cell == cell
    return frame[inside & (frame.g == g)]


@pytest.mark.parametrize("rows_per_slice", [10**6, 90])
@pytest.mark.parametrize("weight", [None, "wt"])
def test_summary_equals_brute_force(df, frame, rows_per_slice, weight):
    slicing = plan_slices(df, "v", rows_per_slice)
    assert len(slicing.splits) == 1 if rows_per_slice == 10**6 else len(slicing.splits) > 1
    out = cell_summary(df, ["cell"], "g", "v", "ref", ["a", "b"], weight=weight, slicing=slicing).collect()
    assert len(out) == 6
    for r in out:
        a, b = group(frame, r.cell, r.g), group(frame, r.cell, "ref")
        weights = (a.wt, b.wt) if weight else (None, None)
        assert r.w == pytest.approx(reference.wasserstein(a.v, b.v, 2, *weights), abs=1e-9)
        assert (r.n, r.n_ref) == (len(a), len(b))
        assert r.m == pytest.approx(a.v.mean()) and r.sd == pytest.approx(a.v.std())
        assert r.m_ref == pytest.approx(b.v.mean()) and r.sd_ref == pytest.approx(b.v.std())
        assert weight or r.w**2 >= (r.m - r.m_ref) ** 2 - 1e-12


def small(spark, rows):
    return spark.createDataFrame(rows, "cell string, g string, v double, w int")


def test_identity_shift_symmetry_and_weights(spark):
    values = [1.0, 2.0, 2.0, 5.0, 9.0]
    rows = [("c", "ref", v, 1) for v in values] + [("c", "same", v, 1) for v in values] + [("c", "up", v + 3, 1) for v in values]
    df = small(spark, rows)
    w = {r.g: r.w for r in wasserstein(df, ["cell"], "g", "v", "ref").collect()}
    assert w["same"] == 0 and w["up"] == pytest.approx(3)
    back = {r.g: r.w for r in wasserstein(df, ["cell"], "g", "v", "up").collect()}
    assert back["ref"] == pytest.approx(w["up"])
    double = df.withColumn("w", F.lit(2))
    weighted = {r.g: r.w for r in wasserstein(double, ["cell"], "g", "v", "ref", weight="w").collect()}
    assert weighted["up"] == pytest.approx(w["up"])


def test_size_guards_and_absent_groups(spark):
    rows = [("c", "ref", float(i), 1) for i in range(10)] + [("c", "nine", float(i), 1) for i in range(9)]
    rows += [("c", "one", 1.0, 1), ("d", "one", 1.0, 1), ("c", "nan", float("nan"), 1)]
    df = small(spark, rows)
    out = {(r.cell, r.g): r for r in wasserstein(df, ["cell"], "g", "v", "ref", ["one", "nine", "none", "nan"], min_obs=2).collect()}
    assert out["c", "one"].w is None and out["c", "one"].n == 1
    assert out["c", "nine"].w is not None
    assert out["c", "none"].w is None and out["c", "none"].n == 0
    assert out["c", "nan"].n == 0
    assert out["d", "one"].w is None and out["d", "one"].n_ref == 0
    few = slice_distance(df, ["cell"], "g", "v", "ref", "nine", [0], 100, 11).collect()
    assert {r.cell: r.w for r in few}["c"] is None


@pytest.mark.parametrize("rows_per_slice", [10**6, 90])
def test_quantiles_and_slices(spark, df, frame, rows_per_slice):
    slicing = plan_slices(df, "v", rows_per_slice)
    grid = slice_grid(spark, [0, 50, 95], 5, 9)
    out = quantiles(df, ["cell"], "g", "v", grid, "p", slicing).toPandas()
    for (cell, g), part in out.groupby(["cell", "g"], dropna=False):
        mine = group(frame, None if pd.isna(cell) else cell, g).v
        assert np.abs(np.quantile(mine, part.p) - part.q).max() < 1e-9
    curve = slice_distance(df, ["cell"], "g", "v", "ref", "a", [0, 95], 5, 250, slicing=slicing).collect()
    for r in curve:
        p = np.linspace(r.quantile / 100, (r.quantile + 5) / 100, 250)
        gap = np.quantile(group(frame, r.cell, "a").v, p) - np.quantile(group(frame, r.cell, "ref").v, p)
        assert r.w == pytest.approx(np.sqrt((gap**2).mean()), abs=1e-9)


@pytest.mark.parametrize("rows_per_slice", [10**6, 90])
def test_ecdf_keeps_every_row(df, frame, rows_per_slice):
    out = ecdf(df, ["cell"], "g", "v", carry=["id"], slicing=plan_slices(df, "v", rows_per_slice)).toPandas().set_index("id")
    assert len(out) == len(frame)
    for _, part in frame.groupby(["cell", "g"], dropna=False):
        assert np.allclose(out.loc[part.id].ecdf, reference.ecdf(part.v.to_numpy()))


def test_row_id_is_dense(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "key")
    for slicing in (None, plan_slices(keys, "key", 70)):
        out = row_id(keys, "key", slicing=slicing).toPandas()
        assert (out.id == out.key // 3 + 1).all()


def test_dispersion_split(df):
    parts = translation_dispersion(cell_summary(df, ["cell"], "g", "v", "ref", ["a"])).collect()
    for r in parts:
        assert r.part_translation + r.part_dispersion == pytest.approx(1)
