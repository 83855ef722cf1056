import hashlib
import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantgap.operators import draws, reweight, samples
from quantgap.operators.resample import (
    bootstrap_cases,
    bootstrap_wasserstein,
    interval_constants,
    percentile_interval,
    poisson_replicates,
)
from quantgap.operators.reweight import balance_nonresponse, composition_weights, stratified_by_rate
from quantgap.operators.samples import Slicing
from quantgap.operators.transport import counterfactual
from tests import reference


def test_replicates_spread_like_theory(spark):
    """The spread of a bootstrapped mean is that of theory, so draws of neighbouring ids are not related."""
    rng = np.random.default_rng(2)
    n, replicates = 2000, 200
    values = rng.normal(0, 1, n)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    drawn = poisson_replicates(df, "id", replicates)
    means = drawn.groupBy("rep").agg((F.sum(F.col("draw") * F.col("v")) / F.sum("draw")).alias("m"), F.sum("draw").alias("n"))
    found = means.toPandas()
    assert len(found) == replicates
    assert found.m.std() == pytest.approx(values.std() / np.sqrt(n), rel=0.2)
    assert found.n.mean() == pytest.approx(n, rel=0.01) and found.n.std() == pytest.approx(np.sqrt(n), rel=0.25)
    again = poisson_replicates(df.repartition(7), "id", replicates)
    assert again.groupBy().agg(F.sum("draw")).first()[0] == drawn.groupBy().agg(F.sum("draw")).first()[0]


def mixed(spark, rows=900, seed=3):
    """Two cells with ties, a heavy value, a missing value and a group outside the comparison."""
    rng = np.random.default_rng(seed)
    data = []
    for i in range(rows):
        v = 5.0 if i % 3 == 0 else float(np.round(rng.normal(i % 2, 1), 1 if i % 5 else 6))
        data.append((i, "small" if i % 30 == 0 else "large", ["a", "b", "ref", "other"][rng.integers(4)], None if i % 101 == 0 else v))
    return spark.createDataFrame(data, "id long, cell string, g string, v double").repartition(4)


def replay(df, groups, replicates, seed, exact):
    """Draws by the definition: a Poisson count per distinct value, completed by single picks where totals are exact."""
    table = df.where("v IS NOT NULL").toPandas()
    table = table if exact else table[table.g.isin(groups)]
    hist = table.groupby(["cell", "g", "v"]).agg(c=("id", "size"), key=("id", "min")).reset_index().sort_values(["cell", "g", "v"])
    size = hist.groupby("cell").c.transform("sum")
    rate = hist.c * np.maximum(0, 1 - 8 / np.sqrt(size)) if exact else hist.c.astype(float)
    bits = [b"".join(hashlib.md5(f"{seed}|{b}|{k}".encode()).digest() for b in range(-(-replicates // 4))) for k in hist.key]
    drawn = draws.draw_counts(bits, rate.to_numpy(), replicates)
    for cell, part in hist.reset_index(drop=True).groupby("cell") if exact else ():
        ends = part.c.cumsum().to_numpy()
        for r in range(replicates):
            for j in range(ends[-1] - drawn[part.index, r].sum()):
                u = int(hashlib.md5(f"fill|{seed}|{r}|{cell}|{j}".encode()).hexdigest()[:13], 16) / 2**52
                drawn[part.index[np.searchsorted(ends, int(u * ends[-1]), side="right")], r] += 1
    return hist.reset_index(drop=True), drawn


@pytest.mark.parametrize("slicing", [Slicing(900, (0.0,)), Slicing(900, (-1.0, -0.5, 0.0, 0.5, 1.0, 5.0), 20)])
@pytest.mark.parametrize("method", ["poisson", "multinomial"])
def test_distances_of_replicates_equal_brute_force(spark, method, slicing):
    df = mixed(spark)
    hist, drawn = replay(df, ["a", "b", "ref"], 9, 42, method == "multinomial")
    if method == "multinomial":
        assert all((drawn[part.index].sum(axis=0) == part.c.sum()).all() for _, part in hist.groupby("cell"))
    found = bootstrap_wasserstein(df, ["cell"], "g", "v", "ref", ["a", "b"], "id", 9, method=method, slicing=slicing).collect()
    assert len(found) == 2 * 9 * 2
    for row in found:
        sides = []
        for g in (row.g, "ref"):
            mine = ((hist.cell == row.cell) & (hist.g == g)).to_numpy()
            sides.append(np.repeat(hist.v[mine].to_numpy(), drawn[mine, row.rep]))
        if min(map(len, sides)) < 2:
            assert row.w is None
        else:
            assert row.w == pytest.approx(reference.wasserstein(*sides), rel=1e-9)


def test_drawn_values_have_exact_totals(spark):
    df = mixed(spark)
    frame = draws.replicate_frame(df, ["cell"], "g", "v", "id", 7, 5, "multinomial", Slicing(900, (0.0, 1.0, 5.0), 50))
    spelled = draws.replicate_draws(frame, ["cell"], "g", "v", 7).toPandas()
    hist, drawn = replay(df, None, 7, 5, True)
    assert spelled.draw.sum() == drawn.sum() and len(spelled) == (drawn > 0).sum()
    assert spelled.groupby(["cell", "rep"]).draw.sum().unstack().nunique(axis=1).eq(1).all()


@pytest.mark.parametrize("rate", [0.4, 1.0, 7.0, 64.0, 65.0, 5000.0])
def test_draws_have_the_moments_of_poisson(rate):
    bits = [b"".join(hashlib.md5(f"{b}|{k}".encode()).digest() for b in range(25)) for k in range(600)]
    drawn = draws.draw_counts(bits, np.full(600, rate), 100)
    assert drawn.mean() == pytest.approx(rate, abs=5 * math.sqrt(rate / 60_000))
    assert drawn.var() == pytest.approx(rate, rel=0.04)
    skew = ((drawn - drawn.mean()) ** 3).mean() / drawn.std() ** 3
    assert skew == pytest.approx(1 / math.sqrt(rate), abs=0.06)


def test_slices_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(samples, "GRID", 4)
    monkeypatch.setattr(samples, "LIMIT", 16)
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    two = samples.plan_slices(df, "v", 100)
    assert 9 <= len(two.splits) <= 12 and two.rows_per_slice == 100
    assert max(np.diff([0, *two.splits, 1000])) < 200
    many = samples.plan_slices(df, "v", 1)
    assert len(many.splits) <= 16 and many.rows_per_slice == 63


def interval(values, level=0.95):
    """Order statistics at (R + 1) alpha, between them on the normal scale."""
    t, z = np.sort(values), NormalDist().inv_cdf
    r, ends = len(t), []
    for alpha in ((1 - level) / 2, (1 + level) / 2):
        rank = (r + 1) * alpha
        k = int(rank)
        if k == 0 or k >= r:
            ends.append(t[0 if k == 0 else -1])
        elif rank == k:
            ends.append(t[k - 1])
        else:
            share = (z(alpha) - z(k / (r + 1))) / (z((k + 1) / (r + 1)) - z(k / (r + 1)))
            ends.append(t[k - 1] + share * (t[k] - t[k - 1]))
    return ends


def test_percentile_interval_and_failures(spark):
    rng = np.random.default_rng(1)
    rows = [("full", i, float(v)) for i, v in enumerate(rng.random(100))]
    rows += [("some", i, float(v) if i < 60 else None) for i, v in enumerate(rng.random(100))]
    rows += [("ten", i, float(i)) for i in range(10)] + [("nine", i, float(i)) for i in range(9)] + [("none", 0, None)]
    df = spark.createDataFrame(rows, "cell string, rep int, w double")
    out = {r.cell: r for r in percentile_interval(df, ["cell"]).collect()}
    for cell in ("full", "some", "ten"):
        lo, hi = interval([w for c, _, w in rows if c == cell and w is not None])
        assert out[cell].lo == pytest.approx(lo) and out[cell].hi == pytest.approx(hi)
    assert out["some"].reps == 60
    assert out["nine"].lo is None and out["none"].hi is None and out["none"].reps == 0
    assert len(interval_constants(100)) == 91


@pytest.mark.parametrize("method", ["poisson", "multinomial"])
def test_bootstrap_surrounds_the_estimate(spark, method):
    rng = np.random.default_rng(4)
    rows = [(i, "c", "a" if i % 2 else "ref", float(rng.normal(1.0 if i % 2 else 0.0))) for i in range(800)]
    df = spark.createDataFrame(rows, "id long, cell string, g string, v double").cache()
    replicates = bootstrap_wasserstein(df, ["cell"], "g", "v", "ref", ["a"], "id", 40, method=method)
    r = percentile_interval(replicates, ["cell", "g"], total=40).first()
    assert r.reps == 40 and r.lo < 1.05 < r.hi and r.hi - r.lo < 0.6


@pytest.mark.parametrize("rows_per_prefix", [65_536, 5])
def test_stratified_sample_is_exact(spark, monkeypatch, rows_per_prefix):
    monkeypatch.setattr(reweight, "ROWS_PER_PREFIX", rows_per_prefix)
    rows = [(i, "big" if i % 10 else "small", 0.25 if i % 10 else 0.5) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, s string, rate double")
    out = stratified_by_rate(df, ["s"], "rate", "id").toPandas()
    assert out.id.is_unique and out.groupby("s").size().to_dict() == {"big": 3375, "small": 250}


def test_balance_keeps_the_unemployed_at_the_floor(spark):
    rows = [(i, 2000, "En emploi", None if i % 5 == 0 else 100.0) for i in range(100)]
    rows += [(100 + i, 2000, "Chômeur", None if i % 2 else 50.0) for i in range(50)] + [(200, 2000, "Retraite", 9.0)]
    df = spark.createDataFrame(rows, "id long, y int, s string, w double")
    out = balance_nonresponse(df, "y", "s", "w", "id", "En emploi", "Chômeur").toPandas()
    assert (out.s == "En emploi").sum() == 80 and (out.s == "Chômeur").sum() == 40
    assert set(out.w) == {100.0, 50.0, 1.0}


def test_composition_weights(spark):
    rows = [(1940, "a")] * 3 + [(1940, "b")] + [(1950, "a")] + [(1950, "b")]
    out = composition_weights(spark.createDataFrame(rows, "g int, o string"), "g", "o", 1940).collect()
    assert {(r.g, r.o): r.w_origin for r in out} == pytest.approx({(1940, "a"): 1, (1940, "b"): 1, (1950, "a"): 1.5, (1950, "b"): 0.5})


def test_small_groups_do_not_lie_in_the_slices_of_a_large_table(spark):
    """Cuts are united per group as far as its rows fit one slice; large groups keep theirs, and results stay."""
    rng = np.random.default_rng(5)
    cells = [(f"c{i}", g, float(v)) for i in range(12) for g in ("ref", "a") for v in rng.normal(i, 1, 20)]
    cells += [("large", g, float(v)) for g in ("ref", "a") for v in rng.normal(5, 4, 1500)] + [(None, "a", 1.0), (None, "ref", 1.0)] * 2
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(cells)], "id long, cell string, g string, v double")
    cuts = tuple(float(v) for v in np.quantile([v for _, _, v in cells], np.linspace(0, 1, 121)[1:-1]))
    slicing = Slicing(len(cells), cuts, 25)
    hist = draws.histogram(df, ["cell"], "g", "v", "id", slicing, 4)
    slices = {r.cell: r.n for r in hist.groupBy("cell").agg(F.countDistinct("g", "_cut").alias("n")).collect()}
    assert all(n == 2 for cell, n in slices.items() if cell != "large") and slices["large"] > 100
    assert hist.groupBy("cell", "g", "_cut").count().agg(F.max("count")).first()[0] <= 2 * slicing.rows_per_slice
    plain, fine = (
        {(r.cell, r.rep): r.w for r in bootstrap_wasserstein(df, ["cell"], "g", "v", "ref", ["a"], "id", 7, slicing=s).collect()}
        for s in (Slicing(len(cells), (0.0,), 10_000), slicing)
    )
    assert plain.keys() == fine.keys() and all(fine[k] == (None if w is None else pytest.approx(w)) for k, w in plain.items())


def test_hashes_of_draws_are_made_in_the_task(spark):
    df = mixed(spark)
    frame = draws.replicate_frame(df, ["cell"], "g", "v", "id", 7, 5, "poisson", Slicing(900, (0.0, 1.0, 5.0), 50))
    assert "binary" not in dict(frame.dtypes).values()
    keys = spark.createDataFrame([(1,), (None,), (-(10**12),)], "id long")
    found = keys.select(F.col("id").cast("string"), draws.draw_bits("id", 7, 5)).collect()
    assert [bytes(b) for _, b in found] == draws.hash_bits([k for k, _ in found], 7, 5)


def test_cases_of_distinct_values_equal_those_of_rows(spark):
    df = mixed(spark).unionByName(mixed(spark)).withColumn("part", F.col("id") % 3)
    single, distinct = (counterfactual(df, ["cell", "part"], "g", "v", "ref", **kept) for kept in ({"carry": ["id"]}, {"unit": "id"}))
    assert distinct.count() < single.count() / 2
    cases = {"real": "v", "moved": "counterfactual"}
    want, got = (
        sorted(bootstrap_cases(moved, ["cell"], "g", cases, "ref", ["a", "b"], "id", 5, count=count).collect(), key=str)
        for moved, count in ((single, None), (distinct, "freq"))
    )
    assert len(want) == 2 * 2 * 5 * 2
    assert all(a[:4] == b[:4] and (a.w == b.w or a.w == pytest.approx(b.w, rel=1e-9)) for a, b in zip(want, got))
