import hashlib

import numpy as np
from pyspark.sql import functions as F

from quantgap.llm import centroids as c
from tests.llm.helpers import rows

SCHEMA = "vec_id bigint, embedding array<float>"


def brute(pairs, k, rounds, width, scale=1024, seed="3"):
    """Lloyd's rounds on Python integers."""
    kept = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in pairs if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    means = [q for _, q in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min((far(q, m), n) for n, m in enumerate(means))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        means = [[sum(col) // len(groups[n]) for col in zip(*groups[n])] if n in groups else m for n, m in enumerate(means)]
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in kept), key=str), means


def made(rows_wanted, width, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(i, (rng.normal(size=width) * spread + rng.integers(0, 4)).astype(np.float32).tolist()) for i in range(rows_wanted)]


def check(spark, pairs, k, rounds, width, **more):
    members, places = c.cluster(spark.createDataFrame(pairs, SCHEMA).repartition(3), k=k, rounds=rounds, width=width, **more)
    expected, means = brute(pairs, k, rounds, width)
    assert sorted(rows(members, "vec_id", "cluster", "distance"), key=str) == expected
    assert [r.centroid for r in places.orderBy("cluster").collect()] == means


def test_rounds_equal_brute_force(spark):
    check(spark, made(240, 16, 1), 8, 4, 16, lead=5)
    check(spark, made(60, 8, 2, 0.001), 5, 3, 8, lead=8)  # few distinct integers: ties


def test_odd_vectors_repeats_and_few_rows(spark):
    good = [0.5, -1.25, 3.0, 0.0]
    odd = [(1, None), (2, []), (3, [1.0] * 5), (4, [1.0, None, 1.0, 1.0]), (5, [float("nan")] * 4), (6, [float("inf"), 0.0, 0.0, 0.0])]
    check(spark, [*odd, (7, good), (7, good), (None, good), (8, [0.0] * 4), (9, [-0.0001] * 4)], 8, 3, 4, lead=2)
    check(spark, [(i, good) for i in range(30)], 8, 2, 4, lead=2)
    members, places = c.cluster(spark.createDataFrame(odd, SCHEMA), width=4)
    assert members.columns == ["vec_id", "cluster", "distance"] and members.count() == 0 and places.count() == 0
    assert c.with_inertia(members).count() == 0


def test_bounds_spare_distances_and_lose_none():
    rng = np.random.default_rng(3)
    at = rng.integers(-4000, 4000, (6, 64))
    q = at[rng.integers(0, 6, 500)] + rng.integers(-60, 60, (500, 64))
    axes = np.linalg.eigh(np.cov(q.T))[1][:, ::-1]
    turn = lambda x: c.rotated(x.astype(float), q.mean(axis=0), axes, 16)
    best, distance, verified = c.nearest(q, *turn(q), at, *turn(at))
    every = ((q[:, None, :] - at[None]) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert verified < 1.2 * len(q)


def test_inertia_and_extra_columns(spark):
    table = spark.createDataFrame(made(40, 4, 5), SCHEMA).withColumn("q", F.lit(1)).withColumn("lead", F.lit("x"))
    members, _ = c.cluster(table, k=3, rounds=2, width=4, lead=2)
    got = c.with_inertia(members).collect()
    assert {r.inertia for r in got} == {sum(r.distance for r in got)}
    for r in got:
        assert r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster)
