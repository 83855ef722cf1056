from pyspark.sql import functions as F

from quantgap.llm import mixing
from tests.llm.helpers import docs, prose, rows


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    targets, left, total = {}, set(sizes), float(sum(sizes.values()))
    while left:
        level = (total - sum(targets.values())) / sum(weight[s] for s in left)
        full = {s for s in left if cap * sizes[s] < weight[s] * level}
        if not full:
            return targets | {s: weight[s] * level for s in left}
        targets |= {s: float(cap * sizes[s]) for s in full}
        left -= full
    return targets


def corpus(spark):
    texts, sources = [], []
    for k, (name, count) in enumerate([("a", 40), ("b", 400), ("C", 3), (None, 60), ("é", 90)]):
        for i in range(count):
            texts.append(prose(k * 1000 + i, 5 + (i * 37) % 200))
            sources.append(name)
    return docs(spark, [*texts, None, ""], sources=[*sources, "b", "empty"])


def test_targets_copies_and_reruns(spark):
    table = corpus(spark).withColumn("taken", F.lit("mine"))
    got = mixing.mix(table, mixing.n_words("text")).cache()
    sizes = {r[0]: r[1] for r in rows(got.groupBy("source").agg(F.sum("size")), "*")}
    targets = {r.source: r.target for r in got.collect()}
    want = water_fill(sizes)
    assert all(abs(targets[s] - want[s]) < 1e-6 * max(want[s], 1) for s in sizes)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.max("size").alias("m"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) <= max(r.m, 1)
    assert got.where("taken > 3 * size OR taken < 0").count() == 0
    again = mixing.mix(table.repartition(5), mixing.n_words("text"))
    assert sorted(rows(got, "doc_id", "taken")) == sorted(rows(again, "doc_id", "taken"))
    assert mixing.repeat_copies(got, ["doc_id"]).count() == got.agg(F.sum("copies")).first()[0]


def test_few_unequal_documents_meet_their_target(spark):
    """Sources of 5 to 60 documents, one of them much longer than the others, end within half a document of the target."""
    texts, sources = [], []
    for k in range(12):
        for i in range(5 + 5 * k):
            texts.append(prose(k * 100 + i, 1000 if i == 0 else 3 + (i * 53 + k) % 400))
            sources.append(f"s{k:02d}")
    table = docs(spark, texts, sources=sources)
    size = mixing.n_words("text")
    for base in (None, mixing.length_base(size)):
        got = mixing.mix(table, size, base=base).groupBy("source").agg(F.sum("taken").alias("t"), F.max("size").alias("m"), F.first("target").alias("g"))
        for r in got.collect():
            assert abs(r.t - r.g) <= r.m / 2 + 1e-6


def test_base_rates_tilt_within_a_source(spark):
    table = docs(spark, [prose(i, 100) for i in range(300)], sources=["a"] * 100 + ["b"] * 200)
    base = F.when(F.col("doc_id") % 2 == 0, 2.0).otherwise(0.5)
    got = mixing.mix(table, mixing.n_words("text"), base=base)
    rates = {(s, o): r for s, o, r in rows(got.groupBy("source", (F.col("doc_id") % 2).alias("o")).agg(F.max("rate")), "*")}
    for source in ("a", "b"):
        assert rates[source, 0] == 3 or abs(rates[source, 0] / rates[source, 1] - 4) < 1e-6
    for r in got.groupBy("source").agg(F.sum(F.col("rate") * F.col("size")).alias("t"), F.first("target").alias("g")).collect():
        assert abs(r.t - r.g) < 1e-3


def test_empty_and_single(spark):
    assert mixing.mix(corpus(spark).limit(0), mixing.n_words("text")).count() == 0
    got = mixing.mix(docs(spark, ["a b c", "a b c"], [1, 1], [None, None]), mixing.n_words("text"))
    assert rows(got, "taken", "target") == [(3, 6.0), (3, 6.0)]


def test_native_plan(spark):
    plan = mixing.mix(corpus(spark), mixing.n_words("text"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
