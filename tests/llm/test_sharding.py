from pyspark.sql import functions as F

from quantgap.llm import sharding
from tests.llm.helpers import docs, rows


def test_permutation_is_one_and_inverts(spark):
    for total in (1, 2, 3, 7, 64, 1000):
        df = spark.range(total).withColumn("p", sharding.permute("id", f"{total}L"))
        back = df.withColumn("q", sharding.permute("p", f"{total}L", backwards=True))
        got = rows(back, "id", "p", "q")
        assert sorted(p for _, p, _ in got) == list(range(total))
        assert all(i == q for i, _, q in got)


def test_shards_are_even_gapless_and_reproducible(spark):
    table = docs(spark, [f"text {i % 50}" for i in range(500)]).withColumn("slot", F.lit("old"))
    first = sharding.shard_table(table, "doc_id", 8)
    again = sharding.shard_table(table.repartition(7), "doc_id", 8)
    assert first.columns == [*table.columns[:-1], "shard", "slot"]
    got = sorted(rows(first, "doc_id", "shard", "slot"))
    assert got == sorted(rows(again, "doc_id", "shard", "slot"))
    sizes = [sorted(s for _, k, s in got if k == shard) for shard in range(8)]
    assert max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert all(s == list(range(len(s))) for s in sizes)


def test_repeated_null_and_missing_rows(spark):
    keys = spark.createDataFrame([(1, "a")] * 9000 + [(None, None)] * 3 + [(2, "b")], "k bigint, v string")
    got = sharding.shard_keys(keys, ["k", "v"], 3)
    assert rows(got.groupBy("k").count().orderBy("k"), "*") == [(None, 3), (1, 9000), (2, 1)]
    assert sorted(r[0] for r in rows(got.groupBy("shard").count(), "count")) == [3001, 3001, 3002]
    assert rows(got.groupBy("shard").agg(F.countDistinct("slot") == F.max("slot") + 1), "*")[0][1]
    assert sharding.shard_keys(keys.limit(0), ["k", "v"], 3).count() == 0
    assert sharding.shard_table(docs(spark, [None, None, "x"], [None, None, None]), "doc_id", 2).count() == 3


def test_numbers_follow_their_order(spark):
    import hashlib

    md5 = lambda *v: hashlib.md5("|".join("" if x is None else str(x) for x in v).encode()).hexdigest()
    table = [(7, f"v{i % 900}") for i in range(1500)] + [(None, f"v{i}") for i in range(40)] + [(i, None) for i in range(60)]
    got = sharding.number_keys(spark.createDataFrame(table, "k bigint, v string"), ["k", "v"]).collect()
    want = sorted(set(table), key=lambda r: (md5(r[0]), md5(r[1]), r[0] is None, r[0] or 0, r[1] is None, r[1] or ""))
    start = 0
    for row in want:
        found = [r for r in got if (r.k, r.v) == row]
        assert [(r.start, r.copies, r.total) for r in found] == [(start, table.count(row), len(table))]
        start += table.count(row)
    assert len(got) == len(want)


def test_names_and_values_of_other_columns_stay(spark):
    names = ["number", "total", "start", "copies", "place", "chunk", "whole", "k0", "k1", "_place", "_lead", "_part", "_key", "Key"]
    table = spark.range(50).select("id", *[(F.col("id") * 10 + i).alias(n) for i, n in enumerate(names)], F.lit(None).alias("none"), F.lit(3).alias("shard"))
    got = sharding.shard_table(table, "id", 4)
    assert got.columns == ["id", *names, "none", "shard", "slot"]
    for row in got.collect():
        assert tuple(row[1 : len(names) + 1]) == tuple(row[0] * 10 + i for i in range(len(names)))
    assert sorted(rows(got, "shard", "slot")) == sorted((i % 4, i // 4) for i in range(50))
    by_name = sharding.shard_keys(table.select("number", "total"), ["number", "total"], 4)
    assert by_name.columns == ["number", "total", "shard", "slot"] and by_name.distinct().count() == 50


def test_one_row_and_one_key_may_hold_most_rows(spark):
    same = spark.range(20_000).select(F.lit(1).cast("bigint").alias("k"), F.lit("x").alias("v"))
    hot = spark.range(5_000).select(F.lit(2).cast("bigint").alias("k"), F.col("id").cast("string").alias("v"))
    got = sharding.shard_table(same.union(hot), "k", 8)
    sizes = rows(got.groupBy("shard").agg(F.count("*"), F.countDistinct("slot"), F.max("slot")), "*")
    assert [tuple(r) for r in sorted(sizes)] == [(s, 3125, 3125, 3124) for s in range(8)]
    assert rows(got.groupBy("k").agg(F.count("*"), F.countDistinct("v")).orderBy("k"), "*") == [(1, 20_000, 1), (2, 5_000, 5_000)]
