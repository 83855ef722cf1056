import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantgap.llm import exact_dedup as e
from tests.llm.helpers import docs, prose, rows


def table_of(spark):
    texts = [None, "", " ", "A", "a", "a ", "x" * 200_000, "x" * 200_000] + ["hot"] * 70 + [prose(i % 25, 30) for i in range(60)]
    ids = list(range(1, len(texts) + 1))
    random.Random(2).shuffle(ids)
    return texts, ids, docs(spark, texts, ids).repartition(5)


def brute(texts, ids):
    groups = {}
    for text, i in zip(texts, ids):
        groups.setdefault(text or "", []).append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for t, i in zip(texts, ids))


@pytest.mark.parametrize("counters", [1, 3, 10, e.COUNTERS])
def test_groups_equal_brute_force(spark, counters):
    texts, ids, table = table_of(spark)
    got = e.find_copies(table, counters=counters)
    assert sorted(rows(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256")) == brute(texts, ids)
    left = e.remove_copies(table, counters=counters)
    assert left.columns == table.columns
    assert sorted(r[0] for r in rows(left, "doc_id")) == [r[0] for r in brute(texts, ids) if r[3]]


def test_summaries_keep_every_frequent_value(spark):
    rng = random.Random(1)
    values = [b"a"] * 500 + [b"b"] * 300 + [str(rng.randrange(400)).encode() for _ in range(1200)]
    rng.shuffle(values)
    counters = {}
    for start in range(0, len(values), 90):
        counters = e.add_counts(counters, pa.array(values[start : start + 90], pa.binary()), 9)
    assert len(counters) <= 9 and counters[b"a"] >= 500 - len(values) / 10
    table = spark.createDataFrame([(v,) for v in values], "digest binary").repartition(6)
    found = {bytes(r.digest) for r in e.frequent(table, len(values), 9).collect()}
    assert found >= {b"a"} and len(found) <= 9


def test_missing_and_repeated_ids(spark):
    table = docs(spark, ["t", "t", "t", None, "", "u", "u"], [None, 4, 4, None, None, 9, 9]).withColumn("digest", F.lit("x")).withColumn("keep_id", F.lit(0))
    got = e.find_copies(table)
    assert sorted(rows(got, "doc_id", "keep_id", "group_size", "kept"), key=str) == sorted(
        [(None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (None, None, 2, True), (None, None, 2, True), (9, 9, 2, True), (9, 9, 2, True)], key=str
    )
    for counters in (1, 100):
        left = e.remove_copies(table, counters=counters)
        assert left.columns == table.columns
        assert sorted(rows(left, "doc_id"), key=str) == [(4,), (9,), (None,)]
    assert e.find_copies(table.limit(0)).count() == 0 and e.remove_copies(table.limit(0)).count() == 0
