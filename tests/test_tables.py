"""Final table of all years beside the rows of its input."""

import os

import pytest
from pyspark.sql import functions as F

from quantgap.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the given tables")


def test_analysis_table_has_every_year(spark):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    early = orders.where(key % 3 == 1).select(F.when(key % 2 == 0, 1982 + key % 8).otherwise(1990 + key % 13).alias("y"))
    year = F.when(key % 3 == 0, 2003 + key % 10).when(key % 3 == 1, 2013 + key % 8).otherwise(2021 + key % 3)
    later = orders.where(cust % 2 == 0).select(year.alias("y"))
    want = {r.y: r["count"] for r in early.union(later).groupBy("y").count().collect()}
    got = {r.ANNEE: r.n for r in QUERIES["analysis_table"](spark, FOLDER).groupBy("ANNEE").agg(F.sum("n").alias("n")).collect()}
    assert got == want and set(range(2013, 2021)) <= set(got)
