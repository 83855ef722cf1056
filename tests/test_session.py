"""Stages written in the shared folder."""

import time

import pytest
from pyspark.sql import functions as F

from quantgap.session import SHUFFLE_CLEANUP, cut_lineage


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def grouped(spark):
    return spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n"))


def test_shuffle_files_go_with_the_write(spark):
    before = shuffle_files(spark)
    frame = grouped(spark)  # held, so that no collected garbage frees the files
    stage = cut_lineage(frame)
    until = time.time() + 10
    while shuffle_files(spark) - before and time.time() < until:  # they go in the background
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert sorted(map(tuple, stage.collect())) == sorted(map(tuple, frame.collect())) == [(k, 100) for k in range(10)]
    assert sorted(map(tuple, cut_lineage(frame).collect())) == [(k, 100) for k in range(10)]


def test_setting_is_restored(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    cut_lineage(grouped(spark))
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == (before or "false")
    with pytest.raises(Exception):
        cut_lineage(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == (before or "false")
