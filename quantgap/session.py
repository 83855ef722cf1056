"""Session conventions, shared scratch folder and literal tables."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

ARROW_TYPES = {
    "int": pa.int32(),
    "long": pa.int64(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
}

# Otherwise they stay until the driver collects its garbage.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app: str = "quantgap", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the conventions the library is tested under: ANSI on, UTC, AQE with skew handling."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording the calling line of every column expression makes building long plans slow.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ship(module: str) -> None:
    """Send a module's functions to the Python workers with their code, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the cluster in ``spark.checkpoint.dir``.

    Only a local master may go without the setting (tests): a temporary folder is then made and recorded in the session.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quantgap-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; paths are never reused."""
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """The same rows from a table written in the shared folder.

    Later passes read the table instead of repeating what made it, a lost executor does not replay it, and the
    optimizer knows its size.  Its shuffle files serve this write alone and go when it ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def literal_table(spark: SparkSession, schema: list[tuple[str, str]], rows: list[tuple]) -> DataFrame:
    """Small constant table, built through Arrow so that the optimizer knows its size and may broadcast it."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(list(values), type=ARROW_TYPES[kind]) for (_, kind), values in zip(schema, columns)]
    return spark.createDataFrame(pa.table(arrays, names=[name for name, _ in schema]))


def result_table(spark: SparkSession, schema: str | StructType, rows: list[tuple]) -> DataFrame:
    """Table of computed results (coefficients and the like), kept as local data of the plan."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) if rows else [()] * len(declared)
    arrays = [pa.array(list(values), type=to_arrow_type(field.dataType)) for values, field in zip(columns, declared)]
    return spark.createDataFrame(pa.table(arrays, names=declared.names), schema=declared)
