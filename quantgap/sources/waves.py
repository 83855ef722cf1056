"""Survey waves: discovery, era crosswalk, declared-type readers and the sink."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantgap.functions.codes import CROSSWALK, CROSSWALK_ERAS
from quantgap.functions.scalar import to_double, to_int
from quantgap.operators.reshape import rename_all, union_all
from quantgap.session import literal_table

SPARK_TYPES = {"int": T.IntegerType(), "num": T.DoubleType(), "chr": T.StringType()}


def discover(
    spark: SparkSession, root: str, pattern: str, ignore_case: bool = False, without: DataFrame | None = None
) -> DataFrame:
    """Paths of all files below a folder whose name matches a pattern, minus another set of paths."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    found = listing.where(name.rlike(("(?i)" if ignore_case else "") + pattern))
    return found if without is None else found.exceptAll(without.select("path"))


def file_years(df: DataFrame, year: str = "ANNEE") -> DataFrame:
    """One row per source file with the survey year of its rows, in the order of years; for tables read from files."""
    files = df.select(F.col("_metadata.file_path").alias("file"), F.col(year).alias(year))
    return files.groupBy("file").agg(F.min(year).alias(year)).orderBy(year, "file")


def years_by_position(files: DataFrame, base: int, first: int = 1, last: int | None = None) -> DataFrame:
    """Year of each file from its place in the sorted list: the files ``first..last`` get ``base + 1, base + 2, …``."""
    place = F.row_number().over(W.orderBy("path"))
    placed = files.withColumn("_place", place).where(F.col("_place") >= first)
    if last is not None:
        placed = placed.where(F.col("_place") <= last)
    return placed.select("path", (F.col("_place") - first + 1 + base).cast("int").alias("ANNEE"))


@dataclass(frozen=True)
class EraColumn:
    final: str
    source: str
    kind: str


def crosswalk(era: str) -> list[EraColumn]:
    """Columns of an era: final name, name in the files, type; variables absent from the era are left out."""
    at = CROSSWALK_ERAS.index(era) + 1
    return [EraColumn(row[0], row[at], row[-1]) for row in CROSSWALK if row[at] is not None]


def crosswalk_table(spark: SparkSession) -> DataFrame:
    schema = [("final", "string"), *[(era, "string") for era in CROSSWALK_ERAS], ("type", "string")]
    return literal_table(spark, schema, [tuple(row) for row in CROSSWALK])


def type_specs(era: str) -> T.StructType:
    """Schema of the era's files, built from the type codes."""
    return T.StructType([T.StructField(c.source, SPARK_TYPES[c.kind]) for c in crosswalk(era)])


def rename_by_crosswalk(df: DataFrame, era: str) -> DataFrame:
    names = {c.source: c.final for c in crosswalk(era) if c.source in df.columns}
    return df.withColumnsRenamed(names)


def select_columns(df: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Projection that fails on absent columns, or skips them."""
    return df.select(*columns) if strict else df.select(*[c for c in columns if c in df.columns])


def read_semicolon_csv(spark: SparkSession, paths: str | list[str], schema: T.StructType, **options) -> DataFrame:
    """``;``-separated, ``,``-decimal files: only the declared columns, in the declared types, bad text is NULL.

    Columns are taken by header name.  Files are read as text and cast afterwards, because a reader cannot be given a
    decimal comma.
    """
    raw = spark.read.options(sep=";", header="true", **options).csv(paths)
    convert = {T.IntegerType(): to_int, T.DoubleType(): to_double, T.StringType(): lambda c: F.col(c)}
    return raw.select(*[convert[f.dataType](f.name).alias(f.name) for f in schema])


def read_parquet_dataset(spark: SparkSession, paths: str | list[str], schema: T.StructType) -> DataFrame:
    """Several Parquet files under one declared schema; the schema is the projection and filters reach the scan."""
    paths = [paths] if isinstance(paths, str) else paths
    return spark.read.schema(schema).parquet(*paths)


def read_era(spark: SparkSession, paths: str | list[str], era: str, kind: str = "csv", first_interview: int = 1) -> DataFrame:
    """Files of one era under the final names: first interviews only, weight as a number."""
    schema = type_specs(era)
    read = read_semicolon_csv if kind == "csv" else read_parquet_dataset
    rows = read(spark, paths, schema).where(F.col("RGA") == first_interview)
    rows = rename_by_crosswalk(rows, era)
    return rows.withColumn("EXTRI", to_double("EXTRI", decimal="."))


def read_waves(spark: SparkSession, paths: list[str], columns: list[str], strict: bool = True) -> DataFrame:
    """Landed Parquet waves in one table; a lenient read takes whatever columns a wave has."""
    if strict:
        return select_columns(spark.read.parquet(*paths), columns)
    return union_all([select_columns(spark.read.parquet(p), columns, strict=False) for p in paths])


def upper_names(df: DataFrame) -> DataFrame:
    return rename_all(df, str.upper)


def write_table(df: DataFrame, path: str, partition: str | None = "ANNEE") -> None:
    """Parquet sink, one folder per year.

    Rows are rebalanced on the year first: small years end in one file each, large ones are split at run time.
    """
    writer = (df.hint("rebalance", F.col(partition)) if partition else df).write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition)
    writer.parquet(path)
