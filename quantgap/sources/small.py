"""Small text sources: yearly price index, label files, repaired dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions.codes import CHARACTER_REPAIRS, CP1252_HIGH
from quantgap.functions.scalar import col, to_double, to_int


def read_index(spark: SparkSession, path: str, year: str = "annee", value: str = "ipc") -> DataFrame:
    """Yearly index from a ``;`` file with preamble lines and comma decimals.

    Preamble and header are the lines whose first field is no year, wherever a split of the file begins.
    """
    raw = spark.read.options(sep=";", header="false").schema("y string, v string").csv(path)
    parsed = raw.select(to_int("y").alias(year), to_double("v").alias(value))
    return parsed.where(F.col(year).isNotNull())


def read_labels(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Label file into ``(variable, code, label, ord)``.

    A line ``/ NAME`` opens a block, lines ``code "label"`` belong to the block above them.  One row per file is read
    (a dictionary is a few thousand lines) and exploded by line.
    """
    decoded = F.decode("content", "ISO-8859-1" if encoding.upper() in ("CP1252", "WINDOWS-1252") else encoding)
    text = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), decoded.alias("value"))
    if encoding.upper() in ("CP1252", "WINDOWS-1252"):
        text = text.withColumn("value", from_cp1252("value"))
    lines = text.select("file", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return parse_labels(lines)


def parse_labels(lines: DataFrame) -> DataFrame:
    """``(file, pos, line)`` rows into the dictionary."""
    before = W.partitionBy("file").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    opens = F.when(F.col("line").rlike(r"^\s*/"), F.regexp_replace("line", r"^\s*/\s*", ""))
    tagged = lines.withColumn("variable", F.last(opens, ignorenulls=True).over(before))
    item = r'^\s*(\d+)\s+"(.*?)"$'
    items = tagged.where(F.col("line").rlike(item)).select(
        "file",
        "pos",
        "variable",
        to_int(F.regexp_extract("line", item, 1)).alias("code"),
        F.regexp_extract("line", item, 2).alias("label"),
    )
    order = F.row_number().over(W.partitionBy("file", "variable").orderBy("pos"))
    return items.withColumn("ord", order.cast("int")).drop("file", "pos")


def from_cp1252(text: str | Column) -> Column:
    """Text that was read as ISO 8859-1 but written in code page 1252."""
    return F.translate(col(text), "".join(map(chr, CP1252_HIGH)), "".join(CP1252_HIGH.values()))


def repair_characters(text: str | Column) -> Column:
    """The five wrong characters of the oldest dictionary."""
    return F.translate(col(text), "".join(CHARACTER_REPAIRS), "".join(CHARACTER_REPAIRS.values()))
