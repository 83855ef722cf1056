"""Wide and long forms of result tables, tagged unions, positional and pattern column selection."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, ids: list[str], names_to: str, values_to: str, columns: list[str] | None = None, strip: str = "") -> DataFrame:
    """Columns into rows; ``strip`` is a prefix removed from the names."""
    columns = columns or [c for c in df.columns if c not in ids]
    typed = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns])
    long = typed.unpivot(ids, columns, names_to, values_to)
    return long.withColumn(names_to, F.regexp_replace(names_to, f"^{re.escape(strip)}", "")) if strip else long


def to_wide(df: DataFrame, ids: list[str], names_from: str, values_from: str, names: list[str]) -> DataFrame:
    """Rows into the given columns (one value per id and name)."""
    return df.groupBy(*ids).pivot(names_from, names).agg(F.max(values_from))


def split_measure(long: DataFrame, variable: str, measures: dict[str, str], group: str) -> DataFrame:
    """``w_Cadre`` into measure and group: the first letter names the measure, the text behind ``_`` the group."""
    letter = F.substring(variable, 1, 1)
    measure = None
    for first, name in measures.items():
        measure = F.when(letter == first, name) if measure is None else measure.when(letter == first, name)
    return long.withColumns({"measure": measure, group: F.regexp_replace(variable, "^[a-z]+_", "")}).drop(variable)


def tagged_union(tables: dict[str, DataFrame], tag: str) -> DataFrame:
    """Union of named tables; missing columns are NULL and the name is kept in a column."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_all(tables: list[DataFrame]) -> DataFrame:
    """Union by name, columns absent from a table become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def columns_starting(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def columns_between(df: DataFrame, first: str, last: str) -> list[str]:
    return df.columns[df.columns.index(first) : df.columns.index(last) + 1]


def columns_at(df: DataFrame, start: int, end: int) -> list[str]:
    """Columns by 1-based inclusive positions."""
    return df.columns[start - 1 : end]


def rename_all(df: DataFrame, function) -> DataFrame:
    return df.toDF(*[function(c) for c in df.columns])


def relocate(df: DataFrame, *first: str) -> DataFrame:
    """Named columns first, the others behind in their order."""
    return df.select(*first, *[c for c in df.columns if c not in first])


def explode_pair(df: DataFrame, column: str, names: tuple[str, str]) -> DataFrame:
    """Two-element array into two columns."""
    return df.select("*", F.get(column, F.lit(0)).alias(names[0]), F.get(column, F.lit(1)).alias(names[1])).drop(column)
