"""Ordered categories as label + ordinal, with the level list kept as a small table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions.scalar import col
from quantgap.session import literal_table


@dataclass(frozen=True)
class Levels:
    """Ordered level list; ``codes`` are the raw codes the labels stand for (1..n when absent)."""

    labels: tuple
    codes: tuple = ()

    def pairs(self) -> list[tuple]:
        return list(zip(self.codes or range(1, len(self.labels) + 1), self.labels))

    def ordinal(self, label: str | Column) -> Column:
        """Position of a label in the level order, NULL for unknown labels."""
        position = F.array_position(F.array(*[F.lit(v) for v in self.labels]), col(label))
        return F.when(position > 0, position.cast("int"))

    def label(self, code: str | Column) -> Column:
        """Label of a code, NULL for unknown codes."""
        code = col(code)
        chain = None
        for raw, label in self.pairs():
            test = code == F.lit(raw)
            chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
        return chain

    def table(self, spark: SparkSession, code_type: str = "int") -> DataFrame:
        rows = [(code, label, i + 1) for i, (code, label) in enumerate(self.pairs())]
        return literal_table(spark, [("code", code_type), ("label", "string"), ("ord", "int")], rows)

    def recoded(self, mapping: dict[str, str | None]) -> "Levels":
        """Rename, merge (same new name) or drop (``None``) levels; order of first appearance is kept."""
        new = [mapping.get(label, label) for label in self.labels]
        return Levels(tuple(dict.fromkeys(label for label in new if label is not None)))

    def moved(self, level: str, after: int) -> "Levels":
        """Move one level behind the given number of others."""
        rest = [label for label in self.labels if label != level]
        return Levels(tuple(rest[:after] + [level] + rest[after:]))

    def reversed(self) -> "Levels":
        return Levels(tuple(reversed(self.labels)))

    def merged(self, other: "Levels") -> "Levels":
        """Levels of a union of two tables: the first list, then what the second adds."""
        return Levels(tuple(dict.fromkeys(self.labels + other.labels)))


def relabel(x: str | Column, mapping: dict[str, str | None]) -> Column:
    """Rename or merge levels, unknown labels pass through, ``None`` drops to NULL."""
    x = col(x)
    chain = None
    for old, new in mapping.items():
        chain = F.when(x == old, F.lit(new)) if chain is None else chain.when(x == old, F.lit(new))
    return chain.otherwise(x)


def attach_labels(df: DataFrame, code: str, dictionary: DataFrame, out: str, variable: str | None = None) -> DataFrame:
    """Label and ordinal of a code column from a ``(variable, code, label, ord)`` dictionary; unknown codes give NULL."""
    if variable is not None:
        dictionary = dictionary.where(F.col("variable") == variable)
    side = dictionary.select(
        F.col("code").alias("__code"), F.col("label").alias(out), F.col("ord").alias(f"{out}_ord")
    )
    return df.join(side, F.col(code) == F.col("__code"), "left").drop("__code")


def observed_levels(df: DataFrame, ordinal: str, out: str = "ord", descending: bool = False) -> DataFrame:
    """Renumber an ordinal over the levels that occur, first or last level first (the distinct list is the level table)."""
    found = df.select(ordinal).where(F.col(ordinal).isNotNull()).distinct()
    order = F.col(ordinal).desc() if descending else F.col(ordinal).asc()
    numbered = found.withColumn(out, F.dense_rank().over(W.orderBy(order)))
    return df.join(numbered, ordinal, "left")


def order_by_code(dictionary: DataFrame) -> DataFrame:
    """Level table of a dictionary in descending order of the smallest code of each label."""
    first = dictionary.groupBy("label").agg(F.min("code").alias("code"))
    return first.withColumn("ord", F.dense_rank().over(W.orderBy(F.col("code").desc())))


def dummies(x: str, levels: list[str], prefix: str = "") -> dict[str, Column]:
    """Treatment coding: a 0/1 column for every level but the first, with sanitised names."""
    import re

    return {
        re.sub(r"[^A-Za-z0-9_.]", ".", f"{prefix or x}{level}"): F.when(F.col(x) == level, 1).otherwise(0)
        for level in levels[1:]
    }
