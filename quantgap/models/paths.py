"""Chained equations origin -> diploma -> occupation -> wage, and the effects along the paths.

Three least-squares equations on level scores: diploma on origin and controls, occupation on origin, diploma and
controls, log wage on origin, diploma, occupation and controls.  All of them, for every group and every bootstrap
replicate, come from one set of cross products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quantgap.models.linear import INTERCEPT, CrossProducts, coefficient_rows, cross_products, solve
from quantgap.models.tails import chi_square_upper
from quantgap.operators.draws import draw_bits, draw_counts, draw_tasks
from quantgap.session import cut_lineage, result_table, ship

for module in (__name__, "quantgap.models.linear", "quantgap.models.tails"):
    ship(module)


@dataclass(frozen=True)
class PathModel:
    """Columns of the three equations; ``origins`` maps a short name to its 0/1 column."""

    origins: dict
    controls: tuple
    diploma: str
    occupation: str
    wage: str

    @property
    def columns(self) -> list[str]:
        return [*self.origins.values(), *self.controls, self.diploma, self.occupation, self.wage]

    def equations(self) -> list[tuple[str, list[str]]]:
        exogenous = [*self.origins.values(), *self.controls]
        return [
            (self.diploma, exogenous),
            (self.occupation, [*exogenous, self.diploma]),
            (self.wage, [*exogenous, self.diploma, self.occupation]),
        ]

    def path_names(self) -> dict[tuple[str, str], str]:
        """Name of each structural coefficient by (outcome, regressor)."""
        names = {
            (self.occupation, self.diploma): "c",
            (self.wage, self.diploma): "e",
            (self.wage, self.occupation): "f",
        }
        for short, column in self.origins.items():
            names[(self.diploma, column)] = f"a_{short}"
            names[(self.occupation, column)] = f"b_{short}"
            names[(self.wage, column)] = f"d_{short}"
        return names

    def paths(self) -> list[str]:
        per_origin = [f"{letter}_{short}" for short in self.origins for letter in "abd"]
        return [*per_origin, "c", "e", "f"]


COEFFICIENT_SCHEMA = (
    "outcome string, term string, path string, estimate double, se double, stat double, p double, standardized double"
)


def coefficient_list(products: CrossProducts, model: PathModel) -> list[tuple]:
    """Rows of ``COEFFICIENT_SCHEMA`` of the three equations."""
    names, rows = model.path_names(), []
    spread = np.sqrt(np.diag(products.centred))
    for y, xs in model.equations():
        fit = solve(products, model.columns, y, xs)
        for row in coefficient_rows(fit):
            term, estimate = row[0], row[1]
            standardized = None
            if term != INTERCEPT and estimate is not None:
                scale = spread[model.columns.index(y)]
                standardized = float(estimate * spread[model.columns.index(term)] / scale) if scale > 0 else None
            rows.append((y, term, names.get((y, term)), *row[1:], standardized))
    return rows


def path_coefficients(df: DataFrame, model: PathModel, by: list[str] = (), weight: str | None = None, frequency: bool = False, center: dict | None = None) -> DataFrame:
    """``by…, outcome, term, path, estimate, se, stat, p, standardized`` for every group of ``by`` at once."""
    rows = []
    for products in cross_products(df, model.columns, by, weight, center, frequency, measure=model.wage):
        rows += [(*products.key, *row) for row in coefficient_list(products, model)]
    keys = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by]
    return result_table(df.sparkSession, ", ".join([*keys, COEFFICIENT_SCHEMA]), rows)


def path_replicates(df: DataFrame, model: PathModel, row_key: str, by: list[str] = (), replicates: int = 100, seed: int = 42) -> DataFrame:
    """Coefficients of every bootstrap replicate (``rep``), all from one pass.

    Rows are collapsed to distinct (pattern of codes, wage) with a count, and each of these draws its number for every
    replicate at once (see :mod:`quantgap.operators.draws`).  A task adds up the products of its rows for all replicates
    as one matrix product; per group and replicate these sums, one row a task, are added and solved on the executors.
    """
    by, columns = list(by), model.columns
    whole = df.select(row_key, *by, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns]).dropna(subset=columns)
    counted = whole.groupBy(*by, *[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_c"), F.min(row_key).alias("_key"))
    counted = cut_lineage(counted, "patterns")
    known = counted.agg(F.sum("_c"), *[F.sum(F.col(f"`{c}`") * F.col("_c")) for c in columns]).first()
    center = np.array([(total or 0.0) / max(known[0] or 0, 1) for total in known[1:]])
    counted = counted.repartition(draw_tasks(df, known[0] or 0, replicates))
    given = counted.select(*by, F.array(*[F.col(f"`{c}`") for c in columns]).alias("_x"), F.col("_c").cast("double"), draw_bits("_key", replicates, seed).alias("_bits"))
    size = len(columns)
    upper = np.triu_indices(size)
    width = 1 + size + len(upper[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("_x").flatten()).reshape(-1, size) - center
            drawn = draw_counts(batch.column("_bits").to_pylist(), np.asarray(batch.column("_c")), replicates)
            terms = np.concatenate([np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]], axis=1)
            keys = list(zip(*[batch.column(k).to_pylist() for k in by])) if by else [()] * len(x)
            labels = {key: i for i, key in enumerate(dict.fromkeys(keys))}
            slot = np.array([labels[key] for key in keys])
            for key, i in labels.items():
                part = drawn[slot == i].T @ terms[slot == i]
                sums[key] = sums[key] + part if key in sums else part
        found = [(*key, r, row.tolist()) for key, matrix in sums.items() for r, row in enumerate(matrix) if row[0] > 0]
        columns_out = zip(*found) if found else [()] * (len(by) + 2)
        kinds_out = [*[given_schema.field(k).type for k in by], pa.int32(), pa.list_(pa.float64())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns_out, kinds_out)], names=[*by, "rep", "_sums"])

    def fit(table: pa.Table) -> pa.Table:
        total = np.asarray(table["_sums"].combine_chunks().flatten()).reshape(-1, width).sum(axis=0)
        weight, mean = total[0], total[1 : 1 + size] / total[0]
        raw = np.zeros((size, size))
        raw[upper] = total[1 + size :]
        raw = raw + np.triu(raw, 1).T
        rows = coefficient_list(CrossProducts((), weight, weight, mean + center, raw - weight * np.outer(mean, mean)), model)
        place = table.select([*by, "rep"]).take(pa.array(np.zeros(len(rows), np.int64)))
        kinds_out = [pa.string()] * 3 + [pa.float64()] * 5
        names_out = [*by, "rep", "outcome", "term", "path", "estimate", "se", "stat", "p", "standardized"]
        return pa.table([*place.columns, *[pa.array(list(c), t) for c, t in zip(zip(*rows), kinds_out)]], names=names_out)

    given_schema = to_arrow_schema(given.select(*by).schema)
    keys = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in by)
    return given.mapInArrow(add, f"{keys}rep int, _sums array<double>").groupBy(*by, "rep").applyInArrow(fit, f"{keys}rep int, {COEFFICIENT_SCHEMA}")


def effect_columns(model: PathModel) -> dict[str, Column]:
    """Products and sums of paths, per origin."""
    effects = {}
    c, e, f = F.col("c"), F.col("e"), F.col("f")
    for short in model.origins:
        a, b, d = F.col(f"a_{short}"), F.col(f"b_{short}"), F.col(f"d_{short}")
        effects[f"via_diploma_{short}"] = a * e
        effects[f"via_occupation_{short}"] = b * f
        effects[f"via_both_{short}"] = a * c * f
        effects[f"indirect_{short}"] = a * e + b * f + a * c * f
        effects[f"total_{short}"] = d + a * e + b * f + a * c * f
    return effects


def path_table(coefficients: DataFrame, model: PathModel, by: list[str] = (), value: str = "estimate") -> DataFrame:
    """One row per group with a column per path and per effect."""
    named = coefficients.where(F.col("path").isNotNull())
    wide = named.groupBy(*by).pivot("path", model.paths()).agg(F.max(value))
    return wide.withColumns(effect_columns(model))


def path_effects(coefficients: DataFrame, model: PathModel, by: list[str] = (), value: str = "estimate") -> DataFrame:
    """``by…, effect, value``: paths, indirect and total effects in long form."""
    wide = path_table(coefficients, model, by, value)
    names = [c for c in wide.columns if c not in by]
    return wide.unpivot(list(by), names, "effect", "value")


def effect_decomposition(coefficients: DataFrame, model: PathModel, by: list[str] = (), value: str = "standardized") -> DataFrame:
    """``by…, path, origin, effect``: direct effect and the three indirect ways for each origin."""
    wide = path_table(coefficients, model, by, value)
    ways = {"Direct": "d", "Via diplôme": "via_diploma", "Via PCS": "via_occupation", "Via dip→PCS": "via_both"}
    entries = [
        F.struct(F.lit(way).alias("path"), F.lit(short).alias("origin"), F.col(f"{column}_{short}").alias("effect"))
        for way, column in ways.items()
        for short in model.origins
    ]
    return wide.select(*by, F.inline(F.array(*entries)))


def group_differences(effects: DataFrame, group: str, first, second, by: list[str] = ()) -> DataFrame:
    """Second group minus first group for every effect."""
    pair = effects.groupBy(*by, "effect").agg(
        F.max(F.when(F.col(group) == first, F.col("value"))).alias("first"),
        F.max(F.when(F.col(group) == second, F.col("value"))).alias("second"),
    )
    return pair.withColumn("diff", F.col("second") - F.col("first"))


def wald_each(differences: DataFrame, replicate_differences: DataFrame) -> DataFrame:
    """``effect, diff, se, chisq, p``: test of equality of each effect between two groups, variance from replicates."""
    spread = replicate_differences.groupBy("effect").agg(F.stddev_samp("diff").alias("se"))
    tests = differences.join(spread, "effect").select(
        "effect", "diff", "se", F.pow(F.try_divide(F.col("diff"), F.col("se")), F.lit(2)).alias("chisq")
    )
    rows = [
        (r["effect"], r["diff"], r["se"], r["chisq"], None if r["chisq"] is None else chi_square_upper(r["chisq"], 1))
        for r in tests.orderBy("effect").collect()
    ]
    return result_table(differences.sparkSession, "effect string, diff double, se double, chisq double, p double", rows)


def wald_joint(differences: DataFrame, replicate_differences: DataFrame, effects: list[str]) -> DataFrame:
    """One row ``chisq, df, p``: all listed effects equal between the groups, covariance from replicates."""
    wide = replicate_differences.where(F.col("effect").isin(effects)).groupBy("rep").pivot("effect", effects).agg(F.max("diff"))
    size = len(effects)
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    moments = wide.agg(*[F.covar_samp(f"`{effects[i]}`", f"`{effects[j]}`").alias(f"v{i}_{j}") for i, j in pairs]).first()
    covariance = np.empty((size, size))
    for i, j in pairs:
        covariance[i, j] = covariance[j, i] = moments[f"v{i}_{j}"]
    found = {r["effect"]: r["diff"] for r in differences.where(F.col("effect").isin(effects)).collect()}
    gap = np.array([found[e] for e in effects])
    chisq = float(gap @ np.linalg.pinv(covariance) @ gap)
    rank = int(np.linalg.matrix_rank(covariance))
    row = (chisq, rank, chi_square_upper(chisq, rank) if not math.isnan(chisq) else None)
    return result_table(differences.sparkSession, "chisq double, df int, p double", [row])
