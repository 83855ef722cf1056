"""From the harmonised table to the analysis sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantgap.functions import codes
from quantgap.functions.bands import AGE_BY_FIVE, AGE_BY_TEN, BIRTH_BY_FIVE, PERIOD_BY_ELEVEN, PERIOD_BY_FIVE, Bands, decade_cohort
from quantgap.functions.levels import relabel
from quantgap.functions.scalar import FRANCS_TO_EUROS, if_else, real_value, safe_log
from quantgap.operators.cells import geometric_mean
from quantgap.operators.joins import deflate
from quantgap.operators.reweight import balance_nonresponse
from quantgap.session import literal_table


@dataclass(frozen=True)
class Preparation:
    """What differs between analyses.

    ``positive_on`` names the wage that must be positive: the recorded wage (years without one drop out) or the real
    wage (years whose wage was imputed from brackets stay).
    """

    cohort_floor: str = "(1940,1945]"
    first_year: int | None = 1990
    keep_unemployed: bool = False
    periods: Bands = PERIOD_BY_ELEVEN
    period_name: str = "AN11"
    impute_brackets: bool = False
    positive_on: str = "SAL"
    ages: tuple[int, int] = (30, 60)
    floor_wage: float = 1.0
    seed: int = 42


def bracket_bounds(rate: float = FRANCS_TO_EUROS) -> list[tuple[str, float, float, bool]]:
    """``(label, low, high, open top)`` of each wage bracket in euros."""
    limits = (0,) + codes.BRACKET_LIMITS + (codes.BRACKET_TOP_LIMIT,)
    last = len(limits) - 2
    return [
        (label, low * rate, high * rate, i == last)
        for i, (label, low, high) in enumerate(zip(codes.BRACKET_LABELS, limits, limits[1:]))
    ]


def top_bracket_mean(
    df: DataFrame, year: str, bracket: str, real_wage: str, index: str, top: str, years: tuple[int, int]
) -> DataFrame:
    """One row: geometric mean of real wages in the open bracket over some years, and the mean index over these rows."""
    rows = df.where(F.col(year).between(*years) & (F.col(bracket) == top))
    return rows.agg(geometric_mean(real_wage).alias("top_wage"), F.avg(index).alias("mean_index"))


def bracket_values(
    index: DataFrame,
    top: DataFrame,
    brackets: list[tuple[str, float, float, bool]],
    years: tuple[int, int],
    year: str = "ANNEE",
) -> DataFrame:
    """Value of each bracket in each year: midpoint times the index, the open bracket from observed top wages."""
    spark = index.sparkSession
    bounds = literal_table(
        spark, [("bracket", "string"), ("low", "double"), ("high", "double"), ("open_top", "boolean")], brackets
    )
    calendar = literal_table(spark, [(year, "int")], [(y,) for y in range(years[0], years[1] + 1)])
    grid = deflate(bounds.crossJoin(calendar), index, year).crossJoin(top)
    middle = (F.col("low") + F.col("high")) / 2 * F.col("ipc") / 100
    observed = F.try_divide("top_wage", "mean_index") * F.col("ipc")
    return grid.select("bracket", year, F.when(F.col("open_top"), observed).otherwise(middle).alias("sal_moyen"))


def impute_brackets(df: DataFrame, values: DataFrame, before: int, year: str = "ANNEE", bracket: str = "SALTR", wage: str = "sal2025") -> DataFrame:
    """Real wage of the years before ``before`` from the bracket value."""
    side = values.withColumnsRenamed({"bracket": bracket})
    joined = df.join(side, [year, bracket], "left")
    return joined.withColumn(wage, if_else(F.col(year) < before, F.col("sal_moyen"), F.col(wage))).drop("sal_moyen")


def prepare(df: DataFrame, index: DataFrame, row_key: str, plan: Preparation = Preparation()) -> DataFrame:
    """Analysis sample: ages, cohorts, real log wage, period, age and cohort bands, origin, diploma level, occupation.

    ``df`` is the analysis table, ``index`` is ``(ANNEE, ipc)``.  ``row_key`` identifies rows in the non-response draw.
    """
    rows = df
    if plan.impute_brackets:
        priced = deflate(rows, index, "ANNEE").withColumn("sal2025", real_value("SAL", "ipc"))
        top = top_bracket_mean(priced, "ANNEE", "SALTR", "sal2025", "ipc", codes.BRACKET_LABELS[-1], (1990, 1999))
        rows = impute_brackets(priced, bracket_values(index, top, bracket_bounds(), (1982, 1989)), 1990)
    floor = BIRTH_BY_FIVE.level_ordinal(plan.cohort_floor)
    rows = rows.where(F.col("AG").between(*plan.ages) & (F.col("gen5_ord") >= floor))
    if plan.first_year is not None:
        rows = rows.where(F.col("ANNEE") >= plan.first_year)
    if plan.keep_unemployed:
        rows = balance_nonresponse(
            rows, "ANNEE", "statut", "SAL", row_key, "En emploi", "Chômeur", plan.floor_wage, plan.seed
        ).drop("n_inconnu")
    if not plan.impute_brackets:
        rows = deflate(rows, index, "ANNEE").withColumn("sal2025", real_value("SAL", "ipc"))
    if not plan.keep_unemployed:
        rows = rows.where(F.col(plan.positive_on) > 0)
    rows = rows.withColumns(
        {
            "logsal": safe_log("sal2025"),
            "AG5": AGE_BY_FIVE.label("AG"),
            "AG10": AGE_BY_TEN.label("AG"),
            "AG10_ord": AGE_BY_TEN.ordinal("AG"),
            plan.period_name: plan.periods.label("ANNEE"),
            f"{plan.period_name}_ord": plan.periods.ordinal("ANNEE"),
        }
    )
    if plan.periods is PERIOD_BY_ELEVEN:
        rows = rows.withColumn("GEN", decade_cohort(F.col(f"{plan.period_name}_ord"), F.col("AG10_ord")))
    rows = rows.where(F.col("CSPP1") != codes.CLASSES.labels[-1])
    return rows.withColumns(
        {
            "Origin": relabel("CSPP1", codes.ORIGIN_NAMES),
            "PCS1": relabel("CSTOT1", codes.ORIGIN_NAMES),
            # Seven diploma codes from 1 (highest); level names count from 0 (lowest).
            "dip7": F.when(F.col("diplome7").between(1, 7), F.concat(F.lit("Niveau"), (7 - F.col("diplome7")).cast("string"))),
        }
    )


LONG_SERIES = Preparation(
    cohort_floor="(1930,1935]", first_year=None, periods=PERIOD_BY_FIVE, period_name="ANby5", impute_brackets=True
)
WITH_UNEMPLOYED = Preparation(keep_unemployed=True)
