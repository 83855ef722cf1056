"""Prepared samples beyond the default choices: the long series, the unemployed kept, mappings inside occupations and diplomas."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from quantgap.functions import codes
from quantgap.functions.bands import BIRTH_BY_FIVE, Bands
from quantgap.operators.distance import wasserstein
from quantgap.operators.samples import plan_slices
from quantgap.operators.transport import counterfactual
from quantgap.plans.prepare import LONG_SERIES, WITH_UNEMPLOYED, Preparation, bracket_bounds, prepare
from quantgap.plans.queries.base import PEOPLE_SQL, PRICE_INDEX, distance_sql, mapping_sql, people, query, rounded, sql_case, sql_text, sql_values
from quantgap.plans.queries.recodes import CLASS_ROWS, SHIFTED_INDEX, SHORT_NAMES, SURVEY_SQL, survey_like
from quantgap.session import literal_table

NO_CLASS = sql_text(codes.CLASSES.labels[-1])
WORKER = "Ouvrier"
OTHERS = ["Agriculteur", "ACCE", "Cadre", "Pinter", "Employé"]
CELL = ["SEXE", "AN11", "AG10"]
AG10_SQL = "CASE WHEN age <= 40 THEN '[30,40]' WHEN age <= 50 THEN '(40,50]' ELSE '(50,60]' END"
AN11_SQL = "CASE WHEN an0 <= 2001 THEN '90-00' WHEN an0 <= 2012 THEN '01-11' WHEN an0 <= 2023 THEN '12-23' END"

# The long series: one given year stands for six years from 1982 on, wages are in hundreds of the given unit, and years
# before 1990 know the bracket only.
LONG_INDEX = [(y * 6 - 9988, v) for y, v in PRICE_INDEX]
BRACKETS = bracket_bounds()
BOUNDS_SQL = sql_values("bounds", ["bracket", "low", "high", "open_top"], [(b, lo, hi, int(o)) for b, lo, hi, o in BRACKETS])


def index_table(spark, rows):
    return literal_table(spark, [("ANNEE", "int"), ("ipc", "double")], rows)


def long_survey(spark, folder):
    bands = Bands(tuple(lo for _, lo, _, _ in BRACKETS) + (float("inf"),), tuple(b for b, *_ in BRACKETS), include_lowest=False)
    year = (F.col("annee") * 6 - 9988).cast("int")
    years = people(spark, folder).select("id", year.alias("ANNEE"), (F.col("sal_gap") / 100).alias("wage"))
    rows = survey_like(spark, folder).drop("ANNEE", "SAL", "gen5_ord").join(years, "id")
    rows = rows.withColumns({"SALTR": bands.label("wage"), "SAL": F.when(F.col("ANNEE") >= 1990, F.col("wage"))}).drop("wage")
    return rows.withColumn("gen5_ord", BIRTH_BY_FIVE.ordinal(F.col("ANNEE") - F.col("AG")))


def long_sql(positive: str) -> str:
    """CTE ``ready`` of the long series; ``positive`` is the wage that must be above zero."""
    return f"""{PEOPLE_SQL}, {sql_values("indices", ["an0", "ipc"], LONG_INDEX)}, {CLASS_ROWS}, {BOUNDS_SQL},
    survey AS (SELECT id, (annee * 6 - 9988)::INTEGER AS an0, sexe, ag - 3 AS age, sal_gap / 100 AS wage, c1.label AS cspp1
      FROM people JOIN classes c1 ON cust % 7 = c1.k),
    priced AS (SELECT s.*, i.ipc, CASE WHEN an0 >= 1990 THEN wage END AS sal, bracket
      FROM survey s JOIN indices i USING (an0) LEFT JOIN bounds b ON wage > b.low AND (wage <= b.high OR b.open_top = 1)),
    top AS (SELECT exp(avg(ln(sal * ipc / 100))) AS top_wage, avg(ipc) AS mean_index FROM priced
      WHERE an0 BETWEEN 1990 AND 1999 AND bracket = {sql_text(codes.BRACKET_LABELS[-1])}),
    vals AS (SELECT bracket, an0, CASE WHEN open_top = 1 THEN top_wage / mean_index * ipc ELSE (low + high) / 2 * ipc / 100 END AS sal_moyen
      FROM bounds CROSS JOIN indices CROSS JOIN top WHERE an0 BETWEEN 1982 AND 1989),
    valued AS (SELECT p.*, CASE WHEN p.an0 < 1990 THEN sal_moyen ELSE sal * ipc / 100 END AS sal2025
      FROM priced p LEFT JOIN vals v ON p.an0 = v.an0 AND p.bracket = v.bracket),
    ready AS (SELECT id, an0, sexe, ln(sal2025) AS logsal, {AG10_SQL} AS ag10,
        CASE WHEN an0 <= 1987 THEN '82-87' WHEN an0 <= 1992 THEN '87-92' WHEN an0 <= 1997 THEN '92-97' WHEN an0 <= 2002 THEN '97-02'
             WHEN an0 <= 2007 THEN '02-07' WHEN an0 <= 2012 THEN '07-12' WHEN an0 <= 2017 THEN '12-17' WHEN an0 <= 2023 THEN '17-23' END AS anby5,
        {sql_case("cspp1", SHORT_NAMES)} AS origin
      FROM valued WHERE age BETWEEN 30 AND 60 AND an0 - age > 1930 AND {positive} > 0 AND cspp1 <> {NO_CLASS})"""


def long_series(spark, folder, positive: str):
    return prepare(long_survey(spark, folder), index_table(spark, LONG_INDEX), "id", replace(LONG_SERIES, positive_on=positive))


def long_rows(spark, folder, positive: str):
    ready = long_series(spark, folder, positive)
    return rounded(ready.select("id", "ANNEE", "logsal", "AG10", "ANby5", "Origin"))


LONG_ROWS = 'SELECT id, an0 AS "ANNEE", round(logsal, 6) AS logsal, ag10 AS "AG10", anby5 AS "ANby5", origin AS "Origin" FROM ready'


@query("prepared_long_series", f"WITH {long_sql('sal2025')} {LONG_ROWS}")
def prepared_long_series(spark, folder):
    """The long series with the years whose wages come from brackets."""
    return long_rows(spark, folder, "sal2025")


@query("prepared_long_series_recorded", f"WITH {long_sql('sal')} {LONG_ROWS}")
def prepared_long_series_recorded(spark, folder):
    """The long series where a recorded wage is asked for, so that years with brackets only drop out."""
    return long_rows(spark, folder, "SAL")


@query(
    "w2_long_series",
    f"""WITH {long_sql("sal2025")}, known AS (SELECT * FROM ready WHERE sexe IS NOT NULL), {distance_sql("known", ["sexe", "anby5"], "origin", "logsal", WORKER, OTHERS)}
    SELECT sexe AS "SEXE", anby5 AS "ANby5", target AS "Origin", n, n_ref, round(w, 6) AS w FROM distances""",
)
def w2_long_series(spark, folder):
    """Distances of every origin over the long series; bracket values are heavy ties in its first periods."""
    ready = long_series(spark, folder, "sal2025").where("SEXE IS NOT NULL")
    return rounded(wasserstein(ready, ["SEXE", "ANby5"], "Origin", "logsal", WORKER, OTHERS))


NAMES_SQL = f"""sexe, {AN11_SQL} AS an11, {AG10_SQL} AS ag10, {sql_case("cspp1", SHORT_NAMES)} AS origin,
      {sql_case("cstot1", SHORT_NAMES, "cstot1")} AS pcs1, CASE WHEN d7 <= 7 THEN 'Niveau' || (7 - d7) END AS dip7"""
KEPT_SQL = f"""{SURVEY_SQL}, kept AS (SELECT * FROM survey WHERE age BETWEEN 30 AND 60 AND an0 - age > 1940 AND an0 >= 1990)"""
READY_SQL = f"""{KEPT_SQL}, ready AS (SELECT id, ln(sal_gap * ipc / 100) AS logsal, {NAMES_SQL} FROM kept JOIN shifted USING (an0)
      WHERE sal_gap > 0 AND sexe IS NOT NULL AND cspp1 <> {NO_CLASS})"""
UNEMPLOYED_SQL = f"""{KEPT_SQL}, rate AS (SELECT an0, avg((sal_gap IS NULL)::INTEGER) AS r FROM kept WHERE statut = 'En emploi' GROUP BY an0),
    placed AS (SELECT kept.*, r, row_number() OVER (PARTITION BY an0, statut ORDER BY md5('42-' || id), id) AS place, count(*) OVER (PARTITION BY an0, statut) AS n FROM kept JOIN rate USING (an0)),
    ready AS (SELECT id, ln(coalesce(sal_gap, 1) * ipc / 100) AS logsal, {NAMES_SQL} FROM placed JOIN shifted USING (an0)
      WHERE sexe IS NOT NULL AND cspp1 <> {NO_CLASS} AND ((statut = 'En emploi' AND sal_gap IS NOT NULL) OR (statut = 'Chômeur' AND place <= floor(n * (1 - r)))))"""
DISTANCES = """SELECT sexe AS "SEXE", an11 AS "AN11", ag10 AS "AG10", target AS "Origin", n, n_ref, round(w, 6) AS w FROM distances"""
LOWER_CELL = ["sexe", "an11", "ag10"]


def ready_rows(spark, folder, plan: Preparation = Preparation()):
    return prepare(survey_like(spark, folder), index_table(spark, SHIFTED_INDEX), "id", plan).where("SEXE IS NOT NULL")


@query("w2_with_unemployed", f"WITH {UNEMPLOYED_SQL}, {distance_sql('ready', LOWER_CELL, 'origin', 'logsal', WORKER, OTHERS)} {DISTANCES}")
def w2_with_unemployed(spark, folder):
    """Distances where the unemployed are the bottom of every distribution."""
    return rounded(wasserstein(ready_rows(spark, folder, WITH_UNEMPLOYED), CELL, "Origin", "logsal", WORKER, OTHERS))


@query(
    "counterfactual_w2_occupation",
    f"""WITH {READY_SQL}, chosen AS (SELECT * FROM ready WHERE pcs1 <> 'ACCE'),
    {mapping_sql("chosen", [*LOWER_CELL, "pcs1"], "origin", "logsal", "Cadre", [*LOWER_CELL, "origin"])},
    {distance_sql("mapped", LOWER_CELL, "origin", "mapped", WORKER, OTHERS)} {DISTANCES}""",
)
def counterfactual_w2_occupation(spark, folder):
    """Every origin on the wages of one origin inside its own occupation, measured in the coarser cells."""
    rows = ready_rows(spark, folder).where("PCS1 <> 'ACCE'")
    slicing = plan_slices(rows, "logsal")
    moved = counterfactual(rows, [*CELL, "PCS1"], "Origin", "logsal", "Cadre", slicing=slicing)
    return rounded(wasserstein(moved, CELL, "Origin", "counterfactual", WORKER, OTHERS, weight="freq", frequency=True, slicing=slicing))


@query(
    "w2_by_diploma",
    f"""WITH {READY_SQL}, {distance_sql("ready", LOWER_CELL, "dip7", "logsal", "Niveau0", [f"Niveau{k}" for k in range(1, 7)])}
    SELECT sexe AS "SEXE", an11 AS "AN11", ag10 AS "AG10", target AS dip7, n, n_ref, round(w, 6) AS w FROM distances""",
)
def w2_by_diploma(spark, folder):
    """Distances of the diploma levels from the lowest one."""
    rows = ready_rows(spark, folder).where("dip7 IS NOT NULL")
    return rounded(wasserstein(rows, CELL, "dip7", "logsal", "Niveau0", [f"Niveau{k}" for k in range(1, 7)]))


@query(
    "counterfactual_w2_diploma",
    f"""WITH {READY_SQL}, chosen AS (SELECT * FROM ready WHERE dip7 IS NOT NULL),
    {mapping_sql("chosen", LOWER_CELL, "dip7", "logsal", "Niveau0", [*LOWER_CELL, "origin"])},
    {distance_sql("mapped", LOWER_CELL, "origin", "mapped", WORKER, OTHERS)} {DISTANCES}""",
)
def counterfactual_w2_diploma(spark, folder):
    """Every diploma level on the wages of one level, then origins measured on what is left."""
    rows = ready_rows(spark, folder).where("dip7 IS NOT NULL")
    slicing = plan_slices(rows, "logsal")
    moved = counterfactual(rows, CELL, "dip7", "logsal", "Niveau0", split=["Origin"], slicing=slicing)
    return rounded(wasserstein(moved, CELL, "Origin", "counterfactual", WORKER, OTHERS, weight="freq", frequency=True, slicing=slicing))
