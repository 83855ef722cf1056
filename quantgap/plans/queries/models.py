"""Regressions on cell tables, imputation and path models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantgap.functions.scalar import indicators, recode
from quantgap.models.contrasts import interactions, polynomial, polynomial_matrix, treatment
from quantgap.models.glm import glm
from quantgap.models.imputation import pooled_ols, predictive_mean_matching
from quantgap.models.linear import ols
from quantgap.models.paths import (
    PathModel,
    effect_decomposition,
    group_differences,
    path_coefficients,
    path_effects,
    path_replicates,
    wald_each,
    wald_joint,
)
from quantgap.operators.cells import keep_varied_groups, reference_join
from quantgap.operators.distance import wasserstein
from quantgap.plans.queries.base import REF, SAMPLE_SQL, distance_sql, query, rounded, sample, table
from quantgap.plans.queries.resampling import REPLICATES, SEED, histogram_draws_sql
from quantgap.session import cut_lineage

FINE = ["sexe", "an", "ag10", "dip", "pcs"]
# Orthonormal polynomial contrasts of three equally spaced levels.
LINEAR, QUADRATIC = (-1 / math.sqrt(2), 0.0, 1 / math.sqrt(2)), (1 / math.sqrt(6), -2 / math.sqrt(6), 1 / math.sqrt(6))


def poly_sql(column: str, values) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i + 1} THEN {v!r}::DOUBLE" for i, v in enumerate(values)) + " END"


def ols_sql(source: str, y: str, xs: list[str], weight: str = "1", by: str | None = None, suffix: str = "") -> str:
    """CTE ``fit(grp, i, estimate, se, r2, df)``: least squares by sweeping the cross-product matrix.

    Row ``i`` is 0 for the intercept and the place of the regressor otherwise.
    """
    columns = ["1.0::DOUBLE", *xs, y]
    size, group = len(columns), by or "0"
    sums = ", ".join(f"sum(({weight})::DOUBLE * ({a}) * ({b}))" for a in columns for b in columns)
    whole = " AND ".join(f"({c}) IS NOT NULL" for c in [*xs, y])
    return f"""
    gram{suffix} AS (SELECT {group} AS grp, [{sums}] AS flat, count(*) AS rows, sum(({weight})::DOUBLE * ({y})) AS sy, sum({weight})::DOUBLE AS sw FROM {source} WHERE {whole} AND ({weight}) > 0 GROUP BY ALL),
    start{suffix} AS (SELECT grp, (x // {size})::INTEGER AS i, (x % {size})::INTEGER AS j, flat[(x + 1)::INTEGER] AS v FROM gram{suffix}, (SELECT unnest(range({size * size})) AS x)),
    sweep{suffix} AS (SELECT 0 AS k, grp, i, j, v FROM start{suffix} UNION ALL
      SELECT k + 1, grp, i, j, CASE WHEN i = k AND j = k THEN -1 / d WHEN i = k OR j = k THEN v / d ELSE v - ik * kj / d END FROM (
        SELECT *, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY grp, i) AS ik, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY grp, j) AS kj,
               max(CASE WHEN i = k AND j = k THEN v END) OVER (PARTITION BY grp) AS d FROM sweep{suffix} WHERE k < {size - 1})),
    done{suffix} AS (SELECT * FROM sweep{suffix} WHERE k = {size - 1}),
    fit{suffix} AS (SELECT b.grp, b.i, b.v AS estimate, sqrt(-q.v * r.v / (rows - {size - 1})) AS se, 1 - r.v / (syy.v - sy * sy / sw) AS r2, (rows - {size - 1})::DOUBLE AS df
      FROM done{suffix} b JOIN done{suffix} q ON b.grp = q.grp AND q.i = b.i AND q.j = b.i JOIN done{suffix} r ON r.grp = b.grp AND r.i = {size - 1} AND r.j = {size - 1}
      JOIN start{suffix} syy ON syy.grp = b.grp AND syy.i = {size - 1} AND syy.j = {size - 1} JOIN gram{suffix} g ON g.grp = b.grp WHERE b.j = {size - 1} AND b.i < {size - 1})"""


def term_sql(names: list[str], column: str = "i") -> str:
    return f"CASE {column} " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(["(Intercept)", *names])) + " END"


def fine_cells(spark, folder):
    """Distance and smaller group size of every fine cell."""
    cells = wasserstein(sample(spark, folder), FINE, "origin", "logsal", REF, ["MACHINERY"], min_obs=2)
    # Models pass over the cell table several times.
    return cut_lineage(cells.withColumn("n_min", F.least("n", "n_ref")), "cells")


FINE_SQL = f"""{SAMPLE_SQL}, {distance_sql("sample", FINE, "origin", "logsal", REF, ["MACHINERY"], least=2)},
    cells AS (SELECT *, least(n, n_ref) AS n_min, (sexe = 'Homme')::INTEGER AS homme FROM distances)"""


@query(
    "ols_trend",
    f"""WITH RECURSIVE {FINE_SQL}, {ols_sql("cells", "w", [poly_sql("ag10", LINEAR), poly_sql("ag10", QUADRATIC)], by="sexe")}
    SELECT grp AS sexe, {term_sql(["ag10.L", "ag10.Q"])} AS term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(r2, 6) AS r2, df AS residual_df FROM fit""",
)
def ols_trend(spark, folder):
    """Trend of the distance along the age bands, one fit per sex."""
    rows = fine_cells(spark, folder).withColumns(polynomial("ag10", 3))
    return rounded(ols(rows, "w", ["ag10.L", "ag10.Q"], ["sexe"]).select("sexe", "term", "estimate", "se", "r2", "residual_df"))


def contrast_names(column: str, levels: int) -> list[str]:
    return [column + (".L", ".Q", ".C", "^4", "^5")[degree] for degree in range(levels - 1)]


def contrasts_sql(column: str, levels: int) -> list[str]:
    return [poly_sql(column, values) for values in polynomial_matrix(levels).T.tolist()]


CLASSES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
FACTORS = ["sexeHomme", *contrast_names("ag10", 3), *contrast_names("an", 3), *contrast_names("dip", 5), *["pcs" + c for c in CLASSES[1:]]]
FACTORS_SQL = ["homme", *contrasts_sql("ag10", 3), *contrasts_sql("an", 3), *contrasts_sql("dip", 5), *[f"(pcs = '{c}')::INTEGER" for c in CLASSES[1:]]]


def with_factors(rows):
    """Sex, age, period, diploma and occupation: treatment coding for unordered factors, polynomials for ordered ones."""
    ordered = {**polynomial("ag10", 3), **polynomial("an", 3), **polynomial("dip", 5)}
    return rows.withColumns({**treatment("sexe", ["Femme", "Homme"]), **ordered, **treatment("pcs", CLASSES)})


@query(
    "ols_factors",
    f"""WITH RECURSIVE {FINE_SQL}, {ols_sql("cells", "w", FACTORS_SQL)} SELECT {term_sql(FACTORS)} AS term, round(estimate, 6) AS estimate, round(se, 6) AS se,
    round(estimate / se, 4) AS stat FROM fit""",
)
def ols_factors(spark, folder):
    """All five factors of a cell."""
    fit = ols(with_factors(fine_cells(spark, folder)), "w", FACTORS)
    return fit.select("term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("stat", 4).alias("stat"))


@query(
    "wls_cells",
    f"""WITH RECURSIVE {FINE_SQL}, {ols_sql("cells", "w", FACTORS_SQL, weight="n_min")} SELECT {term_sql(FACTORS)} AS term, round(estimate, 6) AS estimate, round(se, 6) AS se FROM fit""",
)
def wls_cells(spark, folder):
    """Cells weighted by the size of their smaller group."""
    fit = ols(with_factors(fine_cells(spark, folder)), "w", FACTORS, weight="n_min")
    return rounded(fit.select("term", "estimate", "se"))


BANDS = [*contrast_names("an", 3), *contrast_names("ag5", 6)]
BANDS_SQL = [*contrasts_sql("an", 3), *contrasts_sql("ag5", 6)]
GAP_TERMS = [*BANDS, "homme", *[f"{b}:homme" for b in BANDS]]
GAPS_SQL = f"""{SAMPLE_SQL}, c AS (SELECT an, ag5, sexe, origin, avg(logsal) AS m FROM sample GROUP BY ALL),
    gaps AS (SELECT a.an, a.ag5, (a.sexe = 'Homme')::INTEGER AS homme, a.m - b.m AS gap
      FROM c a JOIN c b ON a.an = b.an AND a.ag5 = b.ag5 AND a.sexe = b.sexe AND b.origin = '{REF}' WHERE a.origin <> '{REF}')"""


def mean_gaps(spark, folder):
    """Gap of the mean to the reference origin, with the contrasts of the ordered bands."""
    means = sample(spark, folder).groupBy("an", "ag5", "sexe", "origin").agg(F.avg("logsal").alias("logsal"))
    gaps = reference_join(means, ["an", "ag5", "sexe"], "origin", REF, "logsal")
    return gaps.withColumns({"homme": (F.col("sexe") == "Homme").cast("double"), **polynomial("an", 3), **polynomial("ag5", 6)})


@query(
    "glm_interaction",
    f"""WITH RECURSIVE {GAPS_SQL}, {ols_sql("gaps", "gap", [*BANDS_SQL, "homme", *[f"({b}) * homme" for b in BANDS_SQL]])}
    SELECT {term_sql(GAP_TERMS)} AS term, round(estimate, 6) AS estimate, round(se, 6) AS se FROM fit""",
)
def glm_interaction(spark, folder):
    """Gaussian model of the mean gap on period and age bands, all with interactions by sex."""
    rows = mean_gaps(spark, folder).withColumns(interactions(BANDS, ["homme"]))
    return rounded(glm(rows, "diff_logsal", GAP_TERMS).select("term", "estimate", "se"))


@query(
    "glm_additive",
    f"""WITH RECURSIVE {GAPS_SQL}, {ols_sql("gaps", "gap", BANDS_SQL)}
    SELECT {term_sql(BANDS)} AS term, round(estimate, 6) AS estimate, round(se, 6) AS se, round(estimate / se, 4) AS stat FROM fit""",
)
def glm_additive(spark, folder):
    """The same without sex."""
    fit = glm(mean_gaps(spark, folder), "diff_logsal", BANDS)
    return fit.select("term", F.round("estimate", 6).alias("estimate"), F.round("se", 6).alias("se"), F.round("stat", 4).alias("stat"))


def newton_sql(term: str) -> str:
    """Logistic fit of ``d(x, y)`` on an intercept and one regressor by Newton steps."""
    return f"""newton AS (SELECT 0 AS it, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS va, 0.0::DOUBLE AS vb UNION ALL
      SELECT it + 1, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01),
             h11 / (h00 * h11 - h01 * h01), h00 / (h00 * h11 - h01 * h01)
      FROM (SELECT it, a, b, sum(y - p) AS g0, sum((y - p) * x) AS g1, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01, sum(p * (1 - p) * x * x) AS h11
            FROM (SELECT newton.*, x, y, 1 / (1 + exp(-(a + b * x))) AS p FROM newton, d WHERE it < 25) GROUP BY it, a, b))
    SELECT '(Intercept)' AS term, round(a, 4) AS estimate, round(sqrt(va), 4) AS se FROM newton WHERE it = 25
    UNION ALL SELECT '{term}', round(b, 4), round(sqrt(vb), 4) FROM newton WHERE it = 25"""


def logistic_rows(fit):
    return fit.select("term", F.round("estimate", 4).alias("estimate"), F.round("se", 4).alias("se"))


def gappy_cells(spark, folder):
    """Fine cells where the distance is missing in some of the small ones."""
    cells = with_factors(fine_cells(spark, folder)).withColumn("n_min", F.col("n_min").cast("double"))
    key = F.concat_ws("|", *FINE)
    few = F.col("n_min") < 18
    return cells.withColumn("cell", key).withColumn("w", F.when(~few | ((F.col("an") + F.col("ag10") + F.col("dip")) % 2 == 0), F.col("w")))


@query(
    "logit_missing",
    f"""WITH RECURSIVE {FINE_SQL}, d AS (SELECT n_min::DOUBLE AS x, (w IS NOT NULL AND (n_min >= 18 OR (an + ag10 + dip) % 2 = 0))::INTEGER::DOUBLE AS y FROM cells),
    {newton_sql("n_min")}""",
)
def logit_missing(spark, folder):
    """Does the size of the smaller group explain which cells have a distance?"""
    rows = gappy_cells(spark, folder).select("n_min", F.col("w").isNotNull().cast("double").alias("observed"))
    return logistic_rows(glm(rows, "observed", ["n_min"], "binomial"))


@query(
    "logit_labels",
    f"""WITH RECURSIVE d AS (SELECT ln(n_chars)::DOUBLE AS x, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    {newton_sql("log_chars")}""",
)
def logit_labels(spark, folder):
    """Logistic fit of a 0/1 label on one regressor."""
    joined = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    rows = joined.select(F.col("quality").cast("double").alias("quality"), F.log(F.col("n_chars").cast("double")).alias("log_chars"))
    return logistic_rows(glm(rows, "quality", ["log_chars"], "binomial"))


@query(
    "poly_contrasts",
    f"""WITH {SAMPLE_SQL} SELECT ag10, an, round({poly_sql("ag10", LINEAR)}, 6) AS "ag10.L", round({poly_sql("ag10", QUADRATIC)}, 6) AS "ag10.Q",
    round({poly_sql("dip", [v / math.sqrt(10) for v in (-2, -1, 0, 1, 2)])}, 6) AS "dip.L", round({poly_sql("dip", [v / math.sqrt(14) for v in (2, -1, -2, -1, 2)])}, 6) AS "dip.Q",
    round({poly_sql("dip", [v / math.sqrt(10) for v in (-1, 2, 0, -2, 1)])}, 6) AS "dip.C", round({poly_sql("dip", [v / math.sqrt(70) for v in (1, -4, 6, -4, 1)])}, 6) AS "dip^4",
    count(*) AS n FROM sample GROUP BY ALL""",
)
def poly_contrasts(spark, folder):
    """Orthogonal polynomial columns of ordered factors."""
    rows = sample(spark, folder).withColumns({**polynomial("ag10", 3), **polynomial("dip", 5)})
    contrasts = ["ag10.L", "ag10.Q", "dip.L", "dip.Q", "dip.C", "dip^4"]
    values = [(F.round(F.col(f"`{c}`"), 6) + F.lit(0.0)).alias(c) for c in contrasts]
    counted = rows.select("ag10", "an", *values).groupBy("ag10", "an", *[F.col(f"`{c}`") for c in contrasts])
    return counted.agg(F.count(F.lit(1)).alias("n"))


@query("pmm_completed")
def pmm_completed(spark, folder):
    """Twenty completed tables: missing distances taken from donor cells of near prediction."""
    filled = predictive_mean_matching(gappy_cells(spark, folder), "w", [*FACTORS, "n_min"], "cell", 20, seed=42)
    return rounded(filled.select("imp", "cell", "w"))


@query("pmm_pooled")
def pmm_pooled(spark, folder):
    """Fits of the twenty tables without the auxiliary column, pooled."""
    filled = predictive_mean_matching(gappy_cells(spark, folder), "w", [*FACTORS, "n_min"], "cell", 20, seed=42)
    return rounded(pooled_ols(filled, "w", FACTORS))


ORIGINS = {"Cadre": "o_machinery", "Ouvrier": "o_building", "Employé": "o_furniture", "Pinter": "o_household"}  # AUTOMOBILE is the base
COHORTS, PERIODS_IN = [1950, 1960, 1970, 1980], [2, 3]  # the first level of each is the base
DUMMIES = [*[f"gen{g}" for g in COHORTS], *[f"an{a}" for a in PERIODS_IN]]
MODEL = PathModel(ORIGINS, ("homme", *DUMMIES), "dip", "occ", "logsal")
BY_SEX = PathModel(ORIGINS, tuple(DUMMIES), "dip", "occ", "logsal")
BY_COHORT = PathModel(ORIGINS, ("homme", "an"), "dip", "occ", "logsal")  # a cohort is seen in two or three periods


def chained(spark, folder):
    """Level scores for diploma and occupation (two lowest classes merged), 0/1 columns for origin and sex."""
    rows = sample(spark, folder)
    occupation = recode("pcs", {1: ["AFRICA", "AMERICA"], 2: ["ASIA"], 3: ["EUROPE"], 4: ["MIDDLE EAST"]})
    rows = rows.withColumn("occ", occupation).withColumns(indicators("origin", [name[2:].upper() for name in ORIGINS.values()], "o_{level}"))
    rows = rows.withColumns({**treatment("gen", [1940, *COHORTS]), **treatment("an", [1, *PERIODS_IN])})
    return rows.withColumns(
        {
            **{name: F.col("o_" + name[2:].upper()) for name in ORIGINS.values()},
            "homme": (F.col("sexe") == "Homme").cast("int"),
        }
    ).dropna(subset=["dip", "occ", "logsal"])


DUMMIES_SQL = ", ".join([*[f"(gen = {g})::INTEGER AS gen{g}" for g in COHORTS], *[f"(an = {a})::INTEGER AS an{a}" for a in PERIODS_IN]])
CHAIN_SQL = f"""{SAMPLE_SQL}, chain AS (SELECT *, CASE WHEN pcs IN ('AFRICA', 'AMERICA') THEN 1 WHEN pcs = 'ASIA' THEN 2 WHEN pcs = 'EUROPE' THEN 3 ELSE 4 END AS occ,
    {", ".join(f"(origin = '{name[2:].upper()}')::INTEGER AS {name}" for name in ORIGINS.values())}, {DUMMIES_SQL}, (sexe = 'Homme')::INTEGER AS homme FROM sample)"""


def chain_fits(controls: list[str], by: str | None = None, source: str = "chain", weight: str = "1", name: str = "") -> str:
    """CTEs of the three equations, told apart by ``name``."""
    xs = [*ORIGINS.values(), *controls]
    return ", ".join(
        [
            ols_sql(source, "dip", xs, weight, by, f"{name}1"),
            ols_sql(source, "occ", [*xs, "dip"], weight, by, f"{name}2"),
            ols_sql(source, "logsal", [*xs, "dip", "occ"], weight, by, f"{name}3"),
        ]
    )


def chain_rows(controls: list[str], name: str = "") -> str:
    xs = [*ORIGINS.values(), *controls]
    parts = [("dip", xs, f"{name}1"), ("occ", [*xs, "dip"], f"{name}2"), ("logsal", [*xs, "dip", "occ"], f"{name}3")]
    return " UNION ALL ".join(f"SELECT grp, '{y}' AS outcome, {term_sql(names)} AS term, estimate, se FROM fit{s}" for y, names, s in parts)


@query(
    "path_scores",
    f"""WITH RECURSIVE {CHAIN_SQL}, {chain_fits(["homme", *DUMMIES])}, rows AS ({chain_rows(["homme", *DUMMIES])})
    SELECT outcome, term, round(estimate, 6) AS estimate, round(se, 6) AS se FROM rows""",
)
def path_scores(spark, folder):
    """Three chained least-squares equations on level scores."""
    return rounded(path_coefficients(chained(spark, folder), MODEL).select("outcome", "term", "estimate", "se"))


@query(
    "path_by_group",
    f"""WITH RECURSIVE {CHAIN_SQL}, {chain_fits(DUMMIES, "sexe")}, rows AS ({chain_rows(DUMMIES)})
    SELECT grp AS sexe, outcome, term, round(estimate, 6) AS estimate, round(se, 6) AS se FROM rows""",
)
def path_by_group(spark, folder):
    """All coefficients free by sex, from the same aggregation."""
    fit = path_coefficients(chained(spark, folder), BY_SEX, ["sexe"])
    return rounded(fit.select("sexe", "outcome", "term", "estimate", "se"))


def filtered_sql(sexe: str, name: str) -> str:
    """CTEs of the model on the rows of one sex."""
    return f"chain{name} AS (SELECT * FROM chain WHERE sexe = '{sexe}'), {chain_fits(DUMMIES, source='chain' + name, name=name)}, rows{name} AS ({chain_rows(DUMMIES, name)})"


@query(
    "path_filtered_group",
    f"""WITH RECURSIVE {CHAIN_SQL}, {filtered_sql("Femme", "f")}, {filtered_sql("Homme", "h")}
    SELECT sexe, outcome, term, round(estimate, 6) AS estimate, round(se, 6) AS se
    FROM (SELECT 'Femme' AS sexe, * FROM rowsf UNION ALL SELECT 'Homme', * FROM rowsh)""",
)
def path_filtered_group(spark, folder):
    """The model fitted on women only and on men only."""
    fits = [
        path_coefficients(chained(spark, folder).where(F.col("sexe") == sexe), BY_SEX).select(F.lit(sexe).alias("sexe"), "outcome", "term", "estimate", "se")
        for sexe in ("Femme", "Homme")
    ]
    return rounded(fits[0].union(fits[1]))


@query(
    "path_by_cohort",
    f"""WITH RECURSIVE {CHAIN_SQL.replace("FROM sample)", "FROM sample WHERE gen IN (SELECT gen FROM sample GROUP BY gen HAVING count(DISTINCT an) > 1))")},
    {chain_fits(["homme", "an"], "gen")}, rows AS ({chain_rows(["homme", "an"])})
    SELECT grp::INTEGER AS gen, outcome, term, round(estimate, 6) AS estimate, round(se, 6) AS se FROM rows""",
)
def path_by_cohort(spark, folder):
    """By cohort, for cohorts seen in more than one period."""
    rows = keep_varied_groups(chained(spark, folder), "gen", "an")
    return rounded(path_coefficients(rows, BY_COHORT, ["gen"]).select("gen", "outcome", "term", "estimate", "se"))


def path_values_sql(source: str) -> str:
    """CTE ``wide`` with one column per path from the coefficient rows."""
    pick = "max(CASE WHEN outcome = '{}' AND term = '{}' THEN estimate END)"
    columns = []
    for short, term in ORIGINS.items():
        for letter, y in (("a", "dip"), ("b", "occ"), ("d", "logsal")):
            columns.append(f"{pick.format(y, term)} AS {letter}_{short}")
    columns += [f"{pick.format(y, t)} AS {n}" for n, y, t in (("c", "occ", "dip"), ("e", "logsal", "dip"), ("f", "logsal", "occ"))]
    return f"wide AS (SELECT grp, {', '.join(columns)} FROM {source} GROUP BY grp)"


def effect_pairs() -> list[tuple[str, str]]:
    pairs = [(n, n) for short in ORIGINS for n in (f"a_{short}", f"b_{short}", f"d_{short}")] + [(n, n) for n in "cef"]
    for s in ORIGINS:
        pairs += [
            (f"via_diploma_{s}", f"a_{s} * e"),
            (f"via_occupation_{s}", f"b_{s} * f"),
            (f"via_both_{s}", f"a_{s} * c * f"),
            (f"indirect_{s}", f"a_{s} * e + b_{s} * f + a_{s} * c * f"),
            (f"total_{s}", f"d_{s} + a_{s} * e + b_{s} * f + a_{s} * c * f"),
        ]
    return pairs


EFFECTS_SQL = " UNION ALL ".join(f"SELECT grp, '{name}' AS effect, {sql} AS value FROM wide" for name, sql in effect_pairs())


@query(
    "path_effects",
    f"""WITH RECURSIVE {CHAIN_SQL}, {chain_fits(["homme", *DUMMIES])}, rows AS ({chain_rows(["homme", *DUMMIES])}), {path_values_sql("rows")}
    SELECT effect, round(value, 6) AS value FROM ({EFFECTS_SQL})""",
)
def path_effect_table(spark, folder):
    """Direct, indirect and total effects of origin."""
    return rounded(path_effects(path_coefficients(chained(spark, folder), MODEL), MODEL))


@query(
    "path_differences",
    f"""WITH RECURSIVE {CHAIN_SQL}, {chain_fits(DUMMIES, "sexe")}, rows AS ({chain_rows(DUMMIES)}), {path_values_sql("rows")}, e AS ({EFFECTS_SQL})
    SELECT effect, round(max(CASE WHEN grp = 'Homme' THEN value END), 6) + 0.0 AS first, round(max(CASE WHEN grp = 'Femme' THEN value END), 6) + 0.0 AS second,
      round(max(CASE WHEN grp = 'Femme' THEN value END) - max(CASE WHEN grp = 'Homme' THEN value END), 6) + 0.0 AS diff FROM e GROUP BY effect""",
)
def path_differences(spark, folder):
    """Women minus men for every path and effect."""
    effects = path_effects(path_coefficients(chained(spark, folder), BY_SEX, ["sexe"]), BY_SEX, ["sexe"])
    return rounded(group_differences(effects, "sexe", "Homme", "Femme"))


STANDARD_SQL = f"""sds AS (SELECT unnest({list(MODEL.columns)}) AS name, unnest([{", ".join(f"stddev_samp({c})" for c in MODEL.columns)}]) AS sd FROM chain),
    scaled AS (SELECT grp, outcome, term, estimate * x.sd / y.sd AS estimate FROM rows JOIN sds x ON term = x.name JOIN sds y ON outcome = y.name)"""


@query(
    "standardised_paths",
    f"""WITH RECURSIVE {CHAIN_SQL}, {chain_fits(["homme", *DUMMIES])}, rows AS ({chain_rows(["homme", *DUMMIES])}),
    {STANDARD_SQL} SELECT outcome, term, round(estimate, 6) AS standardized FROM scaled""",
)
def standardised_paths(spark, folder):
    """Coefficients in standard deviations."""
    fit = path_coefficients(chained(spark, folder), MODEL).where(F.col("standardized").isNotNull())
    return rounded(fit.select("outcome", "term", "standardized"))


@query(
    "effect_decomposition",
    f"""WITH RECURSIVE {CHAIN_SQL}, {chain_fits(["homme", *DUMMIES])}, rows AS ({chain_rows(["homme", *DUMMIES])}), {STANDARD_SQL}, {path_values_sql("scaled")}, e AS ({EFFECTS_SQL})
    SELECT CASE regexp_extract(effect, '^(.*)_[^_]*$', 1) WHEN 'd' THEN 'Direct' WHEN 'via_diploma' THEN 'Via diplôme' WHEN 'via_occupation' THEN 'Via PCS' WHEN 'via_both' THEN 'Via dip→PCS' END AS path,
      regexp_extract(effect, '_([^_]*)$', 1) AS origin, round(value, 6) AS effect FROM e
    WHERE effect LIKE 'd_%' OR effect LIKE 'via_%'""",
)
def decomposition(spark, folder):
    """Standardised effect of origin by way, long form."""
    return rounded(effect_decomposition(path_coefficients(chained(spark, folder), MODEL), MODEL))


def tested(spark, folder):
    rows = chained(spark, folder)
    point = path_effects(path_coefficients(rows, BY_SEX, ["sexe"]), BY_SEX, ["sexe"])
    # The tests pass over the replicates several times.
    replicates = cut_lineage(path_replicates(rows, BY_SEX, "id", ["sexe"], REPLICATES, SEED), "replicates")
    repeated = path_effects(replicates, BY_SEX, ["sexe", "rep"])
    return (
        group_differences(point, "sexe", "Homme", "Femme"),
        group_differences(repeated, "sexe", "Homme", "Femme", ["rep"]),
    )


UNITS = ["sexe", "origin", "gen", "an", "occ", *ORIGINS.values(), *DUMMIES]
REPEATED_SQL = histogram_draws_sql("chain", UNITS, "dip", "logsal")


def sex_gap(effects: str, by: str) -> str:
    pick = "max(CASE WHEN split_part(grp, '|', 1) = '{}' THEN value END)"
    return f"SELECT {by}effect, {pick.format('Femme')} - {pick.format('Homme')} AS diff FROM {effects} GROUP BY ALL"


TESTED_SQL = f"""{CHAIN_SQL}, {chain_fits(DUMMIES, "sexe")}, rows AS ({chain_rows(DUMMIES)}), {path_values_sql("rows")}, e AS ({EFFECTS_SQL}),
    point AS ({sex_gap("e", "")}), {REPEATED_SQL},
    {chain_fits(DUMMIES, "sexe || '|' || rep", "drawn", "draw", "r")}, rowsr AS ({chain_rows(DUMMIES, "r")}), {path_values_sql("rowsr").replace("wide AS", "wider AS")},
    er AS ({EFFECTS_SQL.replace("FROM wide", "FROM wider")}), repeated AS ({sex_gap("er", "split_part(grp, '|', 2) AS rep, ")})"""


def tail_sql(chisq: str, df: str) -> str:
    """Upper tail of chi-square by Simpson's rule over its square root."""
    at, density = f"(sqrt({chisq}) + i / 200.0)", f"2 * pow(s, {df} - 1) * exp(-s * s / 2) / (pow(2, {df} / 2.0) * gamma({df} / 2.0))"
    return f"list_sum(list_transform(range(8001), lambda i: CASE WHEN i IN (0, 8000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density.replace('s *', at + ' *').replace('* s ', '* ' + at + ' ').replace('(s,', '(' + at + ',')})) / 600.0"


@query(
    "wald_equal",
    f"""WITH RECURSIVE {TESTED_SQL}, spread AS (SELECT effect, stddev_samp(diff) AS se FROM repeated GROUP BY effect),
    tests AS (SELECT effect, diff, se, pow(diff / se, 2) AS chisq FROM point JOIN spread USING (effect))
    SELECT effect, round(diff, 6) + 0.0 AS diff, round(se, 6) AS se, round(chisq, 6) AS chisq, round({tail_sql("chisq", "1")}, 6) AS p FROM tests""",
)
def wald_equal(spark, folder):
    """Equality between the sexes, path by path and for the total effects."""
    return rounded(wald_each(*tested(spark, folder)))


PATHS = BY_SEX.paths()


@query(
    "wald_joint",
    f"""WITH RECURSIVE {TESTED_SQL},
    names AS (SELECT unnest({PATHS}) AS effect, unnest(range({len(PATHS)})) AS pos),
    moved AS (SELECT pos, rep, diff - avg(diff) OVER (PARTITION BY pos) AS d FROM repeated JOIN names USING (effect)),
    border AS (SELECT a.pos AS i, b.pos AS j, sum(a.d * b.d) / ({REPLICATES} - 1) AS v FROM moved a JOIN moved b USING (rep) GROUP BY ALL
      UNION ALL SELECT pos, {len(PATHS)}, diff FROM point JOIN names USING (effect) UNION ALL SELECT {len(PATHS)}, pos, diff FROM point JOIN names USING (effect)
      UNION ALL SELECT {len(PATHS)}, {len(PATHS)}, 0.0),
    swept AS (SELECT 0 AS k, i, j, v FROM border UNION ALL
      SELECT k + 1, i, j, CASE WHEN i = k AND j = k THEN -1 / d WHEN i = k OR j = k THEN v / d ELSE v - ik * kj / d END FROM (
        SELECT *, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS ik, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS kj,
               max(CASE WHEN i = k AND j = k THEN v END) OVER () AS d FROM swept WHERE k < {len(PATHS)})),
    stat AS (SELECT -v AS chisq FROM swept WHERE k = {len(PATHS)} AND i = {len(PATHS)} AND j = {len(PATHS)})
    SELECT round(chisq, 4) AS chisq, {len(PATHS)}::INTEGER AS df, round({tail_sql("chisq", str(len(PATHS)))}, 6) AS p FROM stat""",
)
def wald_all(spark, folder):
    """All paths equal at once."""
    differences, repeated = tested(spark, folder)
    return wald_joint(differences, repeated, PATHS).select(F.round("chisq", 4).alias("chisq"), "df", (F.round("p", 6) + F.lit(0.0)).alias("p"))
