"""Distances, quantiles, counterfactuals and their decompositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgap.functions.scalar import is_finite
from quantgap.operators.cells import group_stats
from quantgap.operators.distance import (
    cell_summary,
    compare_cases,
    quantiles,
    slice_distance,
    translation_dispersion,
    wasserstein,
)
from quantgap.operators.reshape import to_long
from quantgap.operators.reweight import composition_weights
from quantgap.operators.samples import ecdf, plan_slices
from quantgap.operators.transport import counterfactual
from quantgap.plans.queries.base import (
    CELL,
    PEOPLE_SQL,
    REF,
    SAMPLE_SQL,
    TARGETS,
    distance_sql,
    mapping_sql,
    people,
    query,
    rounded,
    sample,
    sql_list,
    table,
)
from quantgap.plans.report import share_tiles
from quantgap.session import literal_table

CELLS = ", ".join(CELL)
SUMMARY_SQL = f"""{distance_sql("sample", CELL, "origin", "logsal", REF, TARGETS)},
    stats AS (SELECT {CELLS}, origin, avg(logsal) AS m, stddev_samp(logsal) AS sd FROM sample GROUP BY ALL),
    summary AS (SELECT d.sexe, d.an, d.ag10, d.target AS origin, d.n, s.m, s.sd, d.n_ref, r.m AS m_ref, r.sd AS sd_ref, d.w
      FROM distances d LEFT JOIN stats s ON d.sexe = s.sexe AND d.an = s.an AND d.ag10 = s.ag10 AND d.target = s.origin
           LEFT JOIN stats r ON d.sexe = r.sexe AND d.an = r.an AND d.ag10 = r.ag10 AND r.origin = '{REF}')"""


@query(
    "w2_by_origin",
    f"WITH {SAMPLE_SQL}, {distance_sql('sample', CELL, 'origin', 'logsal', REF, TARGETS)} "
    f"SELECT {CELLS}, target AS origin, n, n_ref, round(w, 6) AS w FROM distances",
)
def w2_by_origin(spark, folder):
    return rounded(wasserstein(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS))


@query(
    "w1_by_origin",
    f"WITH {SAMPLE_SQL}, {distance_sql('sample', CELL, 'origin', 'logsal', REF, TARGETS, p=1)} "
    f"SELECT {CELLS}, target AS origin, n, n_ref, round(w, 6) AS w FROM distances",
)
def w1_by_origin(spark, folder):
    return rounded(wasserstein(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS, p=1))


FINE = ["sexe", "an", "ag10", "dip", "pcs"]


@query(
    "w2_guarded",
    f"WITH {SAMPLE_SQL}, {distance_sql('sample', FINE, 'origin', 'logsal', REF, TARGETS, least=2)} "
    f"SELECT {', '.join(FINE)}, target AS origin, n, n_ref, round(w, 6) AS w FROM distances",
)
def w2_guarded(spark, folder):
    """Fine cells; fewer than two rows on a side give no distance."""
    return rounded(wasserstein(sample(spark, folder), FINE, "origin", "logsal", REF, TARGETS, min_obs=2))


@query(
    "w2_weighted",
    f"WITH {SAMPLE_SQL}, {distance_sql('sample', CELL, 'origin', 'logsal', REF, TARGETS, weight='wt')} "
    f"SELECT {CELLS}, target AS origin, n, n_ref, round(w, 6) AS w FROM distances",
)
def w2_weighted(spark, folder):
    return rounded(wasserstein(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS, weight="wt"))


@query(
    "w2_two_group",
    f"WITH {SAMPLE_SQL}, {distance_sql('sample', ['an', 'ag10', 'origin'], 'sexe', 'logsal', 'Homme', ['Femme'])} "
    "SELECT an, ag10, origin, target AS sexe, n, n_ref, round(w, 6) AS w FROM distances",
)
def w2_two_group(spark, folder):
    """Women against men inside each origin."""
    return rounded(wasserstein(sample(spark, folder), ["an", "ag10", "origin"], "sexe", "logsal", "Homme", ["Femme"]))


@query(
    "w2_prices",
    f"""WITH priced AS (SELECT l_linestatus AS status, l_returnflag AS flag, ln(l_extendedprice) AS v FROM lineitem WHERE l_extendedprice > 0),
    {distance_sql("priced", ["status"], "flag", "v", "N", ["A", "R"])}
    SELECT status, target AS flag, n, n_ref, round(w, 6) AS w FROM distances""",
)
def w2_prices(spark, folder):
    """The largest table in few cells."""
    items = table(spark, folder, "lineitem").where(F.col("l_extendedprice") > 0)
    priced = items.select(
        F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"), F.log("l_extendedprice").alias("v")
    )
    return rounded(wasserstein(priced, ["status"], "flag", "v", "N", ["A", "R"]))


@query(
    "cell_summary",
    f"WITH {SAMPLE_SQL}, {SUMMARY_SQL} SELECT {CELLS}, origin, n, round(m, 6) AS m, round(sd, 6) AS sd, n_ref, "
    "round(m_ref, 6) AS m_ref, round(sd_ref, 6) AS sd_ref, round(w, 6) AS w FROM summary",
)
def cells_summary(spark, folder):
    return rounded(cell_summary(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS))


@query(
    "translation_dispersion",
    f"""WITH {SAMPLE_SQL}, {SUMMARY_SQL}, parts AS (SELECT *, pow(m_ref - m, 2) AS t, pow(sd_ref - sd, 2) AS d FROM summary)
    SELECT {CELLS}, origin, composante, round(CASE composante WHEN 'part_translation' THEN t ELSE d END / (t + d), 6) AS valeur
    FROM parts, (VALUES ('part_translation'), ('part_dispersion')) AS c(composante)""",
)
def split_parts(spark, folder):
    parts = translation_dispersion(cell_summary(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS))
    shares = parts.select(*CELL, "origin", "part_translation", "part_dispersion")
    return rounded(to_long(shares, [*CELL, "origin"], "composante", "valeur"))


def curve_sql(source: str, cell: list[str], group: str, value: str, target: str, ref: str, starts: str, width: int, least: int = 10) -> str:
    keys = ", ".join(cell)
    same = " AND ".join(f"a.{k} = b.{k}" for k in cell)
    lo = " AND ".join(f"lo.{k} = h.{k}" for k in cell)
    hi = " AND ".join(f"hi.{k} = h.{k}" for k in cell)
    return f"""
    ord AS (SELECT {keys}, {group} AS g, {value} AS v, row_number() OVER (PARTITION BY {keys}, {group} ORDER BY {value}) AS k
            FROM {source} WHERE {group} IN ('{target}', '{ref}') AND {value} IS NOT NULL),
    sizes AS (SELECT {keys}, g, count(*) AS n FROM ord GROUP BY ALL),
    grid AS (SELECT q AS quantile, i, least(q / 100.0::DOUBLE + i * ((q + {width}) / 100.0::DOUBLE - q / 100.0::DOUBLE) / 249, 1.0) AS p
             FROM {starts}, (SELECT unnest(range(250)) AS i)),
    h AS (SELECT sizes.*, quantile, i, (n - 1) * p AS h FROM sizes, grid),
    qs AS (SELECT h.*, lo.v + (h.h - floor(h.h)) * (coalesce(hi.v, lo.v) - lo.v) AS qv FROM h
           JOIN ord lo ON {lo} AND lo.g = h.g AND lo.k = floor(h.h) + 1
           LEFT JOIN ord hi ON {hi} AND hi.g = h.g AND hi.k = floor(h.h) + 2),
    keyed AS (SELECT DISTINCT {keys}, quantile FROM h),
    curve AS (SELECT {", ".join("k." + c for c in cell)}, k.quantile,
                CASE WHEN min(a.n) >= {least} AND min(b.n) >= {least} THEN sqrt(avg(pow(a.qv - b.qv, 2))) END AS w
              FROM keyed k LEFT JOIN (SELECT * FROM qs WHERE g = '{target}') a ON {" AND ".join(f"a.{c} = k.{c}" for c in cell)} AND a.quantile = k.quantile
              LEFT JOIN (SELECT * FROM qs WHERE g = '{ref}') b ON {same} AND a.quantile = b.quantile AND a.i = b.i
              GROUP BY {", ".join("k." + c for c in cell)}, k.quantile)"""


@query(
    "tail_w2",
    f"""WITH {curve_sql("events", ["dow"], "event_type", "value", "purchase", "click", "(VALUES (90)) AS s(q)", 10).replace("FROM events", "FROM (SELECT (event_id % 3)::INTEGER AS dow, * FROM events)")}
    SELECT dow, quantile::INTEGER AS quantile, round(w, 6) AS w FROM curve""",
)
def tail_w2(spark, folder):
    """Top tenth of a heavy-tailed sample."""
    events = table(spark, folder, "events").withColumn("dow", (F.col("event_id") % 3).cast("int"))
    return rounded(slice_distance(events, ["dow"], "event_type", "value", "click", "purchase", [90], 10))


@query(
    "w2_curve",
    f"""WITH {SAMPLE_SQL}, {curve_sql("sample", CELL, "origin", "logsal", "MACHINERY", REF, "(SELECT unnest(range(0, 100, 5)) AS q)", 5)}
    SELECT {CELLS}, quantile::INTEGER AS quantile, round(w, 6) AS w, (an - ag10) * 10 + 1960 AS gen FROM curve""",
)
def w2_curve(spark, folder):
    """Distance over twenty slices of the distribution."""
    curve = slice_distance(sample(spark, folder), CELL, "origin", "logsal", REF, "MACHINERY", list(range(0, 100, 5)))
    return rounded(curve).withColumn("gen", (F.col("an") - F.col("ag10")) * 10 + 1960)


PROBABILITIES = (0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0)


@query(
    "quantiles_type7",
    f"""WITH {SAMPLE_SQL}, lists AS (SELECT {CELLS}, origin, quantile_cont(logsal, {list(PROBABILITIES)}) AS qs, count(*) AS n FROM sample GROUP BY ALL)
    SELECT {CELLS}, origin, unnest({list(PROBABILITIES)})::DOUBLE AS p, round(unnest(qs), 6) AS q, n FROM lists""",
)
def quantiles_type7(spark, folder):
    probabilities = literal_table(spark, [("p", "double")], [(p,) for p in PROBABILITIES])
    return rounded(quantiles(sample(spark, folder), CELL, "origin", "logsal", probabilities), "p")


@query(
    "ecdf",
    f"WITH {SAMPLE_SQL} SELECT id, {CELLS}, origin, round(logsal, 6) AS logsal, "
    f"round(cume_dist() OVER (PARTITION BY {CELLS}, origin ORDER BY logsal), 6) AS ecdf FROM sample",
)
def ecdf_rows(spark, folder):
    return rounded(ecdf(sample(spark, folder), CELL, "origin", "logsal", carry=["id"]))


@query(
    "ecdf_weighted",
    f"""WITH {SAMPLE_SQL} SELECT id, {CELLS}, origin, round(logsal, 6) AS logsal,
    round((sum(wt) OVER (PARTITION BY {CELLS}, origin ORDER BY logsal))::DOUBLE / sum(wt) OVER (PARTITION BY {CELLS}, origin), 6) AS ecdf FROM sample""",
)
def ecdf_weighted(spark, folder):
    return rounded(ecdf(sample(spark, folder), CELL, "origin", "logsal", weight="wt", carry=["id"]))


DIPLOMA_CELL = [*CELL, "dip"]
MAP_KEEP = [*CELL, "dip", "origin", "id", "logsal"]


@query(
    "quantile_map",
    f"WITH {SAMPLE_SQL}, {mapping_sql('sample', CELL, 'origin', 'logsal', REF, ['id', *CELL, 'origin'])} "
    f"SELECT id, {CELLS}, origin, round(mapped, 6) AS mapped FROM mapped WHERE origin <> '{REF}'",
)
def quantile_map(spark, folder):
    moved = counterfactual(sample(spark, folder), CELL, "origin", "logsal", REF, carry=["id"], name="mapped")
    return rounded(moved.where(F.col("origin") != REF).select("id", *CELL, "origin", "mapped"))


@query(
    "quantile_map_weighted",
    f"""WITH {SAMPLE_SQL},
    own AS (SELECT *, (sum(wt) OVER (PARTITION BY {CELLS}, origin ORDER BY logsal))::DOUBLE / sum(wt) OVER (PARTITION BY {CELLS}, origin) AS share,
                   min(logsal) OVER (PARTITION BY {CELLS}, origin) AS lowest FROM sample),
    asks AS (SELECT id, {CELLS}, origin, least(greatest(CASE WHEN logsal = lowest THEN share / 2 ELSE share END, 0.001), 0.999) AS p
             FROM own WHERE origin <> '{REF}'),
    knots AS (SELECT DISTINCT {CELLS}, logsal AS x, share AS e FROM own WHERE origin = '{REF}'),
    steps AS (SELECT *, lag(x) OVER (PARTITION BY {CELLS} ORDER BY x) AS x0, coalesce(lag(e) OVER (PARTITION BY {CELLS} ORDER BY x), 0) AS e0 FROM knots)
    SELECT id, a.sexe, a.an, a.ag10, origin, round(coalesce(x0, x) + (p - e0) / (e - e0) * (x - coalesce(x0, x)), 6) AS mapped
    FROM asks a JOIN steps s ON a.sexe = s.sexe AND a.an = s.an AND a.ag10 = s.ag10 AND a.p > s.e0 AND a.p <= s.e""",
)
def quantile_map_weighted(spark, folder):
    moved = counterfactual(sample(spark, folder), CELL, "origin", "logsal", REF, carry=["id"], weight="wt", name="mapped")
    return rounded(moved.where(F.col("origin") != REF).select("id", *CELL, "origin", "mapped"))


MAPPED_SQL = f"{SAMPLE_SQL}, {mapping_sql('sample', DIPLOMA_CELL, 'origin', 'logsal', 'MACHINERY', MAP_KEEP)}"


@query("counterfactual", f"WITH {MAPPED_SQL} SELECT id, {CELLS}, dip, origin, round(mapped, 6) AS counterfactual FROM mapped")
def counterfactual_rows(spark, folder):
    """Every origin on the wages of one origin with the same diploma."""
    moved = counterfactual(sample(spark, folder), DIPLOMA_CELL, "origin", "logsal", "MACHINERY", carry=["id"])
    return rounded(moved.select("id", *DIPLOMA_CELL, "origin", "counterfactual"))


@query(
    "counterfactual_missing_ref",
    f"""WITH {SAMPLE_SQL}, thinned AS (SELECT * FROM sample WHERE NOT (dip = 3 AND origin = 'MACHINERY')),
    {mapping_sql("thinned", DIPLOMA_CELL, "origin", "logsal", "MACHINERY", MAP_KEEP)}
    SELECT id, {CELLS}, dip, origin, round(mapped, 6) AS counterfactual FROM mapped""",
)
def counterfactual_missing_ref(spark, folder):
    """Cells without the reference group keep their own values."""
    thinned = sample(spark, folder).where(~((F.col("dip") == 3) & (F.col("origin") == "MACHINERY")))
    moved = counterfactual(thinned, DIPLOMA_CELL, "origin", "logsal", "MACHINERY", carry=["id"])
    return rounded(moved.select("id", *DIPLOMA_CELL, "origin", "counterfactual"))


@query(
    "counterfactual_w2",
    f"WITH {MAPPED_SQL}, {distance_sql('mapped', CELL, 'origin', 'mapped', REF, TARGETS)} "
    f"SELECT {CELLS}, target AS origin, n, n_ref, round(w, 6) AS w FROM distances",
)
def counterfactual_w2(spark, folder):
    """Mapped inside diploma cells, measured in the coarser cells."""
    rows = sample(spark, folder)
    slicing = plan_slices(rows, "logsal")
    moved = counterfactual(rows, DIPLOMA_CELL, "origin", "logsal", "MACHINERY", slicing=slicing)
    return rounded(
        wasserstein(moved, CELL, "origin", "counterfactual", REF, TARGETS, weight="freq", frequency=True, slicing=slicing)
    )


@query(
    "worktime_counterfactual_w2",
    f"""WITH {SAMPLE_SQL}, {mapping_sql("sample", ["an", "ag10", "origin"], "tp", "logsal", "Temps complet", ["an", "ag10", "origin", "sexe"])},
    {distance_sql("mapped", ["an", "ag10", "origin"], "sexe", "mapped", "Homme", ["Femme"])}
    SELECT an, ag10, origin, target AS sexe, n, n_ref, round(w, 6) AS w FROM distances""",
)
def worktime_counterfactual_w2(spark, folder):
    """Part-time wages moved onto full-time wages, then women against men."""
    cell = ["an", "ag10", "origin"]
    rows = sample(spark, folder)
    slicing = plan_slices(rows, "logsal")
    moved = counterfactual(rows, cell, "tp", "logsal", "Temps complet", split=["sexe"], slicing=slicing)
    return rounded(
        wasserstein(moved, cell, "sexe", "counterfactual", "Homme", ["Femme"], weight="freq", frequency=True, slicing=slicing)
    )


REAL_SQL = distance_sql("sample", CELL, "origin", "logsal", REF, ["MACHINERY"])
OTHER_SQL = distance_sql("mapped", CELL, "origin", "mapped", REF, ["MACHINERY"], suffix="_c")
COMPARED_SQL = f"""{MAPPED_SQL}, {REAL_SQL}, {OTHER_SQL}, compared AS (
    SELECT r.sexe, r.an, r.ag10, r.w AS w_real, c.w AS w_counterfactual, r.w - c.w AS delta, 100 * (r.w * r.w - c.w * c.w) / (r.w * r.w) AS share
    FROM distances r JOIN distances_c c ON r.sexe = c.sexe AND r.an = c.an AND r.ag10 = c.ag10)"""


def compared_cases(spark, folder):
    rows = sample(spark, folder)
    # Mapped values lie among the original ones, so one division of the value axis serves both measurements.
    slicing = plan_slices(rows, "logsal")
    real = wasserstein(rows, CELL, "origin", "logsal", REF, ["MACHINERY"], slicing=slicing)
    moved = counterfactual(rows, DIPLOMA_CELL, "origin", "logsal", "MACHINERY", slicing=slicing)
    other = wasserstein(
        moved, CELL, "origin", "counterfactual", REF, ["MACHINERY"], weight="freq", frequency=True, slicing=slicing
    )
    return compare_cases(real, other, CELL)


@query(
    "rendement_share",
    f"""WITH {COMPARED_SQL} SELECT sexe, an, ag10, round(w_real, 6) AS w_real, round(w_counterfactual, 6) AS w_counterfactual,
    round(delta, 6) AS delta, round(share, 5) AS share FROM compared""",
)
def rendement_share(spark, folder):
    """Part of the distance explained by unequal wages within diplomas."""
    return rounded(compared_cases(spark, folder), "share").withColumn("share", F.round("share", 5))


@query(
    "share_tiles",
    f"""WITH {COMPARED_SQL} SELECT sexe, an, ag10, printf('%.2f', round(delta, 2)) AS indice, printf('%.1f', round(share, 1)) || '%' AS part FROM compared""",
)
def share_tiles_table(spark, folder):
    """The table behind a tile chart of two cases."""
    return share_tiles(compared_cases(spark, folder), CELL)


COMPOSITION_SQL = """counts AS (SELECT gen, origin, count(*) AS n FROM sample WHERE gen IS NOT NULL AND origin IS NOT NULL GROUP BY ALL),
    shares AS (SELECT *, 100 * n::DOUBLE / sum(n) OVER (PARTITION BY gen) AS perc FROM counts),
    composition AS (SELECT gen, origin, perc, max(CASE WHEN gen = 1940 THEN perc END) OVER (PARTITION BY origin) / perc AS w_origin FROM shares)"""


@query(
    "origin_reweight",
    f"WITH {SAMPLE_SQL}, {COMPOSITION_SQL} SELECT gen, origin, round(perc, 6) AS perc, round(w_origin, 6) AS w_origin FROM composition",
)
def origin_reweight(spark, folder):
    return rounded(composition_weights(sample(spark, folder), "gen", "origin", 1940))


@query(
    "w2_composition_weighted",
    f"""WITH {SAMPLE_SQL}, {COMPOSITION_SQL}, weighted AS (SELECT s.*, w_origin FROM sample s LEFT JOIN composition USING (gen, origin)),
    {distance_sql("weighted", ["sexe", "gen"], "pcs", "logsal", "EUROPE", ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"], weight="w_origin")}
    SELECT sexe, gen, target AS pcs, n, n_ref, round(w, 6) AS w FROM distances""",
)
def w2_composition_weighted(spark, folder):
    """Real-valued weights that give all cohorts the origin composition of the first."""
    rows = sample(spark, folder)
    weights = composition_weights(rows, "gen", "origin", 1940).drop("perc")
    weighted = rows.join(weights, ["gen", "origin"], "left")
    return rounded(wasserstein(weighted, ["sexe", "gen"], "pcs", "logsal", "EUROPE", ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"], weight="w_origin"))


@query(
    "finite_w2",
    f"""WITH {PEOPLE_SQL}, logs AS (SELECT *, CASE WHEN id % 13 <> 0 THEN ln(sal) END AS v FROM people),
    {distance_sql("logs", ["annee"], "origin", "v", REF, TARGETS, least=2)}
    SELECT annee, target AS origin, n, n_ref, round(w, 6) AS w FROM distances""",
)
def finite_w2(spark, folder):
    """Zero wages have no finite logarithm and stay out."""
    wage = F.when(F.col("id") % 13 != 0, F.col("sal")).otherwise(F.lit(0.0))
    rows = people(spark, folder).withColumn("v", F.log(wage)).where(is_finite("v"))
    return rounded(wasserstein(rows, ["annee"], "origin", "v", REF, TARGETS, min_obs=2))


@query(
    "group_moments",
    f"WITH {SAMPLE_SQL} SELECT {CELLS}, origin, round(avg(logsal), 6) AS m, round(stddev_samp(logsal), 6) AS sd, count(logsal) AS n "
    "FROM sample GROUP BY ALL",
)
def group_moments(spark, folder):
    return rounded(group_stats(sample(spark, folder), CELL, "origin", "logsal"))
