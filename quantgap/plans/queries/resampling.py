"""Bootstrap replicates, percentile intervals and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgap.operators.distance import wasserstein
from quantgap.operators.draws import MARGIN, TABLE_RATE, replicate_draws, replicate_frame
from quantgap.operators.resample import (
    bootstrap_cases,
    bootstrap_wasserstein,
    draw_slices,
    interval_constants,
    percentile_interval,
    poisson_replicates,
    poisson_thresholds,
    with_interval,
)
from quantgap.operators.samples import plan_slices
from quantgap.operators.transport import counterfactual
from quantgap.plans.queries.base import CELL, REF, SAMPLE_SQL, TARGETS, distance_sql, mapping_sql, query, rounded, sample, sql_list
from quantgap.plans.queries.distances import DIPLOMA_CELL, MAP_KEEP
from quantgap.plans.report import chart_tiles

CELLS = ", ".join(CELL)
REPLICATES = 100
SEED = 42


def draws_sql(source: str, replicates: int = REPLICATES) -> str:
    """CTE ``drawn``: every row with its Poisson(1) count in each replicate."""
    digits = "substr(md5(concat_ws('|', '%d', rep // 4, id)), (1 + 8 * (rep %% 4))::INTEGER, 8)" % SEED
    count = " + ".join(f"(hx >= '{cut}')::INTEGER" for cut in poisson_thresholds())
    return f"""reps AS (SELECT unnest(range({replicates}))::INTEGER AS rep),
    hashed AS (SELECT s.*, rep, {digits} AS hx FROM {source} s, reps),
    drawn AS (SELECT * FROM (SELECT *, {count} AS draw FROM hashed) WHERE draw > 0)"""


def histogram_draws_sql(source: str, cell: list[str], group: str, value: str, groups: list[str] | None = None, replicates: int = REPLICATES, exact: bool = False, suffix: str = "") -> str:
    """CTE ``drawn(cell…, group, value, rep, draw)``: draws of the values of each cell's histogram; CTE names take the suffix."""
    keys, x = ", ".join(cell), suffix
    hashed = "('0x' || substr(md5(concat_ws('|', '%d', rep // 4, id)), (1 + 8 * (rep %% 4))::INTEGER, 8))::BIGINT" % SEED
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in cell) or "true"
    some = "" if exact or groups is None else f"AND {group} IN ({sql_list(groups)})"
    present = " AND ".join(f"{v} IS NOT NULL" for v in value.split(", "))
    rate = f"c * greatest(0.0::DOUBLE, 1 - {MARGIN}::DOUBLE / sqrt(size::DOUBLE))" if exact else "c::DOUBLE"
    expanded = "floor(rate + sqrt(rate) * z + (z * z - 1) / 6 + (z - pow(z, 3)) / (72 * sqrt(rate)) + 0.5)"
    normal = f"sqrt(-2 * ln(((u >> 16) + 0.5) / 65536)) * cos(2 * pi() * (u & 65535) / 65536)"
    parts = f"""reps{x} AS (SELECT unnest(range({replicates}))::INTEGER AS rep),
    values0{x} AS (SELECT {keys}, {group}, {value}, count(*) AS c, min(id) AS id FROM {source} WHERE {present} AND {group} IS NOT NULL {some} GROUP BY ALL),
    celled{x} AS (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS size FROM values0{x}),
    rated{x} AS MATERIALIZED (SELECT *, {rate} AS rate FROM celled{x}),
    terms{x} AS (SELECT rate, unnest(range(floor(rate + 12 * sqrt(rate))::BIGINT + 12)) AS k FROM (SELECT DISTINCT rate FROM rated{x} WHERE rate > 0 AND rate <= {TABLE_RATE})),
    sums{x} AS (SELECT rate, k, floor(sum(exp(-rate + k * ln(rate) - lgamma(k + 1.0))) OVER (PARTITION BY rate ORDER BY k) * 4294967296)::BIGINT AS cut FROM terms{x}),
    cuts{x} AS (SELECT rate, list(cut ORDER BY k) AS cuts FROM sums{x} WHERE cut < 4294967295 GROUP BY rate),
    bits{x} AS (SELECT h.*, rep, {hashed} AS u FROM rated{x} h, reps{x}),
    poisson{x} AS (SELECT * EXCLUDE (z, cuts), CASE WHEN rate <= {TABLE_RATE} THEN len(list_filter(coalesce(cuts, []), lambda q: q <= u)) ELSE greatest({expanded}, 0)::BIGINT END AS draw
      FROM (SELECT *, {normal} AS z FROM bits{x}) LEFT JOIN cuts{x} USING (rate))"""
    if not exact:
        return f"""{parts}, drawn{x} AS (SELECT {keys}, {group}, {value}, rep, draw FROM poisson{x} WHERE draw > 0)"""
    number = f"floor(('0x' || substr(md5(concat_ws('|', 'fill', '{SEED}', rep, {keys}, j)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * size)::BIGINT"
    return f"""{parts},
    poissons{x} AS MATERIALIZED (SELECT * FROM poisson{x}),
    holes{x} AS (SELECT {keys}, rep, any_value(size) AS size, (any_value(size) - sum(draw))::BIGINT AS missing FROM poissons{x} GROUP BY {keys}, rep),
    fills{x} AS (SELECT {keys}, rep, {number} AS number FROM (SELECT *, unnest(range(missing)) AS j FROM holes{x})),
    ends{x} AS (SELECT *, sum(c) OVER (PARTITION BY {keys} ORDER BY {group}, {value}) AS e FROM rated{x}),
    joined{x} AS (SELECT {keys}, {group}, {value}, rep, draw FROM poissons{x} WHERE draw > 0
      UNION ALL SELECT {", ".join("e." + c for c in cell)}, e.{group}, e.{value}, rep, 1 FROM fills{x} f JOIN ends{x} e ON {same("f", "e")} AND number >= e.e - e.c AND number < e.e),
    drawn{x} AS (SELECT {keys}, {group}, {value}, rep, sum(draw)::BIGINT AS draw FROM joined{x} GROUP BY ALL)"""


def boot_sql(cell: list[str], group: str, ref: str, targets: list[str], exact: bool = False) -> str:
    """CTE ``distances`` of every replicate."""
    drawn = histogram_draws_sql("sample", cell, group, "logsal", [*targets, ref], exact=exact)
    return f"{SAMPLE_SQL}, {drawn}, {distance_sql('drawn', [*cell, 'rep'], group, 'logsal', ref, targets, weight='draw', least=2, frequency=True)}"


BOOT_SQL = boot_sql(CELL, "origin", REF, TARGETS)


@query("bootstrap_draws", f"WITH {SAMPLE_SQL}, {draws_sql('sample', 8)} SELECT id, rep, draw FROM drawn")
def bootstrap_draws(spark, folder):
    return poisson_replicates(sample(spark, folder).select("id"), "id", 8, SEED)


@query("bootstrap_w2", f"WITH {BOOT_SQL} SELECT {CELLS}, rep, target AS origin, round(w, 6) AS w FROM distances")
def bootstrap_w2(spark, folder):
    """The distance on every replicate of every cell."""
    return rounded(bootstrap_wasserstein(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS, "id", REPLICATES, SEED))


CONSTANTS_SQL = "consts(reps, k1, s1, k2, s2) AS (VALUES " + ", ".join(str(r) for r in interval_constants(REPLICATES)) + ")"
INTERVAL_SQL = f"""{CONSTANTS_SQL}, lists AS (SELECT {CELLS}, target, list_sort(list(w) FILTER (w IS NOT NULL)) AS t, count(w)::INTEGER AS reps FROM distances GROUP BY ALL),
    intervals AS (SELECT {CELLS}, target, reps, t[k1] + s1 * (coalesce(t[k1 + 1], t[k1]) - t[k1]) AS lo, t[k2] + s2 * (coalesce(t[k2 + 1], t[k2]) - t[k2]) AS hi
      FROM lists LEFT JOIN consts USING (reps))"""


@query("bootstrap_ci", f"WITH {BOOT_SQL}, {INTERVAL_SQL} SELECT {CELLS}, target AS origin, reps, round(lo, 6) AS lo, round(hi, 6) AS hi FROM intervals")
def bootstrap_ci(spark, folder):
    replicates = bootstrap_wasserstein(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS, "id", REPLICATES, SEED)
    return rounded(percentile_interval(replicates, [*CELL, "origin"], total=REPLICATES))


SPARSE = [*CELL, "dip", "pcs", "tp"]


@query(
    "bootstrap_ci_sparse",
    f"""WITH {boot_sql(SPARSE, "origin", REF, TARGETS)},
    {INTERVAL_SQL.replace(CELLS, ", ".join(SPARSE))}
    SELECT {", ".join(SPARSE)}, target AS origin, reps, round(lo, 6) AS lo, round(hi, 6) AS hi FROM intervals""",
)
def bootstrap_ci_sparse(spark, folder):
    """Many small cells: replicates without enough rows are missing, too few usable ones give no interval."""
    replicates = bootstrap_wasserstein(sample(spark, folder), SPARSE, "origin", "logsal", REF, TARGETS, "id", REPLICATES, SEED)
    return rounded(percentile_interval(replicates, [*SPARSE, "origin"], total=REPLICATES))


def interval_query(name: str, cell: list[str], group: str, ref: str, targets: list[str]) -> None:
    """Register the intervals of all distances between groups of ``group``, on replicates of whole cells."""
    keys = ", ".join(cell)

    @query(
        name,
        f"""WITH {boot_sql(cell, group, ref, targets)},
        {INTERVAL_SQL.replace(CELLS, keys)}
        SELECT {keys}, target AS {group}, reps, round(lo, 6) AS lo, round(hi, 6) AS hi FROM intervals""",
    )
    def intervals(spark, folder):
        replicates = bootstrap_wasserstein(sample(spark, folder), cell, group, "logsal", ref, targets, "id", REPLICATES, SEED)
        return rounded(percentile_interval(replicates, [*cell, group]))


interval_query("bootstrap_ci_sex", ["an", "ag10", "origin"], "sexe", "Homme", ["Femme"])
interval_query("bootstrap_ci_diploma", ["sexe", "an", "ag10"], "dip", "5", ["1", "2", "3", "4"])


@query(
    "bootstrap_multinomial",
    f"""WITH {SAMPLE_SQL}, {histogram_draws_sql("sample", CELL, "origin", "logsal", [*TARGETS, REF], exact=True)}
    SELECT {CELLS}, rep, count(*) AS valeurs, sum(draw)::BIGINT AS tirages, round(sum(draw * logsal) / sum(draw), 6) AS m FROM drawn GROUP BY ALL""",
)
def bootstrap_multinomial(spark, folder):
    """Replicates with exactly as many draws as the cell has rows."""
    rows = sample(spark, folder)
    frame = replicate_frame(rows, CELL, "origin", "logsal", "id", REPLICATES, SEED, "multinomial", plan_slices(rows, "logsal", draw_slices(REPLICATES)))
    drawn = replicate_draws(frame, CELL, "origin", "logsal", REPLICATES)
    mean = F.sum(F.col("draw") * F.col("logsal")) / F.sum("draw")
    return rounded(drawn.groupBy(*CELL, "rep").agg(F.count(F.lit(1)).alias("valeurs"), F.sum("draw").alias("tirages"), mean.alias("m")))


@query(
    "bootstrap_multinomial_w2",
    f"""WITH {boot_sql(CELL, "origin", REF, TARGETS, exact=True)} SELECT {CELLS}, rep, target AS origin, round(w, 6) AS w FROM distances""",
)
def bootstrap_multinomial_w2(spark, folder):
    """Distances on exact multinomial replicates."""
    return rounded(
        bootstrap_wasserstein(sample(spark, folder), CELL, "origin", "logsal", REF, TARGETS, "id", REPLICATES, SEED, method="multinomial")
    )


MAPPED_SQL = f"{SAMPLE_SQL}, {mapping_sql('sample', DIPLOMA_CELL, 'origin', 'logsal', 'MACHINERY', MAP_KEEP)}"
PAIRS_SQL = f"""{MAPPED_SQL}, {histogram_draws_sql("mapped", CELL, "origin", "logsal, mapped", [*TARGETS, REF])},
    cases AS (SELECT {CELLS}, origin, rep, draw, 'real' AS cas, logsal AS v FROM drawn UNION ALL SELECT {CELLS}, origin, rep, draw, 'counterfactual', mapped FROM drawn),
    {distance_sql("cases", [*CELL, "cas", "rep"], "origin", "v", REF, TARGETS, weight="draw", least=2, frequency=True)}"""


@query(
    "bootstrap_ci_counterfactual",
    f"""WITH {PAIRS_SQL}, {INTERVAL_SQL.replace(CELLS, CELLS + ", cas")}
    SELECT {CELLS}, cas, target AS origin, reps, round(lo, 6) AS lo, round(hi, 6) AS hi FROM intervals""",
)
def bootstrap_ci_counterfactual(spark, folder):
    """Intervals of the distances before and after the mapping inside diploma cells, on the same replicates."""
    moved = counterfactual(sample(spark, folder), DIPLOMA_CELL, "origin", "logsal", "MACHINERY", unit="id")
    replicates = bootstrap_cases(moved, CELL, "origin", {"real": "logsal", "counterfactual": "counterfactual"}, REF, TARGETS, "id", REPLICATES, SEED, count="freq")
    return rounded(percentile_interval(replicates, [*CELL, "cas", "origin"], total=REPLICATES))


POINT_SQL = distance_sql("sample", CELL, "origin", "logsal", REF, TARGETS, suffix="_p")
TILE_SQL = f"{BOOT_SQL}, {INTERVAL_SQL}, {POINT_SQL}"


@query(
    "estimate_interval_join",
    f"""WITH {TILE_SQL} SELECT p.sexe, p.an, p.ag10, p.target AS origin, p.n, p.n_ref, round(p.w, 6) AS w, reps, round(lo, 6) AS lo, round(hi, 6) AS hi
    FROM distances_p p LEFT JOIN intervals i ON p.sexe = i.sexe AND p.an = i.an AND p.ag10 = i.ag10 AND p.target = i.target""",
)
def estimate_interval_join(spark, folder):
    rows = sample(spark, folder)
    slicing = plan_slices(rows, "logsal")
    point = wasserstein(rows, CELL, "origin", "logsal", REF, TARGETS, slicing=slicing)
    replicates = bootstrap_wasserstein(rows, CELL, "origin", "logsal", REF, TARGETS, "id", REPLICATES, SEED)
    return rounded(with_interval(point, percentile_interval(replicates, [*CELL, "origin"], total=REPLICATES), [*CELL, "origin"]))


@query(
    "chart_tiles",
    f"""WITH {TILE_SQL} SELECT p.sexe, p.an, p.ag10, p.target AS origin, printf('%.2f', round(round(p.w, 6), 2)) AS indice,
      '[' || printf('%.3f', round(round(lo, 6), 3)) || ', ' || printf('%.3f', round(round(hi, 6), 3)) || ']' AS intervalle
    FROM distances_p p LEFT JOIN intervals i ON p.sexe = i.sexe AND p.an = i.an AND p.ag10 = i.ag10 AND p.target = i.target""",
)
def tiles(spark, folder):
    """The table behind a tile chart: index and interval as text, cut from values of six digits."""
    return chart_tiles(estimate_interval_join(spark, folder), [*CELL, "origin"])


