"""Cell statistics, shares, joins of cell tables, reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgap.functions.bands import AGE_BY_FIVE
from quantgap.functions.scalar import across, indicators, is_finite, known_in
from quantgap.operators import cells
from quantgap.operators.joins import deflate, join_null_safe, join_suffixed
from quantgap.operators.reshape import (
    columns_at,
    columns_between,
    columns_starting,
    explode_pair,
    relocate,
    rename_all,
    split_measure,
    tagged_union,
    to_long,
    to_wide,
    union_all,
)
from quantgap.operators.samples import row_id
from quantgap.plans.queries.base import (
    CELL,
    PEOPLE_SQL,
    PERIODS,
    PRICES_SQL,
    REF,
    SAMPLE_SQL,
    TARGETS,
    people,
    price_index,
    query,
    rounded,
    sample,
    sql_list,
    table,
)
from quantgap.plans.report import mean_tiles

CELLS = ", ".join(CELL)


@query(
    "deflate_join",
    f"""WITH {PRICES_SQL}, {PEOPLE_SQL} SELECT id, annee, CASE WHEN annee <> 2000 THEN ipc END AS ipc,
    CASE WHEN annee <> 2000 THEN round(sal * ipc / 100, 6) END AS real FROM people LEFT JOIN prices USING (annee)""",
)
def deflate_join(spark, folder):
    """One year is missing from the index on purpose."""
    rows = deflate(people(spark, folder), price_index(spark, drop=2000))
    return rounded(rows.select("id", "annee", "ipc", (F.col("sal") * F.col("ipc") / 100).alias("real")))


@query(
    "cell_mean_sd",
    f"WITH {SAMPLE_SQL} SELECT {CELLS}, pcs, round(avg(logsal), 6) AS mean_logsal, round(stddev_samp(logsal), 6) AS sd_logsal FROM sample GROUP BY ALL",
)
def cell_mean_sd(spark, folder):
    return rounded(cells.mean_sd(sample(spark, folder), [*CELL, "pcs"], "logsal"))


@query(
    "cell_mean_count",
    f"WITH {SAMPLE_SQL} SELECT {CELLS}, origin, round(avg(logsal), 6) AS logsal, min(gen)::INTEGER AS gen, count(*) AS n FROM sample GROUP BY ALL",
)
def cell_mean_count(spark, folder):
    return rounded(cells.mean_count(sample(spark, folder), [*CELL, "origin"], "logsal", "gen"))


@query(
    "topbracket_geomean",
    f"""WITH {SAMPLE_SQL} SELECT round(exp(avg(ln(real))), 4) AS top_wage, round(avg(ipc), 6) AS mean_index
    FROM sample WHERE annee BETWEEN 1996 AND 1999 AND sal > 300000""",
)
def topbracket_geomean(spark, folder):
    rows = sample(spark, folder).where(F.col("annee").between(1996, 1999) & (F.col("sal") > 300000))
    found = rows.agg(cells.geometric_mean("real").alias("top_wage"), F.avg("ipc").alias("mean_index"))
    return found.select(F.round("top_wage", 4).alias("top_wage"), F.round("mean_index", 6).alias("mean_index"))


@query("group_count", f"WITH {SAMPLE_SQL} SELECT gen, origin, count(*) AS n FROM sample GROUP BY ALL")
def group_count(spark, folder):
    return sample(spark, folder).groupBy("gen", "origin").agg(F.count(F.lit(1)).alias("n"))


@query("missing_share", f"WITH {PEOPLE_SQL} SELECT annee, round(avg((sal_gap IS NULL)::INTEGER), 6) AS missing FROM people GROUP BY ALL")
def missing_share(spark, folder):
    return rounded(cells.missing_share(people(spark, folder), ["annee"], "sal_gap"))


SHORT = {REF: "ref", "MACHINERY": "mach", "HOUSEHOLD": "house", "AUTOMOBILE": "auto", "FURNITURE": "furn"}


@query(
    "conditional_stats",
    f"WITH {SAMPLE_SQL} SELECT {CELLS}, "
    + ", ".join(
        f"round(avg(logsal) FILTER (origin = '{g}'), 6) AS m_{s}, round(stddev_samp(logsal) FILTER (origin = '{g}'), 6) AS sd_{s}, "
        f"count(*) FILTER (origin = '{g}') AS n_{s}"
        for g, s in SHORT.items()
    )
    + " FROM sample GROUP BY ALL",
)
def conditional_stats(spark, folder):
    return rounded(cells.conditional_stats(sample(spark, folder), CELL, "origin", "logsal", SHORT))


@query(
    "min_group_size",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT {CELLS}, dip, pcs, count(*) FILTER (origin = 'MACHINERY') AS n_first,
    count(*) FILTER (origin = '{REF}') AS n_second FROM sample GROUP BY ALL) SELECT *, least(n_first, n_second) AS n_min FROM c""",
)
def min_group_size(spark, folder):
    return cells.smaller_group(sample(spark, folder), [*CELL, "dip", "pcs"], "origin", "MACHINERY", REF)


@query("distinct_years", f"WITH {PEOPLE_SQL} SELECT DISTINCT annee FROM people")
def distinct_years(spark, folder):
    return people(spark, folder).select("annee").distinct()


@query(
    "collected_names",
    "SELECT r_name AS region, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
)
def collected_names(spark, folder):
    """A list per group of a dictionary table."""
    joined = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = joined.groupBy(F.col("r_name").alias("region")).agg(F.sort_array(F.collect_list("n_name")).alias("names"))
    return lists.withColumn("names", F.array_join("names", ";"))


RATES_SQL = f"""rates AS (SELECT {CELLS},
      count(*) FILTER (origin = '{REF}' AND statut = 'Chômeur')::DOUBLE / nullif(count(*) FILTER (origin = '{REF}'), 0) AS rate_ref,
      count(*) FILTER (origin = 'MACHINERY' AND statut = 'Chômeur')::DOUBLE / nullif(count(*) FILTER (origin = 'MACHINERY'), 0) AS rate_mach
    FROM sample GROUP BY ALL)"""


@query(
    "unemployment_odds",
    f"""WITH {SAMPLE_SQL}, {RATES_SQL} SELECT {CELLS}, round(rate_ref, 6) AS rate_ref, round(rate_mach, 6) AS rate_mach,
    round(rate_ref * (1 - rate_mach) / nullif(rate_mach * (1 - rate_ref), 0), 6) AS odds FROM rates""",
)
def unemployment_odds(spark, folder):
    names = {REF: "ref", "MACHINERY": "mach"}
    rates = cells.conditional_rate(
        sample(spark, folder), CELL, "origin", "statut", "Chômeur", ["En emploi", "Chômeur"], names
    )
    return rounded(cells.rate_odds(rates, "rate_ref", "rate_mach"))


@query(
    "moments",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT *, avg(logsal) OVER (PARTITION BY {CELLS}, dip) AS mu FROM sample)
    SELECT {CELLS}, dip, round(avg(pow(logsal - mu, 3)) / pow(avg(pow(logsal - mu, 2)), 1.5), 6) AS skew,
           round(avg(pow(logsal - mu, 4)) / pow(avg(pow(logsal - mu, 2)), 2), 6) AS kurt FROM c GROUP BY ALL""",
)
def moments(spark, folder):
    return rounded(cells.moments(sample(spark, folder), [*CELL, "dip"], "logsal"))


@query(
    "share_in_group",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT gen, origin, count(*) AS n FROM sample GROUP BY ALL)
    SELECT gen, origin, n, round(100 * n::DOUBLE / sum(n) OVER (PARTITION BY gen), 6) AS perc FROM c""",
)
def share_in_group(spark, folder):
    counts = sample(spark, folder).groupBy("gen", "origin").agg(F.count(F.lit(1)).alias("n"))
    return rounded(cells.share_in_group(counts, ["gen"]))


@query(
    "gap_to_reference",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT {CELLS}, dip, origin, avg(logsal) AS m, stddev_samp(logsal) AS sd, count(logsal) AS n FROM sample GROUP BY ALL)
    SELECT {CELLS}, dip, origin, round(m, 6) AS m, round(sd, 6) AS sd, n,
           round(m - max(CASE WHEN origin = '{REF}' THEN m END) OVER (PARTITION BY {CELLS}, dip), 6) AS delta_m FROM c""",
)
def gap_to_reference(spark, folder):
    stats = cells.group_stats(sample(spark, folder), [*CELL, "dip"], "origin", "logsal")
    return rounded(cells.gap_to_reference(stats, [*CELL, "dip"], "origin", REF, "m", "delta_m"))


@query(
    "reference_self_join",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT an, ag5, sexe, origin, avg(logsal) AS logsal FROM sample GROUP BY ALL)
    SELECT a.an, a.ag5, a.sexe, a.origin, round(a.logsal, 6) AS logsal, round(b.logsal, 6) AS logsal_ref, round(a.logsal - b.logsal, 6) AS diff_logsal
    FROM c a LEFT JOIN c b ON a.an = b.an AND a.ag5 = b.ag5 AND a.sexe = b.sexe AND b.origin = '{REF}' WHERE a.origin <> '{REF}'""",
)
def reference_self_join(spark, folder):
    means = sample(spark, folder).groupBy("an", "ag5", "sexe", "origin").agg(F.avg("logsal").alias("logsal"))
    return rounded(cells.reference_join(means, ["an", "ag5", "sexe"], "origin", REF, "logsal"))


@query(
    "mean_tiles",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT an, ag5, sexe, origin, avg(logsal) AS m FROM sample GROUP BY ALL)
    SELECT a.an, a.ag5, a.sexe, a.origin, round(a.m - b.m, 3) + 0.0 AS diff_logsal
    FROM c a LEFT JOIN c b ON a.an = b.an AND a.ag5 = b.ag5 AND a.sexe = b.sexe AND b.origin = '{REF}' WHERE a.origin <> '{REF}'""",
)
def mean_tiles_table(spark, folder):
    """The table behind a tile chart of mean gaps."""
    means = sample(spark, folder).groupBy("an", "ag5", "sexe", "origin").agg(F.avg("logsal").alias("logsal"))
    return mean_tiles(cells.reference_join(means, ["an", "ag5", "sexe"], "origin", REF, "logsal"), ["an", "ag5", "sexe", "origin"])


@query(
    "suffixed_self_join",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT an, sexe, origin, count(*) AS n FROM sample GROUP BY ALL)
    SELECT a.an, a.sexe, a.origin, a.n, b.n AS n_y FROM c a LEFT JOIN c b ON a.an = b.an AND a.sexe = b.sexe AND b.origin = '{REF}'""",
)
def suffixed_self_join(spark, folder):
    counts = sample(spark, folder).groupBy("an", "sexe", "origin").agg(F.count(F.lit(1)).alias("n"))
    reference = counts.where(F.col("origin") == REF).drop("origin")
    return join_suffixed(counts, reference, ["an", "sexe"], "_y").select("an", "sexe", "origin", "n", "n_y")


@query(
    "mapping_join_back",
    f"""WITH {PEOPLE_SQL}, m AS (SELECT id, sal * 2 AS mapped FROM people WHERE origin = '{REF}')
    SELECT p.id, round(coalesce(mapped, sal), 6) AS final FROM people p LEFT JOIN m USING (id)""",
)
def mapping_join_back(spark, folder):
    """New values for some rows, joined back by row id with the old value as fallback."""
    rows = people(spark, folder)
    mapped = rows.where(F.col("origin") == REF).select("id", (F.col("sal") * 2).alias("mapped"))
    return rounded(rows.join(mapped, "id", "left").select("id", F.coalesce("mapped", "sal").alias("final")))


@query(
    "cell_key_bind",
    f"""WITH {SAMPLE_SQL}, a AS (SELECT {CELLS}, count(*) AS n FROM sample GROUP BY ALL),
    b AS (SELECT {CELLS}, round(avg(real), 6) AS m FROM sample WHERE tp = 'Temps partiel' AND ag <> 41 GROUP BY ALL)
    SELECT a.sexe, a.an, a.ag10, n, m FROM a LEFT JOIN b ON a.sexe = b.sexe AND a.an = b.an AND a.ag10 = b.ag10""",
)
def cell_key_bind(spark, folder):
    """Two result tables beside each other, by cell key and never by position."""
    rows = sample(spark, folder)
    counts = rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    means = rows.where((F.col("tp") == "Temps partiel") & (F.col("ag") != 41)).groupBy(*CELL).agg(F.avg("real").alias("m"))
    return rounded(join_null_safe(counts, means, CELL))


@query(
    "grouped_having",
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS cust, year(o_orderdate)::INTEGER AS annee FROM orders)
    SELECT id, cust FROM o WHERE cust IN (SELECT cust FROM o GROUP BY cust HAVING count(DISTINCT annee) > 1)""",
)
def grouped_having(spark, folder):
    """Rows of customers seen in more than one year."""
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"), F.year("o_orderdate").alias("annee")
    )
    return cells.keep_varied_groups(orders, "cust", "annee").select("id", "cust")


@query(
    "pick_by_key",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT {CELLS}, origin, avg(logsal) AS m FROM sample GROUP BY ALL)
    SELECT {CELLS}, round(max(CASE WHEN origin = 'MACHINERY' THEN m END) - max(CASE WHEN origin = '{REF}' THEN m END), 6) AS delta FROM c GROUP BY ALL""",
)
def pick_by_key(spark, folder):
    stats = cells.group_stats(sample(spark, folder), CELL, "origin", "logsal")
    gap = cells.pick("origin", "MACHINERY", "m") - cells.pick("origin", REF, "m")
    return rounded(stats.groupBy(*CELL).agg(gap.alias("delta")))


BRACKET_SQL = f"""{PEOPLE_SQL}, b AS (SELECT annee, least(floor(sal / 25000), 18)::INTEGER AS bracket FROM people WHERE sal_gap IS NOT NULL),
    n AS (SELECT annee, bracket, count(*) AS n FROM b GROUP BY ALL),
    s AS (SELECT *, 100 * n::DOUBLE / sum(n) OVER (PARTITION BY annee) AS prop FROM n),
    q AS (SELECT *, sum(prop) OVER (PARTITION BY annee ORDER BY bracket) AS cum FROM s),
    percentiles AS (SELECT annee, bracket, n, (cum + lag(cum, 1, 0.0::DOUBLE) OVER (PARTITION BY annee ORDER BY bracket)) / 2 AS centile FROM q)"""


@query("bracket_mid_percentile", f"WITH {BRACKET_SQL} SELECT annee, bracket, n, round(centile, 6) AS centile_moyen FROM percentiles")
def bracket_mid_percentile(spark, folder):
    bracket = F.least(F.floor(F.col("sal") / 25000), F.lit(18)).cast("int")
    rows = people(spark, folder).where(F.col("sal_gap").isNotNull()).withColumn("bracket", bracket).withColumn("ord", bracket)
    return rounded(cells.bracket_mid_percentile(rows, "annee", "bracket", "ord").drop("ord"))


@query(
    "bracket_percentile_join",
    f"""WITH {BRACKET_SQL} SELECT p.id, p.annee, round(centile, 6) AS centile_moyen FROM people p
    LEFT JOIN percentiles c ON p.annee = c.annee AND c.bracket = least(floor(p.sal / 25000), 18) AND p.sal_gap IS NOT NULL""",
)
def bracket_percentile_join(spark, folder):
    """Every row with the mid-percentile of its bracket and year; rows without bracket keep a NULL."""
    bracket = F.when(F.col("sal_gap").isNotNull(), F.least(F.floor(F.col("sal") / 25000), F.lit(18)).cast("int"))
    rows = people(spark, folder).withColumn("bracket", bracket).withColumn("ord", F.col("bracket"))
    found = cells.bracket_mid_percentile(rows, "annee", "bracket", "ord").select("annee", "bracket", "centile_moyen")
    return rounded(rows.join(found, ["annee", "bracket"], "left").select("id", "annee", "centile_moyen"))


@query("row_ids", "SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) AS id FROM orders WHERE o_orderstatus <> 'P'")
def row_ids(spark, folder):
    kept = table(spark, folder, "orders").where(F.col("o_orderstatus") != "P").select(F.col("o_orderkey").alias("key"))
    return row_id(kept, "key")


@query(
    "null_union",
    """SELECT o_orderkey AS id, o_totalprice AS price, NULL AS status FROM orders WHERE year(o_orderdate) < 1998
    UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE year(o_orderdate) >= 1998""",
)
def null_union(spark, folder):
    """Union of two eras with different columns."""
    orders = table(spark, folder, "orders").withColumn("annee", F.year("o_orderdate"))
    early = orders.where("annee < 1998").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"))
    late = orders.where("annee >= 1998").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    return union_all([early, late])


@query(
    "tagged_union",
    f"""WITH {SAMPLE_SQL} SELECT 'réel' AS cas, {CELLS}, round(avg(logsal), 6) AS m FROM sample GROUP BY ALL
    UNION ALL SELECT 'nominal', {CELLS}, round(avg(ln(sal)), 6) FROM sample GROUP BY ALL""",
)
def tagged(spark, folder):
    rows = sample(spark, folder)
    real = rows.groupBy(*CELL).agg(F.avg("logsal").alias("m"))
    nominal = rows.groupBy(*CELL).agg(F.avg(F.log("sal")).alias("m"))
    return rounded(tagged_union({"réel": real, "nominal": nominal}, "cas"))


@query("path_difference", "SELECT DISTINCT c_custkey AS cust FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def path_difference(spark, folder):
    """Keys of one list that are not in another."""
    everyone = table(spark, folder, "customer").select(F.col("c_custkey").alias("cust"))
    seen = table(spark, folder, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_custkey").alias("cust"))
    return everyone.subtract(seen)


@query(
    "renest_cells",
    f"""WITH {SAMPLE_SQL}, fine AS (SELECT *, logsal - avg(logsal) OVER (PARTITION BY {CELLS}, dip) AS centred FROM sample)
    SELECT {CELLS}, round(sqrt(avg(centred * centred)), 6) AS spread, count(*) AS n FROM fine GROUP BY ALL""",
)
def renest_cells(spark, folder):
    """Centred inside fine cells, summarised in coarser ones: only the key list changes."""
    rows = sample(spark, folder)
    fine = rows.groupBy(*CELL, "dip").agg(F.avg("logsal").alias("mu"))
    centred = rows.join(fine, [*CELL, "dip"]).withColumn("centred", F.col("logsal") - F.col("mu"))
    spread = F.sqrt(F.avg(F.col("centred") * F.col("centred"))).alias("spread")
    return rounded(centred.groupBy(*CELL).agg(spread, F.count(F.lit(1)).alias("n")))


@query(
    "unpivot_stats",
    f"""WITH {SAMPLE_SQL}, c AS (SELECT {CELLS}, avg(logsal) FILTER (origin = '{REF}') AS m_ref, avg(logsal) FILTER (origin = 'MACHINERY') AS m_mach,
    stddev_samp(logsal) FILTER (origin = '{REF}') AS sd_ref, stddev_samp(logsal) FILTER (origin = 'MACHINERY') AS sd_mach FROM sample GROUP BY ALL)
    SELECT {CELLS}, measure, grp, round(CASE measure WHEN 'moyenne' THEN CASE grp WHEN 'ref' THEN m_ref ELSE m_mach END
      ELSE CASE grp WHEN 'ref' THEN sd_ref ELSE sd_mach END END, 6) AS valeur
    FROM c, (VALUES ('moyenne'), ('sd')) AS a(measure), (VALUES ('ref'), ('mach')) AS b(grp)""",
)
def unpivot_stats(spark, folder):
    """Wide measure columns into long form, their names parsed into measure and group."""
    wide = cells.conditional_stats(sample(spark, folder), CELL, "origin", "logsal", {REF: "ref", "MACHINERY": "mach"})
    columns = [c for c in wide.columns if c.startswith(("m_", "sd_"))]
    long = to_long(wide.select(*CELL, *columns), CELL, "variable", "valeur")
    return rounded(split_measure(long, "variable", {"m": "moyenne", "s": "sd"}, "grp"))


@query(
    "pivot_stats",
    f"WITH {SAMPLE_SQL} SELECT {CELLS}, "
    + ", ".join(f"round(avg(logsal) FILTER (origin = '{g}'), 6) AS \"{g}\"" for g in [REF, *TARGETS])
    + " FROM sample GROUP BY ALL",
)
def pivot_stats(spark, folder):
    stats = cells.group_stats(sample(spark, folder), CELL, "origin", "logsal")
    return rounded(to_wide(stats, CELL, "origin", "m", [REF, *TARGETS]))


@query(
    "interval_columns",
    f"WITH {SAMPLE_SQL} SELECT {CELLS}, round(min(logsal), 6) AS ci_1, round(max(logsal), 6) AS ci_2 FROM sample GROUP BY ALL",
)
def interval_columns(spark, folder):
    """A two-element result into two numbered columns."""
    ends = sample(spark, folder).groupBy(*CELL).agg(F.array(F.min("logsal"), F.max("logsal")).alias("ci"))
    return rounded(explode_pair(ends, "ci", ("ci_1", "ci_2")))


@query(
    "column_selection",
    f"""WITH {PEOPLE_SQL} SELECT id AS "ID", annee AS "ANNEE", sal AS "SAL", sal_gap AS "SAL_GAP", sexe AS "SEXE", origin AS "ORIGINE",
    round(sal / 12, 6) AS "MENSUEL" FROM people""",
)
def column_selection(spark, folder):
    """Keep, drop, select by range, prefix and position, rename, reorder, upper-case names."""
    rows = people(spark, folder)
    ranged = rows.select(*columns_between(rows, "id", "origin")).drop("cust")
    picked = ranged.select(*columns_at(ranged, 1, 2), *columns_starting(ranged, "sal"), "sexe", "origin")
    renamed = picked.withColumnRenamed("origin", "origine").withColumn("mensuel", F.col("sal") / 12)
    return rounded(rename_all(relocate(renamed, "annee", "id"), str.upper))


@query(
    "across_columns",
    "SELECT l_orderkey AS id, l_linenumber AS line, round(ln(1 + l_quantity), 6) AS log_l_quantity, round(ln(1 + l_extendedprice), 6) AS log_l_extendedprice, "
    "round(ln(1 + l_tax), 6) AS log_l_tax FROM lineitem",
)
def across_columns(spark, folder):
    """One expression over several columns, new names from a template."""
    items = table(spark, folder, "lineitem")
    logs = items.withColumns(across(["l_quantity", "l_extendedprice", "l_tax"], lambda c: F.log(c + 1), "log_{col}"))
    return rounded(logs.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), *columns_starting(logs, "log_")))


@query(
    "filters",
    f"""WITH {PEOPLE_SQL} SELECT id FROM people WHERE ag BETWEEN 35 AND 55 AND sexe <> 'Homme' AND origin NOT LIKE '%MOB%'
    AND pcs IN ('ASIA', 'EUROPE', 'AFRICA') AND sal_gap > 20000 AND NOT regexp_matches(pcs, '^A.*A$')""",
)
def filters(spark, folder):
    """Comparison, closed range, membership and pattern predicates; a NULL comparison drops the row."""
    rows = people(spark, folder)
    kept = rows.where(
        F.col("ag").between(35, 55)
        & (F.col("sexe") != "Homme")
        & ~F.col("origin").rlike("MOB")
        & known_in("pcs", ["ASIA", "EUROPE", "AFRICA"])
        & (F.col("sal_gap") > 20000)
        & ~F.col("pcs").rlike("^A.*A$")
    )
    return kept.select("id")


@query(
    "negated_membership",
    f"WITH {PEOPLE_SQL} SELECT coalesce(sexe, '?') AS sexe, count(*) AS n FROM people WHERE NOT coalesce(sexe IN ('Femme'), false) GROUP BY ALL",
)
def negated_membership(spark, folder):
    """NULL is no member, so it survives the negation."""
    kept = people(spark, folder).where(~known_in("sexe", ["Femme"]))
    return kept.groupBy(F.coalesce("sexe", F.lit("?")).alias("sexe")).agg(F.count(F.lit(1)).alias("n"))


@query("ordinal_filter", f"WITH {PEOPLE_SQL} SELECT id, ag FROM people WHERE ag > 40")
def ordinal_filter(spark, folder):
    """Ordered bands compare by position: at least the band (40,45]."""
    rows = people(spark, folder).where(AGE_BY_FIVE.ordinal("ag") >= AGE_BY_FIVE.level_ordinal("(40,45]"))
    return rows.select("id", "ag")


@query("drop_missing", f"WITH {PEOPLE_SQL} SELECT id, sal_gap, sexe FROM people WHERE sal_gap IS NOT NULL AND sexe IS NOT NULL")
def drop_missing(spark, folder):
    return people(spark, folder).dropna(subset=["sal_gap", "sexe"]).select("id", "sal_gap", "sexe")


@query("finite_rows", "SELECT event_id AS id, round(10 / nullif(floor(value), 0), 6) AS v FROM events WHERE floor(value) <> 0")
def finite_rows(spark, folder):
    """NULL, NaN and infinite values dropped."""
    safe = F.when(F.floor("value") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(10.0), F.floor("value")))
    rows = table(spark, folder, "events").select(F.col("event_id").alias("id"), safe.alias("v"))
    return rounded(rows.where(is_finite("v")))


@query(
    "group_indicators",
    f"""WITH {SAMPLE_SQL} SELECT id, (origin = '{REF}')::INTEGER AS is_ref, (origin = 'MACHINERY')::INTEGER AS is_machinery,
    (origin = '{REF}')::INTEGER * an AS ref_an, (origin = 'MACHINERY')::INTEGER * an AS machinery_an FROM sample""",
)
def group_indicators(spark, folder):
    """0/1 columns and their products with the cohort index."""
    rows = sample(spark, folder).withColumns(indicators("origin", [REF, "MACHINERY"]))
    return rows.select(
        "id",
        F.col(f"is_{REF}").alias("is_ref"),
        F.col("is_MACHINERY").alias("is_machinery"),
        (F.col(f"is_{REF}") * F.col("an")).alias("ref_an"),
        (F.col("is_MACHINERY") * F.col("an")).alias("machinery_an"),
    )


@query(
    "sorted_years",
    f"WITH {PEOPLE_SQL} SELECT annee, min(id) AS first_id, count(*) AS n FROM people GROUP BY ALL ORDER BY annee",
)
def sorted_years(spark, folder):
    """Manifest of the years in order, with the first row of each."""
    return people(spark, folder).groupBy("annee").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n")).orderBy("annee")


@query(
    "year_grid",
    f"""WITH {PEOPLE_SQL}, span AS (SELECT min(annee) AS lo, max(annee) + 2 AS hi FROM people),
    years AS (SELECT unnest(range(lo, hi + 1))::INTEGER AS annee FROM span),
    origins AS (SELECT DISTINCT origin FROM people), n AS (SELECT annee, origin, count(*) AS n FROM people GROUP BY ALL)
    SELECT annee, origin, coalesce(n, 0) AS n FROM years CROSS JOIN origins LEFT JOIN n USING (annee, origin)""",
)
def year_grid(spark, folder):
    """Every origin in every year of a sequence, counts filled with 0."""
    rows = people(spark, folder)
    counts = rows.groupBy("annee", "origin").agg(F.count(F.lit(1)).alias("n"))
    span = counts.agg(F.min("annee").alias("lo"), (F.max("annee") + 2).alias("hi"))
    years = span.select(F.explode(F.sequence("lo", "hi")).alias("annee"))
    grid = years.crossJoin(counts.select("origin").distinct())
    return grid.join(counts, ["annee", "origin"], "left").select("annee", "origin", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    "period_labels",
    f"WITH {SAMPLE_SQL} SELECT CASE an WHEN 1 THEN '95-97' WHEN 2 THEN '98-99' WHEN 3 THEN '00-01' END AS periode, count(*) AS n FROM sample GROUP BY ALL",
)
def period_labels(spark, folder):
    rows = sample(spark, folder).withColumn("periode", PERIODS.label("annee"))
    return rows.groupBy("periode").agg(F.count(F.lit(1)).alias("n"))


@query(
    "origin_set_counts",
    f"WITH {PEOPLE_SQL} SELECT origin, count(*) AS n FROM people WHERE origin IN ({sql_list(TARGETS)}) GROUP BY ALL",
)
def origin_set_counts(spark, folder):
    kept = people(spark, folder).where(F.col("origin").isin(TARGETS))
    return kept.groupBy("origin").agg(F.count(F.lit(1)).alias("n"))
