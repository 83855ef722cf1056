"""Recodes, bands, level tables, bracket imputation and the prepared sample."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantgap.functions import codes
from quantgap.functions.bands import AGE_BY_FIVE, AGE_BY_TEN, BIRTH_BY_FIVE, Bands, decade_cohort
from quantgap.functions.levels import Levels, attach_labels, dummies, observed_levels, order_by_code, relabel
from quantgap.functions.scalar import (
    capture,
    clamp,
    detailed_code,
    digit_class,
    first_match,
    francs_to_euros,
    if_else,
    recode,
    remove,
    row_max,
    row_min,
    safe_log,
    sentence_case,
    slice_text,
    swap_when,
    to_double,
    to_int,
)
from quantgap.operators.joins import deflate
from quantgap.operators.reshape import tagged_union
from quantgap.operators.reweight import balance_nonresponse, missing_rate, stratified_by_rate
from quantgap.plans import harmonise
from quantgap.plans.prepare import Preparation, bracket_bounds, bracket_values, impute_brackets, prepare, top_bracket_mean
from quantgap.plans.queries.base import (
    PEOPLE_SQL,
    PRICE_INDEX,
    PRICES_SQL,
    SAMPLE_SQL,
    people,
    price_index,
    query,
    rounded,
    sample,
    sql_case,
    sql_list,
    sql_text,
    sql_values,
    table,
)
from quantgap.session import literal_table


@query(
    "log_exp_guard",
    """SELECT o_orderkey AS id, round(CASE WHEN x > 0 THEN ln(x) END, 6) AS log_x, round(exp(x / 100000), 6) AS exp_x, round(sqrt(abs(x)), 6) AS root_x,
    round(pow(x / 1000, 2), 4) AS square_x, round(100000 / nullif(x, 0), 6) AS inverse_x
    FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 0.0 ELSE o_totalprice - 100000 END AS x FROM orders)""",
)
def log_exp_guard(spark, folder):
    """Arithmetic and logarithms with zero and negative values."""
    x = F.when(F.col("o_orderkey") % 10 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") - 100000)
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("id"), x.alias("x"))
    return rows.select(
        "id",
        F.round(safe_log("x"), 6).alias("log_x"),
        F.round(F.exp(F.col("x") / 100000), 6).alias("exp_x"),
        F.round(F.sqrt(F.abs("x")), 6).alias("root_x"),
        F.round(F.pow(F.col("x") / 1000, F.lit(2)), 4).alias("square_x"),
        F.round(F.try_divide(F.lit(100000.0), F.col("x")), 6).alias("inverse_x"),
    )


@query(
    "row_extremes",
    """SELECT l_orderkey AS id, l_linenumber AS line, greatest(a, l_tax, l_discount) AS high, least(a, l_tax) AS low,
    CASE WHEN a IS NOT NULL THEN least(greatest(a, 0.02), 0.06) END AS limited
    FROM (SELECT *, CASE WHEN l_quantity > 10 THEN l_discount END AS a FROM lineitem)""",
)
def row_extremes(spark, folder):
    """Row-wise maximum and minimum skip NULL, limits keep it."""
    rows = table(spark, folder, "lineitem").withColumn("a", F.when(F.col("l_quantity") > 10, F.col("l_discount")))
    return rows.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").alias("line"),
        row_max("a", "l_tax", "l_discount").alias("high"),
        row_min("a", "l_tax").alias("low"),
        clamp("a", 0.02, 0.06).alias("limited"),
    )


@query(
    "text_to_number",
    """SELECT o_orderkey AS id, try_cast(t AS INTEGER) AS n, try_cast(replace(d, ',', '.') AS DOUBLE) AS x FROM (SELECT o_orderkey,
    CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'abc' ELSE (o_custkey)::VARCHAR END AS t,
    CASE o_orderkey % 4 WHEN 0 THEN ' ' WHEN 1 THEN 'n.d.' ELSE o_custkey::VARCHAR || ',25' END AS d FROM orders)""",
)
def text_to_number(spark, folder):
    """Blank or malformed text is NULL; decimal commas."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    t = F.when(key % 5 == 0, "").when(key % 5 == 1, "abc").otherwise(cust)
    d = F.when(key % 4 == 0, " ").when(key % 4 == 1, "n.d.").otherwise(F.concat(cust, F.lit(",25")))
    return table(spark, folder, "orders").select(key.alias("id"), to_int(t).alias("n"), to_double(d).alias("x"))


@query(
    "if_else_missing",
    f"""WITH {PEOPLE_SQL} SELECT id, CASE WHEN sal_gap IS NULL THEN NULL WHEN sal_gap > 200000 THEN 'haut' ELSE 'bas' END AS strict,
    CASE WHEN sal_gap IS NULL THEN 'inconnu' WHEN sal_gap > 200000 THEN 'haut' ELSE 'bas' END AS filled, coalesce(sal_gap, -1) AS known FROM people""",
)
def if_else_missing(spark, folder):
    """A NULL condition is neither branch."""
    test = F.col("sal_gap") > 200000
    return people(spark, folder).select(
        "id",
        if_else(test, F.lit("haut"), F.lit("bas")).alias("strict"),
        if_else(test, F.lit("haut"), F.lit("bas"), F.lit("inconnu")).alias("filled"),
        F.coalesce("sal_gap", F.lit(-1.0)).alias("known"),
    )


@query(
    "case_chain",
    """SELECT p_partkey AS id, CASE WHEN a > 40 THEN a WHEN b > 900 THEN b WHEN p_size >= 0 THEN p_size END::INTEGER AS first_of,
    CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'petit' WHEN p_type = 'LARGE' THEN 'grand' ELSE 'autre' END AS taille,
    CASE WHEN p_type IN ('SMALL', 'MEDIUM') THEN 'petit' ELSE p_type END AS kept
    FROM (SELECT *, CASE WHEN p_size % 3 <> 0 THEN p_size END AS a, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice::INTEGER END AS b FROM part)""",
)
def case_chain(spark, folder):
    """First match of chained conditions, NULL conditions fall through; value recodes with and without default."""
    rows = table(spark, folder, "part").withColumns(
        {
            "a": F.when(F.col("p_size") % 3 != 0, F.col("p_size")),
            "b": F.when(F.col("p_partkey") % 2 == 0, F.rint("p_retailprice").cast("int")),
        }
    )
    size = F.col("p_size")
    return rows.select(
        F.col("p_partkey").alias("id"),
        first_match([(F.col("a") > 40, F.col("a")), (F.col("b") > 900, F.col("b")), (size >= 0, size)]).alias("first_of"),
        recode("p_type", {"petit": ["SMALL", "MEDIUM"], "grand": ["LARGE"]}, default="autre").alias("taille"),
        recode("p_type", {"petit": ["SMALL", "MEDIUM"]}, keep_others=True).alias("kept"),
    )


WAGE_BANDS = Bands((1000, 100000, 200000, 300000, float("inf")), include_lowest=False)


@query(
    "cut_bands",
    f"""WITH {PEOPLE_SQL} SELECT id, CASE WHEN ag BETWEEN 32 AND 40 THEN '[32,40]' WHEN ag BETWEEN 41 AND 50 THEN '(40,50]' WHEN ag BETWEEN 51 AND 58 THEN '(50,58]' END AS age,
    CASE WHEN sal_gap > 300000 THEN 4 WHEN sal_gap > 200000 THEN 3 WHEN sal_gap > 100000 THEN 2 WHEN sal_gap > 1000 THEN 1 END AS band FROM people""",
)
def cut_bands(spark, folder):
    """Right-closed bins, first bin closed on request, outside and NULL give NULL."""
    ages = Bands((32, 40, 50, 58))
    return people(spark, folder).select(
        "id", ages.label("ag").alias("age"), WAGE_BANDS.ordinal("sal_gap").alias("band")
    )


@query(
    "cohort_from_bands",
    f"WITH {SAMPLE_SQL} SELECT id, an, ag10, ag5, ((an - ag10) * 10 + 1960)::INTEGER AS gen FROM sample",
)
def cohort_from_bands(spark, folder):
    rows = sample(spark, folder)
    return rows.select("id", "an", "ag10", "ag5", decade_cohort(F.col("an"), F.col("ag10")).alias("gen"))


@query(
    "birth_cohorts",
    f"""WITH {PEOPLE_SQL}, b AS (SELECT id, annee - ag AS born FROM people)
    SELECT id, born AS date_naissance, '(' || (1880 + 5 * (ceil((born - 1880) / 5.0) - 1))::INTEGER || ',' || (1880 + 5 * ceil((born - 1880) / 5.0))::INTEGER || ']' AS gen5 FROM b""",
)
def birth_cohorts(spark, folder):
    rows = people(spark, folder).withColumn("date_naissance", F.col("annee") - F.col("ag"))
    return rows.select("id", "date_naissance", BIRTH_BY_FIVE.label("date_naissance").alias("gen5"))


PRIORITY = Levels(("Urgent", "Haut", "Moyen", "Indéfini"), (1, 2, 3, 4))


@query(
    "factor_labels",
    f"""WITH {PEOPLE_SQL} SELECT id, CASE dip WHEN 1 THEN 'Urgent' WHEN 2 THEN 'Haut' WHEN 3 THEN 'Moyen' WHEN 4 THEN 'Indéfini' END AS label,
    CASE WHEN dip <= 4 THEN dip END AS ord FROM people""",
)
def factor_labels(spark, folder):
    """Code to label with its order; unknown codes are NULL."""
    rows = people(spark, folder).withColumn("label", PRIORITY.label("dip"))
    return rows.select("id", "label", PRIORITY.ordinal("label").alias("ord"))


@query(
    "recode_levels",
    f"""WITH {PEOPLE_SQL} SELECT origin, CASE WHEN origin IN ('AUTOMOBILE', 'MACHINERY') THEN 'Engins' WHEN origin = 'HOUSEHOLD' THEN NULL ELSE origin END AS merged,
    count(*) AS n FROM people GROUP BY ALL""",
)
def recode_levels(spark, folder):
    """Levels renamed, merged and dropped; the others pass."""
    merged = relabel("origin", {"AUTOMOBILE": "Engins", "MACHINERY": "Engins", "HOUSEHOLD": None})
    return people(spark, folder).withColumn("merged", merged).groupBy("origin", "merged").agg(F.count(F.lit(1)).alias("n"))


THIRTEEN = sql_values("levels", ["k", "label"], list(enumerate(codes.DIPLOMA_13.labels)))
TEN = sql_values("ten", ["ord", "diplome10"], [(i + 1, v) for i, v in enumerate(codes.DIPLOMA_10.labels)])


@query(
    "level_collapse",
    f"""WITH {THIRTEEN}, {TEN}, c AS (SELECT label AS diplome13, {sql_case("label", {n: [o for o, m in codes.DIPLOMA_13_TO_10.items() if m == n] for n in dict.fromkeys(codes.DIPLOMA_13_TO_10.values())}, "label")} AS diplome10,
      count(*) AS n FROM orders JOIN levels ON o_orderkey % 13 = k GROUP BY ALL)
    SELECT diplome13, diplome10, ord, n FROM c JOIN ten USING (diplome10)""",
)
def level_collapse(spark, folder):
    """Thirteen levels to ten, with one level moved in the order."""
    names = F.array(*[F.lit(v) for v in codes.DIPLOMA_13.labels])
    rows = table(spark, folder, "orders").select(F.get(names, (F.col("o_orderkey") % 13).cast("int")).alias("diplome13"))
    rows = rows.withColumn("diplome10", harmonise.diploma_10("diplome13"))
    counted = rows.groupBy("diplome13", "diplome10").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("diplome13", "diplome10", codes.DIPLOMA_10.ordinal("diplome10").alias("ord"), "n")


@query(
    "reorder_levels",
    "SELECT label, min(code) AS code, dense_rank() OVER (ORDER BY min(code) DESC)::INTEGER AS ord FROM "
    "(SELECT p_type || ' ' || p_brand AS label, p_size AS code FROM part) GROUP BY label",
)
def reorder_levels(spark, folder):
    """Labels in descending order of their smallest code."""
    part = table(spark, folder, "part")
    return order_by_code(part.select(F.concat_ws(" ", "p_type", "p_brand").alias("label"), F.col("p_size").alias("code")))


@query(
    "observed_levels",
    f"""WITH {PEOPLE_SQL}, kept AS (SELECT * FROM people WHERE dip <> 3) SELECT id, dip, dense_rank() OVER (ORDER BY dip DESC)::INTEGER AS ord FROM kept""",
)
def observed(spark, folder):
    """An ordered factor after a filter: unused level dropped, order reversed."""
    rows = people(spark, folder).where(F.col("dip") != 3)
    return observed_levels(rows, "dip", "ord", descending=True).select("id", "dip", "ord")


@query(
    "text_slices",
    """SELECT c_custkey AS id, substr(c_name, 1, 4) AS head, right(c_name, 3) AS tail, substr(c_name, 2, length(c_name) - 3) AS middle,
    regexp_extract(c_name, '#0*(\\d+)$', 1) AS number, regexp_replace(c_name, '^Customer#', '') AS bare, c_mktsegment || '-' || c_nationkey AS joined FROM customer""",
)
def text_slices(spark, folder):
    """Substrings with negative positions, captures, removals, concatenation."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        slice_text("c_name", 1, 4).alias("head"),
        slice_text("c_name", -3).alias("tail"),
        slice_text("c_name", 2, -3).alias("middle"),
        capture("c_name", r"#0*(\d+)$").alias("number"),
        remove("c_name", "^Customer#").alias("bare"),
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("joined"),
    )


@query(
    "sentence_case",
    "SELECT p_partkey AS id, upper(substr(t, 1, 1)) || lower(substr(t, 2)) AS titre FROM (SELECT p_partkey, 'é' || upper(p_name) || ' ' || p_type AS t FROM part)",
)
def sentence(spark, folder):
    text = F.concat(F.lit("é"), F.upper("p_name"), F.lit(" "), F.col("p_type"))
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), sentence_case(text).alias("titre"))


@query(
    "greatest_code",
    f"""WITH c AS (SELECT o_orderkey AS id, try_cast(g AS INTEGER) AS g, try_cast(t AS INTEGER) AS t, try_cast(h AS INTEGER) AS h FROM (
      SELECT o_orderkey, {sql_case("(o_orderkey % 9)::VARCHAR", codes.GENERAL_1982)} AS g,
             {sql_case("CASE WHEN o_custkey % 10 = 0 THEN '' ELSE (o_custkey % 10)::VARCHAR END", codes.TECHNICAL_1982)} AS t,
             {sql_case("(o_orderkey % 23)::VARCHAR", codes.HIGHER_1982)} AS h FROM orders)),
    d AS (SELECT id, {sql_case("greatest(g, t, h)", codes.DIPLOMA_FROM_1990)} AS diplome FROM c)
    SELECT id, diplome, {sql_case("diplome", codes.DIPLOMA_13_TO_7)}::INTEGER AS diplome7 FROM d""",
)
def greatest_code(spark, folder):
    """Three partial diploma codes of 1982 in the coding of 1990, the largest one labelled, seven levels."""
    cust = F.col("o_custkey") % 10
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderkey") % 9).cast("string").alias("DIEG"),
        F.when(cust == 0, "").otherwise(cust.cast("string")).alias("DIEP"),
        (F.col("o_orderkey") % 23).cast("string").alias("DIES"),
    )
    rows = harmonise.diploma_codes_1982(raw).withColumn("diplome", harmonise.highest_diploma("DIEG", "DIET", "DIES"))
    return rows.select("id", "diplome", harmonise.diploma_7("diplome").alias("diplome7"))


@query(
    "diploma_17_levels",
    f"""WITH c AS (SELECT o_orderkey AS id, (1998 + o_orderkey % 26)::INTEGER AS annee, (11 + o_custkey % 61)::INTEGER AS det,
      (o_orderkey % 7 * 10 + o_orderkey % 5 - 1)::INTEGER AS sup, (o_custkey % 37 - 5)::INTEGER AS tec, (o_custkey % 18)::INTEGER AS gen FROM orders),
    p AS (SELECT *, CASE WHEN sup > 0 THEN sup WHEN tec > 0 THEN tec WHEN gen >= 0 THEN gen END AS part FROM c),
    d AS (SELECT id, annee, CASE WHEN annee > 2012 THEN {sql_case("det", codes.DIPLOMA_FROM_2013)} ELSE {sql_case("part", codes.DIPLOMA_FROM_2003)} END AS diplome17 FROM p)
    SELECT id, diplome17, {sql_case("diplome17", codes.DIPLOMA_17_TO_13, "diplome17")} AS diplome13 FROM d""",
)
def diploma_17_levels(spark, folder):
    """Priority of three codes before 2013, one code after, 17 levels and 13."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, folder, "orders").select(
        key.alias("id"),
        (1998 + key % 26).cast("int").alias("annee"),
        (11 + cust % 61).cast("int").alias("det"),
        harmonise.diploma_priority(
            (key % 7 * 10 + key % 5 - 1).cast("int"), (cust % 37 - 5).cast("int"), (cust % 18).cast("int")
        ).alias("part"),
    )
    rows = rows.withColumn("diplome17", harmonise.diploma_17("annee", "det", "part"))
    return rows.select("id", "diplome17", harmonise.diploma_13("diplome17").alias("diplome13"))


DETAIL = sql_values("detail", ["code", "label"], codes.DIPLOMA_DETAIL.pairs())


@query(
    "diploma_detail",
    f"""WITH {DETAIL}, firsts AS (SELECT label, min(code) AS f FROM detail GROUP BY label),
    ranks AS (SELECT label, dense_rank() OVER (ORDER BY f DESC)::INTEGER AS diplome104_ord FROM firsts)
    SELECT o_orderkey AS id, (100 + o_orderkey % 700)::INTEGER AS code, label AS diplome104, diplome104_ord
    FROM orders LEFT JOIN detail ON code = 100 + o_orderkey % 700 LEFT JOIN ranks USING (label)""",
)
def diploma_detail(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), (100 + F.col("o_orderkey") % 700).cast("int").alias("code")
    )
    return harmonise.diploma_detail(rows, "code", "diplome104")


TITLES = [label for label in codes.OCCUPATION_DETAIL.labels]
TITLE_ROWS = sql_values("titles", ["k", "title"], list(enumerate(TITLES)))
CLASS_SQL = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(t, '{p}') THEN {sql_text(label)}" for p, label in codes.CLASS_PATTERNS)
    + " "
    + " ".join(f"WHEN t IN ({sql_list(names)}) THEN {sql_text(label)}" for label, names in codes.CLASS_TITLES.items())
    + " END"
)


@query(
    "occupation_class",
    f"""WITH {TITLE_ROWS}, t AS (SELECT o_orderkey AS id, upper(substr(title, 1, 1)) || lower(substr(title, 2)) AS raw FROM orders JOIN titles ON o_orderkey % {len(TITLES)} = k),
    u AS (SELECT id, {sql_case("raw", codes.OWN_TITLE_FIXES, "raw")} AS t FROM t)
    SELECT id, t AS titre, {CLASS_SQL} AS classe FROM u""",
)
def occupation_class(spark, folder):
    """Titles in sentence case with corrected spelling, then one of seven classes by ordered rules."""
    names = F.array(*[F.lit(v) for v in TITLES])
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.get(names, (F.col("o_orderkey") % len(TITLES)).cast("int")).alias("raw")
    )
    rows = rows.withColumn("titre", harmonise.occupation_title("raw"))
    return rows.select("id", "titre", harmonise.occupation_class("titre").alias("classe"))


@query(
    "regex_classes",
    """SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, '(r|R)ed') THEN 'rouge' WHEN regexp_matches(p_name, 'ing') THEN 'anneau'
    WHEN regexp_matches(p_type, '(S|s)mall|(P|p)romo|PROMO') THEN 'promo' WHEN p_type IN ('LARGE', 'MEDIUM') THEN 'taille' END AS classe FROM part""",
)
def regex_classes(spark, folder):
    """Ordered pattern rules on part names; the first match wins."""
    name, kind = F.col("p_name"), F.col("p_type")
    classe = first_match(
        [
            (name.rlike("(r|R)ed"), F.lit("rouge")),
            (name.rlike("ing"), F.lit("anneau")),
            (kind.rlike("(S|s)mall|(P|p)romo|PROMO"), F.lit("promo")),
            (kind.isin("LARGE", "MEDIUM"), F.lit("taille")),
        ]
    )
    return table(spark, folder, "part").select(F.col("p_partkey").alias("id"), classe.alias("classe"))


@query(
    "parent_swap",
    """WITH c AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 <> 0 THEN 1 + o_orderkey % 2 END AS s1, CASE WHEN o_orderkey % 11 <> 0 THEN 1 + o_custkey % 2 END AS s2,
      (o_custkey % 90)::INTEGER AS f, (o_orderkey % 90)::INTEGER AS m FROM orders)
    SELECT id, CASE WHEN s1 = 2 AND s2 = 1 THEN m ELSE f END AS "CSPP", CASE WHEN s1 = 2 AND s2 = 1 THEN f ELSE m END AS "CSPM" FROM c""",
)
def parent_swap(spark, folder):
    """Father's and mother's codes exchanged where the sexes are reversed; unknown sexes change nothing."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, folder, "orders").select(
        key.alias("id"),
        F.when(key % 7 != 0, 1 + key % 2).alias("s1"),
        F.when(key % 11 != 0, 1 + cust % 2).alias("s2"),
        (cust % 90).cast("int").alias("CSPP"),
        (key % 90).cast("int").alias("CSPM"),
    )
    return swap_when(rows, (F.col("s1") == 2) & (F.col("s2") == 1), "CSPP", "CSPM").select("id", "CSPP", "CSPM")


@query(
    "digit_class",
    """WITH c AS (SELECT o_orderkey AS id, (o_orderkey % 90)::INTEGER AS code, (o_orderkey % 90)::VARCHAR AS t FROM orders),
    d AS (SELECT *, CASE WHEN substr(t, 1, 1) = '7' THEN substr(t, 2, 1) ELSE substr(t, 1, 1) END AS z FROM c)
    SELECT id, CASE WHEN z <> '0' THEN try_cast(z AS INTEGER) END AS class1, CASE WHEN right(t, 1) <> '0' THEN code END AS code2 FROM d""",
)
def digit_classes(spark, folder):
    code = (F.col("o_orderkey") % 90).cast("int")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), digit_class(code).alias("class1"), detailed_code(code).alias("code2")
    )


@query(
    "era_status",
    f"""WITH c AS (SELECT o_orderkey AS id, (2003 + o_orderkey % 21)::INTEGER AS annee, (o_custkey % 10)::INTEGER AS code FROM orders)
    SELECT id, annee, CASE WHEN annee >= 2021 THEN {sql_case("code", codes.STATUS_FROM_2021)} WHEN annee >= 2013 THEN {sql_case("code", codes.STATUS_FROM_2013)}
      ELSE {sql_case("code", codes.STATUS_FROM_2003)} END::INTEGER AS statut, {sql_case("code", codes.STATUS_FROM_1982)}::INTEGER AS statut82 FROM c""",
)
def era_status(spark, folder):
    """Activity status under four codings."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (2003 + F.col("o_orderkey") % 21).cast("int").alias("annee"),
        (F.col("o_custkey") % 10).cast("int").alias("code"),
    )
    return rows.select(
        "id", "annee", harmonise.activity_status("annee", "code").alias("statut"), harmonise.activity_status_1982("code").alias("statut82")
    )


@query(
    "marital_recode",
    f"""WITH c AS (SELECT o_orderkey AS id, (2003 + o_orderkey % 21)::INTEGER AS annee, (o_custkey % 10)::INTEGER AS code FROM orders)
    SELECT id, CASE WHEN annee < 2021 THEN code ELSE {sql_case("code", codes.MARITAL_FROM_2021)} END::INTEGER AS matri FROM c""",
)
def marital_recode(spark, folder):
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        (2003 + F.col("o_orderkey") % 21).cast("int").alias("annee"),
        (F.col("o_custkey") % 10).cast("int").alias("code"),
    )
    return rows.select("id", harmonise.marital_status("annee", "code").alias("matri"))


@query(
    "dictionary_labels",
    """SELECT c_custkey AS id, n_name AS pays, n_nationkey + 1 AS pays_ord FROM (SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 99 ELSE c_nationkey END AS code FROM customer)
    LEFT JOIN nation ON code = n_nationkey""",
)
def dictionary_labels(spark, folder):
    """Code to label through a dictionary table; unknown codes keep a NULL label."""
    nation = table(spark, folder, "nation")
    dictionary = nation.select(
        F.lit("PAYS").alias("variable"),
        F.col("n_nationkey").alias("code"),
        F.col("n_name").alias("label"),
        (F.col("n_nationkey") + 1).alias("ord"),
    )
    code = F.when(F.col("c_custkey") % 6 == 0, 99).otherwise(F.col("c_nationkey"))
    rows = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), code.alias("code"))
    return attach_labels(rows, "code", dictionary, "pays", "PAYS").drop("code")


LABEL_TABLES = {
    "sexe": codes.SEX,
    "activite": codes.ACTIVITY_1982,
    "profession": codes.OCCUPATION_DETAIL,
    "profession_pere": codes.OCCUPATION_PARENT,
    "menage": codes.HOUSEHOLD,
    "secteur": codes.SECTOR,
    "diplome": codes.DIPLOMA_1982,
    "temps": codes.WORK_TIME,
}


@query(
    "value_labels",
    "SELECT o_orderkey AS id, "
    + ", ".join(
        f"CASE (o_orderkey % {m})::INTEGER " + " ".join(f"WHEN {c} THEN {sql_text(t)}" for c, t in levels.pairs()) + f" END AS {name}"
        for (name, levels), m in zip(LABEL_TABLES.items(), (3, 10, 88, 71, 7, 16, 73, 4))
    )
    + " FROM orders",
)
def value_labels(spark, folder):
    """All raw-code label tables of the early waves."""
    key = F.col("o_orderkey")
    columns = [
        levels.label((key % m).cast("int")).alias(name)
        for (name, levels), m in zip(LABEL_TABLES.items(), (3, 10, 88, 71, 7, 16, 73, 4))
    ]
    return table(spark, folder, "orders").select(key.alias("id"), *columns)


@query(
    "sample_restriction",
    f"""WITH {PEOPLE_SQL} SELECT 'premier' AS regle, id FROM people WHERE id % 6 + 1 = 1 UNION ALL SELECT 'tiers', id FROM people WHERE id % 3 = 2""",
)
def sample_restriction(spark, folder):
    """First interviews only, and one rotation third."""
    rows = people(spark, folder)
    first = rows.where(F.col("id") % 6 + 1 == 1).select("id")
    third = rows.where(F.col("id") % 3 == 2).select("id")
    return tagged_union({"premier": first, "tiers": third}, "regle").select("regle", "id")


@query(
    "real_value",
    f"WITH {PRICES_SQL}, {PEOPLE_SQL} SELECT id, round(sal * 0.152449, 6) AS euros, round(sal * 0.152449 * ipc / 100, 6) AS reel FROM people JOIN prices USING (annee)",
)
def real_values(spark, folder):
    rows = deflate(people(spark, folder), price_index(spark)).withColumn("euros", francs_to_euros("sal"))
    return rounded(rows.select("id", "euros", (F.col("euros") * F.col("ipc") / 100).alias("reel")))


LETTERS_SQL = sql_values("letters", ["k", "label"], [(i, b[0]) for i, b in enumerate(bracket_bounds())])
BOUNDS = bracket_bounds(rate=10.0)
BOUNDS_SQL = sql_values("bounds", ["bracket", "low", "high", "open_top"], [(b, lo, hi, int(o)) for b, lo, hi, o in BOUNDS])
IMPUTE_SQL = f"""{PRICES_SQL}, {BOUNDS_SQL}, {PEOPLE_SQL},
    placed AS (SELECT p.*, ipc, sal * ipc / 100 AS real, b.bracket FROM people p JOIN prices USING (annee)
      JOIN bounds b ON p.sal > b.low AND (p.sal <= b.high OR b.open_top = 1)),
    top AS (SELECT exp(avg(ln(real))) AS top_wage, avg(ipc) AS mean_index FROM placed WHERE annee BETWEEN 1998 AND 2001 AND bracket = 'Plus de 30000 francs'),
    vals AS (SELECT b.bracket, annee, CASE WHEN open_top = 1 THEN top_wage / mean_index * ipc ELSE (low + high) / 2 * ipc / 100 END AS sal_moyen
      FROM bounds b CROSS JOIN prices CROSS JOIN top WHERE annee BETWEEN 1995 AND 1997)"""


def placed_people(spark, folder):
    bands = Bands(tuple(lo for _, lo, _, _ in BOUNDS) + (float("inf"),), tuple(b for b, *_ in BOUNDS), include_lowest=False)
    rows = deflate(people(spark, folder), price_index(spark))
    return rows.withColumns({"real": F.col("sal") * F.col("ipc") / 100, "bracket": bands.label("sal")})


def bracket_value_table(spark, folder):
    placed = placed_people(spark, folder)
    top = top_bracket_mean(placed, "annee", "bracket", "real", "ipc", codes.BRACKET_LABELS[-1], (1998, 2001))
    return bracket_values(price_index(spark), top, BOUNDS, (1995, 1997), "annee")


@query("bracket_midpoints", f"WITH {IMPUTE_SQL} SELECT bracket, annee, round(sal_moyen, 4) AS sal_moyen FROM vals")
def bracket_midpoints(spark, folder):
    """Value of every wage bracket and year, the open one from observed top wages."""
    values = bracket_value_table(spark, folder)
    return values.select("bracket", "annee", F.round("sal_moyen", 4).alias("sal_moyen"))


@query(
    "bracket_imputation",
    f"""WITH {IMPUTE_SQL} SELECT id, p.annee, round(CASE WHEN p.annee < 1998 THEN sal_moyen ELSE real END, 4) AS real
    FROM placed p LEFT JOIN vals v ON p.annee = v.annee AND p.bracket = v.bracket""",
)
def bracket_imputation(spark, folder):
    rows = impute_brackets(placed_people(spark, folder), bracket_value_table(spark, folder), 1998, "annee", "bracket", "real")
    return rows.select("id", "annee", F.round("real", 4).alias("real"))


@query(
    "wage_brackets",
    f"""WITH {LETTERS_SQL}, {PEOPLE_SQL} SELECT id, label AS tranche FROM people JOIN letters ON id % 19 = k""",
)
def wage_brackets(spark, folder):
    """Bracket letters of the early waves as labels."""
    letters = F.array(*[F.lit(v) for v in codes.BRACKET_LETTERS])
    letter = F.get(letters, (F.col("id") % 19).cast("int"))
    return people(spark, folder).select("id", harmonise.wage_bracket_letter(letter).alias("tranche"))


@query(
    "design_matrix",
    f"""WITH {SAMPLE_SQL} SELECT id, (an = 2)::INTEGER AS "an2", (an = 3)::INTEGER AS "an3", (pcs = 'AMERICA')::INTEGER AS "pcsAMERICA", (pcs = 'ASIA')::INTEGER AS "pcsASIA",
    (pcs = 'EUROPE')::INTEGER AS "pcsEUROPE", (pcs = 'MIDDLE EAST')::INTEGER AS "pcsMIDDLE.EAST" FROM sample""",
)
def design_matrix(spark, folder):
    """Treatment coding of two factors, the first level of each as baseline, names made safe."""
    rows = sample(spark, folder).withColumn("an", F.col("an").cast("string"))
    columns = {**dummies("an", ["1", "2", "3"]), **dummies("pcs", ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"])}
    return rows.select("id", *[c.alias(name) for name, c in columns.items()])


RATE_SQL = f"""{PEOPLE_SQL}, rate AS (SELECT annee, avg((sal_gap IS NULL)::INTEGER) AS n_inconnu FROM people WHERE statut = 'En emploi' GROUP BY annee)"""


@query(
    "stratified_sample",
    f"""WITH {RATE_SQL}, k AS (SELECT p.id, p.annee, n_inconnu, row_number() OVER (PARTITION BY p.annee, statut ORDER BY md5('42-' || p.id), p.id) AS r,
      count(*) OVER (PARTITION BY p.annee, statut) AS n FROM people p JOIN rate USING (annee) WHERE statut = 'Chômeur')
    SELECT id, annee FROM k WHERE r <= floor(n * (1 - n_inconnu))""",
)
def stratified(spark, folder):
    """Exactly floor(n (1 - rate)) rows per year and status, without replacement."""
    rows = people(spark, folder)
    rate = missing_rate(rows.where(F.col("statut") == "En emploi"), ["annee"], "sal_gap")
    out_of_work = rows.where(F.col("statut") == "Chômeur").join(rate, "annee")
    return stratified_by_rate(out_of_work, ["annee", "statut"], "n_inconnu", "id").select("id", "annee")


@query(
    "nonresponse_balance",
    f"""WITH {RATE_SQL}, k AS (SELECT p.*, n_inconnu, row_number() OVER (PARTITION BY p.annee, statut ORDER BY md5('42-' || p.id), p.id) AS r,
      count(*) OVER (PARTITION BY p.annee, statut) AS n FROM people p JOIN rate USING (annee))
    SELECT id, annee, statut, CASE WHEN statut <> 'En emploi' AND sal_gap IS NULL THEN 1 ELSE sal_gap END AS sal FROM k
    WHERE (statut = 'En emploi' AND sal_gap IS NOT NULL) OR (statut = 'Chômeur' AND r <= floor(n * (1 - n_inconnu)))""",
)
def nonresponse_balance(spark, folder):
    """The unemployed kept at the bottom of the distribution and thinned like the employed."""
    rows = people(spark, folder).select("id", "annee", "statut", F.col("sal_gap").alias("sal"))
    balanced = balance_nonresponse(rows, "annee", "statut", "sal", "id", "En emploi", "Chômeur")
    return balanced.select("id", "annee", "statut", "sal")


def survey_like(spark, folder):
    """The analysis table with the given tables in its roles, shifted to the years 1990 and on."""
    rows = people(spark, folder)
    origins = F.array(*[F.lit(v) for v in codes.CLASSES.labels])
    return rows.select(
        "id",
        (F.col("annee") * 5 - 7985).cast("int").alias("ANNEE"),
        F.col("sexe").alias("SEXE"),
        (F.col("ag") - 3).alias("AG"),
        F.col("sal_gap").alias("SAL"),
        "statut",
        F.get(origins, (F.col("cust") % 7).cast("int")).alias("CSPP1"),
        F.get(origins, (F.col("id") % 7).cast("int")).alias("CSTOT1"),
        (F.col("id") % 8 + 1).cast("int").alias("diplome7"),
    ).withColumn("gen5_ord", BIRTH_BY_FIVE.ordinal(F.col("ANNEE") - F.col("AG")))


SHIFTED_INDEX = [(y * 5 - 7985, v) for y, v in PRICE_INDEX]
SHORT_NAMES = {short: [label] for label, short in codes.ORIGIN_NAMES.items()}
CLASS_ROWS = sql_values("classes", ["k", "label"], list(enumerate(codes.CLASSES.labels)))
SURVEY_SQL = f"""{PEOPLE_SQL}, {sql_values("shifted", ["an0", "ipc"], SHIFTED_INDEX)}, {CLASS_ROWS},
    survey AS (SELECT id, (annee * 5 - 7985)::INTEGER AS an0, sexe, ag - 3 AS age, sal_gap, statut, c1.label AS cspp1, c2.label AS cstot1, (id % 8 + 1)::INTEGER AS d7
      FROM people JOIN classes c1 ON cust % 7 = c1.k JOIN classes c2 ON id % 7 = c2.k)"""


@query(
    "prepared_sample",
    f"""WITH {SURVEY_SQL} SELECT id, an0 AS "ANNEE", round(ln(sal_gap * ipc / 100), 6) AS logsal,
      CASE WHEN age <= 40 THEN '[30,40]' WHEN age <= 50 THEN '(40,50]' ELSE '(50,60]' END AS "AG10",
      CASE WHEN an0 <= 2001 THEN '90-00' WHEN an0 <= 2012 THEN '01-11' WHEN an0 <= 2023 THEN '12-23' END AS "AN11",
      ((CASE WHEN an0 <= 2001 THEN 1 WHEN an0 <= 2012 THEN 2 WHEN an0 <= 2023 THEN 3 END - CASE WHEN age <= 40 THEN 1 WHEN age <= 50 THEN 2 ELSE 3 END) * 10 + 1960)::INTEGER AS "GEN",
      {sql_case("cspp1", SHORT_NAMES)} AS "Origin", {sql_case("cstot1", SHORT_NAMES, "cstot1")} AS "PCS1", CASE WHEN d7 <= 7 THEN 'Niveau' || (7 - d7) END AS dip7
    FROM survey JOIN shifted USING (an0) WHERE age BETWEEN 30 AND 60 AND an0 - age > 1940 AND an0 >= 1990 AND sal_gap > 0
      AND cspp1 <> {sql_text(codes.CLASSES.labels[-1])}""",
)
def prepared_sample(spark, folder):
    """The whole preparation with its default choices."""
    index = literal_table(spark, [("ANNEE", "int"), ("ipc", "double")], SHIFTED_INDEX)
    ready = prepare(survey_like(spark, folder), index, "id", Preparation())
    return rounded(ready.select("id", "ANNEE", "logsal", "AG10", "AN11", "GEN", "Origin", "PCS1", "dip7"))


@query(
    "prepared_with_unemployed",
    f"""WITH {SURVEY_SQL}, kept AS (SELECT * FROM survey WHERE age BETWEEN 30 AND 60 AND an0 - age > 1940 AND an0 >= 1990),
    rate AS (SELECT an0, avg((sal_gap IS NULL)::INTEGER) AS r FROM kept WHERE statut = 'En emploi' GROUP BY an0),
    k AS (SELECT kept.*, r, row_number() OVER (PARTITION BY an0, statut ORDER BY md5('42-' || id), id) AS place, count(*) OVER (PARTITION BY an0, statut) AS n FROM kept JOIN rate USING (an0))
    SELECT id, statut, round(ln(CASE WHEN sal_gap IS NULL THEN 1 ELSE sal_gap END * ipc / 100), 6) AS logsal, {sql_case("cspp1", SHORT_NAMES)} AS "Origin"
    FROM k JOIN shifted USING (an0) WHERE cspp1 <> {sql_text(codes.CLASSES.labels[-1])}
      AND ((statut = 'En emploi' AND sal_gap IS NOT NULL) OR (statut = 'Chômeur' AND place <= floor(n * (1 - r))))""",
)
def prepared_with_unemployed(spark, folder):
    """The preparation that keeps the unemployed at a floor wage."""
    index = literal_table(spark, [("ANNEE", "int"), ("ipc", "double")], SHIFTED_INDEX)
    ready = prepare(survey_like(spark, folder), index, "id", Preparation(keep_unemployed=True))
    return rounded(ready.select("id", "statut", "logsal", "Origin"))


@query(
    "age_bands",
    f"""WITH {PEOPLE_SQL} SELECT ag, CASE WHEN ag <= 40 THEN '[30,40]' WHEN ag <= 50 THEN '(40,50]' ELSE '(50,60]' END AS "AG10",
    CASE WHEN ag <= 35 THEN '[30,35]' WHEN ag <= 40 THEN '(35,40]' WHEN ag <= 45 THEN '(40,45]' WHEN ag <= 50 THEN '(45,50]' WHEN ag <= 55 THEN '(50,55]' ELSE '(55,60]' END AS "AG5",
    count(*) AS n FROM people GROUP BY ALL""",
)
def age_bands(spark, folder):
    rows = people(spark, folder).withColumns({"AG10": AGE_BY_TEN.label("ag"), "AG5": AGE_BY_FIVE.label("ag")})
    return rows.groupBy("ag", "AG10", "AG5").agg(F.count(F.lit(1)).alias("n"))
