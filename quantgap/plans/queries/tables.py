"""Sources and sinks: the given tables are landed as survey files in the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantgap.functions import codes
from quantgap.functions.scalar import recode
from quantgap.plans import harmonise
from quantgap.plans.queries.base import PEOPLE_SQL, people, query, rounded, sql_case, sql_text, table
from quantgap.session import literal_table, scratch_path
from quantgap.sources.small import parse_labels, read_index, read_labels, repair_characters
from quantgap.sources.waves import (
    crosswalk_table,
    discover,
    file_years,
    read_era,
    read_parquet_dataset,
    read_semicolon_csv,
    read_waves,
    rename_by_crosswalk,
    select_columns,
    type_specs,
    upper_names,
    write_table,
    years_by_position,
)


def comma(column: str):
    return F.replace(F.col(column).cast("string"), F.lit("."), F.lit(","))


@query(
    "csv_semicolon",
    """SELECT o_orderkey::INTEGER AS cle, CASE WHEN o_orderkey % 8 <> 0 THEN o_totalprice END AS prix, o_orderpriority AS priorite FROM orders""",
)
def csv_semicolon(spark, folder):
    """Declared types and columns from a ``;`` file with decimal commas and blanks."""
    path = scratch_path(spark, "orders-csv")
    orders = table(spark, folder, "orders").withColumn("blank", F.when(F.col("o_orderkey") % 8 != 0, comma("o_totalprice")).otherwise("n.d."))
    landed = orders.select(
        F.col("o_orderkey").alias("cle"), F.col("blank").alias("prix"), F.col("o_orderpriority").alias("priorite"), F.col("o_custkey").alias("autre")
    )
    landed.write.options(sep=";", header="true").csv(path)
    schema = T.StructType(
        [T.StructField("cle", T.IntegerType()), T.StructField("prix", T.DoubleType()), T.StructField("priorite", T.StringType())]
    )
    return read_semicolon_csv(spark, path, schema)


def landed_years(spark, folder, name: str, partition: str = "vague"):
    """People written as Parquet with one folder per year."""
    path = scratch_path(spark, name)
    rows = people(spark, folder).withColumn(partition, F.col("annee"))
    write_table(rows, path, partition)
    return path


def folder_of(path: str = "path"):
    return F.regexp_extract(path, r"(vague=\d+)/[^/]*$", 1)


@query("discover_files", f"WITH {PEOPLE_SQL} SELECT DISTINCT 'vague=' || annee AS dossier FROM people WHERE annee <> 1997")
def discover_files(spark, folder):
    """Files below a folder by name pattern, minus another list of files."""
    root = landed_years(spark, folder, "discover")
    excluded = discover(spark, f"{root}/vague=1997", r"\.parquet$")
    found = discover(spark, root, r"\.PARQUET$", ignore_case=True, without=excluded)
    return found.select(folder_of().alias("dossier")).distinct()


@query("file_manifest", f"WITH {PEOPLE_SQL} SELECT DISTINCT 'vague=' || annee AS dossier, annee FROM people")
def file_manifest(spark, folder):
    """Survey year of each file, found in its rows."""
    rows = spark.read.parquet(landed_years(spark, folder, "manifest"))
    manifest = file_years(rows, "annee")
    return manifest.select(folder_of("file").alias("dossier"), "annee").distinct()


@query(
    "year_by_position",
    f"""WITH {PEOPLE_SQL} SELECT 'vague=' || annee AS dossier, (1989 + row_number() OVER (ORDER BY annee))::INTEGER AS "ANNEE"
    FROM (SELECT DISTINCT annee FROM people WHERE annee >= 1997)""",
)
def year_by_position(spark, folder):
    """Year from the place in the sorted list, from the third wave on."""
    root = landed_years(spark, folder, "position")
    waves = discover(spark, root, r"\.parquet$").select(folder_of().alias("path")).distinct()
    return years_by_position(waves, 1989, first=3).withColumnRenamed("path", "dossier")


@query(
    "waves_union",
    f"""WITH {PEOPLE_SQL} SELECT id, annee, sal, NULL AS tp FROM people WHERE annee < 1998 UNION ALL
    SELECT id, annee, NULL, tp FROM people WHERE annee >= 1998""",
)
def waves_union(spark, folder):
    """Lenient reading of waves with different columns, strict reading of the common ones."""
    rows = people(spark, folder)
    early, late = scratch_path(spark, "waves-early"), scratch_path(spark, "waves-late")
    write_table(select_columns(rows.where("annee < 1998"), ["id", "annee", "sal"]), early, None)
    write_table(select_columns(rows.where("annee >= 1998"), ["id", "annee", "tp"]), late, None)
    lenient = read_waves(spark, [early, late], ["id", "annee", "sal", "tp", "absent"], strict=False)
    strict = read_waves(spark, [early, late], ["id"], strict=True)
    return lenient.join(strict, "id", "left_semi").select("id", "annee", "sal", "tp")


@query("parquet_declared_schema", f"WITH {PEOPLE_SQL} SELECT id, sexe, sal FROM people WHERE annee = 1999 AND sal > 100000")
def parquet_declared_schema(spark, folder):
    """Several folders under one declared schema: only its columns are read and the filter reaches the scan."""
    root = landed_years(spark, folder, "declared")
    schema = T.StructType(
        [T.StructField("id", T.LongType()), T.StructField("sexe", T.StringType()), T.StructField("sal", T.DoubleType()), T.StructField("annee", T.IntegerType())]
    )
    rows = read_parquet_dataset(spark, [f"{root}/vague=1998", f"{root}/vague=1999"], schema)
    return rows.where((F.col("annee") == 1999) & (F.col("sal") > 100000)).select("id", "sexe", "sal")


@query(
    "partitioned_sink",
    f"WITH {PEOPLE_SQL} SELECT annee, count(*) AS n, round(sum(sal), 2) AS total FROM people WHERE annee BETWEEN 1997 AND 1999 GROUP BY annee",
)
def partitioned_sink(spark, folder):
    """A year filter on the written table reads the folders of these years only."""
    rows = spark.read.parquet(landed_years(spark, folder, "sink", "annee_dossier"))
    kept = rows.where(F.col("annee_dossier").between(1997, 1999))
    return kept.groupBy("annee").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("sal"), 2).alias("total"))


@query("price_index_file", f"WITH {PEOPLE_SQL} SELECT annee, round(avg(sal), 4) AS ipc FROM people GROUP BY annee")
def price_index_file(spark, folder):
    """A yearly index file with preamble lines and decimal commas."""
    path = scratch_path(spark, "index")
    yearly = people(spark, folder).groupBy("annee").agg(F.round(F.avg("sal"), 4).cast("decimal(18,4)").alias("v"))
    lines = yearly.select(F.concat_ws(";", F.col("annee").cast("string"), comma("v"), F.lit("A")).alias("value"))
    preamble = literal_table(
        spark, [("value", "string")], [("Libellé;Indice;Codes",), ("Dernière mise à jour;12/01/2026",), ("Période;;",)]
    )
    preamble.unionByName(lines).write.text(path)
    return read_index(spark, path)


LABEL_RESULT = """SELECT 'PAYS' AS variable, n_nationkey AS code, n_name AS label, (n_nationkey + 1)::INTEGER AS ord FROM nation
    UNION ALL SELECT 'REGION', r_regionkey, r_name, (r_regionkey + 1)::INTEGER FROM region"""


def label_text(spark, folder):
    """The two dictionary tables of the data as the text of a label file."""
    nation = table(spark, folder, "nation").select(F.lit("PAYS").alias("v"), F.col("n_nationkey").alias("c"), F.col("n_name").alias("l"))
    region = table(spark, folder, "region").select(F.lit("REGION").alias("v"), F.col("r_regionkey").alias("c"), F.col("r_name").alias("l"))
    line = F.format_string(' %d "%s"', "c", "l")
    blocks = nation.unionByName(region).groupBy("v").agg(F.sort_array(F.collect_list(F.struct("c", line.alias("t")))).alias("b"))
    body = F.concat(F.lit("/ "), F.col("v"), F.lit("\n"), F.array_join(F.col("b.t"), "\n"), F.lit("\n.\n"))
    return blocks.agg(F.array_join(F.sort_array(F.collect_list(body)), "\n").alias("value"))


@query("label_file", LABEL_RESULT)
def label_file(spark, folder):
    """Label file blocks into (variable, code, label)."""
    path = scratch_path(spark, "labels")
    label_text(spark, folder).write.text(path)
    return read_labels(spark, f"{path}/*.txt")


@query("label_lines", LABEL_RESULT)
def label_lines(spark, folder):
    """The same from lines that already are a table."""
    text = label_text(spark, folder).withColumn("file", F.lit("dictionary"))
    return parse_labels(text.select("file", F.posexplode(F.split("value", "\n")).alias("pos", "line")))


@query(
    "encoding_repair",
    "SELECT c_custkey AS id, replace(replace(c_name, 'e', 'é'), 'o', 'ô') || 'èàî' AS nom FROM customer",
)
def encoding_repair(spark, folder):
    """Five wrong characters put right."""
    broken = F.concat(F.translate("c_name", "eo", "‚“"), F.lit("Š…Œ"))
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), repair_characters(broken).alias("nom"))


@query(
    "upper_case_names",
    'SELECT r_regionkey AS "R_REGIONKEY", r_name AS "R_NAME" FROM region',
)
def upper_case_names(spark, folder):
    return upper_names(table(spark, folder, "region"))


def wave_rows(spark, folder, era: str):
    """Orders of one third of the keys as a wave under the column names of an era."""
    number = codes.CROSSWALK_ERAS.index(era)
    first, span = ((2003, 10), (2013, 8), (2021, 3))[number]
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    whole = {
        "ANNEE": first + key % span,
        "RGA": 1 + cust % 2,
        "SEXE": 1 + key % 2,
        "AG": 30 + cust % 31,
        "CSTOT": 11 + cust % 76,
        "MATRI": 1 + cust % 8,
        "CSPP": 10 + key % 60,
        "CSPM": 10 + cust % 60,
        "SEXE_PAR1": 1 + key % 2,
        "SEXE_PAR2": 1 + cust % 2,
        "DIP_long": 100 + key % 700,
        "DIP_moyen": 11 + cust % 61,
        "DIP_court": 1 + key % 7,
        "DIPGEN": cust % 18,
        "DIPTEC": cust % 37 - 5,
        "DIPSUP": key % 7 * 10 + key % 5 - 1,
        "TYPMEN": 1 + cust % 5,
        "SP00": 1 + cust % 9,
        "TPPRED": 1 + cust % 2,
    }
    columns = {name: value.cast("int") for name, value in whole.items()}
    columns["EXTRI"] = F.concat((cust % 50).cast("string"), F.lit(".5"))
    columns["SAL"] = F.col("o_totalprice")
    orders = table(spark, folder, "orders").where(key % 3 == number)
    names = [(row[0], row[number + 1]) for row in codes.CROSSWALK if row[number + 1] is not None]
    return orders.select(*[columns[final].alias(source) for final, source in names])


def landed_era(spark, folder, era: str, kind: str) -> str:
    path = scratch_path(spark, f"era-{era}")
    rows = wave_rows(spark, folder, era)
    if kind == "csv":
        wage = "SALRED_Y" if era == "post2021" else "SALRED"
        rows.withColumn(wage, comma(wage)).write.options(sep=";", header="true").csv(path)
    else:
        rows.write.parquet(path)
    return path


WAVES_SQL = """waves AS (SELECT o_orderkey % 3 AS era, (CASE o_orderkey % 3 WHEN 0 THEN 2003 + o_orderkey % 10 WHEN 1 THEN 2013 + o_orderkey % 8 ELSE 2021 + o_orderkey % 3 END)::INTEGER AS y,
      1 + o_orderkey % 2 AS s, (30 + o_custkey % 31)::INTEGER AS age, o_totalprice AS w, o_custkey % 50 + 0.5::DOUBLE AS extri, (1 + o_orderkey % 7)::INTEGER AS d7,
      (11 + o_custkey % 61)::INTEGER AS det, (o_orderkey % 7 * 10 + o_orderkey % 5 - 1)::INTEGER AS sup, (o_custkey % 37 - 5)::INTEGER AS tec, (o_custkey % 18)::INTEGER AS gen,
      (1 + o_custkey % 9)::INTEGER AS sp, (1 + o_custkey % 8)::INTEGER AS matri, (10 + o_orderkey % 60)::INTEGER AS f, (10 + o_custkey % 60)::INTEGER AS m, 1 + o_custkey % 2 AS s2,
      (100 + o_orderkey % 700)::INTEGER AS long
    FROM orders WHERE 1 + o_custkey % 2 = 1)"""


@query(
    "crosswalk_rename",
    f"""WITH {WAVES_SQL} SELECT y AS "ANNEE", s::INTEGER AS "SEXE", age AS "AG", w AS "SAL", extri AS "EXTRI", d7 AS "DIP_court", det AS "DIP_moyen" FROM waves WHERE era = 1""",
)
def crosswalk_rename(spark, folder):
    """One era's file with a lower-case column: declared types, first interviews, final names."""
    path = landed_era(spark, folder, "post2013", "csv")
    rows = read_era(spark, path, "post2013")
    return rows.select("ANNEE", "SEXE", "AG", "SAL", "EXTRI", "DIP_court", "DIP_moyen")


FINAL_TYPES = {"int": "int", "num": "double", "chr": "string"}
TYPES_SQL = ", ".join(f"({sql_text(row[0])}, {sql_text(FINAL_TYPES[row[4]])})" for row in codes.CROSSWALK if row[3])


@query(
    "crosswalk_types",
    f"SELECT name, kind, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 2) AS n FROM (VALUES {TYPES_SQL}) AS t(name, kind)",
)
def crosswalk_types(spark, folder):
    """Type specification of an era under the final names, beside the number of rows it describes."""
    path = landed_era(spark, folder, "post2021", "parquet")
    rows = rename_by_crosswalk(read_parquet_dataset(spark, path, type_specs("post2021")), "post2021")
    kinds = literal_table(spark, [("name", "string"), ("kind", "string")], [tuple(t) for t in rows.dtypes])
    known = crosswalk_table(spark).select(F.col("final").alias("name"))
    return kinds.join(known, "name", "left_semi").crossJoin(rows.agg(F.count(F.lit(1)).alias("n")))


def era_dictionary(spark):
    rows = [(v, c, t, i + 1) for v, levels in
            (("CSTOT", codes.OCCUPATION_DETAIL), ("CSPP", codes.OCCUPATION_PARENT), ("SEXE", codes.SEX), ("TYPMEN5", codes.HOUSEHOLD), ("TPPRED", codes.WORK_TIME))
            for i, (c, t) in enumerate(levels.pairs())]
    return literal_table(spark, [("variable", "string"), ("code", "int"), ("label", "string"), ("ord", "int")], rows)


@query(
    "harmonised_waves",
    f"""WITH {WAVES_SQL}, p AS (SELECT *, CASE WHEN sup > 0 THEN sup WHEN tec > 0 THEN tec WHEN gen >= 0 THEN gen END AS part,
      CASE WHEN era = 2 AND s = 2 AND s2 = 1 THEN m ELSE f END AS father FROM waves),
    d AS (SELECT *, CASE WHEN y > 2012 THEN CASE WHEN era > 0 THEN {sql_case("det", codes.DIPLOMA_FROM_2013)} END ELSE {sql_case("part", codes.DIPLOMA_FROM_2003)} END AS d17 FROM p)
    SELECT y AS "ANNEE", CASE s WHEN 1 THEN 'Homme' ELSE 'Femme' END AS "SEXE", age AS "AG", w AS "SAL", extri AS "EXTRI", d7 AS diplome7, d17 AS diplome17,
      (CASE WHEN y >= 2021 THEN {sql_case("sp", codes.STATUS_FROM_2021)} WHEN y >= 2013 THEN {sql_case("sp", codes.STATUS_FROM_2013)} ELSE {sql_case("sp", codes.STATUS_FROM_2003)} END)::INTEGER AS statut,
      (CASE WHEN y < 2021 THEN matri ELSE {sql_case("matri", codes.MARITAL_FROM_2021)} END)::INTEGER AS "MATRI",
      CASE WHEN father % 10 <> 0 THEN CASE father {" ".join(f"WHEN {c} THEN {sql_text(t)}" for c, t in codes.OCCUPATION_PARENT.pairs())} END END AS "CSPP"
    FROM d""",
)
def harmonised_waves(spark, folder):
    """Three eras of files in three layouts, brought to one table."""
    eras = [
        read_era(spark, landed_era(spark, folder, "pre2013", "csv"), "pre2013"),
        read_era(spark, landed_era(spark, folder, "post2013", "csv"), "post2013"),
        read_era(spark, landed_era(spark, folder, "post2021", "parquet"), "post2021", "parquet"),
    ]
    rows = harmonise.harmonise_2003(eras, era_dictionary(spark))
    return rows.select("ANNEE", "SEXE", "AG", "SAL", "EXTRI", "diplome7", "diplome17", "statut", "MATRI", "CSPP")


def waves_1982(spark, folder):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    orders = table(spark, folder, "orders")
    letters = F.array(*[F.lit(v) for v in codes.BRACKET_LETTERS])
    common = {
        "AG": (30 + cust % 31).cast("string"),
        "CSTOT": (11 + cust % 76).cast("string"),
        "CSPP": (10 + key % 60).cast("string"),
        "DIPL": (cust % 80).cast("string"),
        "EXTRI": (cust % 50).cast("double"),
        "FI": (1 + cust % 8).cast("string"),
        "RANSECH": (1 + key % 3).cast("int"),
        "S": (1 + key % 2).cast("string"),
        "SECT14": (1 + cust % 15).cast("string"),
        "STATUT": (cust % 4).cast("string"),
    }
    early = {
        **common,
        "ANNEE": (1982 + key % 8).cast("int"),
        "DIEG": (key % 9).cast("string"),
        "DIEP": F.when(cust % 10 == 0, "").otherwise((cust % 10).cast("string")),
        "DIES": (key % 23).cast("string"),
        "NA": (1 + cust % 2).cast("string"),
        "SALTR": F.get(letters, (cust % 20).cast("int")),
        "TYPMENR": (1 + cust % 6).cast("string"),
    }
    late = {
        **common,
        "ANNEE": (1990 + key % 13).cast("int"),
        "DIEG": F.lpad((key % 20).cast("string"), 2, "0"),
        "DIET": F.lpad((cust % 40).cast("string"), 2, "0"),
        "DIES": F.lpad((key % 50).cast("string"), 2, "0"),
        "TP": (1 + cust % 2).cast("string"),
        "SALRED": F.col("o_totalprice") / 10,
        "TYMEN90R": (1 + cust % 6).cast("string"),
    }
    return (
        orders.where(key % 2 == 0).select(*[c.alias(n) for n, c in early.items()]),
        orders.where(key % 2 == 1).select(*[c.alias(n) for n, c in late.items()]),
    )


DIPLOMA_1982_SQL = f"""greatest(try_cast({sql_case("(o_orderkey % 9)::VARCHAR", codes.GENERAL_1982)} AS INTEGER),
    try_cast({sql_case("CASE WHEN o_custkey % 10 = 0 THEN '' ELSE (o_custkey % 10)::VARCHAR END", codes.TECHNICAL_1982)} AS INTEGER),
    try_cast({sql_case("(o_orderkey % 23)::VARCHAR", codes.HIGHER_1982)} AS INTEGER))"""
LIMITS = (0,) + codes.BRACKET_LIMITS
FRANC_SQL = "CASE " + " ".join(
    f"WHEN salred > {low}" + (f" AND salred <= {high}" if high else "") + f" THEN {sql_text(label)}"
    for low, high, label in zip(LIMITS, codes.BRACKET_LIMITS + (None,), codes.BRACKET_LABELS)
) + " END"
LETTER_SQL = "CASE o_custkey % 20 " + " ".join(f"WHEN {i} THEN {sql_text(t)}" for i, t in enumerate(codes.BRACKETS.labels)) + " END"


@query(
    "early_waves",
    f"""WITH w AS (SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice / 10 END AS salred,
      CASE WHEN o_orderkey % 2 = 0 THEN {DIPLOMA_1982_SQL} ELSE greatest(o_orderkey % 20, o_custkey % 40, o_orderkey % 50) END AS top FROM orders WHERE 1 + o_orderkey % 3 = 2),
    d AS (SELECT *, {sql_case("top", codes.DIPLOMA_FROM_1990)} AS diplome13 FROM w)
    SELECT (CASE WHEN o_orderkey % 2 = 0 THEN 1982 + o_orderkey % 8 ELSE 1990 + o_orderkey % 13 END)::INTEGER AS "ANNEE",
      CASE o_orderkey % 2 WHEN 0 THEN 'Homme' ELSE 'Femme' END AS "SEXE", (30 + o_custkey % 31)::INTEGER AS "AG", round(salred * 0.152449, 6) AS "SAL",
      CASE WHEN o_orderkey % 2 = 0 THEN {LETTER_SQL} ELSE {FRANC_SQL} END AS "SALTR", CASE o_custkey % 2 WHEN 0 THEN 'Temps complet' ELSE 'Temps partiel' END AS "TP",
      {sql_case("1 + o_custkey % 8", codes.STATUS_FROM_1982)}::INTEGER AS statut, diplome13, {sql_case("diplome13", codes.DIPLOMA_13_TO_7)}::INTEGER AS diplome7
    FROM d""",
)
def early_waves(spark, folder):
    """Two early layouts in one table: diploma chain, brackets from letters and from francs, labels, one rotation third."""
    waves82, waves90 = waves_1982(spark, folder)
    rows = harmonise.align_1982(harmonise.harmonise_1982(waves82, waves90))
    return rounded(rows.select("ANNEE", "SEXE", "AG", "SAL", "SALTR", "TP", "statut", "diplome13", "diplome7"))


@query("analysis_table")
def analysis_table(spark, folder):
    """Early and later waves in the final table, written and read back by year; rows per year and class."""
    waves82, waves90 = waves_1982(spark, folder)
    early = harmonise.align_1982(harmonise.harmonise_1982(waves82, waves90))
    eras = [read_era(spark, landed_era(spark, folder, era, kind), era, kind) for era, kind in (("pre2013", "csv"), ("post2013", "csv"), ("post2021", "parquet"))]
    later = harmonise.harmonise_2003(eras, era_dictionary(spark))
    path = scratch_path(spark, "analysis")
    write_table(harmonise.analysis_table(early, later), path)
    final = spark.read.parquet(path)
    return rounded(
        final.groupBy("ANNEE", "CSTOT1", "diplome10", "statut").agg(
            F.count(F.lit(1)).alias("n"), F.avg("centile_moyen").alias("centile_moyen"), F.max("gen5").alias("gen5")
        )
    )


@query(
    "status_labels",
    f"WITH {PEOPLE_SQL} SELECT CASE WHEN statut = 'Chômeur' THEN 2 ELSE 1 END AS code, statut, count(*) AS n FROM people GROUP BY ALL",
)
def status_labels(spark, folder):
    rows = people(spark, folder).select(recode("statut", {1: ["En emploi"], 2: ["Chômeur"]}).alias("code"))
    return rows.withColumn("statut", codes.STATUS.label("code")).groupBy("code", "statut").agg(F.count(F.lit(1)).alias("n"))
