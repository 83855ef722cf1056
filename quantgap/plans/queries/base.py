"""Tables, roles and SQL text shared by the registered queries.

The given tables play the roles of the survey: an order is a person seen in a year, its price the wage, its status the
sex, the customer's segment the social origin.  ``people`` is the raw role view, ``sample`` the analysis sample.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgap.functions.bands import AGE_BY_FIVE, AGE_BY_TEN, Bands, decade_cohort
from quantgap.functions.scalar import real_value, recode, safe_log
from quantgap.operators.joins import deflate
from quantgap.session import literal_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PRICE_INDEX = [(1995, 72.0), (1996, 73.5), (1997, 74.7), (1998, 76.0), (1999, 77.2), (2000, 78.6), (2001, 80.0)]
PERIODS = Bands((1995, 1997, 1999, 2001), ("95-97", "98-99", "00-01"))
REF = "BUILDING"
TARGETS = ["AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
CELL = ["sexe", "an", "ag10"]


def query(name: str, sql: str | None = None):
    """Register a query, with the SQL it must agree with where there is one."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql.strip()
        return function

    return register


# Declared schemas spare a look into the files whenever a table is opened.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def price_index(spark: SparkSession, drop: int | None = None) -> DataFrame:
    return literal_table(spark, [("annee", "int"), ("ipc", "double")], [r for r in PRICE_INDEX if r[0] != drop])


def people(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = table(spark, folder, "orders"), table(spark, folder, "customer")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    places = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("cust"),
        F.year("o_orderdate").alias("annee"),
        F.col("o_totalprice").alias("sal"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("sal_gap"),
        recode("o_orderstatus", {"Femme": ["F"], "Homme": ["O"]}).alias("sexe"),
        F.col("c_mktsegment").alias("origin"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("dip"),
        (30 + F.col("o_custkey") % 31).cast("int").alias("ag"),
        F.col("r_name").alias("pcs"),
        F.when(F.col("o_orderkey") % 9 == 0, "Chômeur").otherwise("En emploi").alias("statut"),
        F.when(F.col("o_custkey") % 4 == 0, "Temps partiel").otherwise("Temps complet").alias("tp"),
        (1 + F.col("o_custkey") % 5).cast("int").alias("wt"),
    )


def sample(spark: SparkSession, folder: str) -> DataFrame:
    rows = deflate(people(spark, folder).where(F.col("sexe").isNotNull() & (F.col("sal") > 0)), price_index(spark))
    rows = rows.withColumn("real", real_value("sal", "ipc"))
    rows = rows.withColumns(
        {
            "logsal": safe_log("real"),
            "an": PERIODS.ordinal("annee"),
            "ag10": AGE_BY_TEN.ordinal("ag"),
            "ag5": AGE_BY_FIVE.ordinal("ag"),
        }
    )
    return rows.withColumn("gen", decade_cohort(F.col("an"), F.col("ag10")))


def rounded(df: DataFrame, *keep: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison across engines (adding zero turns -0.0 into 0.0)."""
    columns = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        columns.append((F.round(column, digits) + F.lit(0.0)).alias(name) if kind == "double" and name not in keep else column)
    return df.select(*columns)


PRICES_SQL = "prices(annee, ipc) AS (VALUES " + ", ".join(f"({y}, {v}::DOUBLE)" for y, v in PRICE_INDEX) + ")"

PEOPLE_SQL = """people AS (
  SELECT o_orderkey AS id, o_custkey AS cust, year(o_orderdate)::INTEGER AS annee, o_totalprice AS sal,
    CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice END AS sal_gap,
    CASE o_orderstatus WHEN 'F' THEN 'Femme' WHEN 'O' THEN 'Homme' END AS sexe,
    c_mktsegment AS origin, substr(o_orderpriority, 1, 1)::INTEGER AS dip, (30 + o_custkey % 31)::INTEGER AS ag,
    r_name AS pcs, CASE WHEN o_orderkey % 9 = 0 THEN 'Chômeur' ELSE 'En emploi' END AS statut,
    CASE WHEN o_custkey % 4 = 0 THEN 'Temps partiel' ELSE 'Temps complet' END AS tp, (1 + o_custkey % 5)::INTEGER AS wt
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey)"""

SAMPLE_SQL = f"""{PRICES_SQL}, {PEOPLE_SQL}, sample AS (
  SELECT *, (an - ag10) * 10 + 1960 AS gen FROM (
    SELECT p.*, ipc, sal * ipc / 100 AS real, ln(sal * ipc / 100) AS logsal,
      CASE WHEN annee BETWEEN 1995 AND 1997 THEN 1 WHEN annee BETWEEN 1998 AND 1999 THEN 2
           WHEN annee BETWEEN 2000 AND 2001 THEN 3 END AS an,
      CASE WHEN ag BETWEEN 30 AND 40 THEN 1 WHEN ag BETWEEN 41 AND 50 THEN 2 WHEN ag BETWEEN 51 AND 60 THEN 3 END AS ag10,
      CASE WHEN ag BETWEEN 30 AND 35 THEN 1 WHEN ag <= 40 THEN 2 WHEN ag <= 45 THEN 3 WHEN ag <= 50 THEN 4
           WHEN ag <= 55 THEN 5 WHEN ag <= 60 THEN 6 END AS ag5
    FROM people p LEFT JOIN prices USING (annee) WHERE sexe IS NOT NULL AND sal > 0))"""


def sql_list(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)


def sql_text(value) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else ("NULL" if value is None else str(value))


def sql_case(column: str, groups: dict, otherwise: str = "NULL") -> str:
    """CASE for ``{new: [old values]}``."""
    arms = " ".join(f"WHEN {column} IN ({sql_list(olds)}) THEN {sql_text(new)}" for new, olds in groups.items())
    return f"CASE {arms} ELSE {otherwise} END"


def sql_values(name: str, columns: list[str], rows) -> str:
    body = ", ".join("(" + ", ".join(sql_text(v) for v in row) + ")" for row in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def distance_sql(source: str, cell: list[str], group: str, value: str, ref: str, targets: list[str], weight: str = "1", p: int = 2, least: int = 1, frequency: bool = False, suffix: str = "") -> str:
    """CTE ``distances(cell…, target, n, n_ref, w)`` by pairwise merging of two histograms; CTE names take the suffix."""
    keys = ", ".join(cell)
    part = ", ".join([*cell, "target"])
    join = " AND ".join(f"x.{k} = t.{k}" for k in cell) or "true"
    tkeys = ", ".join(f"t.{k}" for k in cell)
    count = f"sum({weight})" if frequency else "count(*)"
    return f"""
    hist{suffix} AS (SELECT {keys}, {group} AS g, {value} AS v, sum({weight}) AS w, {count} AS c FROM {source}
             WHERE {value} IS NOT NULL AND {group} IN ({sql_list([*targets, ref])}) GROUP BY ALL),
    run{suffix} AS (SELECT *, (sum(w) OVER (PARTITION BY {keys}, g ORDER BY v))::DOUBLE / sum(w) OVER (PARTITION BY {keys}, g) AS u,
                   sum(c) OVER (PARTITION BY {keys}, g) AS obs FROM hist{suffix}),
    wanted{suffix} AS (SELECT DISTINCT {keys}, target FROM hist{suffix}, (VALUES {", ".join(f"('{t}')" for t in targets)}) AS l(target)),
    pairs{suffix} AS (SELECT {tkeys}, t.target, x.v, x.u, true AS mine, x.obs FROM run{suffix} x JOIN wanted{suffix} t ON {join} AND x.g = t.target
              UNION ALL SELECT {tkeys}, t.target, x.v, x.u, false, x.obs FROM run{suffix} x JOIN wanted{suffix} t ON {join} WHERE x.g = '{ref}'),
    filled{suffix} AS (SELECT *, first_value(CASE WHEN mine THEN v END IGNORE NULLS) OVER ahead AS qa,
                      first_value(CASE WHEN NOT mine THEN v END IGNORE NULLS) OVER ahead AS qb,
                      u - lag(u, 1, 0.0::DOUBLE) OVER (PARTITION BY {part} ORDER BY u) AS du
               FROM pairs{suffix} WINDOW ahead AS (PARTITION BY {part} ORDER BY u ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    distances{suffix} AS (SELECT {tkeys}, t.target, coalesce(max(CASE WHEN mine THEN obs END), 0)::BIGINT AS n,
                         coalesce(max(CASE WHEN NOT mine THEN obs END), 0)::BIGINT AS n_ref,
                         CASE WHEN least(coalesce(max(CASE WHEN mine THEN obs END), 0), coalesce(max(CASE WHEN NOT mine THEN obs END), 0)) >= {least}
                              THEN pow(sum(du * pow(abs(qa - qb), {p})), 1.0 / {p}) END AS w
                  FROM wanted{suffix} t LEFT JOIN filled{suffix} x ON {join} AND x.target = t.target GROUP BY {tkeys}, t.target)"""


def mapping_sql(source: str, cell: list[str], group: str, value: str, ref: str, keep: list[str]) -> str:
    """CTE ``mapped(keep…, mapped)``: type-7 quantile of the reference group at each row's own rank."""
    keys = ", ".join(cell)
    on = " AND ".join(f"r.{k} = s.{k}" for k in cell)
    target = " AND ".join("{0}.%s = s.%s" % (k, k) for k in cell)
    return f"""
    refs AS (SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS k,
                    count(*) OVER (PARTITION BY {keys}) AS m FROM {source} WHERE {group} = '{ref}'),
    sized AS (SELECT DISTINCT {keys}, m FROM refs),
    ranks AS (SELECT *, least(greatest(cume_dist() OVER (PARTITION BY {keys}, {group} ORDER BY {value}), 0.001), 0.999) AS prank FROM {source}),
    asks AS (SELECT s.*, (r.m - 1) * prank AS h FROM ranks s LEFT JOIN sized r ON {on}),
    mapped AS (SELECT {", ".join("s." + k for k in keep)},
                 CASE WHEN s.{group} = '{ref}' OR s.h IS NULL THEN s.{value}
                      ELSE lo.v + (s.h - floor(s.h)) * (coalesce(hi.v, lo.v) - lo.v) END AS mapped
               FROM asks s LEFT JOIN refs lo ON {target.format("lo")} AND lo.k = floor(s.h) + 1
                    LEFT JOIN refs hi ON {target.format("hi")} AND hi.k = floor(s.h) + 2)"""
