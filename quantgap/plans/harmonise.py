"""Recodes that bring all survey years to one set of variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions import codes
from quantgap.functions.bands import BIRTH_BY_FIVE, Bands
from quantgap.functions.levels import attach_labels, relabel
from quantgap.functions.scalar import (
    FRANCS_TO_EUROS,
    col,
    detailed_code,
    digit_class,
    first_match,
    francs_to_euros,
    if_else,
    recode,
    row_max,
    sentence_case,
    swap_when,
    to_int,
)
from quantgap.operators.cells import bracket_mid_percentile
from quantgap.operators.joins import join_null_safe
from quantgap.operators.reshape import relocate, union_all

BRACKETS_1990 = Bands((0,) + codes.BRACKET_LIMITS + (float("inf"),), codes.BRACKET_LABELS, include_lowest=False)
BRACKETS_EURO = Bands(
    tuple(b * FRANCS_TO_EUROS for b in (0,) + codes.BRACKET_LIMITS) + (float("inf"),), include_lowest=False
)


def diploma_codes_1982(df: DataFrame) -> DataFrame:
    """General, technical and higher diploma codes of 1982-89 in the coding of 1990."""
    return df.withColumns(
        {
            "DIEG": recode("DIEG", codes.GENERAL_1982),
            "DIET": recode("DIEP", codes.TECHNICAL_1982),
            "DIES": recode("DIES", codes.HIGHER_1982),
        }
    ).drop("DIEP")


def highest_diploma(general: str | Column, technical: str | Column, higher: str | Column) -> Column:
    """Diploma in 13 levels from the largest of three partial codes."""
    return recode(row_max(to_int(general), to_int(technical), to_int(higher)), codes.DIPLOMA_FROM_1990)


def diploma_priority(higher: str | Column, technical: str | Column, general: str | Column) -> Column:
    """Partial code that counts from 2003: higher, then technical, then general."""
    higher, technical, general = col(higher), col(technical), col(general)
    return first_match([(higher > 0, higher), (technical > 0, technical), (general >= 0, general)])


def diploma_17(year: str | Column, code_2013: str | Column, code_2003: str | Column) -> Column:
    return if_else(col(year) > 2012, recode(code_2013, codes.DIPLOMA_FROM_2013), recode(code_2003, codes.DIPLOMA_FROM_2003))


def diploma_13(diploma17: str | Column) -> Column:
    return recode(diploma17, codes.DIPLOMA_17_TO_13, keep_others=True)


def diploma_7(diploma13: str | Column) -> Column:
    """Seven levels, 1 the highest."""
    return recode(diploma13, codes.DIPLOMA_13_TO_7)


def diploma_10(diploma13: str | Column) -> Column:
    return relabel(diploma13, codes.DIPLOMA_13_TO_10)


def diploma_detail(df: DataFrame, code: str, out: str) -> DataFrame:
    """Detailed diploma label by dictionary join; its ordinal runs from the highest code down."""
    table = codes.DIPLOMA_DETAIL.table(df.sparkSession)
    first = table.groupBy("label").agg(F.min("code").alias("first"))
    ranks = first.select("label", F.dense_rank().over(W.orderBy(F.col("first").desc())).alias("ord"))
    dictionary = table.drop("ord").join(ranks, "label")
    return attach_labels(df, code, dictionary, out)


def short_diploma(code: str | Column) -> Column:
    """First digit of the short diploma code."""
    return to_int(F.substring(col(code).cast("string"), 1, 1))


def activity_status_1982(code: str | Column) -> Column:
    return recode(code, codes.STATUS_FROM_1982)


def activity_status(year: str | Column, code: str | Column) -> Column:
    """Status code under the coding of the year."""
    year = col(year)
    later = if_else(year >= 2013, recode(code, codes.STATUS_FROM_2013), recode(code, codes.STATUS_FROM_2003))
    return if_else(year >= 2021, recode(code, codes.STATUS_FROM_2021), later)


def marital_status(year: str | Column, code: str | Column) -> Column:
    return if_else(col(year) < 2021, col(code), recode(code, codes.MARITAL_FROM_2021))


def order_parents(df: DataFrame, sex_first: str = "SEXE_PAR1", sex_second: str = "SEXE_PAR2") -> DataFrame:
    """Father's and mother's occupation exchanged where the first parent is the mother and the second the father."""
    return swap_when(df, (F.col(sex_first) == 2) & (F.col(sex_second) == 1), "CSPP", "CSPM")


def occupation_title(title: str | Column, parent: bool = False) -> Column:
    """Occupation title in sentence case with the spelling of the later years."""
    fixes = codes.PARENT_TITLE_FIXES if parent else codes.OWN_TITLE_FIXES
    return recode(sentence_case(title), fixes, keep_others=True)


def occupation_class(title: str | Column) -> Column:
    """One of seven classes: ordered pattern rules first, exact titles after them."""
    title = col(title)
    rules = [(title.rlike(pattern), F.lit(label)) for pattern, label in codes.CLASS_PATTERNS]
    titles = [(title.isin(*names), F.lit(label)) for label, names in codes.CLASS_TITLES.items()]
    return first_match(rules + titles)


def code_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """One-digit class ``<col>1`` and detailed two-digit code of occupation codes."""
    classes = {f"{c}1": digit_class(c) for c in columns}
    return df.withColumns(classes).withColumns({c: detailed_code(c) for c in columns})


def wage_bracket_letter(letter: str | Column) -> Column:
    return codes.BRACKETS.label(letter)


def harmonise_1982(waves82: DataFrame, waves90: DataFrame) -> DataFrame:
    """Waves 1982-2002 in one table: middle rotation third only, labels, diploma, wage in euros."""
    early = diploma_codes_1982(waves82).withColumn("SALTR", wage_bracket_letter("SALTR")).withColumnRenamed("NA", "TP")
    late = waves90.withColumn("SALTR", BRACKETS_1990.label("SALRED")).withColumnRenamed("TYMEN90R", "TYPMENR")
    both = union_all([early, late]).where(F.col("RANSECH") == 2).drop("RANSECH")
    both = both.withColumn("diplome", highest_diploma("DIEG", "DIET", "DIES"))
    labelled = both.withColumns(
        {
            "S": codes.SEX.label(to_int("S")),
            "AG": to_int("AG"),
            "FI": to_int("FI"),
            "CSTOT": codes.OCCUPATION_DETAIL.label(to_int("CSTOT")),
            "CSPP": codes.OCCUPATION_PARENT.label(to_int("CSPP")),
            "TYPMENR": codes.HOUSEHOLD.label(to_int("TYPMENR")),
            "SECT14": codes.SECTOR.label(to_int("SECT14")),
            "DIPL": codes.DIPLOMA_1982.label(to_int("DIPL")),
            "TP": codes.WORK_TIME.label(to_int("TP")),
            "SAL": francs_to_euros("SALRED"),
        }
    ).drop("SALRED")
    return relocate(labelled, "ANNEE", "S", "AG", "CSTOT")


def align_1982(table: DataFrame) -> DataFrame:
    """The 1982-2002 table under the final names."""
    return table.select(
        "ANNEE",
        F.col("S").alias("SEXE"),
        "AG",
        "CSTOT",
        "CSPP",
        "SALTR",
        "SAL",
        "TP",
        "TYPMENR",
        activity_status_1982("FI").alias("statut"),
        diploma_7("diplome").alias("diplome7"),
        F.col("diplome").alias("diplome13"),
    )


def harmonise_2003(eras: list[DataFrame], dictionary: DataFrame) -> DataFrame:
    """Waves from 2003 under the final names; ``dictionary`` is ``(variable, code, label, ord)``."""
    rows = union_all(eras)
    rows = rows.withColumn("diplome7", short_diploma("DIP_court"))
    rows = order_parents(rows)
    rows = code_columns(rows, ["CSTOT", "CSPP", "CSPM"])
    for column, variable in (("CSTOT", "CSTOT"), ("CSPP", "CSPP"), ("CSPM", "CSPP")):
        rows = attach_labels(rows, column, dictionary, f"{column}_label", variable)
    for column, variable in (("SEXE", "SEXE"), ("TYPMEN", "TYPMEN5"), ("TPPRED", "TPPRED")):
        rows = attach_labels(rows, column, dictionary, f"{column}_label", variable)
    diploma = diploma_17("ANNEE", "DIP_moyen", diploma_priority("DIPSUP", "DIPTEC", "DIPGEN"))
    rows = diploma_detail(rows.withColumn("diplome17", diploma), "DIP_long", "diplome104")
    return rows.select(
        "ANNEE",
        F.col("SEXE_label").alias("SEXE"),
        "AG",
        F.col("CSTOT_label").alias("CSTOT"),
        F.col("CSPP_label").alias("CSPP"),
        F.col("CSPM_label").alias("CSPM"),
        "SAL",
        BRACKETS_EURO.label("SAL").alias("SALTR"),
        F.col("TPPRED_label").alias("TP"),
        relabel("TYPMEN_label", codes.HOUSEHOLD_RENAMED).alias("TYPMENR"),
        marital_status("ANNEE", "MATRI").alias("MATRI"),
        activity_status("ANNEE", "SP00").alias("statut"),
        "diplome7",
        "diplome17",
        diploma_13("diplome17").alias("diplome13"),
        "diplome104",
        "EXTRI",
    )


def bracket_order(label: str | Column) -> Column:
    """Order of a wage bracket within its era; the two eras carry different labels."""
    label = col(label)
    franc = codes.Levels(codes.BRACKET_LABELS).ordinal(label)
    euro = codes.Levels(tuple(BRACKETS_EURO.levels())).ordinal(label)
    return F.coalesce(franc, euro)


def analysis_table(table82: DataFrame, table03: DataFrame) -> DataFrame:
    """All years: status labels, bracket mid-percentiles, occupation titles and classes, birth cohorts, diploma in ten levels."""
    rows = union_all([table82, table03]).withColumn("statut", codes.STATUS.label("statut"))
    rows = rows.withColumn("SALTR_ord", bracket_order("SALTR"))
    percentiles = bracket_mid_percentile(rows.where(F.col("SALTR_ord").isNotNull()), "ANNEE", "SALTR", "SALTR_ord")
    rows = join_null_safe(rows, percentiles.select("ANNEE", "SALTR", "centile_moyen"), ["ANNEE", "SALTR"])
    rows = rows.withColumns(
        {"CSTOT": occupation_title("CSTOT"), "CSPP": occupation_title("CSPP", True), "CSPM": occupation_title("CSPM", True)}
    )
    rows = rows.withColumns({f"{c}1": occupation_class(c) for c in ("CSTOT", "CSPP", "CSPM")})
    rows = rows.withColumn("date_naissance", F.col("ANNEE") - F.col("AG"))
    return rows.withColumns(
        {
            "gen5": BIRTH_BY_FIVE.label("date_naissance"),
            "gen5_ord": BIRTH_BY_FIVE.ordinal("date_naissance"),
            "diplome10": diploma_10("diplome13"),
        }
    )
