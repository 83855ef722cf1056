import pytest
from pyspark.sql import functions as F

from quantgap.functions import codes
from quantgap.functions.bands import AGE_BY_TEN, BIRTH_BY_FIVE, PERIOD_BY_FIVE, Bands, interval_labels
from quantgap.functions.levels import Levels, attach_labels, dummies, observed_levels, relabel
from quantgap.functions.scalar import (
    clamp,
    detailed_code,
    digit_class,
    if_else,
    is_finite,
    known_in,
    odds_ratio,
    sentence_case,
    slice_text,
    swap_when,
    to_double,
    to_int,
)
from quantgap.plans import harmonise


def column(spark, values, kind, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", expression.alias("y")).orderBy("i").collect()]


def test_bands_close_on_the_right(spark):
    values = [29.0, 30.0, 30.5, 40.0, 40.1, 50.0, 60.0, 60.1, None]
    assert column(spark, values, "double", AGE_BY_TEN.ordinal("x")) == [None, 1, 1, 1, 2, 2, 3, None, None]
    open_first = Bands((30, 40, float("inf")), include_lowest=False)
    assert column(spark, values, "double", open_first.ordinal("x")) == [None, None, 1, 1, 2, 2, 2, 2, None]
    assert column(spark, [30.0, 41.0], "double", AGE_BY_TEN.label("x")) == ["[30,40]", "(40,50]"]


def test_band_labels():
    assert BIRTH_BY_FIVE.levels()[10] == "(1930,1935]" and BIRTH_BY_FIVE.level_ordinal("(1940,1945]") == 13
    assert PERIOD_BY_FIVE.labels[0] == "82-87" and PERIOD_BY_FIVE.labels[-1] == "17-23"
    assert interval_labels([0, 1, 2.5]) == ["(0,1]", "(1,2.5]"]


def test_missing_rules(spark):
    assert column(spark, [True, False, None], "boolean", if_else(F.col("x"), F.lit("a"), F.lit("b"))) == ["a", "b", None]
    assert column(spark, [True, None], "boolean", if_else(F.col("x"), F.lit(1), F.lit(2), F.lit(3))) == [1, 3]
    assert column(spark, ["a", "b", None], "string", known_in("x", ["a"])) == [True, False, False]
    assert column(spark, [-1.0, 0.5, 9.0, None], "double", clamp("x", 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert column(spark, [1.0, float("nan"), float("inf"), None], "double", is_finite("x")) == [True, False, False, False]
    assert column(spark, [0.0], "double", odds_ratio(F.col("x"), F.col("x"))) == [None]


def test_text(spark):
    assert column(spark, ["12", " 7 ", "", "x", None], "string", to_int("x")) == [12, 7, None, None, None]
    assert column(spark, ["12,5", "", "n.d."], "string", to_double("x")) == [12.5, None, None]
    assert column(spark, ["éLÈVE, Étudiant"], "string", sentence_case("x")) == ["Élève, étudiant"]
    assert column(spark, ["abcdef"], "string", slice_text("x", -3)) == ["def"]
    assert column(spark, ["abcdef"], "string", slice_text("x", 2, -2)) == ["bcde"]
    assert column(spark, [12, 71, 70, 5, 80], "int", digit_class("x")) == [1, 1, None, 5, 8]
    assert column(spark, [12, 10], "int", detailed_code("x")) == [12, None]


def test_parent_swap(spark):
    rows = [(2, 1, 10, 20), (1, 2, 10, 20), (2, None, 10, 20), (None, 1, 10, 20)]
    df = spark.createDataFrame(rows, "s1 int, s2 int, f int, m int")
    out = swap_when(df, (F.col("s1") == 2) & (F.col("s2") == 1), "f", "m").collect()
    assert [(r.f, r.m) for r in out] == [(20, 10), (10, 20), (10, 20), (10, 20)]


def test_levels(spark):
    levels = Levels(("low", "mid", "high"))
    assert levels.recoded({"low": "rest", "mid": "rest", "high": None}).labels == ("rest",)
    assert levels.moved("low", 2).labels == ("mid", "high", "low")
    assert levels.merged(Levels(("top", "mid"))).labels == ("low", "mid", "high", "top")
    assert levels.reversed().labels == ("high", "mid", "low")
    assert column(spark, ["mid", "?"], "string", levels.ordinal("x")) == [2, None]
    assert column(spark, ["low", "top"], "string", relabel("x", {"low": None})) == [None, "top"]
    df = spark.createDataFrame([(1,), (3,), (9,)], "code int")
    assert {r.code: r.t for r in attach_labels(df, "code", levels.table(spark), "t").collect()} == {1: "low", 3: "high", 9: None}
    assert {r.code: r.ord for r in observed_levels(df, "code", descending=True).collect()} == {9: 1, 3: 2, 1: 3}
    assert list(dummies("x", ["a", "b c"])) == ["xb.c"]


def test_fixed_tables():
    assert len(codes.BRACKET_LABELS) == 19 and codes.BRACKET_LABELS[1] == "De 1000 à 1500 francs"
    assert len(codes.OCCUPATION_PARENT.labels) == 29
    assert codes.DIPLOMA_10.labels[5] == "Baccalauréat techno" and len(codes.DIPLOMA_10.labels) == 10
    assert {v for group in codes.DIPLOMA_13_TO_7.values() for v in group} == set(codes.DIPLOMA_13.labels)


def test_occupation_rules_keep_their_order(spark):
    titles = ["Professions intermédiaires de la santé", "Ouvriers agricoles", "Anciens cadres", "Chauffeurs", "Techniciens", "Inconnu"]
    out = column(spark, titles, "string", harmonise.occupation_class("x"))
    assert out == [
        "Professions intermédiaires",
        "Ouvriers",
        "Cadres et professions intellectuelles",
        "Ouvriers",
        "Professions intermédiaires",
        None,
    ]


@pytest.mark.parametrize("year,code,expected", [(2004, 3, 1), (2014, 3, 4), (2022, 4, 6), (2022, 8, None), (2004, None, None)])
def test_status_by_era(spark, year, code, expected):
    df = spark.createDataFrame([(year, code)], "y int, c int")
    assert df.select(harmonise.activity_status("y", "c").alias("s")).first().s == expected
