import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantgap.session import cut_lineage, literal_table, result_table, shared_folder
from quantgap.sources.small import read_index, read_labels, repair_characters
from quantgap.sources.waves import crosswalk, discover, file_years, read_era, read_semicolon_csv, read_waves, type_specs, write_table, years_by_position


def write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as out:
        out.write(text)
    return str(path)


LABELS = '  / SEXE\n 1 "Homme"\n 2 "Femme"\nnot an item\n/ DIP7\n 1 "Diplôme – supérieur"\n x "bad"\n'


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252"])
def test_label_file(spark, tmp_path, encoding):
    path = write(f"{tmp_path}/formats.txt", LABELS.replace("\n", "\r\n"), encoding)
    out = read_labels(spark, path, encoding).orderBy("variable", "ord").collect()
    assert [tuple(r) for r in out] == [("DIP7", 1, "Diplôme – supérieur", 1), ("SEXE", 1, "Homme", 1), ("SEXE", 2, "Femme", 2)]


def test_character_repair(spark):
    assert spark.range(1).select(repair_characters(F.lit("M‚decin h“tel")).alias("x")).first().x == "Médecin hôtel"


def test_index_with_preamble(spark, tmp_path):
    path = write(f"{tmp_path}/i.csv", '"Libellé";"Indice"\n"Maj";"12/01"\n"Période";""\n"2001";"80,5"\n"2000";"78,25"\n')
    assert {r.annee: r.ipc for r in read_index(spark, path).collect()} == {2001: 80.5, 2000: 78.25}


def test_semicolon_csv_takes_declared_columns(spark, tmp_path):
    path = write(f"{tmp_path}/w.csv", "B;A;C\n1,5;1;x\n;;y\nnon;2;z\n")
    schema = T.StructType([T.StructField("A", T.IntegerType()), T.StructField("B", T.DoubleType())])
    assert [tuple(r) for r in read_semicolon_csv(spark, path, schema).collect()] == [(1, 1.5), (None, None), (2, None)]


def test_crosswalk_eras():
    assert {c.final: c.source for c in crosswalk("post2013")}["EXTRI"] == "extri"
    assert "DIPGEN" not in {c.final for c in crosswalk("post2021")} and len(crosswalk("pre2013")) == 17
    assert type_specs("post2021")["SALRED_Y"].dataType == T.DoubleType()


def test_read_era_renames_and_restricts(spark, tmp_path):
    names = [c.source for c in crosswalk("post2013")]
    values = {n: "1" for n in names} | {"SALRED": "1500,5", "extri": "12.5", "ANNEE": "2014"}
    second = values | {"RGA": "2"}
    text = ";".join(names) + "\n" + "\n".join(";".join(v[n] for n in names) for v in (values, second)) + "\n"
    rows = read_era(spark, write(f"{tmp_path}/e.csv", text), "post2013").collect()
    assert len(rows) == 1 and rows[0].SAL == 1500.5 and rows[0].EXTRI == 12.5 and rows[0].DIP_long == 1


def test_discovery_and_positions(spark, tmp_path):
    for name in ("a/x_indiv.csv", "b/Y_INDIV.csv", "b/other.txt"):
        write(f"{tmp_path}/{name}", "1\n")
    every = discover(spark, str(tmp_path), "indiv", ignore_case=True)
    lower = discover(spark, str(tmp_path), "indiv")
    assert every.count() == 2 and lower.count() == 1
    assert discover(spark, str(tmp_path), "indiv", True, without=lower).count() == 1
    assert [r.ANNEE for r in years_by_position(every, 1981).orderBy("path").collect()] == [1982, 1983]
    assert years_by_position(every, 1989, first=2, last=2).first().ANNEE == 1990


def test_waves_and_manifest(spark, tmp_path):
    for year in (2003, 2004):
        spark.range(2).select(F.lit(year).alias("ANNEE"), "id", *([F.lit("x").alias("only")] if year == 2004 else [])).coalesce(1).write.parquet(f"{tmp_path}/{year}")
    paths = [f"{tmp_path}/2003", f"{tmp_path}/2004"]
    lenient = read_waves(spark, paths, ["ANNEE", "only", "never"], strict=False)
    assert sorted(lenient.columns) == ["ANNEE", "only"] and lenient.where("only IS NULL").count() == 2
    with pytest.raises(Exception):
        read_waves(spark, paths, ["never"])
    assert [r.ANNEE for r in file_years(spark.read.parquet(*paths)).collect()] == [2003, 2004]
    write_table(lenient, f"{tmp_path}/out")
    assert sorted(d for d in os.listdir(f"{tmp_path}/out") if "=" in d) == ["ANNEE=2003", "ANNEE=2004"]


def test_scratch_tables(spark):
    folder = shared_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") == folder == shared_folder(spark)
    assert cut_lineage(spark.range(5)).count() == 5
    assert literal_table(spark, [("a", "int")], []).count() == 0
    assert result_table(spark, "a int, b double", [(1, None)]).first().b is None
