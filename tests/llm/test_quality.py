import re

from pyspark.sql import functions as F

from quantgap.llm import quality
from tests.llm.helpers import docs, prose, rows

CASES = [
    None, "", " \n\t ", "one", "a b c a b c a b c", "x\nx\n\nx\ny", "é € 😀 #*$%&|<>", "a\x0bb\x0cc d e",
    prose(1, 60), prose(1, 60), "spam spam " * 40, prose(2, 30_000, 50), "the cat and the dog " + prose(3, 70) + "\n" + "the end of it",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, twice = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            twice.update(p + k for p in places for k in range(3))
    n, repeats = len(words), len(twice)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, n < 50 or 100 * repeats > 50 * n


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_measures_equal_brute_force(spark):
    got = quality.judge(quality.measure(docs(spark, CASES))).orderBy("doc_id")
    assert rows(got, *COLUMNS) == [brute(t) for t in CASES]
    assert all(not r.kept for r in got.where("base_failed").collect())


def test_colliding_hashes_take_the_exact_path(spark):
    texts = [c for c in CASES if c is None or len(c) < 5000]
    got = quality.judge(quality.measure(docs(spark, texts), hash_mask=0)).orderBy("doc_id")
    assert rows(got, *COLUMNS) == [brute(t) for t in texts]


def test_a_filter_on_any_column_ends(spark):
    judged = quality.judge(quality.measure(docs(spark, [prose(7, 2000), prose(8, 300), None])))
    for column, kind in judged.dtypes:
        if kind in ("bigint", "double", "boolean"):
            assert judged.where(F.col(column).cast("double") > -1).count() == 3
    assert judged.where("n_words > 400 AND NOT base_failed AND stop_ratio >= 0").count() == 1


def test_rules_and_pass_through(spark):
    good = "the end of the day is not what it was to be and we said so " * 1 + prose(5, 60)
    table = docs(spark, [good, good + " " + "# " * 60, None]).withColumn("_tokens", F.lit(1)).withColumn("n_words", F.lit(7))
    kept = quality.keep_good(table)
    assert kept.columns == table.columns
    assert rows(kept, "doc_id", "n_words", "_tokens") == [(1, 7, 1)]
    assert quality.keep_good(table.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = quality.judge(quality.measure(docs(spark, ["x"])))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
