import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quantgap.llm import decontamination as d
from tests.llm.helpers import docs, prose, rows

ITEMS = [(1, prose(10, 25)), (2, "Short item here"), (10, prose(10, 25)), (3, None), (4, " ... "), (None, prose(11, 12)), (5, "word " * 14)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(text, items):
    w, hit, ids = words(text), set(), set()
    for item, body in items:
        b = words(body)
        width = min(len(b), 10)
        grams = {tuple(b[i : i + width]) for i in range(len(b) - width + 1)} if b else set()
        for i in range(len(w) - width + 1):
            if grams and tuple(w[i : i + width]) in grams:
                hit.update(range(i, i + width))
                if item is not None:
                    ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


TEXTS = [
    None, "", "nothing of the kind", "A SHORT-item, here; and a short Item hEre", "x " + ITEMS[0][1].upper() + " y", ITEMS[5][1], "word " * 40,
    " ".join(ITEMS[0][1].split()[3:12]), " ".join(ITEMS[0][1].split()[3:13]), "é" * 5 + " É short item hereé", prose(1, 5000) + " short item here", "short item here", "short item here",
]


def table(spark, texts, ids=None):
    return docs(spark, texts, ids)


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id bigint, text string")


def test_hits_equal_brute_force(spark):
    got = d.find_hits(table(spark, TEXTS), bench(spark)).select(
        "doc_id", "n_words", d.hit_words().alias("n_hit"), F.size("items").alias("n"), F.sha2(F.array_join("items", ","), 256).alias("sha")
    )
    assert sorted(rows(got, "*")) == [(i, *brute(t, ITEMS)) for i, t in enumerate(TEXTS, 1)]


def test_repeats_nulls_and_empty_tables(spark):
    texts = ["short item here", "short item here", "other", "short item here"]
    got = d.find_hits(table(spark, texts, [7, 7, 7, None]), bench(spark)).select("doc_id", "n_words", d.hit_words())
    assert sorted(rows(got, "*"), key=str) == [(7, 1, 0), (7, 3, 3), (7, 3, 3), (None, 3, 3)]
    assert {r[1] for r in rows(d.find_hits(table(spark, texts), bench(spark).limit(0)).select("doc_id", d.hit_words()), "*")} == {0}
    assert d.find_hits(table(spark, texts).limit(0), bench(spark)).count() == 0


def test_removal(spark):
    texts = ["keep me as I am", "before, short ITEM here! after", None, "short item here"]
    source = table(spark, texts, [1, 2, None, 4]).withColumn("_bad_id", F.lit("x"))
    left = d.remove_documents(source, bench(spark))
    assert left.columns == source.columns and sorted(rows(left, "doc_id"), key=str) == [(1,), (None,)]
    cut = d.remove_spans(source, bench(spark))
    assert cut.columns == source.columns
    found = {r.doc_id: r.text for r in cut.collect()}
    assert found[1] == texts[0] and found[None] is None
    assert "short" not in found[2].lower() and found[2].startswith("before") and found[2].endswith("after")
    assert d.find_hits(cut, bench(spark)).where("size(hits) > 0").count() == 0


def test_large_test_sets_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr("quantgap.llm.common.BROADCAST_BYTES", 0)
    got = d.find_hits(table(spark, TEXTS), bench(spark)).select("doc_id", "n_words", d.hit_words())
    assert sorted(rows(got, "*")) == [(i, *brute(t, ITEMS)[:2]) for i, t in enumerate(TEXTS, 1)]


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_sorts_and_shuffles_do_not_hold_the_words_of_a_text(spark, monkeypatch, limit):
    monkeypatch.setattr("quantgap.llm.common.BROADCAST_BYTES", limit)
    plan = d.find_hits(table(spark, TEXTS), bench(spark))._jdf.queryExecution().executedPlan().toString().split("\n")
    holds = [below for line, below in zip(plan, plan[1:]) if re.search(r"Exchange hash|Aggregate\(", line)]
    assert holds and not [line[:200] for line in holds if re.search(r"Project .*[\[ ]w#\d+[,\]]", line)]


def test_a_bit_a_gram_loses_none(spark, monkeypatch):
    monkeypatch.setattr("quantgap.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr(d, "BROADCAST_BITS", 4096)
    items = [(i, prose(100 + i, 40)) for i in range(300)]
    texts = [f"{prose(500 + i, 30)} {' '.join(items[i][1].split()[i % 20 :])} {prose(900 + i, 9)}" for i in range(0, 300, 7)]
    got = d.find_hits(table(spark, texts), bench(spark, items)).select("doc_id", "n_words", d.hit_words(), F.size("items"))
    assert sorted(rows(got, "*")) == [(i, *brute(t, items)[:3]) for i, t in enumerate(texts, 1)]
