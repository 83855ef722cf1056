import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quantgap.llm import toxicity as t
from tests.llm.helpers import docs, prose, rows


def corpus(seed=1, n=900):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words, toxic = prose(10_000 + i, 60, 3000).split(), i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["grobian", "schnarchnase", "plagegeist", "flegelhaft", "flegelig"]))
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy_and_leaks(spark):
    texts, labels = corpus()
    table = docs(spark, texts)
    known = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels, 1)], "doc_id bigint, quality int, toxic int")
    model = t.fit(table, known)
    assert {"grobian", "plagegeist"} <= set(model.insults) and len(model.insults) < 60
    got = t.score(table, model)
    marks = got.join(known, "doc_id").where("held_out")
    assert marks.where("predicted <> toxic").count() <= 0.03 * marks.count()
    # Labels of held-out rows change nothing.
    flipped = known.withColumn("toxic", F.when(t.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert t.fit(table, flipped) == model


def test_context_decides():
    table = t.transducer({"rotter": 2.0})
    on = lambda text: {o for o, v in zip(t.OUTPUTS, t.outputs(text, table)) if v}
    assert on("rotter") == {"plain"} and on("you rotter") == {"aimed"} and on("you are not a rotter") == {"negated"}
    assert on("he said rotter") == {"reported"} and on("i will kill you") == {"threat"} and on("you, i kill you") == {"aimed_threat"}
    assert on("not this. rotter") == {"plain"} and on("never kill") == {"void_threat"} and on("nice words") == set()


def test_threats_in_their_forms():
    table = t.transducer({})
    on = lambda text: {o for o, v in zip(t.OUTPUTS, t.outputs(text, table)) if v}
    for text in ("I\u2019m killing you", "he stabbed", "we burned", "she destroys", "sie schlagt", "ils frappent", "destroying", "murdered", "beating"):
        assert on(text) & {"threat", "aimed_threat"}, text
    assert on("he don\u2019t kill") == {"void_threat"}
    for text in ("mate and mates", "skill", "murmur", "the stable", "burnish", "hurtle"):
        assert not on(text), text


def composed(text, insults):
    """The grammar from its definition, clauses without commas: what stood before in the clause decides."""
    total = dict.fromkeys(t.OUTPUTS, 0.0)
    threats = {w for verb in t.THREATS for w in t.inflected(verb)}
    for clause in re.split(r"[.!?;:\n]", text):
        seen = []
        for word in clause.split():
            if word in insults or word in threats:
                kind = "reported" if set(seen) & set(t.REPORTS) else "negated" if set(seen) & set(t.NEGATIONS) else "aimed" if set(seen) & set(t.TARGETS) else "plain"
                total[kind if word in insults else {"plain": "threat", "aimed": "aimed_threat"}.get(kind, "void_threat")] += insults.get(word, 1.0)
            seen.append(word)
    return total


def test_composition_equals_its_definition():
    rng, insults = random.Random(3), {"rotter": 2.0, "lout": 0.5}
    choice = ["you", "not", "never", "said", "rotter", "lout", "kill", "killing", "stabbed", "word", "other", ".", ";"]
    for _ in range(500):
        text = " ".join(rng.choice(choice) for _ in range(rng.randint(0, 30)))
        got = [math.expm1(v) for v in t.outputs(text, t.transducer(insults))[:-1]]
        assert got == pytest.approx(list(composed(text, insults).values())), text


def test_odd_rows_and_missing_labels(spark):
    table = docs(spark, [None, "", "fine", "fine", "rotter " * 20_000], [1, 2, 3, 3, None])
    none = spark.createDataFrame([(3, 1, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    for known in (none, none.limit(0)):
        got = rows(t.score(table, t.fit(table, known)), "doc_id", "score", "predicted", "held_out")
        assert len(got) == 5 and all(0 <= s <= 1 and p == int(s >= 0.5) and h is not None for _, s, p, h in got)
    assert t.score(table.limit(0), t.Model({}, [0.0] * (len(t.OUTPUTS) + 2))).count() == 0
