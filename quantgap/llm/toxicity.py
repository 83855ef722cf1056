"""Toxicity by a weighted finite-state grammar of clauses.

One transducer turns a word into a symbol (insult, threat, target, negation, reported speech) with a weight; a second one
reads the symbols of a clause and sends each insult or threat to an output that depends on what stood before it: aimed at
someone, negated, reported, or plain.  Their composition runs once over a clause; a document's score comes from the
weights its clauses put on the outputs, never from words outside a matched clause.

Insults are learned, as whole words and as stems (``abcd*``): those that labelled toxic texts share and clean ones lack, beyond what chance explains among so many
words.  Texts that are near copies of each other count once.  The outputs' weights are learned by logistic regression.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgap.llm.common import ship

SAMPLE = 20_000  # labelled rows that a model is fitted on at most, the first in the order of a hash of their ids
DENSITY = 100.0  # the weight per word counts as that of so many words
FALSE_SHARE = 0.1  # share of words that may be in the lexicon by chance
RIDGE = 0.05
STEMS = (6, 5, 4)  # letters of a stem; longer words are insults by their stem too, whatever ending they take

# Words of the grammar.
TARGETS = "you your you're u he she they them him her du dich dir ihr euch sie er tu toi te vous il elle ils eux usted ustedes tú ti él ella ellos".split()
NEGATIONS = "not no never don't isn't aren't wasn't nobody neither nor nicht kein keine keinen nie niemals pas jamais aucun ni nunca jamás tampoco".split()
REPORTS = "said says say told tells wrote writes quoted called claims claimed allegedly sagte sagt schrieb behauptet dit disait écrit dijo dice escribió".split()
THREATS = "kill hurt destroy beat murder shoot stab burn töten schlagen umbringen tuer frapper détruire brûler matar golpear destruir quemar".split()

# Endings that leave a threat what it is, in the languages of the lists.
ENDINGS = ("", "s", "es", "ed", "d", "ing", "t", "te", "ten", "st", "en", "e", "é", "ée", "és", "er", "ez", "ons", "ent", "ai", "era", "ado", "ando", "iendo", "aré", "eré", "iré", "ó", "o", "a", "as", "an")
PARTS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]|[\"«»“”]|,")
ENDS = set(".!?;:\n")
QUOTES = set("\"«»“”")
OUTPUTS = ("plain", "aimed", "negated", "reported", "threat", "aimed_threat", "void_threat")

# Grammar: state and symbol to the next state and, for insults (I) and threats (H), the output.
GRAMMAR = {
    (state, symbol): (
        {"T": {"start": "aimed"}, "N": {"start": "negated", "aimed": "negated"}, "R": {"start": "reported", "aimed": "reported", "negated": "reported"}, ",": {"negated": "start"}}
        .get(symbol, {})
        .get(state, state),
        {
            "I": {"start": "plain", "aimed": "aimed", "negated": "negated", "reported": "reported"}[state],
            "H": {"start": "threat", "aimed": "aimed_threat", "negated": "void_threat", "reported": "void_threat"}[state],
        }.get(symbol),
    )
    for state in ("start", "aimed", "negated", "reported")
    for symbol in "ITNRH,"
}

ship(__name__)


@dataclass
class Model:
    insults: dict[str, float]
    weights: list[float]  # of the outputs, of their density, and last the constant


def inflected(verb: str) -> set[str]:
    """Regular forms of a verb: its stem with each ending, a final consonant doubled or not."""
    stem = verb
    for ending in ("en", "er", "ar", "ir", "re", "e"):
        if verb.endswith(ending) and len(verb) - len(ending) >= 4:
            stem = verb[: -len(ending)]
            break
    stems = {verb, stem} | ({stem + stem[-1]} if stem[-1] in "bdgmnprt" else set())
    return {verb} | {s + ending for s in stems for ending in ENDINGS if len(s + ending) >= len(verb) - 1}


def transducer(insults: dict[str, float]) -> dict[str, tuple[str, float]]:
    """Word to symbol and weight; a learned insult takes precedence over the fixed lists."""
    table = {w: ("H", 1.0) for verb in THREATS for w in inflected(verb)}
    table |= {w: (symbol, 1.0) for symbol, group in (("H", THREATS), ("R", REPORTS), ("N", NEGATIONS), ("T", TARGETS)) for w in group}
    return table | {w: ("I", weight) for w, weight in insults.items()} | {q: ("R", 1.0) for q in QUOTES} | {",": (",", 0.0)}


def lowered(text: str) -> str:
    """Lower case with one kind of apostrophe."""
    return text.lower().replace("\u2019", "'").replace("\u02bc", "'")


def outputs(text: str, table: dict[str, tuple[str, float]]) -> list[float]:
    """What the composed transducers put on each output, and on all of them per word: logarithms of one plus the weights."""
    total = dict.fromkeys(OUTPUTS, 0.0)
    state, words = "start", 0
    for part in PARTS.findall(lowered(text)):
        if part in ENDS:
            state = "start"
            continue
        words += 1
        found = table.get(part)
        if found is None and len(part) > STEMS[-1]:
            for letters in STEMS:
                if letters < len(part):
                    found = table.get(part[:letters] + "*")
                    if found is not None:
                        break
        if found is not None:
            symbol, weight = found
            state, output = GRAMMAR[state, symbol]
            if output:
                total[output] += weight
    matched = sum(total.values())
    return [math.log1p(v) for v in (*total.values(), DENSITY * matched / max(words, 1))]


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """``(text, toxic)`` of labelled rows that are not held out; a doc_id labelled twice is toxic if any label says so."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    return docs.join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))  # at most ``limit`` rows


def learn_insults(rows: DataFrame) -> dict[str, float]:
    """Words whose share among toxic texts exceeds the general one beyond chance, with their log-odds less one error."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(*batch.columns):
                order = [w for w in PARTS.findall(lowered(text.as_py() or "")) if w[0].isalpha()]
                found = sorted(set(order) | {w[:k] + "*" for w in set(order) for k in STEMS if len(w) > k})
                if found:
                    columns = [pa.array(found), pa.array([toxic.as_py()] * len(found), pa.int32()), pa.array([sketch(order)] * len(found), pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["word", "toxic", "sketch"])

    # Near copies share a sketch, and count as one text.
    words = rows.select("text", "toxic").mapInArrow(split, "word string, toxic int, sketch bigint")
    texts = words.groupBy("toxic").agg(F.countDistinct("sketch").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in texts}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    if not toxic or not clean:
        return {}
    by_word = words.groupBy("word", "toxic").agg(F.countDistinct("sketch").alias("n"))
    by_word = by_word.groupBy("word").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n"))).alias("q"))
    by_word = by_word.select("word", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q")).where("p + q > 1").cache()
    tried = by_word.count()
    share, base = F.col("p") / (F.col("p") + F.col("q")), toxic / (toxic + clean)
    gain = F.col("p") * F.log(share / base) + F.when(F.col("q") > 0, F.col("q") * F.log((1 - share) / (1 - base))).otherwise(0.0)
    odds = F.log((F.col("p") + 0.5) / (toxic - F.col("p") + 0.5)) - F.log((F.col("q") + 0.5) / (clean - F.col("q") + 0.5))
    doubt = F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("q") + 0.5))
    leading = by_word.where(share > base).select("word", gain.alias("gain"), (odds - doubt).alias("weight")).where("weight > 0")
    # Words that fall short of the loosest bound of the rule below cannot enter; the others are few beside the sample.
    leading = leading.where(F.col("gain") >= -math.log(FALSE_SHARE)).orderBy(F.desc("gain"), "word").collect()
    # Benjamini and Hochberg: with exp(-gain) as chance of a word, take words while the expected share of false ones stays low.
    last = max((i for i, r in enumerate(leading, 1) if -r["gain"] <= math.log(i * FALSE_SHARE / tried)), default=0)
    by_word.unpersist()
    return {r["word"]: r["weight"] for r in leading[:last]}


def sketch(words: list[str], width: int = 4) -> int:
    """Smallest hash of ``width`` words in a row; near copies mostly share it, other texts hardly ever do."""
    return min(zlib.crc32(" ".join(words[i : i + width]).encode()) for i in range(max(1, len(words) - width + 1)))


def fit_weights(rows: DataFrame, insults: dict[str, float]) -> list[float]:
    """Ridge logistic regression of the label on the outputs, by Newton's method over the bounded sample."""
    table = transducer(insults)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [outputs(t.as_py() or "", table) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    # Equal rows are counted, so what comes to the driver is at most the sample.
    grouped = rows.select("text", "toxic").mapInArrow(features, "x array<double>, y int").groupBy("x", "y").count().orderBy("x", "y").collect()
    if not grouped:
        return [0.0] * (len(OUTPUTS) + 1) + [-2.0]
    x = np.array([[*r["x"], 1.0] for r in grouped])
    y, n = np.array([r["y"] for r in grouped], float), np.array([r["count"] for r in grouped], float)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        hessian = (x.T * (n * p * (1 - p))) @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    rows = training_rows(docs, labels).persist()
    insults = learn_insults(rows)
    weights = fit_weights(rows, insults)
    rows.unpersist()
    return Model(insults, weights)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs``; null texts count as empty, repeats stay."""
    table, weights = transducer(model.insults), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for value in batch.column(1):
                x = outputs(value.as_py() or "", table)
                z = sum(a * b for a, b in zip(x, weights)) + weights[-1]
                scores.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
