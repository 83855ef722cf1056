import random

from pyspark.sql import functions as F

from quantgap.llm import periodic_runs as p
from tests.llm.helpers import docs, prose, rows


def brute(words):
    """All runs by definition: maximal stretches of every period, the smallest period of each."""
    found = {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        start = None
        for i in range(n - q + 1):
            same = i < n - q and words[i] == words[i + q]
            if same and start is None:
                start = i
            if not same and start is not None:
                length = i + q - start
                if length >= max(6, 4 * q):
                    found.setdefault((start, length), q)
                start = None
    return sorted((s, q, length) for (s, length), q in found.items())


def shortened(words, runs):
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(11)
    made = [None, "", " \n ", "a", "a a a a a", "a a a a a a", "é b " * 40, "A a " * 9, "x" * 100_000]
    for size in (8, 13, 30, 64, 131, 300):
        for letters in (1, 2, 3, 40):
            made.append(" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:letters] if letters < 27 else [f"w{k}" for k in range(letters)]) for _ in range(size)))
    for _ in range(60):  # blocks that repeat, with rests, errors and repeats inside repeats
        words = prose(rng.random(), rng.randrange(0, 30)).split()
        for _ in range(rng.randrange(1, 4)):
            inner = [rng.choice("ab") for _ in range(rng.randrange(1, 4))] * rng.choice([1, 1, 4, 9])
            block = inner + prose(rng.random(), rng.randrange(0, 40)).split()
            words += block * rng.randrange(2, 9) + block[: rng.randrange(len(block) + 1)]
            if rng.random() < 0.4:
                words[rng.randrange(len(words))] = "odd"
        made.append(" ".join(words))
    made.append("one " * 5000)
    made.append(prose(1, 700) + " " + (prose(2, 300) + " ") * 5 + prose(3, 100))
    return made


def test_runs_and_collapse_equal_brute_force(spark):
    made = texts()
    got = p.find_runs(docs(spark, made).repartition(3), ["doc_id"]).orderBy("doc_id").collect()
    for row, text in zip(got, made):
        words = (text or "").split()
        runs = brute(words)
        assert [(r.start, r.period, r.length) for r in row.runs] == runs, text
        assert (row.n_words, row.collapsed) == (len(words), shortened(words, runs))
    assert sum(len(r.runs) > 0 for r in got) > 50


def test_small_groups_of_tiles_are_stitched(spark, monkeypatch):
    monkeypatch.setattr(p, "GROUP", 1)
    made = texts()[5:70]
    got = p.find_runs(docs(spark, made), ["doc_id"]).orderBy("doc_id").collect()
    assert [[(r.start, r.period, r.length) for r in row.runs] for row in got] == [brute(t.split()) for t in made]


def test_tiles_do_not_depend_on_neighbours():
    words = [p.split_words(t) for t in texts()]
    together = p.tiles(words)[1]
    assert together == [p.tiles([w])[1][0] for w in words]
    assert p.tiles([]) == ([], [])


def test_pieces_of_text_leave_results_alone(spark, monkeypatch):
    table = docs(spark, texts()).coalesce(1)
    whole = sorted(rows(p.find_runs(table, ["doc_id"]), "doc_id", "collapsed"))
    monkeypatch.setattr(p, "PIECE", 50)
    assert sorted(rows(p.find_runs(table, ["doc_id"]), "doc_id", "collapsed")) == whole


def test_names_repeats_and_empty_tables(spark):
    table = docs(spark, ["a b " * 6, "a b " * 6, None], [None, None, 3]).select("doc_id", "text", F.lit(1).alias("runs"), F.lit("x").alias("row_key"))
    got = p.find_runs(table, ["doc_id", "runs", "row_key", "text"])
    assert got.columns == ["doc_id", "runs", "row_key", "text", "n_words", "_runs", "collapsed"]
    assert sorted(rows(got, "doc_id", "runs", "row_key", "n_words", "collapsed"), key=str) == [(3, 1, "x", 0, ""), (None, 1, "x", 12, "a b"), (None, 1, "x", 12, "a b")]
    assert p.find_runs(table.limit(0), ["doc_id"]).count() == 0


def test_divisors():
    assert [sorted(p.divisors(q)) for q in (1, 2, 7, 12, 30, 49)] == [[], [1], [1], [4, 6], [6, 10, 15], [7]]
