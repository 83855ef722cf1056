import random

import numpy as np
from pyspark.sql import functions as F

from quantgap.llm import near_dedup as n
from tests.llm.helpers import docs, prose, rows


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(pairs):
    """doc_id to smallest linked id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in pairs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return [(i, len(sets[i]), find(i), find(i) == i) for i in ids]


def corpus():
    rng = random.Random(4)
    texts = [None, "", " ", "one two", "ONE two", "one  two three four", prose(1, 8000), prose(1, 8000) + " tail"]
    for g in range(12):
        base = prose(100 + g, 120, 5000).split()
        for c in range(1 + g * 2):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10_000)}"
            texts.append(" ".join(copy))
    passage = prose(9, 60, 5000)
    texts += [passage + " " + prose(500 + i, 90, 5000) for i in range(120)]
    return texts


def test_components_equal_brute_force(spark):
    pairs = list(enumerate(corpus(), 1))
    got = n.near_duplicates(docs(spark, [t for _, t in pairs]).repartition(5))
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id", "kept")) == brute(pairs)


def test_crowded_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(n, "CROWDED", 1)
    pairs = list(enumerate(corpus(), 1))
    got = n.near_duplicates(docs(spark, [t for _, t in pairs]))
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id", "kept")) == brute(pairs)


def test_chains_and_stars(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)], "x bigint, y bigint")
    assert sorted(rows(n.components(links), "node", "root")) == [(i, 0) for i in range(61)] + [(k, 100) for k in range(100, 140)]
    assert n.components(links.limit(0)).count() == 0


def test_bands_agree_as_often_as_similarity_says():
    rng = np.random.default_rng(5)
    hits = total = 0
    for _ in range(60):
        shared = rng.integers(0, 2**63, 600, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 2**63, 100, dtype=np.uint64)])) for _ in range(2))
        hits += int((n._bands(a, 1) == n._bands(b, 1)).sum())
        total += n.BANDS
    assert abs(hits / total - 0.75**3) < 0.05


def test_rows_without_id_repeats_and_columns(spark):
    text = prose(3, 80)
    table = docs(spark, [text, text, text, text, None, prose(4, 80)], [5, 5, 9, None, 6, 7]).withColumn("set_key", F.lit("x"))
    got = n.near_duplicates(table)
    assert sorted(rows(got, "doc_id", "component_id", "kept"), key=str) == [(5, 5, True), (5, 5, True), (6, 6, True), (7, 7, True), (9, 5, False), (None, None, True)]
    left = n.keep_one(table)
    assert left.columns == table.columns and sorted(rows(left, "doc_id"), key=str) == [(5,), (6,), (7,), (None,)]
    assert n.keep_one(table.limit(0)).count() == 0


def test_unlike_texts_under_one_id_stay(spark):
    near = prose(3, 80)
    copy = near.rsplit(" ", 1)[0] + " tail"
    lone = [prose(50 + i, 60, 5000) for i in range(30)]
    own = prose(90, 80, 5000)
    pairs = [(1, near), (5, copy), *[(5, t) for t in lone], (5, lone[0]), (7, own), (7, own + " tail"), (7, own), (8, None), (8, None), (8, " "), (None, near)]
    table = docs(spark, [t for _, t in pairs], [i for i, _ in pairs])
    got = sorted(rows(n.keep_one(table), "doc_id", "text"), key=str)
    either = [sorted([(1, near), *[(5, t) for t in lone], (7, t), (8, None), (8, " "), (None, near)], key=str) for t in (own, own + " tail")]
    assert got in either
    assert sorted(rows(n.keep_one(table.repartition(7)), "doc_id", "text"), key=str) == got


def test_pairs_beside_a_pivot_lose_no_link(spark):
    """Members of two pivots with edits of their own, edits shared by few, and parts the pivot lacks itself."""
    rng = random.Random(11)
    members, sets = [], {}
    for c in range(2):
        core = list(range(c * 10_000, c * 10_000 + 100))
        pivot = set(core[: 100 - 3 * c])
        families = [[rng.randrange(10**6, 2 * 10**6) for _ in range(rng.randrange(4, 14))] for _ in range(25)]
        for k in range(160):
            family = families[rng.randrange(25)]
            hashes = set(core) - set(rng.sample(core, rng.randrange(0, 12))) - set(core[: len(family)]) | set(family)
            hashes |= {rng.randrange(10**9, 10**10) for _ in range(rng.randrange(0, 5))}
            key = f"{c}-{k}".encode()
            sets[key] = hashes
            linked = 100 * len(hashes & pivot) >= 75 * len(hashes | pivot)
            members.append((bytearray(key), len(hashes), f"p{c}", len(hashes & pivot), sorted(hashes - pivot), b"top" if linked else key))
    table = spark.createDataFrame(members, "set_key binary, n bigint, c string, i int, out array<bigint>, root binary")
    got = {(bytes(x), bytes(y)) for x, y in rows(n.beside_pivot(table), "x", "y")}
    known = {bytes(m[0]): (m[2], m[3], bytes(m[5])) for m in members}
    expected = set()
    for x in sets:
        for y in sets:
            (cx, ix, rx), (cy, iy, ry) = known[x], known[y]
            common = len(sets[x] & sets[y])
            if x < y and cx == cy and rx != ry and 100 * common >= 75 * len(sets[x] | sets[y]) and 175 * min(ix, iy) < 75 * (len(sets[x]) + len(sets[y])):
                expected.add((x, y))
    assert len(expected) > 50 and expected <= got and len(got) < 160 * 159 / 2
    assert n.beside_pivot(table.limit(0)).count() == 0


def test_only_buckets_that_span_components_reach_the_pair_stage(spark, monkeypatch):
    seen = []

    def spy(rows, real=n._across):
        seen.append(rows.groupBy("key").agg(F.count_distinct("root").alias("roots")).agg(F.count("*"), F.min("roots")).first())
        return real(rows)

    monkeypatch.setattr(n, "_across", spy)
    pairs = list(enumerate(corpus(), 1))
    got = n.near_duplicates(docs(spark, [t for _, t in pairs]))
    assert sorted(rows(got, "doc_id", "n_shingles", "component_id", "kept")) == brute(pairs)
    assert seen[0][0] > 0 and all(keys == 0 or roots > 1 for keys, roots in seen)
