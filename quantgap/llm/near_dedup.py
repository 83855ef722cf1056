"""Near-duplicate detection by MinHash with tensored banding.

A text's set are its distinct five-word shingles.  Two small collections of ``BANDS`` keys, three minhashes each, are
taken of every set; a table key combines one of the first with one of the second.  ``2 * 3 * BANDS`` minhashes thus
serve ``BANDS * BANDS`` tables of six minhashes.  At the similarity asked for, 0.75, one band agrees with probability
0.75 ** 3, and a pair meets in no table with probability below ``2 * (1 - 0.42) ** BANDS``, 4e-6 for 24 bands.

Texts with equal sets form one class before anything else.  Table keys are only formed from band keys that another class
shares, so a unique text costs two short arrays.  In larger buckets the support of a class is counted, the shingles that
any other such class has too: a link needs three quarters of both sets' union to be common, so a class without that much
support for the sizes it meets has no link there and leaves the bucket.  The best supported class of a bucket is its
pivot; every class is compared with the pivot it shares most tables with, and classes that this joins need no further
comparison among each other.  Classes measured against one pivot have at most the smaller of their common shingles with it
in common inside it; where that is too little they must share shingles that the pivot lacks, and these are few: they meet
by the rarest of those.  What is left are buckets that span several components: their other pairs across components are
compared, and a bucket with many such pairs is first divided by fresh bands.  All links are confirmed on full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgap.llm.common import fresh_name, ship, small_side
from quantgap.session import cut_lineage

SHINGLE = 5
BAND = 3
BANDS = 24
FINE_LEVELS = 2  # sets of fresh bands that divide crowded buckets
CROWDED = 64  # pairs across components per row of a bucket, beyond which it is divided
SHARE = 75  # per cent
LARGER = 16  # rows of a bucket from which on support is counted
HEAVY = 256  # comparisons with one class, from which on it is copied and they are spread over the copies
MASK = (1 << 64) - 1
BLOCK = 8192

ship(__name__)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text; a text of fewer than five words is one shingle."""
    # On bytes, lower() and split() know ASCII only: A-Z, and blank, \t, \n, \v, \f, \r.
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    hashed = pd.util.hash_array(np.array(found, dtype=object), categorize=False)
    width = min(SHINGLE, len(hashed))
    total = np.full(len(hashed) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mixed(total * np.uint64(0x9E3779B97F4A7C15) + hashed[k : len(hashed) - width + 1 + k])
    return np.unique(total)


def _bands(hashes: np.ndarray, salt: int) -> np.ndarray:
    """``BANDS`` keys, each of ``BAND`` minhashes, as signed numbers; ``salt`` names the collection."""
    rng = np.random.default_rng(salt)
    odd, mask = (rng.integers(0, MASK, BAND * BANDS, dtype=np.uint64, endpoint=True) for _ in range(2))
    odd |= np.uint64(1)
    least = np.full(BAND * BANDS, MASK, np.uint64)
    for start in range(0, len(hashes), BLOCK):
        block = (hashes[start : start + BLOCK][None, :] ^ mask[:, None]) * odd[:, None]
        np.minimum(least, block.min(axis=1), out=least)
    least = least.reshape(BANDS, BAND)
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(salt * BANDS)
    for k in range(BAND):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[:, k])
    return key.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))


def _set_key(hashes: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", also: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *also, n_shingles, set_key, a, b)`` per row; set_key and bands are null for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, a, b = [], [], [], []
            for value in batch.column(len(names) - 1):
                hashes = shingle_hashes(value.as_py())
                sizes.append(len(hashes))
                keys.append(_set_key(hashes) if len(hashes) else None)
                a.append(_bands(hashes, 1) if len(hashes) else np.zeros(0, np.int64))
                b.append(_bands(hashes, 2) if len(hashes) else np.zeros(0, np.int64))
            columns = [*batch.columns[:-1], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), _lists(a), _lists(b)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names[:-1], "n_shingles", "set_key", "a", "b"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), *also, F.col(text).alias("text"))
    names = rows.columns
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names[:-1])
    return rows.mapInArrow(sign, f"{kinds}, n_shingles bigint, set_key binary, a array<bigint>, b array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(set_key, hashes, fine)`` of the classes in ``wanted (set_key, doc_id)``: whole sets, and fresh bands by level."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(value.as_py()) for value in batch.column(1)]
            fine = [np.concatenate([_bands(s, 3 + level) for level in range(FINE_LEVELS)]) for s in sets]
            columns = [batch.column(0), pa.array([_set_key(s) for s in sets], pa.binary()), _lists(sets), _lists(fine)]
            yield pa.RecordBatch.from_arrays(columns, names=["set_key", "own_key", "hashes", "fine"])

    rows = docs.join(wanted, "doc_id").select("set_key", "text")
    rows = rows.mapInArrow(expand, "set_key binary, own_key binary, hashes array<bigint>, fine array<bigint>")
    # A doc_id may stand for several texts; only the one with the class's set counts.
    return rows.where(F.col("set_key") == F.col("own_key")).drop("own_key").dropDuplicates(["set_key"])


def table_rows(classes: DataFrame) -> DataFrame:
    """``(key, set_key, n)`` for the tables in which a class can have a mate.

    Band keys that no other class has are left out before the two collections are combined.
    """
    sides = F.concat(
        F.transform("a", lambda v: F.struct(F.lit(0).alias("side"), v.alias("v"))),
        F.transform("b", lambda v: F.struct(F.lit(1).alias("side"), v.alias("v"))),
    )
    bands = classes.select("set_key", "n", F.explode(sides).alias("band")).select("set_key", "n", "band.*")
    shared = bands.groupBy("v").agg(F.count("*").alias("mates")).where("mates > 1").select("v")
    kept = bands.join(shared, "v").groupBy("set_key", "n").agg(
        F.collect_list(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.collect_list(F.when(F.col("side") == 1, F.col("v"))).alias("b")
    )
    return kept.select("set_key", "n", "b", F.explode("a").alias("va")).select(
        "set_key", "n", "va", F.explode("b").alias("vb")
    ).select(F.xxhash64("va", "vb").alias("key"), "set_key", "n")


def compatible(s: str | Column, m: str | Column, n: str | Column) -> Column:
    """``s`` common shingles, or more, are enough for sets of ``m`` and ``n``; and so may the sizes be."""
    return ((100 + SHARE) * F.col(s) if isinstance(s, str) else (100 + SHARE) * s) >= SHARE * (m + n)


def support(sets: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(set_key, s)`` of the chosen classes: how many of their shingles another chosen class has.

    Shingles are compared by half of their hash; a chance agreement can only raise ``s``, which stays an upper bound.
    """
    half = F.col("h").bitwiseAND(F.lit(0xFFFFFFFF)).cast("long")
    spread = sets.join(chosen, "set_key").select(F.xxhash64("set_key").alias("who"), F.explode("hashes").alias("h")).select("who", half.alias("h"))
    shared = spread.groupBy("h").agg(F.min("who").alias("a"), F.max("who").alias("b")).where("a <> b").select("h")
    counted = spread.join(shared, "h").groupBy("who").agg(F.count("*").alias("s"))
    return chosen.withColumn("who", F.xxhash64("set_key")).join(counted, "who", "left").select("set_key", F.coalesce("s", F.lit(0)).alias("s"))


def measured(pairs: DataFrame, sets: DataFrame, *more: Column) -> DataFrame:
    """The pairs ``(x, y)`` with the sizes of their full sets and of what they have in common: ``nx, ny, both``.

    ``more`` are further columns made of the sets ``hx`` and ``hy``.  A class that very many others are compared with is
    copied and its pairs are spread over the copies.
    """
    load = pairs.groupBy("y").agg(F.ceil(F.count("*") / HEAVY).cast("int").alias("copies")).where("copies > 1")
    load = cut_lineage(load, "load")
    load = small_side(load, load.count(), 64)
    spread = pairs.join(load, "y", "left")
    spread = spread.select("x", "y", F.pmod(F.xxhash64("x"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt"))
    left = sets.select(F.col("set_key").alias("x"), F.col("hashes").alias("hx"))
    right = sets.select(F.col("set_key").alias("y"), F.col("hashes").alias("hy")).join(load, "y", "left")
    right = right.select("y", "hy", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt"))
    joined = spread.join(left, "x").join(right, ["y", "salt"])
    return joined.select("x", "y", F.size("hx").alias("nx"), F.size("hy").alias("ny"), F.size(F.array_intersect("hx", "hy")).alias("both"), *more)


def linked(pairs: DataFrame) -> DataFrame:
    """Measured pairs that are similar enough."""
    return pairs.where(100 * F.col("both") >= SHARE * (F.col("nx") + F.col("ny") - F.col("both"))).select("x", "y")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (x, y)``: root is the smallest node that can be reached.

    Large and small star steps alternate until no edge changes; a node with very many links meets its minimum in a
    pre-aggregated table, its links are never gathered.
    """
    edges = cut_lineage(links.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()
        before = mark
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", "m")).distinct()
        edges = cut_lineage(small, "edges")


def _spanning(rows: DataFrame) -> DataFrame:
    """The rows of the buckets that span several components."""
    rows = cut_lineage(rows, "rows")
    root = F.xxhash64("root")  # numbers are aggregated without a sort
    keys = rows.groupBy("key").agg(F.min(root).alias("a"), F.max(root).alias("b")).where("a <> b").select("key")
    keys = cut_lineage(keys, "spans")
    return cut_lineage(rows.join(small_side(keys, keys.count(), 64), "key"), "spanning")


def _across(rows: DataFrame) -> DataFrame:
    """Bucket keys with pairs across components that ``_pairs`` can make: ``(key, crowd)``, crowd in such pairs per row.

    Of two classes with one pivot both must be ``able``, share enough with it for the least mate they can have.
    """
    square = lambda name: F.sum(F.col(name) * F.col(name))
    parts = rows.groupBy("key", F.coalesce("c", "set_key").alias("g"), "root").agg(F.count("*").alias("m"), F.count_if("able").alias("a"))
    by_pivot = parts.groupBy("key", "g").agg(F.sum("m").alias("m"), F.sum("a").alias("a"), (square("m") - square("a")).alias("inside"))
    by_pivot = by_pivot.groupBy("key").agg(F.sum("m").alias("rows"), (square("m") - square("a") - F.sum("inside")).alias("unable"))
    by_root = parts.groupBy("key", "root").agg(F.sum("m").alias("m")).groupBy("key").agg(square("m").alias("inside"), F.count("*").alias("roots"))
    pairs = (F.col("rows") * F.col("rows") - F.col("inside") - F.col("unable")) / 2
    return by_root.where("roots > 1").join(by_pivot, "key").where(pairs > 0).select("key", (pairs / F.col("rows")).alias("crowd"))


def _pairs(rows: DataFrame) -> DataFrame:
    left = rows.select("key", F.col("set_key").alias("x"), F.col("root").alias("rx"), F.col("n").alias("nx"), F.col("s").alias("sx"), F.col("c").alias("cx"), F.col("i").alias("ix"))
    right = rows.select("key", F.col("set_key").alias("y"), F.col("root").alias("ry"), F.col("n").alias("ny"), F.col("s").alias("sy"), F.col("c").alias("cy"), F.col("i").alias("iy"))
    # Two classes measured against one pivot that need shingles outside it are found by ``beside_pivot``.
    most = F.when(F.col("cx") == F.col("cy"), F.least("sx", "sy", "ix", "iy")).otherwise(F.least("sx", "sy"))
    possible = compatible(most, F.col("nx"), F.col("ny"))
    met = left.join(right, "key").where((F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & possible)
    return met.select("x", "y").distinct()


def beside_pivot(members: DataFrame) -> DataFrame:
    """Pairs ``(x, y)`` of ``members (set_key, n, c, i, out, root)`` that only shingles beside their pivot can link.

    ``c`` is the pivot, ``i`` the shingles shared with it, ``out`` those it lacks.  Two members of one pivot share at most
    the smaller ``i`` inside it; a pair that needs ``k`` more has ``k`` in common of what both have beside it.  With these
    in one order, rarest first, a member that needs ``k`` with its smallest possible mate meets that mate in all but its
    last ``k - 1``, and from the first that agrees there are ``k`` left on either side.  Only members outside a pivot's
    largest component ask; it answers.
    """
    by_root = members.groupBy("c", "root").agg(F.count("*").alias("m"), F.min("n").alias("least"))
    clusters = by_root.groupBy("c").agg(F.max(F.struct("m", "root"))["root"].alias("main"), F.min("least").alias("least"), F.count("*").alias("roots"))
    mate = F.greatest(F.expr(f"({SHARE} * n + 99) div 100"), F.col("least"))
    rows = members.join(clusters.where("roots > 1").drop("roots"), "c").withColumn("need", F.greatest(F.lit(1), _least_common(F.col("n"), mate) - F.col("i")))
    rows = rows.where(F.size("out") >= F.col("need"))
    spread = rows.select("set_key", "c", F.explode("out").alias("h"))
    often = spread.groupBy("c", "h").agg(F.count("*").alias("df")).where("df > 1")
    listed = spread.join(often, ["c", "h"]).groupBy("set_key").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("list"))
    rows = rows.drop("out").join(listed, "set_key").withColumn("r", F.size("list")).where(F.col("r") >= F.col("need"))
    prefix = F.expr("slice(list, 1, cast(r - need + 1 as int))")
    rows = rows.select("c", "set_key", "n", "i", "r", "root", (F.col("root") == F.col("main")).alias("inside"), F.posexplode(prefix).alias("at", "e"))
    rows = cut_lineage(rows.select("c", F.col("e.h").alias("h"), "set_key", "n", "i", "root", "inside", (F.col("r") - F.col("at")).alias("rest")), "beside")
    side = lambda end: [F.col(name).alias(name + end) for name in ("set_key", "n", "i", "root", "inside", "rest")]
    joined = rows.where("NOT inside").select("c", "h", *side("x")).join(rows.select("c", "h", *side("y")), ["c", "h"])
    sized = 100 * F.least("nx", "ny") >= SHARE * F.greatest("nx", "ny")
    need = _least_common(F.col("nx"), F.col("ny")) - F.least("ix", "iy")
    once = F.col("insidey") | (F.col("set_keyx") < F.col("set_keyy"))
    met = joined.where(once & (F.col("rootx") != F.col("rooty")) & sized & (need >= 1) & (F.least("restx", "resty") >= need))
    return met.select(F.least("set_keyx", "set_keyy").alias("x"), F.greatest("set_keyx", "set_keyy").alias("y")).distinct()


def _least_common(m: Column, n: Column) -> Column:
    """The fewest common shingles that link sets of ``m`` and ``n``."""
    return F.ceil(SHARE * (m + n) / (100 + SHARE))


def link_classes(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Components of linked classes, ``(node, root)``; ``classes`` holds ``(set_key, rep, n, a, b)``."""
    tables = cut_lineage(table_rows(classes), "tables")
    counts = tables.groupBy("key").agg(F.count("*").alias("rows"), F.min("n").alias("least")).where("rows > 1")
    buckets = cut_lineage(tables.join(counts, "key"), "buckets")
    wanted = cut_lineage(buckets.select("set_key").distinct().join(classes.select("set_key", F.col("rep").alias("doc_id")), "set_key"), "wanted")
    sets = cut_lineage(full_sets(docs, small_side(wanted, wanted.count(), 64)), "sets")
    backed = cut_lineage(support(sets, buckets.where(F.col("rows") > LARGER).select("set_key").distinct()), "support")
    known = buckets.join(backed, "set_key", "left").select(
        # Mates in a smaller bucket need not have been counted, so support speaks for the larger ones only.
        "key", "set_key", "n", "least", F.when(F.col("rows") > LARGER, F.coalesce("s", "n")).otherwise(F.col("n")).alias("s")
    )
    # The smallest mate a class can have here has the bucket's least size, or three quarters of its own.
    mate = F.greatest(F.col("least"), F.col("n") * SHARE / 100)
    buckets = cut_lineage(known.where(compatible("s", F.col("n"), mate)), "buckets")
    pivots = buckets.groupBy("key").agg(F.count("*").alias("rows"), F.max(F.struct(F.col("s") / F.col("n"), "set_key"))["set_key"].alias("pivot"))
    star = buckets.join(pivots.where("rows > 1").select("key", "pivot"), "key").where(F.col("set_key") != F.col("pivot"))
    star = star.groupBy("set_key", "pivot").agg(F.count("*").alias("tables"))
    star = star.groupBy("set_key").agg(F.max(F.struct("tables", "pivot")).alias("best"))
    star = cut_lineage(star.select(F.col("set_key").alias("x"), F.col("best.pivot").alias("y")), "chosen")
    star = cut_lineage(measured(star, sets, F.array_except("hx", "hy").alias("out")), "star")
    first = linked(star)
    # Pivots whose shingles were counted bound what the classes measured against them can share; they themselves lie at it.
    members = star.join(backed.select(F.col("set_key").alias("y")), "y").select(
        F.col("x").alias("set_key"), F.col("nx").alias("n"), F.col("y").alias("c"), F.col("both").alias("i"), "out"
    )
    seen = members.select("set_key", "c", "i")
    centres = seen.select(F.col("c").alias("set_key")).distinct().join(star.select(F.col("x").alias("set_key")), "set_key", "left_anti")
    seen = cut_lineage(seen.union(centres.select("set_key", F.col("set_key").alias("c"), F.lit(None).cast("int").alias("i"))), "seen")
    placed = buckets.join(seen, "set_key", "left").select("key", "set_key", "n", "s", "c", F.coalesce("i", "n").alias("i"), "least")
    placed = placed.withColumn("able", compatible("i", F.col("n"), mate)).drop("least")
    roots = components(first)
    rows = with_root(placed, roots)
    found = [cut_lineage(beside_pivot(cut_lineage(with_root(members, roots), "members")), "met")]
    for level in range(FINE_LEVELS + 1):
        rows = _spanning(rows)
        spans = cut_lineage(_across(rows), "across")
        calm = spans if level == FINE_LEVELS else spans.where(F.col("crowd") <= CROWDED)
        found.append(cut_lineage(_pairs(rows.join(calm.select("key"), "key")), "met"))
        if level < FINE_LEVELS:
            crowded = rows.join(spans.where(F.col("crowd") > CROWDED).select("key"), "key")
            fine = sets.select("set_key", F.explode(F.slice("fine", level * BANDS + 1, BANDS)).alias("band"))
            rows = crowded.join(fine, "set_key").select(F.xxhash64("key", "band").alias("key"), "set_key", "n", "s", "c", "i", "able", "root")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    second = linked(measured(cut_lineage(pairs.distinct(), "pairs"), sets))
    return components(first.union(second))


def with_root(rows: DataFrame, roots: DataFrame) -> DataFrame:
    joined = rows.join(roots.withColumnRenamed("node", "set_key"), "set_key", "left")
    return joined.select(*rows.columns, F.coalesce("root", "set_key").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` per row: component_id is the smallest doc_id that links lead to.

    Texts without words are linked with nothing.  Rows without doc_id are linked with nothing either and are kept.  One
    doc_id may stand on several rows; each row belongs to the component of its own text.
    """
    return _judged(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "n_shingles", "component_id", "kept")


def _judged(narrow: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """``near_duplicates`` with the columns ``also`` and ``root``, the group of the row's text: null without words."""
    signed = cut_lineage(signatures(narrow, also=also), "signatures")
    classes = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    classes = cut_lineage(classes, "classes")
    roots = cut_lineage(link_classes(classes, narrow), "roots")
    named = roots.join(classes.select(F.col("set_key").alias("node"), "rep"), "node")
    ids = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = named.join(ids, "root").select(F.col("node").alias("set_key"), "component_id", "root")
    lone = classes.where("copies > 1").join(roots.select(F.col("node").alias("set_key")), "set_key", "left_anti").select("set_key", F.col("rep").alias("component_id"), F.col("set_key").alias("root"))
    named = signed.select("doc_id", *also, "n_shingles", "set_key").join(linked.union(lone), "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return named.select("doc_id", *also, "n_shingles", component.alias("component_id"), kept.alias("kept"), F.coalesce("root", "set_key").alias("root"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; columns unchanged.

    Rows that repeat an id are judged by their own texts: unlike texts all stay.  Of near copies under one id the one
    with the smallest digest stays, of rows alike in id and text one.  Rows without id stay.
    """
    mark = fresh_name(docs, "_digest")
    marked = docs.withColumn(mark, F.md5(F.col(text).cast("binary")))
    narrow = marked.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(mark).alias("digest"))
    judged = cut_lineage(_judged(narrow, ("digest",)), "judged")
    # Texts without words have no group; each is one of its own.
    kept = judged.where("kept AND doc_id IS NOT NULL")
    again = kept.groupBy("doc_id", "root", F.when(F.col("root").isNull(), F.col("digest")).alias("alone")).agg(F.count("*").alias("rows"), F.min("digest").alias("least"))
    again = cut_lineage(again.where("rows > 1").select("doc_id", "root", "least"), "again")
    repeats = again.count()
    gone = judged.where("NOT kept").select("doc_id", "digest")
    if repeats:
        others = kept.join(small_side(again.where("root IS NOT NULL"), repeats, 128), ["doc_id", "root"]).where("digest <> least")
        gone = gone.union(others.select("doc_id", "digest"))
    gone = cut_lineage(gone.distinct(), "gone")
    gone = small_side(gone.select(F.col("doc_id").alias(doc_id), F.col("digest").alias(mark)), gone.count(), 64)
    rest = marked.join(gone, [doc_id, mark], "left_anti").select(*docs.columns, mark)
    if not repeats:
        return rest.select(*docs.columns)
    alike = small_side(again.select(F.col("doc_id").alias("_again_id"), F.col("least").alias("_again_digest")), repeats, 64)
    same = (F.col(doc_id) == F.col("_again_id")) & F.col(mark).eqNullSafe(F.col("_again_digest"))
    # Rows alike in id and text may differ elsewhere; the choice among them is the same on every run.
    row = F.struct(*docs.columns)
    one = rest.join(alike, same, "left_semi").groupBy(doc_id, mark).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")
    return rest.join(alike, same, "left_anti").select(*docs.columns).union(one)
