"""Periodic runs of words, found in scale-tiled pieces.

A run is a stretch of words with smallest period ``q``, of at least ``max(6, 4 * q)`` words, that no neighbour extends.
Periods are taken by octaves ``[S, 2 * S)``.  For an octave a text has a boundary every ``2 * S`` words, and a run of the
octave covers ``reach(q)`` words from the first boundary in it.  The tile of a boundary are ``2 * S`` words before it and
``8 * S`` after it: tiles overlap so far that the first boundary of a run sees its start, the last one its end, and
neighbours see a period of it in common.

1. Fingerprints of blocks of ``S`` words, each octave's made of the former's, tell for all boundaries of all texts of a
   batch at which distances the block returns; only tiles where one does can hold a run.  Texts without any are done.
2. The others are written with their tiles, and the tiles, a row each (those of small octaves in groups that lie side by
   side), are dealt over the cluster, so that a very long text is not one task's work.
3. A tile is solved alone: the Z-function from its boundary to the right and the one to the left give the stretch of
   every period around the boundary.  A period whose block at the boundary is itself a power is none.
4. Stretches are shuffled by text and period, and those that share a period's length are one.

Each row of the table is a text of its own, whatever its id: copies meet in no shuffle, and no key is larger than one
text's stretches.  Null counts as empty; texts of fewer than six words have no run.  Work grows with ``n log n``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quantgap.llm.common import fresh_name, ship
from quantgap.session import cut_lineage

SHORTEST, REPEATS = 6, 4
GROUP = 256  # words whose boundaries travel as one row where octaves are small
PIECE = 4 << 20  # bytes of text that are fingerprinted together

ship(__name__)

RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


def split_words(text: str | None) -> list[bytes]:
    """Words of a text: on bytes, split() knows ASCII white space only."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def reach(q: np.ndarray | int, octave: int) -> np.ndarray | int:
    """Words that a run of period ``q`` covers, at least, from the first boundary in it."""
    return np.maximum(SHORTEST, REPEATS * q) - 2 * octave + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def boundaries(codes: np.ndarray, lengths: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(octave, text, boundary)`` arrays of the tiles that can hold a run; texts lie one after the other in ``codes``.

    A boundary counts from the start of its text, so that the tiles of a text do not depend on its neighbours.
    """
    found = []
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    prints = _mixed(codes.astype(np.uint64) + np.uint64(1))
    octave = 1
    while True:
        fit = np.flatnonzero(lengths >= max(SHORTEST, REPEATS * octave))
        if not len(fit):
            return found
        # The smallest reach of the octave says which boundaries need a look.
        counts = (lengths[fit] - reach(octave, octave)) // (2 * octave) + 1
        text = np.repeat(fit, counts)
        local = (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)) * 2 * octave
        ends = starts[text] + lengths[text]
        hit = np.zeros(len(text), bool)
        for q in range(octave, 2 * octave) if octave <= 64 else ():
            hit |= _returns(prints, starts[text] + local, ends, q, octave)
        if octave > 64:  # few boundaries, many distances: each boundary looks at all of them at once
            for k in range(len(text)):
                q = np.arange(octave, 2 * octave)
                hit[k] = _returns(prints, starts[text[k]] + local[k], ends[k], q, octave).any()
        found.append((octave, text[hit], local[hit]))
        prints = _mixed(prints[:-octave] * np.uint64(0x9E3779B97F4A7C15) + prints[octave:])
        octave *= 2


def _returns(prints: np.ndarray, at: np.ndarray | int, end: np.ndarray | int, q: np.ndarray | int, octave: int) -> np.ndarray:
    """Whether the first and the last block of what a run covers from ``at`` come again ``q`` words later."""
    last = reach(q, octave) - octave
    inside = at + last + octave <= end
    top = len(prints) - 1
    first = prints[np.minimum(at, top)] == prints[np.minimum(at + q, top)]
    return inside & first & (prints[np.minimum(at + last - q, top)] == prints[np.minimum(at + last, top)])


def tiles(words: list[list[bytes]]) -> tuple[list[np.ndarray], list[list[tuple[int, int, int, list[int]]]]]:
    """Per text its words as numbers, and its tile groups ``(octave, low, high, boundaries)``; no groups, no run."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = [word for text in words for word in text]
    codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int32) if flat else np.zeros(0, np.int32)
    groups: list[list[tuple[int, int, int, list[int]]]] = [[] for _ in words]
    for octave, text, local in boundaries(codes, lengths):
        if not len(text):
            continue
        block = local // max(2 * octave, GROUP)
        cuts = np.flatnonzero((np.diff(text) != 0) | (np.diff(block) != 0)) + 1
        for owner, marks in zip(text[np.concatenate([[0], cuts])], np.split(local, cuts)):
            low, high = max(0, int(marks[0]) - 2 * octave), min(int(lengths[owner]), int(marks[-1]) + 8 * octave)
            groups[owner].append((octave, low, high, [int(m) - low for m in marks]))
    return np.split(codes, np.cumsum(lengths)[:-1]) if len(words) else [], groups


def z_values(s: list[int], upto: int) -> list[int]:
    """How far ``s`` from each place below ``upto`` agrees with ``s`` from its start."""
    n = len(s)
    z = [n] + [0] * (upto - 1)
    left = right = 0
    for i in range(1, upto):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def divisors(q: int) -> list[int]:
    """``q`` divided by each of its prime factors."""
    found, rest, p = [], q, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            found.append(q // p)
            while rest % p == 0:
                rest //= p
        p += 1
    return found


def stretches(codes: list[int], octave: int, marks: list[int]) -> dict[int, list[list[int]]]:
    """Period to stretches ``[start, end]`` around the boundaries ``marks`` of one group of tiles."""
    found: dict[int, list[list[int]]] = {}
    for b in marks:
        right = codes[b : b + 8 * octave]
        z = z_values(right, min(2 * octave, len(right)))
        fits = [q for q in range(octave, len(z)) if q + z[q] >= reach(q, octave) and all(z[d] < q - d for d in divisors(q))]
        if not fits:
            continue
        before = codes[max(0, b - 2 * octave) : b][::-1]
        # From the boundary to the left: the words before it against the words before it moved by a period.
        turned = codes[max(0, b - 2 * octave) : b + 2 * octave - 1][::-1]
        missing = 2 * octave - 1 - len(codes[b : b + 2 * octave - 1])
        z_left = z_values([*before, -1, *turned], len(before) + 1 + octave)
        for q in fits:
            ahead = z_left[len(before) + 1 + 2 * octave - 1 - q - missing] if before else 0
            start, end = b - ahead, b + q + z[q]
            pieces = found.setdefault(q, [])
            if pieces and start + q <= pieces[-1][1]:
                pieces[-1][1] = max(pieces[-1][1], end)
            else:
                pieces.append([start, end])
    return found


def solve(rows: DataFrame) -> DataFrame:
    """``(row_key, period, start, end)`` of the stretches in tile groups ``(row_key, octave, low, marks, codes)``."""

    def solve_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for key, octave, low, marks, codes in zip(*(column.to_pylist() for column in batch.columns)):
                for q, pieces in stretches(codes, octave, marks).items():
                    out.extend((key, q, low + start, low + end) for start, end in pieces)
            columns = zip(*out) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["row_key", "period", "start", "end"])

    return rows.select("row_key", "octave", "low", "marks", "codes").mapInArrow(solve_batches, "row_key bigint, period bigint, start bigint, end bigint")


def stitch(pieces: DataFrame) -> DataFrame:
    """``(row_key, runs)``: stretches of one text and period that share a period's length are one; long ones are runs."""
    order = W.partitionBy("row_key", "period").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    opened = pieces.withColumn("opens", F.when(before - F.col("start") >= F.col("period"), 0).otherwise(1))
    island = opened.withColumn("island", F.sum("opens").over(order.rowsBetween(W.unboundedPreceding, 0)))
    whole = island.groupBy("row_key", "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    runs = whole.where(F.col("end") - F.col("start") >= F.greatest(F.lit(SHORTEST), REPEATS * F.col("period")))
    run = F.struct("start", "period", (F.col("end") - F.col("start")).alias("length"))
    return runs.groupBy("row_key").agg(F.sort_array(F.collect_list(run)).alias("runs"))  # a text's own runs


def collapsed(words: list[bytes], runs: list[dict] | None) -> str:
    """The words that no run repeats, joined by one space: of a run its first period stays, unless another run drops it."""
    change = np.zeros(len(words) + 1, np.int64)
    for run in runs or ():
        change[run["start"] + run["period"]] += 1
        change[run["start"] + run["length"]] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept]).decode("utf-8", "surrogatepass")


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[list[bytes]]]]:
    """A batch in parts of limited text, with the words of the last column."""
    start, size, words = 0, 0, []
    for i, value in enumerate(batch.column(batch.num_columns - 1)):
        text = value.as_py()
        words.append(split_words(text))
        size += len(text or "")
        if size >= PIECE or i + 1 == batch.num_rows:
            yield batch.slice(start, i + 1 - start), words
            start, size, words = i + 1, 0, []


def find_runs(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``n_words``, ``runs`` (start, period, length, in this order) and ``collapsed`` per row.

    A name of these that ``keep`` has already gets underscores in front.
    """
    inner = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, inner)], F.col(text).cast("string").alias("text"))
    kinds = rows.schema

    def shape(names: list[str], ddl: str) -> StructType:
        return StructType([kinds[name] for name in names] + StructType.fromDDL(ddl).fields)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _pieces(batch):
                codes, groups = tiles(words)
                rows_of = [i for i, g in enumerate(groups) if g]
                listed = [[dict(zip(("octave", "low", "high", "marks"), g)) for g in groups[i]] for i in rows_of]
                kind = pa.list_(pa.struct([("octave", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("marks", pa.list_(pa.int32()))]))
                columns = [*part.take(pa.array(rows_of, pa.int64())).columns, pa.array([codes[i] for i in rows_of], pa.list_(pa.int32())), pa.array(listed, kind)]
                yield pa.RecordBatch.from_arrays(columns, names=[*inner, "text", "codes", "tiles"])

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _pieces(batch):
                _, groups = tiles(words)
                rows_of = [i for i, g in enumerate(groups) if not g]
                counts = pa.array([len(words[i]) for i in rows_of], pa.int64())
                texts = pa.array([collapsed(words[i], None) for i in rows_of], pa.string())
                columns = [*part.take(pa.array(rows_of, pa.int64())).columns[:-1], counts, texts]
                yield pa.RecordBatch.from_arrays(columns, names=[*inner, "n_words", "collapsed"])

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [split_words(value.as_py()) for value in batch.column(len(inner))]
            texts = [collapsed(w, runs.as_py()) for w, runs in zip(words, batch.column(len(inner) + 1))]
            columns = [*batch.columns[: len(inner)], batch.column(len(inner) + 1), pa.array([len(w) for w in words], pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*inner, "runs", "n_words", "collapsed"])

    listed = "text string, codes array<int>, tiles array<struct<octave: int, low: bigint, high: bigint, marks: array<int>>>"
    open_rows = rows.mapInArrow(apart, shape(inner, listed)).withColumn("row_key", F.monotonically_increasing_id())
    open_rows = cut_lineage(open_rows, "tiled")  # the keys stay as written
    dealt = open_rows.select("row_key", "codes", F.explode("tiles").alias("tile")).select(
        "row_key", "tile.octave", "tile.low", "tile.marks", F.expr("slice(codes, cast(tile.low as int) + 1, cast(tile.high - tile.low as int))").alias("codes")
    )
    runs = stitch(solve(dealt.repartition("row_key", "octave", "low")))
    found = open_rows.select(*inner, "text", "row_key").join(runs, "row_key", "left")
    found = found.select(*inner, "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs")).mapInArrow(collapse, shape(inner, f"runs {RUNS}, n_words bigint, collapsed string"))
    done = rows.mapInArrow(plain, shape(inner, "n_words bigint, collapsed string")).withColumn("runs", F.array().cast(RUNS))
    names = [fresh_name(docs.select(*keep), n) for n in ("n_words", "runs", "collapsed")]
    return done.unionByName(found).select(*[F.col(k).alias(c) for c, k in zip(keep, inner)], *[F.col(n).alias(m) for n, m in zip(("n_words", "runs", "collapsed"), names)])
