"""Bootstrap replicates drawn on histograms.

A replicate needs only how often each distinct value of a group is drawn.  Rows are therefore collapsed to
``(cell, group, value) -> count`` first, and a value of count ``c`` gets its number of draws in a replicate at once: a
Poisson number of rate ``c``, taken from a hash of seed, replicate and the value's smallest row key.  Replicates are
never rows of a shuffle; they are the columns of a matrix inside a task.

The histogram lies in slices of the value axis.  One pass adds up the draws of every slice and replicate; from these sums
it is known which stretch of the rank axis a slice covers in any replicate.  A second pass sends each slice to the
stretches it touches (two or three), where all groups of the cell meet and the distances are taken replicate by
replicate.  A task holds a few slices of each group, whatever the size of a cell.

``exact`` replicates draw as many rows as the cell has.  Poisson draws of a rate eight deviations below that are
completed by single picks; given their number, both are draws with equal chances, so their sum is multinomial.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.functions.scalar import is_finite
from quantgap.operators.joins import join_null_safe
from quantgap.operators.samples import Slicing
from quantgap.session import cut_lineage, ship

try:  # without the set-up of a call to OpenSSL, which short texts notice
    from _md5 import md5
except ImportError:
    from hashlib import md5

DRAWS_PER_HASH = 4
TABLE_RATE = 64  # above it the inverse distribution function is expanded around the normal one
DRAWS_PER_TASK = 50_000_000
FEW_CUTS = 8  # cuts that are not worth a pass to unite them
BINS = 64  # pieces of the value axis, at most, in which the rows of every group are counted to unite cuts
MARGIN = 8.0  # standard deviations between the Poisson draws of an exact replicate and its total

ship(__name__)


def rate_cuts(rate: float) -> list[int]:
    """Cumulative Poisson probabilities on the scale of 32 bits; a number of draws is how many cuts a draw reaches."""
    total, term, cuts = 0.0, math.exp(-rate), []
    for k in range(int(rate + 12 * math.sqrt(rate)) + 12):
        total += term
        term = term * rate / (k + 1)
        cut = math.floor(total * 2**32)
        if cut < 2**32 - 1:
            cuts.append(cut)
    return cuts


def draw_bits(key: str, replicates: int, seed: int) -> Column:
    """Four hash bytes per replicate."""
    blocks = F.sequence(F.lit(0), F.lit(math.ceil(replicates / DRAWS_PER_HASH) - 1))
    return F.unhex(F.array_join(F.transform(blocks, lambda b: F.md5(F.concat_ws("|", F.lit(str(seed)), b, F.col(key)))), ""))


def hash_bits(keys: list[str | None], replicates: int, seed: int) -> list[bytes]:
    """The bytes of :func:`draw_bits`, made where the rows are used: a shuffle of them would be several times the table."""
    heads = [f"{seed}|{b}".encode() for b in range(math.ceil(replicates / DRAWS_PER_HASH))]
    ends = [b"" if k is None else b"|" + k.encode() for k in keys]
    return [b"".join([md5(h + end).digest() for h in heads]) for end in ends]


def draw_counts(bits: list[bytes], rates: np.ndarray, replicates: int) -> np.ndarray:
    """Poisson draws, a row per value and a column per replicate."""
    u = np.frombuffer(b"".join(bits), ">u4").reshape(len(rates), -1)[:, :replicates].astype(np.int64)
    drawn = np.zeros((len(rates), replicates), np.int64)
    for rate in np.unique(rates):
        mine = rates == rate
        if 0 < rate <= TABLE_RATE:
            drawn[mine] = np.searchsorted(np.array(rate_cuts(float(rate)), np.int64), u[mine], side="right")
        elif rate > TABLE_RATE:
            z = np.sqrt(-2 * np.log(((u[mine] >> 16) + 0.5) / 65536)) * np.cos(2 * math.pi * (u[mine] & 0xFFFF) / 65536)
            root = math.sqrt(rate)
            drawn[mine] = np.maximum(np.floor(rate + root * z + (z * z - 1) / 6 + (z - z**3) / (72 * root) + 0.5), 0).astype(np.int64)
    return drawn


def draw_tasks(df: DataFrame, rows: int, replicates: int) -> int:
    """Number of tasks for drawing: the work of a row is not seen in its bytes, so it is not left to their size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * replicates / DRAWS_PER_TASK))


def united_cuts(rows: DataFrame, keys: list[str], slicing: Slicing) -> DataFrame:
    """``(keys…, _shift)``: of small groups, how many bits of ``_cut`` can go without a slice of more than its rows.

    The cuts are those of the whole table; a group that is a small part of it would lie in as many slices as it has rows.
    A group too large for a bin of cuts keeps the cuts as they are.
    """
    top = len(slicing.splits).bit_length()
    bins = max(0, top - BINS.bit_length() + 1)
    counted = rows.groupBy(*keys, F.shiftright("_cut", bins).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))
    tried = counted.withColumn("_shift", F.explode(F.sequence(F.lit(bins), F.lit(top))))
    tried = tried.groupBy(*keys, "_shift", F.expr(f"shiftright(_bin, _shift - {bins})").alias("_bin")).agg(F.sum("_n").alias("_n"))
    most = tried.groupBy(*keys, "_shift").agg(F.max("_n").alias("_n")).where(F.col("_n") <= slicing.rows_per_slice)
    return cut_lineage(most.groupBy(*keys).agg(F.max("_shift").alias("_shift")), "shifts")


def histogram(df: DataFrame, cell: list[str], group: str, value: str, row_key: str, slicing: Slicing, tasks: int, count: str | None = None) -> DataFrame:
    """``(cell…, group, _cut, _v, _c, _key)``: distinct values, their count and smallest row key, written slice by slice.

    With ``count`` the rows are such already, and several of a group may have one value.
    """
    keys = [*cell, group]
    # Adding zero makes one value of 0.0 and -0.0, which would fall on two sides of a boundary at zero.
    rows = df.select(*cell, F.col(group).cast("string").alias(group), (F.col(value).cast("double") + 0.0).alias("_v"), F.col(row_key).alias("_key"), *([F.col(count).alias("_c")] if count else []))
    cutter = Bucketizer(splits=[-math.inf, *slicing.splits, math.inf], inputCol="_v", outputCol="_cut")
    rows = cutter.transform(rows.where(is_finite("_v") & F.col(group).isNotNull())).withColumn("_cut", F.col("_cut").cast("int"))
    values = rows if count else rows.groupBy(*keys, "_cut", "_v").agg(F.count(F.lit(1)).alias("_c"), F.min("_key").alias("_key"))
    if len(slicing.splits) > FEW_CUTS:
        values = join_null_safe(values, united_cuts(rows, keys, slicing), keys, "left")
        values = values.withColumn("_cut", F.expr("shiftright(_cut, coalesce(_shift, 0))")).drop("_shift")
    return cut_lineage(values.repartition(tasks, *keys, "_cut").sortWithinPartitions(*keys, "_cut"), "histogram")


def slice_draws(hist: DataFrame, keys: list[str], replicates: int, seed: int) -> DataFrame:
    """``(keys…, _cut, _rep, _s, _d, _n)``: draws of a slice in each replicate, its values and rows; ``hist`` has ``_rate``."""
    names = [*keys, "_cut"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch.select(names).to_pandas()
            slot = table.groupby(names, dropna=False, sort=False).ngroup().to_numpy()
            drawn = draw_counts(batch.column("_bits").to_pylist(), np.asarray(batch.column("_rate")), replicates)
            count, firsts = slot.max() + 1, np.unique(slot, return_index=True)[1]
            sums = np.zeros((count, replicates), np.int64)
            np.add.at(sums, slot, drawn)
            rows = np.bincount(slot, np.asarray(batch.column("_c"))).astype(np.int64)
            columns = [*batch.select(names).take(pa.array(firsts)).columns, pa.array(sums.tolist(), pa.list_(pa.int64())), pa.array(np.bincount(slot)), pa.array(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "_sums", "_d", "_n"])

    kinds = ", ".join(f"`{n}` {hist.schema[n].dataType.simpleString()}" for n in names)
    given = hist.select(*names, "_c", "_rate", draw_bits("_key", replicates, seed).alias("_bits"))
    parts = given.mapInArrow(add, f"{kinds}, _sums array<bigint>, _d bigint, _n bigint")
    long = parts.select(*names, F.posexplode("_sums").alias("_rep", "_part"), "_d", "_n")
    return long.groupBy(*names, "_rep").agg(F.sum("_part").alias("_s"), F.sum("_d").alias("_d"), F.sum("_n").alias("_n"))


def exact_picks(sums: DataFrame, cell: list[str], group: str, seed: int) -> DataFrame:
    """``(cell…, group, _cut, _rep, _offset)``: the rows that complete each replicate of a cell, by place in their slice."""
    names = [*cell, group, "_cut", "_rep"]

    def fill(table: pa.Table) -> pa.Table:
        order = np.lexsort((np.asarray(table["_cut"]), np.array(table[group].to_pylist(), dtype=object)))
        table = table.take(pa.array(order))
        size = np.asarray(table["_n"])
        missing = int(size.sum() - np.asarray(table["_s"]).sum())
        if missing < 0:
            raise ValueError("a replicate drew more than its cell has; take another seed")
        prefix = table["_prefix"][0].as_py()
        share = np.array([int(hashlib.md5(f"{prefix}|{j}".encode()).hexdigest()[:13], 16) for j in range(missing)], dtype=np.float64) / 2.0**52
        number = np.floor(share * size.sum()).astype(np.int64)
        ends = np.cumsum(size)
        place = np.searchsorted(ends, number, side="right")
        picked = table.select(names).take(pa.array(place, pa.int64()))
        return picked.append_column("_offset", pa.array(number - (ends - size)[place], pa.int64()))

    prefix = F.concat_ws("|", F.lit("fill"), F.lit(str(seed)), F.col("_rep"), *[F.col(c).cast("string") for c in cell])
    kinds = ", ".join(f"`{n}` {sums.schema[n].dataType.simpleString()}" for n in names)
    return sums.withColumn("_prefix", prefix).groupBy(*cell, "_rep").applyInArrow(fill, f"{kinds}, _offset bigint")


def replicate_frame(
    df: DataFrame, cell: list[str], group: str, value: str, row_key: str, replicates: int, seed: int, method: str, slicing: Slicing, groups: list[str] | None = None, count: str | None = None,
) -> DataFrame:
    """What the tasks of replicates need, by cell and stretch ``_k`` of ``_slices`` of the rank axis.

    Rows of ``_kind`` 0 say where a slice begins in each replicate, rows of kind 1 are values with count, rate and row
    key, rows of kind 2 single picks of exact replicates.  The hash of the key has a number a replicate and is made in the task.
    """
    if method not in ("poisson", "multinomial"):
        raise ValueError(f"unknown method {method!r}")
    keys = [*cell, group]
    # Draws of Poisson replicates are independent between rows; exact ones need all rows of the cell.
    kept = df.where(F.col(group).isin(*groups)) if groups and method == "poisson" else df
    tasks = draw_tasks(df, slicing.rows, replicates)
    hist = histogram(kept, cell, group, value, row_key, slicing, tasks, count)
    rated = hist.withColumn("_rate", F.col("_c").cast("double"))
    picks = None
    if method == "multinomial":
        sizes = hist.groupBy(*cell).agg(F.sum("_c").alias("_size"))
        share = sizes.select(*cell, F.greatest(F.lit(0.0), 1 - F.lit(MARGIN) / F.sqrt("_size")).alias("_share"))
        rated = join_null_safe(hist, share, cell, "inner").withColumn("_rate", F.col("_c") * F.col("_share")).drop("_share")
    sums = cut_lineage(slice_draws(rated, keys, replicates, seed), "slice-draws")
    if method == "multinomial":
        picks = cut_lineage(exact_picks(sums, cell, group, seed), "picks")
        more = picks.groupBy(*keys, "_cut", "_rep").agg(F.count(F.lit(1)).alias("_more"))
        sums = join_null_safe(sums, more, [*keys, "_cut", "_rep"], "left").withColumn("_s", F.col("_s") + F.coalesce("_more", F.lit(0))).drop("_more")
    along = W.partitionBy(*keys, "_rep")
    placed = sums.select(
        *keys,
        "_cut",
        "_rep",
        "_d",
        "_s",
        F.coalesce(F.sum("_s").over(along.orderBy("_cut").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_s").over(along).alias("_total"),
    )
    place = F.when(F.col("_total") > 0, F.col("_before") / F.col("_total"))
    end = F.when(F.col("_total") > 0, (F.col("_before") + F.col("_s")) / F.col("_total"))
    heads = placed.groupBy(*keys, "_cut").agg(
        F.sort_array(F.collect_list(F.struct("_rep", "_before", "_total"))).alias("_starts"),  # one entry a replicate
        F.max("_d").alias("_d"),
        F.coalesce(F.min(place), F.lit(0.0)).alias("_low"),
        F.coalesce(F.max(end), F.lit(0.0)).alias("_high"),
    )
    of_group = F.sum("_d").over(W.partitionBy(*keys))
    heads = heads.withColumn("_slices", F.ceil(of_group / F.lit(slicing.rows_per_slice)))
    heads = heads.withColumn("_slices", F.max("_slices").over(W.partitionBy(*cell)))
    top = F.col("_slices") - 1
    low = F.least(F.greatest(F.floor(F.col("_low") * F.col("_slices")), F.lit(0)), top)
    high = F.least(F.greatest(F.ceil(F.col("_high") * F.col("_slices")) - 1, low), top)
    heads = heads.select(*keys, "_cut", "_slices", F.sequence(low, high).alias("_ks"), "_starts")
    if groups:
        heads = heads.where(F.col(group).isin(*[str(g) for g in groups]))
    heads = cut_lineage(heads, "slice-places")
    where_to = heads.select(*keys, "_cut", "_slices", "_ks")
    values = rated.select(*keys, "_cut", "_v", "_c", "_rate", F.col("_key").cast("string").alias("_key"), F.lit(1).alias("_kind"))
    frame = heads.select(*keys, "_cut", "_slices", "_ks", "_starts", F.lit(0).alias("_kind"))
    frame = frame.unionByName(join_null_safe(values, where_to, [*keys, "_cut"], "inner"), allowMissingColumns=True)
    if picks is not None:
        placed_picks = join_null_safe(picks.withColumn("_kind", F.lit(2)), where_to, [*keys, "_cut"], "inner")
        frame = frame.unionByName(placed_picks, allowMissingColumns=True)
    else:
        frame = frame.withColumns({"_rep": F.lit(None).cast("int"), "_offset": F.lit(None).cast("long")})
    return frame.withColumn("_k", F.explode("_ks")).drop("_ks").repartition(tasks, *cell, "_k").withColumn("_seed", F.lit(seed))


def group_draws(table: pa.Table, replicates: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one group in one stretch: values in order, their draws, and per replicate the draws before them and in all."""
    kind = np.asarray(table["_kind"])
    heads = table.filter(pa.array(kind == 0))
    first = heads["_starts"][int(np.argmin(np.asarray(heads["_cut"])))].as_py()
    before, total = (np.array([s[name] for s in first], np.int64) for name in ("_before", "_total"))
    rows = table.filter(pa.array(kind == 1))
    rows = rows.take(pa.array(np.argsort(np.asarray(rows["_v"]), kind="stable")))
    values, counts, cuts = (np.asarray(rows[name]) for name in ("_v", "_c", "_cut"))
    bits = hash_bits(rows["_key"].to_pylist(), replicates, heads["_seed"][0].as_py())
    drawn = draw_counts(bits, np.asarray(rows["_rate"]), replicates)
    picks = table.filter(pa.array(kind == 2))
    if picks.num_rows:
        starts = np.searchsorted(cuts, np.asarray(picks["_cut"]))  # first value of the slice
        ends = np.cumsum(counts)
        place = np.searchsorted(ends, np.asarray(picks["_offset"]) + (ends - counts)[starts], side="right")
        np.add.at(drawn, (place, np.asarray(picks["_rep"])), 1)
    return values, drawn, before, total


def gap(a: tuple, b: tuple, r: int, low: float, high: float, p: float) -> float:
    """Integral of ``|Qa - Qb| ** p`` over the ranks between ``low`` and ``high`` in replicate ``r``."""
    ua, ub = (np.clip((before[r] + drawn[:, r].cumsum()) / total[r], low, high) for _, drawn, before, total in (a, b))
    edges = np.concatenate([[low], ua, ub, [high]])
    edges.sort(kind="stable")  # merges runs that are in order
    qa, qb = (v[np.minimum(np.searchsorted(u, edges[:-1], side="right"), len(v) - 1)] for v, u in ((a[0], ua), (b[0], ub)))
    return float((np.diff(edges) * np.abs(qa - qb) ** p).sum())


def replicate_distances(frame: DataFrame, cell: list[str], group: str, ref: str, targets: list[str], replicates: int, p: float, min_obs: int) -> DataFrame:
    """``(cell…, rep, group, w)``: distance of every target from the reference in every replicate with any draw."""
    names = [str(t) for t in targets]

    def walk(table: pa.Table) -> pa.Table:
        k, slices = table["_k"][0].as_py(), table["_slices"][0].as_py()
        labels = np.array(table[group].to_pylist(), dtype=object)
        sides = {name: group_draws(table.filter(pa.array(labels == name)), replicates) for name in set(labels)}
        nothing = np.zeros(replicates, np.int64)
        totals = {name: sides[name][3] if name in sides else nothing for name in [*names, str(ref)]}
        found = []
        for r in range(replicates):
            if not any(total[r] for total in totals.values()):
                continue
            for name in names:
                least = min(totals[name][r], totals[str(ref)][r])
                part = gap(sides[name], sides[str(ref)], r, k / slices, (k + 1) / slices, p) if least else None
                found.append((r, name, part, int(least)))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.int32(), pa.string(), pa.float64(), pa.int64()))]
        place = table.select(cell).take(pa.array(np.zeros(len(found), np.int64)))
        return pa.table([*place.columns, *columns], names=[*cell, "rep", group, "_part", "_least"])

    kinds = "".join(f"`{c}` {frame.schema[c].dataType.simpleString()}, " for c in cell)
    parts = frame.groupBy(*cell, "_k").applyInArrow(walk, f"{kinds}rep int, `{group}` string, _part double, _least bigint")
    whole = parts.groupBy(*cell, "rep", group).agg(F.sum("_part").alias("_part"), F.max("_least").alias("_least"))
    w = F.when(F.col("_least") >= min_obs, F.pow(F.greatest(F.col("_part"), F.lit(0.0)), F.lit(1.0 / p)))
    label = F.col(group) if all(isinstance(t, str) for t in targets) else F.col(group).cast("long")
    return whole.select(*cell, "rep", label.alias(group), w.alias("w"))


def replicate_draws(frame: DataFrame, cell: list[str], group: str, value: str, replicates: int) -> DataFrame:
    """``(cell…, group, value, rep, draw)``: the drawn values of every replicate, for other statistics than distances."""

    def spell(table: pa.Table) -> pa.Table:
        values, drawn, _, _ = group_draws(table, replicates)
        row, rep = np.nonzero(drawn)
        place = table.select([*cell, group]).take(pa.array(np.zeros(len(row), np.int64)))
        return pa.table([*place.columns, pa.array(values[row]), pa.array(rep.astype(np.int32)), pa.array(drawn[row, rep])], names=[*cell, group, value, "rep", "draw"])

    kinds = ", ".join(f"`{c}` {frame.schema[c].dataType.simpleString()}" for c in [*cell, group])
    # Each slice once: a slice that touches several stretches is taken at its first.
    first = F.min("_k").over(W.partitionBy(*cell, group, "_cut"))
    once = frame.withColumn("_first", first).where(F.col("_k") == F.col("_first")).drop("_first")
    return once.groupBy(*cell, group, "_cut").applyInArrow(spell, f"{kinds}, `{value}` double, rep int, draw bigint")
