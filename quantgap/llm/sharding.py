"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered without gaps in an order that only depends on their keys; a keyed permutation of ``0 .. n-1``
scatters the numbers, and place and shard follow by arithmetic, as does the way back.  Keys are counted per bucket of
their md5, buckets are summed up in a table of at most 65 536 rows, and a first key that many rows share is cut by the
md5 of the others, so no row order is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgap.llm.common import fresh_name

ROUNDS = 6
BUCKET_DIGITS = 4  # md5 digits: at most 65 536 buckets
TAIL_DIGITS = 3  # md5 digits of the other keys: rows of one first key are ordered in at most 4096 parts
CHUNK = 4096


def _round(value: str, tag: str, modulus: str) -> str:
    """Round function: 48 bits of an md5 of the other half."""
    return f"pmod(cast(conv(substring(md5(concat('{tag}:', cast({value} AS string))), 1, 12), 16, 10) AS bigint), {modulus})"


def _pass(state: str, seed: int, backwards: bool = False) -> str:
    """One pass of the network over a struct ``(l, r, a, b)``, with l below a and r below b."""
    for k in reversed(range(ROUNDS)) if backwards else range(ROUNDS):
        half, other, modulus = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        moved = f"pmod(s.{half} {'-' if backwards else '+'} {_round(f's.{other}', f'{seed}.{k}', f's.{modulus}')}, s.{modulus})"
        fields = {"l": "s.l", "r": "s.r", "a": "s.a", "b": "s.b", half: moved}
        state = f"transform(array({state}), s -> struct({', '.join(f'{v} AS {n}' for n, v in fields.items())}))[0]"
    return state


def permute(number: str, total: str, seed: int = 7, backwards: bool = False) -> Column:
    """Place of row ``number`` in a shuffle of ``total`` rows (both SQL expressions); ``backwards`` inverts it.

    The network permutes ``a * b`` numbers, with ``a`` the root of the total rounded up, fewer than ``a`` more than
    asked for.  A number that lands beyond the total walks on along its cycle; as at most ``a * b - total`` numbers lie
    beyond, that many further steps always bring it back, so the walk has a bound and no row is ever cut off.
    """
    a = f"greatest(1L, cast(ceil(sqrt(cast({total} AS double))) AS bigint))"
    b = f"greatest(1L, cast(ceil(cast({total} AS double) / {a}) AS bigint))"
    once = lambda n: f"transform(array({_pass(f'struct({n} DIV {b} AS l, {n} % {b} AS r, {a} AS a, {b} AS b)', seed, backwards)}), s -> s.l * s.b + s.r)[0]"
    walk = f"aggregate(sequence(1L, {a} * {b} - {total}), y, (v, i) -> CASE WHEN v < {total} THEN v ELSE {once('v')} END)"
    return F.expr(f"transform(array({once(number)}), y -> CASE WHEN y < {total} THEN y ELSE {walk} END)[0]")


def _md5(*keys: str) -> Column:
    """md5 of the keys as text, a null as nothing."""
    return F.md5(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))


def number_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct key: ``keys, start, copies, total``; rows of a key take the numbers from ``start`` on.

    Order: md5 of the first key, md5 of the others, then the keys, nulls last.  Equal rows are counted before anything is
    shuffled.  A first key that very many different rows share is ordered in ``16 ** TAIL_DIGITS`` parts, so that no task
    sorts all its rows.
    """
    groups = df.groupBy(*keys).agg(F.count("*").alias("copies"))
    parts = {"_lead": _md5(keys[0]), "_tail": _md5(*keys[1:]) if keys[1:] else F.lit("")}
    groups = groups.select(F.struct(*keys).alias("_key"), "copies", *[c.alias(n) for n, c in parts.items()], F.substring(parts["_tail"], 1, TAIL_DIGITS).alias("_part"))
    one_part = groups.groupBy("_lead", "_part").agg(F.sum("copies").alias("_in_part"))
    one_lead = one_part.groupBy("_lead").agg(F.sum("_in_part").alias("_in_lead")).withColumn("_bucket", F.substring("_lead", 1, BUCKET_DIGITS))
    sums = one_lead.groupBy("_bucket").agg(F.sum("_in_lead").alias("_in_bucket"))
    everything = Window.orderBy("_bucket")
    before = sums.select(
        "_bucket",
        (F.sum("_in_bucket").over(everything.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_in_bucket")).alias("_before"),
        F.sum("_in_bucket").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    until = lambda n, by, *order: F.sum(n).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    leads = one_lead.select("_lead", "_bucket", (until("_in_lead", ["_bucket"], "_lead") - F.col("_in_lead")).alias("_leads_before"))
    leads = leads.join(F.broadcast(before), "_bucket")  # at most 65 536 buckets
    starts = one_part.select("_lead", "_part", (until("_in_part", ["_lead"], "_part") - F.col("_in_part")).alias("_parts_before")).join(leads, "_lead")
    starts = starts.select("_lead", "_part", "total", (F.col("_before") + F.col("_leads_before") + F.col("_parts_before")).alias("_first"))
    order = ["_tail", *[F.col("_key")[k].asc_nulls_last() for k in keys]]
    running = groups.withColumn("_until", until("copies", ["_lead", "_part"], *order))
    numbered = running.join(starts, ["_lead", "_part"])
    return numbered.select("_key.*", (F.col("_first") + F.col("_until") - F.col("copies")).alias("start"), "copies", "total")


def deal(numbered: DataFrame, shards: int, seed: int = 7, number: str = "number", total: str = "total") -> DataFrame:
    """``shard`` and ``slot`` instead of ``number`` and ``total``: sizes of shards differ by one row at most."""
    place = fresh_name(numbered, "_place")
    placed = numbered.withColumn(place, permute(f"`{number}`", f"`{total}`", seed)).drop(number, total)
    return placed.withColumns({"shard": F.expr(f"cast({place} % {shards} AS int)"), "slot": F.expr(f"{place} DIV {shards}")}).drop(place)


def _rows(keyed: DataFrame, by: list[str]) -> DataFrame:
    """``keyed`` (``whole, start, copies, total``) with a row per copy, as ``whole, total, number``.

    A key with very many copies is cut into chunks first, which spread over the tasks before they become rows.
    """
    chunks = keyed.withColumn("chunk", F.explode(F.expr(f"sequence(0L, copies - 1, {CHUNK}L)")))
    dealt = chunks.repartition(*[F.col(b) for b in by], "chunk")
    return dealt.select("whole", "total", F.explode(F.expr(f"sequence(start + chunk, start + least(chunk + {CHUNK}L, copies) - 1)")).alias("number"))


def shard_keys(df: DataFrame, keys: list[str], shards: int, seed: int = 7) -> DataFrame:
    """Shard and slot of every row of a table made of key columns only; repeated rows are dealt one by one."""
    named = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    starts = number_keys(named, named.columns).select(F.struct(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)]).alias("whole"), "start", "copies", "total")
    return deal(_rows(starts, ["whole"]), shards, seed).select("whole.*", "shard", "slot")


def shard_table(df: DataFrame, key: str, shards: int, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` and ``slot``, ordered by ``key`` and then by the whole row; columns of these names are replaced.

    Rows are told apart by key and row hash.  Equal rows are counted and kept once, and become as many rows again after
    the numbers are known, chunk by chunk.  Other columns keep whatever name and value they have; nulls are a key like any.
    """
    df = df.drop("shard", "slot")
    whole = F.struct(*df.columns)
    hashed = df.select(whole.alias("whole"), F.col(key).alias("k0"), F.md5(F.to_json(whole, {"ignoreNullFields": "false"})).alias("k1"))
    starts = number_keys(hashed.select("k0", "k1"), ["k0", "k1"])
    single = hashed.groupBy("k0", "k1").agg(F.first("whole").alias("whole")).alias("l")
    right = starts.alias("r")
    joined = single.join(right, F.col("l.k0").eqNullSafe(F.col("r.k0")) & (F.col("l.k1") == F.col("r.k1"))).select("l.k1", "whole", "start", "copies", "total")
    return deal(_rows(joined, ["k1"]), shards, seed).select("whole.*", "shard", "slot")
