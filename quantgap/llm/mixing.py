"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of copies.  The rates keep as close as possible, in relative entropy of
words, to the documents' base rates while each source's words meet its target: ``rate = min(cap, base * exp(lambda))``
with one multiplier per source, the solution of a convex dual found by Newton's method.  Rates become whole copies by
order sampling, so that a source's taken words end within a document of its target.

Documents are aggregated to (source, base) sums first; Newton runs on those sums, all sources side by side.  Only the
table of sources (one row each) is ordered as a whole; documents are never sorted: the rank at which a source is full is
searched in 4096 bins of the draw and then inside the one bin that holds it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantgap.llm.common import WORD, fresh_name, small_side, unit_draw
from quantgap.session import cut_lineage

WEIGHTS = (5, 2, 1)
CAP = 3
LEVELS = 64  # base rates are rounded to multiples of 1/64, so a source has at most CAP * LEVELS of them
STEPS = 80
BINS = 4096
LONG, PREFERRED = 200, 2.0  # words from which on the registered mixes prefer a document, and how much


def n_words(text: str) -> Column:
    return F.coalesce(F.expr(f"regexp_count({text}, '{WORD}')".replace("\\", "\\\\")), F.lit(0)).cast("long")


def length_base(size: Column) -> Column:
    """Base rate of the registered mixes: a document of ``LONG`` words or more counts ``PREFERRED`` times a shorter one."""
    return F.when(size >= LONG, PREFERRED).otherwise(1.0)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, size)`` rows.

    Sources take the weights in turn by code point, null last, and share the sum of all sizes; a target stops at ``cap``
    times its source and the excess is shared again by weight.  Sources fill up in the order of size to weight, so the
    last level of that order gives all targets at once.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    totals = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    totals = totals.withColumn("full", (F.col("source_size") * cap).cast("double"))
    by_need = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = by_need.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = by_need.rowsBetween(Window.unboundedPreceding, -1), by_need.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    totals = totals.withColumn("level", level).withColumn("open", F.col("full") / F.col("weight") > F.col("level"))
    # The level of the first source that does not fill up holds for all that follow.
    shared = F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), "level"))).over(everything)["level"]
    target = F.when(F.col("open"), F.least("full", F.col("weight") * shared)).otherwise(F.col("full"))
    return totals.select("source", "source_size", target.alias("target"))


def balance(sums: DataFrame, cap: int = CAP) -> DataFrame:
    """Multiplier per source: ``(source, tilt)`` from ``(source, target, levels)``, levels being (base, size) sums.

    Newton steps on the dual, at most one in size, until the words meet the target; a target at the cap of all documents
    needs every rate at the cap and is met by the largest multiplier that any level asks for.
    """
    words = f"aggregate(levels, 0D, (t, l) -> t + l.size * least({cap}D, l.base * exp(x)))"
    slope = f"aggregate(levels, 0D, (t, l) -> t + if(l.base * exp(x) < {cap}D, l.size * l.base * exp(x), 0D))"
    step = f"(target - {words}) / greatest({slope}, 1e-9D)"
    newton = f"aggregate(sequence(1, {STEPS}), 0D, (x, i) -> x + greatest(-1D, least(1D, {step})))"
    highest = f"array_max(transform(levels, l -> ln({cap}D / l.base)))"
    return sums.select("source", F.expr(f"CASE WHEN target <= 0 THEN -1e9D ELSE least({newton}, {highest}) END").alias("tilt"))


def _base(base: Column | None, cap: int) -> Column:
    raw = F.lit(1.0) if base is None else F.coalesce(base.cast("double"), F.lit(1.0))
    return F.least(F.lit(float(cap)), F.greatest(F.lit(1.0 / LEVELS), F.round(raw * LEVELS) / LEVELS))


def _draw(doc_id: str, size: str, seed: int) -> Column:
    return unit_draw(str(seed), F.col(doc_id), F.col(size))


def plan(sizes: DataFrame, seed: int = 11, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """What the documents of each source are taken by: ``(source, source_size, target, tilt, open, cut)``.

    ``sizes`` holds ``(doc_id, source, size, base)``.  A document takes ``floor(rate)`` copies and one more if its
    draw's key is at most ``cut``.  The documents of a source share what the whole copies leave of its target in the
    order of their keys, the last one only if it brings the source nearer to its target.
    """
    targets = cut_lineage(source_targets(sizes, weights, cap), "targets")
    levels = sizes.groupBy("source", "base").agg(F.sum("size").cast("double").alias("size"))
    levels = levels.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("base", "size"))).alias("levels"))
    tilts = balance(levels.join(targets, levels.source.eqNullSafe(targets.source)).select(targets.source, "target", "levels"), cap)
    sources = cut_lineage(targets.join(tilts, targets.source.eqNullSafe(tilts.source)).select(targets["*"], "tilt"), "tilts")
    count = sources.count()
    drawn = with_rates(sizes, sources, count, seed, cap)
    part = drawn.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"))
    rest = sources.join(part, sources.source.eqNullSafe(part.source)).select(sources["*"], (F.col("target") - F.col("sure")).alias("rest"))
    rest = cut_lineage(rest, "rest")
    parted = drawn.where((F.col("frac") > 0) & (F.col("size") > 0)).withColumn("bin", F.floor(F.col("key") / (1 + F.col("key")) * BINS))
    bins = parted.groupBy("source", "bin").agg(F.sum("size").alias("in_bin"))
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = bins.withColumn("until", F.sum("in_bin").over(upto)).withColumn("before", F.col("until") - F.col("in_bin"))
    met = bins.join(rest, bins.source.eqNullSafe(rest.source)).where(F.col("before") <= F.col("rest"))
    edge = met.groupBy(rest.source.alias("source")).agg(F.max(F.struct("bin", "before", "rest")).alias("e"))
    edge = small_side(cut_lineage(edge.select(F.col("source").alias("edge_source"), "e.*"), "edge").withColumnRenamed("bin", "edge_bin"), count, 64)
    inner = parted.join(edge, parted.source.eqNullSafe(edge.edge_source) & (parted.bin == F.col("edge_bin")))
    # Equal keys (repeated rows) are taken together.
    running = Window.partitionBy("source").orderBy("key").rangeBetween(Window.unboundedPreceding, 0)
    inner = inner.withColumn("sum", F.sum("size").over(running) + F.col("before")).withColumn("alike", F.sum("size").over(Window.partitionBy("source", "key")))
    cuts = inner.where(F.col("sum") - F.col("alike") / 2 <= F.col("rest")).groupBy("source").agg(F.max("key").alias("inner_cut"))
    cuts = cuts.select(F.col("source").alias("cut_source"), "inner_cut")
    out = rest.join(edge, rest.source.eqNullSafe(edge.edge_source), "left").join(cuts, rest.source.eqNullSafe(cuts.cut_source), "left")
    # Without a document of the last bin, all keys of the bins before it are taken: those below its lower end.
    end = F.col("edge_bin") / BINS
    return out.select(
        rest.source.alias("source"),
        "source_size",
        "target",
        "tilt",
        F.coalesce("inner_cut", F.nanvl(end / (1 - end), F.lit(0.0)), F.lit(-1.0)).alias("cut"),
    )


def with_rates(sizes: DataFrame, sources: DataFrame, count: int, seed: int = 11, cap: int = CAP) -> DataFrame:
    """Add each row's source values, rate, its whole part, what is left of it, and the key of its draw."""
    names = [c for c in sources.columns if c != "source"]
    side = small_side(sources.select(F.col("source").alias("_source"), *names), count, 64)
    joined = sizes.join(side, sizes.source.eqNullSafe(side._source), "left").drop("_source")
    # Rounding hides the last bits of the multiplier, so that a rate meant to be whole is whole.
    joined = joined.withColumn("rate", F.round(F.least(F.lit(float(cap)), F.col("base") * F.exp("tilt")), 9))
    joined = joined.withColumns({"whole": F.floor("rate"), "u": _draw("doc_id", "size", seed)})
    joined = joined.withColumn("frac", F.col("rate") - F.col("whole"))
    key = (F.col("u") / (1 - F.col("u"))) / (F.col("frac") / (1 - F.col("frac")))
    return joined.withColumn("key", F.when(F.col("frac") > 0, key))


def mix(docs: DataFrame, size: Column, seed: int = 11, base: Column | None = None, doc_id: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with ``size, source_size, target, rate, copies, taken``; replaced where the table has such columns.

    Documents without words take no copies.  Null sources are one source.  The same rows give the same mix on every
    run; rows alike in doc_id and size are treated alike.  The table itself is not shuffled while the sources stay few.
    """
    out = [c for c in docs.columns if c not in ("size", "source_size", "target", "rate", "copies", "taken")]
    sized = docs.select(F.struct(*out).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), _base(base, cap).alias("base"))
    narrow = cut_lineage(sized.select("doc_id", "source", "size", "base"), "sizes")
    sources = cut_lineage(plan(narrow, seed, weights, cap), "plan")
    rated = with_rates(sized, sources, sources.count(), seed, cap)
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when(F.col("key") <= F.col("cut"), 1).otherwise(0)).otherwise(0).cast("int")
    rated = rated.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return rated.select("row.*", "size", "source_size", "target", "rate", "copies", "taken")


def repeat_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as many times as it is taken."""
    times = fresh_name(mixed, "_time")
    return mixed.where(F.col("copies") > 0).select(*columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias(times)).drop(times)
