"""Benchmark decontamination: a broadcast set of test n-grams against every window of the training texts.

Windows travel as hashes; a hit is verified word by word before it counts.  The texts stay in their rows: only verified
hits and one marker per text reach the single shuffle, so its size follows the texts' number and the contamination.
Grams too large for a broadcast, by their measured bytes, broadcast a bit each; the windows whose bit is set meet them in a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantgap.llm import common
from quantgap.llm.common import bench_words, fresh_name, small_side
from quantgap.session import cut_lineage

WINDOW = 10
BROADCAST_BITS = 1 << 28
SIGNS = r"0-9A-Za-z\x{80}-\x{10FFFF}"  # signs of a word, before it is put in lower case


def _tokens(text: str) -> Column:
    return bench_words(F.coalesce(F.col(text), F.lit("")))


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """Distinct windows of the test items: ``(key, width, gram, items)``.

    An item with fewer words than ``width``, but not none, is one window.  Items without an id take part without being listed.
    """
    items = benchmark.select(F.col(item).cast("string").alias("item"), _tokens(text).alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.size("w"), F.lit(width)))
    grams = items.select("item", "width", F.explode(F.expr("transform(sequence(0, size(w) - width), i -> array_join(slice(w, i + 1, width), ' '))")).alias("gram"))
    grams = grams.groupBy("gram", "width").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hashed = F.xxhash64(F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)))
    return grams.select(hashed.alias("key"), "width", "gram", "items")


def _likely(places: DataFrame, grams: DataFrame, size: int) -> DataFrame:
    """``places`` with ``likely``: false only where no gram has the key.

    One bit a key, of 32 times as many, tells; rows of 4096 bits are broadcast, ``BROADCAST_BITS`` in all at most.
    """
    bits = min(max(4096, 1 << (32 * size).bit_length()), BROADCAST_BITS)
    place = F.col("key").bitwiseAND(F.lit(bits - 1))
    row, part, bit = F.shiftright(place, 12), F.shiftright(place, 6).bitwiseAND(F.lit(63)).cast("int"), place.bitwiseAND(F.lit(63)).cast("int")
    masks = grams.select(row.alias("row"), part.alias("part"), F.expr("1L").alias("one"), bit.alias("bit"))
    masks = masks.groupBy("row", "part").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("mask"))
    masks = masks.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("part", "mask"))).alias("parts"))
    masks = masks.select("row", F.expr("transform(sequence(0, 63), i -> coalesce(parts[i], 0L))").alias("masks"))
    masks = cut_lineage(masks, "gram-bits")
    placed = places.withColumn("row", row).join(F.broadcast(masks), ["row"], "left")
    return placed.withColumn("likely", F.coalesce(F.getbit(F.get("masks", part), bit) == 1, F.lit(False))).drop("row", "masks")


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item: str = "item_id", width: int = WINDOW) -> DataFrame:
    """One row per text: ``(doc_id, digest, n_words, hits, items)``.

    ``hits`` are the verified windows as ``(start, width)`` in words, distinct and sorted; ``items`` the items they come
    from, sorted as strings; ``digest`` the text's md5 (null texts: of the empty text, without words).  Repeated rows
    stay repeated.  An empty benchmark gives no hits.
    """
    grams = cut_lineage(benchmark_windows(benchmark, item, width=width), "grams")
    held = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + 24 + F.octet_length(x)) + F.octet_length("gram") + 96
    size, lengths, held = grams.agg(F.count("*"), F.collect_set("width"), F.sum(held)).first()
    tokens = docs.select(F.col(doc_id).alias("doc_id"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("digest"), _tokens(text).alias("w"))
    hashed = tokens.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    large = (held or 0) > common.BROADCAST_BYTES
    # Width 0 marks the text itself, so that it is counted once whether or not it is hit.  In a shuffle its key spreads the texts.
    slots = F.array(F.struct(F.lit(0).alias("width"), F.array(F.xxhash64("digest") if large else F.lit(None).cast("long")).alias("keys")))
    for n in sorted(lengths):
        keys = F.expr(f"transform(sequence(0, size(h) - {n}), i -> xxhash64(slice(h, i + 1, {n})))")
        slots = F.concat(slots, F.array(F.struct(F.lit(n).alias("width"), F.when(F.size("h") >= n, keys).otherwise(F.array().cast("array<bigint>")).alias("keys"))))
    blocks = hashed.select("doc_id", "digest", "w", F.explode(slots).alias("s")).select("doc_id", "digest", "w", F.col("s.width").alias("len"), F.col("s.keys").alias("keys"))
    places = blocks.select("doc_id", "digest", "w", "len", F.posexplode("keys").alias("at", "key"))
    marker = F.col("len") == 0
    # Words leave a row as their number or as one window, never as the whole text: sorts and shuffles hold all that is selected.
    n_words = F.when(marker, F.size("w")).alias("n_words")
    words = F.array_join(F.slice("w", F.col("at") + 1, F.greatest("len", F.lit(1))), " ")
    if large:
        likely = _likely(places, grams, size).where(marker | F.col("likely"))
        likely = likely.select("doc_id", "digest", "len", "at", "key", n_words, F.when(~marker, words).alias("gram"))
        found = likely.join(grams.withColumnRenamed("width", "len"), ["key", "len", "gram"], "left").where(marker | F.col("items").isNotNull())
        found = found.select("doc_id", "digest", "len", "at", "n_words", "items")
    else:
        met = places.join(F.broadcast(grams.withColumnRenamed("width", "gram_width")), ["key"], "left")
        verified = (F.col("gram_width") == F.col("len")) & (F.col("gram") == words)
        found = met.where(marker | verified).select("doc_id", "digest", "len", "at", n_words, "items")
    hit = F.when(~marker, F.struct(F.col("at").alias("start"), F.col("len").alias("width")))
    grouped = found.groupBy("doc_id", "digest").agg(
        F.max("n_words").cast("long").alias("n_words"),
        F.sum(F.when(marker, 1).otherwise(0)).alias("rows"),
        F.sort_array(F.collect_set(hit)).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(~marker, F.col("items")))))).alias("items"),
    )
    return grouped.select("doc_id", "digest", "n_words", "hits", "items", F.explode(F.expr("sequence(1L, rows)")).alias("_")).drop("_")


def hit_words(hits: str = "hits") -> Column:
    """Number of words inside any hit."""
    return F.size(F.array_distinct(F.flatten(F.transform(hits, lambda h: F.sequence(h.start, h.start + h.width - 1))))).cast("long")


def remove_documents(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """``docs`` without the texts that hold a test window; columns unchanged, clean rows untouched."""
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    bad = find_hits(docs, benchmark, **names).where(F.size("hits") > 0).select("doc_id", "digest").distinct()
    bad = cut_lineage(bad, "contaminated")
    bad = small_side(bad, bad.count(), 100)
    key, digest = fresh_name(docs, "_bad_id"), fresh_name(docs, "_bad_digest")
    bad = bad.select(F.col("doc_id").alias(key), F.col("digest").alias(digest))
    return docs.join(bad, docs[doc_id].eqNullSafe(bad[key]) & (F.md5(F.coalesce(docs[text], F.lit(""))) == bad[digest]), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", mark: str = " ", **names) -> DataFrame:
    """``docs`` with every hit span cut out of the text and ``mark`` put in its place; clean rows untouched."""
    hits = find_hits(docs, benchmark, doc_id=doc_id, text=text, **names).where(F.size("hits") > 0)
    hits = hits.select("doc_id", "digest", "hits").dropDuplicates(["doc_id", "digest"])
    key, digest, spans, parts = (fresh_name(docs, n) for n in ("_bad_id", "_bad_digest", "_hits", "_parts"))
    hits = hits.select(F.col("doc_id").alias(key), F.col("digest").alias(digest), F.col("hits").alias(spans))
    joined = docs.join(hits, docs[doc_id].eqNullSafe(hits[key]) & (F.md5(F.coalesce(docs[text], F.lit(""))) == hits[digest]), "left")
    # Words and the gaps before them alternate; hit words and the gaps inside a hit are dropped.
    joined = joined.withColumn(parts, F.when(F.col(spans).isNotNull(), F.regexp_extract_all(F.col(text), F.lit(f"[^{SIGNS}]*[{SIGNS}]+"), F.lit(0))))
    inside = f"flatten(transform({spans}, h -> sequence(h.start, h.start + h.width - 1)))"
    cut, tail = fresh_name(docs, "_cut"), F.regexp_extract(F.col(text), f"[^{SIGNS}]*$", 0)
    joined = joined.withColumn(cut, F.expr(f"map_from_arrays(array_distinct({inside}), transform(array_distinct({inside}), x -> true))"))
    kept = F.concat(F.array_join(F.transform(parts, lambda p, i: F.when(F.element_at(cut, i).isNull(), p).otherwise(F.lit(mark))), ""), tail)
    return joined.withColumn(text, F.when(F.col(spans).isNotNull(), kept).otherwise(F.col(text))).select(*docs.columns)
