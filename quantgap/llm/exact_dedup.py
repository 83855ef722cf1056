"""Exact duplicates by a heavy-hitter split.

A text that very many documents share would send them all to one task.  Misra-Gries summaries of ``COUNTERS`` digests a
task, added up, find every digest that more than ``2 / (COUNTERS + 1)`` of all rows have; those whose added counter
exceeds ``1 / (COUNTERS + 1)`` of the rows are fewer than ``COUNTERS + 1``, whatever the table, so their winners can be
broadcast.  The winners are verified by an exact pass: row count, largest id, one length.  Rows of these digests are
judged where they are read; the others are shuffled by digest, at most ``2 / (COUNTERS + 1)`` of the table to a key.

Texts are equal when their bytes are (SHA-256 and length); null counts as empty, and empty texts are equal like others.
Of equal texts the row with the largest id stays, a row without id only if none of them has one.  Rows alike in id and
text share one verdict; ``remove_copies`` leaves one of them.  Very long texts are only hashed; no row is ever dropped
to escape a hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quantgap.llm.common import fresh_name, ship
from quantgap.session import cut_lineage

COUNTERS = 4096

ship(__name__)


def digest(text: str) -> Column:
    """SHA-256 of the text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def add_counts(counters: dict[bytes, int], values: pa.Array, limit: int) -> dict[bytes, int]:
    """Misra-Gries step for a whole batch: add its counts, then take the largest surplus counter off all of them."""
    seen = pc.value_counts(values)
    for value, count in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist()):
        counters[value] = counters.get(value, 0) + count
    if len(counters) > limit:
        off = sorted(counters.values(), reverse=True)[limit]
        counters = {value: count - off for value, count in counters.items() if count > off}
    return counters


def frequent(table: DataFrame, rows: int, counters: int = COUNTERS) -> DataFrame:
    """``(digest)`` of fewer than ``counters + 1`` digests, all that more than ``2 / (counters + 1)`` of the rows have among them."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[bytes, int] = {}
        for batch in batches:
            kept = add_counts(kept, batch.column(0), counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array(list(kept.values()), pa.int64())], names=["digest", "seen"])

    merged = table.select("digest").mapInArrow(summarise, "digest binary, seen bigint").groupBy("digest").agg(F.sum("seen").alias("seen"))
    return merged.where(F.col("seen") * (counters + 1) > rows).select("digest")


def winners(table: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``(digest, keep_id, group_size)`` of the frequent digests, from an exact count of their rows."""
    found = table.join(F.broadcast(frequent(table, table.count(), counters)), "digest")  # at most `counters` rows of 32 bytes
    exact = found.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.min("size").alias("least"), F.max("size").alias("most")
    )
    return cut_lineage(exact.where("least = most").drop("least", "most"), "winners")


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The ids with digests and lengths, written once so that the texts are read once."""
    size = F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("size")
    return cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("digest"), size), "digests")


def find_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``."""
    table = _narrow(docs, doc_id, text)
    hot = F.broadcast(winners(table, counters))
    group = W.partitionBy("digest", "size")
    rest = table.join(hot.select("digest"), "digest", "left_anti").select(
        "doc_id", F.max("doc_id").over(group).alias("keep_id"), F.count("*").over(group).alias("group_size"), "digest"
    )
    judged = table.join(hot, "digest").select("doc_id", "keep_id", "group_size", "digest").union(rest)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")
    return judged.select("doc_id", "keep_id", "group_size", kept, F.lower(F.hex("digest")).alias("text_sha256"))


def remove_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each text, columns unchanged.

    Copies of frequent texts go where they are read; single texts are only kept apart from the repeated ones.
    """
    table = _narrow(docs, doc_id, text)
    hot = winners(table, counters)
    rest = table.join(F.broadcast(hot.select("digest")), "digest", "left_anti").groupBy("digest", "size")
    repeated = cut_lineage(rest.agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("copies")).where("copies > 1").select("digest", "keep_id"), "repeated")
    mark, keep = fresh_name(docs, "_digest"), fresh_name(docs, "_keep_id")
    marked = docs.withColumn(mark, digest(text))

    def one(groups: DataFrame) -> DataFrame:
        named = groups.select(F.col("digest").alias(mark), F.col("keep_id").alias(keep))
        best = marked.join(named, mark).where(F.col(doc_id).eqNullSafe(F.col(keep)))
        # Rows alike in id and text may differ elsewhere; the choice among them is the same on every run.
        row = F.struct(*docs.columns)
        return best.groupBy(mark).agg(F.min_by(row, F.xxhash64(F.to_json(row))).alias("row")).select("row.*")

    single = marked.join(F.broadcast(hot.select(F.col("digest").alias(mark))), mark, "left_anti")
    single = single.join(repeated.select(F.col("digest").alias(mark)), mark, "left_anti").select(*docs.columns)
    return single.union(one(F.broadcast(hot))).union(one(repeated))
