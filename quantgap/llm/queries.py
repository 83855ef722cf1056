"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgap.llm import (
    centroids,
    credentials,
    decontamination,
    exact_dedup,
    html_text,
    mixing,
    near_dedup,
    periodic_runs,
    quality,
    sharding,
    sql,
    token_counts,
    toxicity,
    warc,
)
from quantgap.llm.common import words
from quantgap.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


@query("op1_sharding", sql.sharding_query())
def op1_sharding(spark, folder):
    content = F.coalesce("text", F.lit(""))
    keys = table(spark, folder, "documents").select(
        "doc_id", (F.octet_length(content) + 1).cast("long").alias("size"), F.crc32(content.cast("binary")).alias("text_crc32")
    )
    dealt = sharding.shard_keys(keys, ["doc_id", "size", "text_crc32"], shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_warc", sql.warc_query())
def op2_warc(spark, folder):
    records = warc.archive(table(spark, folder, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_near_duplicates", sql.near_duplicate_query())
def op3_near_duplicates(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op4_mixing", sql.mixing_query())
def op4_mixing(spark, folder):
    docs = table(spark, folder, "documents")
    counted = cut_lineage(docs.select("doc_id", "source", mixing.n_words("text").alias("n_words")), "counted")  # one pass over the texts
    mixed = mixing.mix(counted, F.col("n_words"), base=mixing.length_base(F.col("n_words")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate")


@query("op5_html_extraction")
def op5_html_extraction(spark, folder):
    return html_text.extract(table(spark, folder, "pages"))


@query("op6_token_counts")
def op6_token_counts(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"))


@query("op7_secret_scan")
def op7_secret_scan(spark, folder):
    return credentials.scan(table(spark, folder, "documents"))


@query("op8_toxicity")
def op8_toxicity(spark, folder):
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels")
    return toxicity.score(docs, toxicity.fit(docs, labels))


@query("op9_quality_rules", sql.quality_query())
def op9_quality_rules(spark, folder):
    judged = quality.judge(quality.measure(table(spark, folder, "documents").select("doc_id", "text")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_decontamination", sql.decontamination_query())
def op10_decontamination(spark, folder):
    hits = decontamination.find_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        decontamination.hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` where every tenth document, by the CRC of its id, repeats a part of itself from some word on."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", mark.alias("h")).withColumn("w", F.when(F.col("h") % 10 == 0, words(F.coalesce("text", F.lit("")))))
    rows = rows.withColumns({"n": F.size("w"), "g": F.floor(F.col("h") / 10)})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    moved = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.col("w")[place(i)])
    return rows.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", sql.periodic_query())
def op11_periodic_runs(spark, folder):
    found = periodic_runs.find_runs(planted(table(spark, folder, "documents")), ["doc_id"])
    none = F.lit(None).cast("struct<start: bigint, period: bigint, length: bigint>")
    # Runs come by start, then period, so the first of equal exponents stays.
    more = lambda best, run: best.isNull() | (run.length * best.period > best.length * run.period)
    best = F.aggregate("runs", none, lambda best, run: F.when(more(best, run), run).otherwise(best))
    line = lambda run: F.concat(run.start.cast("string"), F.lit(","), run.length.cast("string"), F.lit(","), run.period.cast("string"), F.lit("\n"))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.array_join(F.transform("runs", line), "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_centroids", sql.centroid_query())
def op12_centroids(spark, folder):
    members, places = centroids.cluster(table(spark, folder, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    named = centroids.with_inertia(members).join(F.broadcast(places), "cluster")
    return named.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


@query("op13_exact_dedup", sql.exact_query())
def op13_exact_dedup(spark, folder):
    return exact_dedup.find_copies(table(spark, folder, "documents"))
