"""From raw documents to sharded training text: quality rules, one of each group of near-duplicates, no benchmark
passages, sources mixed to their target weights, shards.

Every stage is a function of ``(spark, docs, sf_dir)`` whose rows are written as Parquet and read again by the next.
All stages but the last return the columns of ``documents``; a document that the mix takes n times is n rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantgap.llm import decontamination, mixing, near_dedup, quality, sharding, sql
from quantgap.session import cut_lineage

SHARDS = 8
BENCHMARK = "item_id bigint, text string"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every rule accepts."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontamination.remove_documents(docs, spark.read.schema(BENCHMARK).parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its source's target asks for."""
    rows = docs.select(F.struct(*docs.columns).alias("whole_row"), "doc_id", "source", mixing.n_words("text").alias("n_words"))
    return mixing.repeat_copies(mixing.mix(rows, F.col("n_words"), base=mixing.length_base(F.col("n_words"))), ["whole_row.*"])


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row, beside its columns."""
    return sharding.shard_table(docs, "doc_id", SHARDS)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("source mix", source_mix),
    ("shards", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


def _oracle() -> str:
    columns = "doc_id, text, lang, source, n_chars"
    good = f"(SELECT {columns} FROM ({sql.quality_rows('documents')}) WHERE kept)"
    single = f"(SELECT {columns} FROM ({sql.near_duplicate_rows(good)}) WHERE kept)"
    clean = f"(SELECT {columns} FROM ({sql.decontamination_rows(single)}) WHERE NOT contaminated)"
    mixed = f"(SELECT {columns} FROM (SELECT *, unnest(range(copies::BIGINT)) FROM ({sql.mixing_rows(clean)})))"
    return f"SELECT {columns}, shard, slot::BIGINT AS slot FROM ({sql.sharding_rows(mixed, ['doc_id'], SHARDS)})"


ORACLE_SQL = _oracle()
