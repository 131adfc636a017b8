"""A training corpus from ``documents``: each stage takes the rows that the one before it kept.

Quality rules, near-duplicates, benchmark passages, mixing to target weights, then token ids in shard files. All
stages but the last return the columns of their input, whatever further ones are named; a document that the mix repeats is a row each time.
Null and empty texts fail the quality rules. Rows without a difference are interchangeable, so ties give the same rows in every
run. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, mixing, near_dedup, quality, token_output
from ledgerloom.llm.common import numbered, read_table, ship
from ledgerloom.session import state_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither fail the rules nor come from a rejected host."""
    return quality.judge(docs, keep_rows=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group (similarity of 0.8 or more), that of the least id; documents without words all stay."""
    ship(spark)
    found = near_dedup.near_duplicates(docs, percent=80)
    stays = (found.where("group is not null").groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
             .select(F.col("one.doc_id").alias("id"), F.col("one.text_hash").alias("th"), F.lit(1).alias("copies")))
    empty = found.where("group is null").groupBy("doc_id", "text_hash").agg(F.count("*").cast("int").alias("copies"))
    stays = stays.union(empty.select("doc_id", "text_hash", "copies"))
    rows = numbered(docs, ["doc_id"], "text")
    rows = rows.join(stays, rows["row"]["doc_id"].eqNullSafe(stays["id"]) & (rows["hash"] == stays["th"]))
    return rows.where("place <= copies").select("row.*")


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without a benchmark item."""
    ship(spark)
    return decontaminate.without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs, mixing.mix_sources(docs))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of the files written: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return token_output.encode_to_files(docs).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing to target weights", source_weights),
    ("token ids", token_files),
]

#: Near-duplicate groups, edit distances and the tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    base = state_dir(spark, "llm-pipeline")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
