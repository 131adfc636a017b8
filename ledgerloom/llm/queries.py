"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language_id, manifest, mixing, periodic_runs, quality, sanitise, token_counts, token_output
from .common import read_table, ship
from .license_scan import scan_licenses
from .near_dedup import near_duplicates
from .suffix_dedup import remove_repeats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), length=200).drop("kept", "spans")


@query
def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85, words=5).drop("text_hash", "group")


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).drop("source", "text_hash", "number")


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"))


SQL["op4_mixing"] = mixing.SQL
SQL["op6_quality"] = quality.SQL


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(read_table(spark, sf_dir, "documents"))


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out_of_sample = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~out_of_sample))
    return language_id.identify(docs, model).select("doc_id", out_of_sample.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts_by_document(read_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


@query
def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_output.encode_to_files(read_table(spark, sf_dir, "documents"))
    return files.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations")).select("conv_id", "place", "rendered", "n_turns")


SQL["op8_chat_format"] = chat.SQL


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic_runs.digests(periodic_runs.find_runs(periodic_runs.with_periods(docs)))


@query
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.documents_manifest(read_table(spark, sf_dir, "documents"))


SQL["op12_manifest"] = manifest.SQL


@query
def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.spans_report(read_table(spark, sf_dir, "documents"))
