"""SQL surface: ``similarity(a, b)`` as a Spark SQL temporary function (a SQL-bodied function of
native higher-order expressions, so ``spark.sql`` queries can call it with no Python UDF)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .trigram import WORD_SPLIT


def _trigrams_sql(x: str) -> str:
    pattern = WORD_SPLIT.replace("\\", "\\\\")
    return (f"array_distinct(flatten(transform(filter(split(lower({x}), '{pattern}'), w -> length(w) > 0), "
            f"w -> transform(sequence(1, length(w) + 1), i -> substr(concat('  ', w, ' '), i, 3)))))")


def similarity_sql_body() -> str:
    a, b = _trigrams_sql("a"), _trigrams_sql("b")
    common = f"size(array_intersect({a}, {b}))"
    union = f"(size({a}) + size({b}) - {common})"
    return (f"CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN {union} = 0 THEN CAST(0 AS FLOAT) "
            f"ELSE CAST({common} / {union} AS FLOAT) END")


def register_sql_functions(spark: SparkSession) -> None:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION similarity(a STRING, b STRING) RETURNS FLOAT RETURN "
              + similarity_sql_body())
