"""Trigram similarity as native higher-order-function expressions (no UDF).

Word trigrams: lower-case the text, split it into words of letters and digits, pad each word with
two blanks in front and one behind, take every 3-character window, and keep the distinct set.
similarity(a, b) = |A ∩ B| / |A ∪ B|, computed in single precision; NULL in gives NULL out and an
empty set on either side gives 0. The comparison against a threshold is done in double on the
single-precision value, so a score of exactly 1/5 passes ``> 0.2``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default search threshold and word-splitting pattern.
DEFAULT_THRESHOLD = 0.2
WORD_SPLIT = r"[^\p{L}\p{N}]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trigram_set(text) -> Column:
    words = F.filter(F.split(F.lower(_col(text)), WORD_SPLIT), lambda w: F.length(w) > 0)
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(
        padded,
        lambda p: F.transform(F.sequence(F.lit(1), F.length(p) - 2),
                              lambda i: F.substring(p, i, F.lit(3)))))
    return F.array_distinct(grams)


def similarity_of_sets(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    score = F.when(union > 0, common / union).otherwise(F.lit(0.0))
    return F.when(a.isNotNull() & b.isNotNull(), score.cast("float"))


def similarity(a, b) -> Column:
    """similarity(a, b) as FLOAT."""
    return similarity_of_sets(trigram_set(a), trigram_set(b))


def passes(score: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return score.cast("double") > F.lit(float(threshold))


# ---- DuckDB text of the same function, used by the SQL oracle -------------------------------

def sql_trigram_set(text_sql: str) -> str:
    return ("list_distinct(flatten(list_transform("
            f"list_filter(string_split_regex(lower({text_sql}), '{WORD_SPLIT}'), lambda w: length(w) > 0), "
            "lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


def sql_similarity(a_sql: str, b_sql: str) -> str:
    a, b = sql_trigram_set(a_sql), sql_trigram_set(b_sql)
    common = f"length(list_intersect({a}, {b}))"
    union = f"(length({a}) + length({b}) - {common})"
    return (f"CASE WHEN {a_sql} IS NULL OR {b_sql} IS NULL THEN NULL "
            f"WHEN {union} > 0 THEN CAST({common} / {union} AS FLOAT) ELSE CAST(0 AS FLOAT) END")
