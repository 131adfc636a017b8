"""Published-wasm search (ranked, keyset-paged) and the trigram similarity join.

The similarity join replaces a trigram index: names are de-duplicated, and only pairs that agree in one of their rarest trigrams,
early enough for the score to be reached, are compared (a prefix filter with places); no side is collected or counted first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursor import keyset_predicate, parse_cursor, validate_limit
from ..functions.trigram import DEFAULT_THRESHOLD, passes, similarity, trigram_set


def search_rank(query: str | None):
    if query is None:
        return F.lit(0.0).cast("double")
    q = F.lit(query)
    return F.greatest(similarity(F.col("wasm_name"), q).cast("double"),
                      similarity(F.col("channel"), q).cast("double"),
                      F.when(F.col("wasm_hash") == q, F.lit(1.0)).otherwise(F.lit(0.0)),
                      F.when(F.col("author") == q, F.lit(1.0)).otherwise(F.lit(0.0)))


def search_published(latest: DataFrame, query: str | None = None, limit: int | None = None,
                     cursor: str | None = None, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """One page of the published list, optionally filtered and ranked by a search term.

    Pages are cut by (ledger, id) while rows are ordered by rank, as the service does; paging a
    ranked search can therefore skip or repeat rows (kept on purpose, see README)."""
    limit = validate_limit(limit)
    ledger, bound = parse_cursor(cursor)
    df = latest.where(keyset_predicate(ledger, bound))
    if query is not None:
        q = F.lit(query)
        df = df.where(passes(similarity(F.col("wasm_name"), q), threshold) | (F.col("wasm_hash") == q)
                      | (F.col("author") == q) | passes(similarity(F.col("channel"), q), threshold))
    ranked = df.select("id", "author", "wasm_version", "wasm_name", "wasm_hash", "channel", "ledger_sequence",
                       search_rank(query).alias("rank"))
    page = ranked.orderBy(F.col("rank").desc(), F.col("ledger_sequence").asc(), F.col("id").asc()).limit(limit)
    return page.select("id", "author", "wasm_version", "wasm_name", "wasm_hash", "channel",
                       F.round("rank", 6).alias("rank"))


def name_trigrams(names: DataFrame, name_col: str) -> DataFrame:
    """Distinct names with their trigrams: name, grams."""
    d = names.select(F.col(name_col).alias("name")).where(F.col("name").isNotNull()).distinct()
    return d.select("name", trigram_set(F.col("name")).alias("grams"))


def similarity_candidates(q: DataFrame, n: DataFrame, threshold: float) -> DataFrame:
    """(query, q_grams, name, grams): pairs that may pass ``threshold``, by a prefix filter.

    Trigrams have one order, the rarest first (counted over both sides). A pair with more than t of its trigrams in common has
    at least ceil(t x size) of either set in common, so one of them is among the first size - ceil(t x size) + 1 of each in that order.
    Only those are joined: a frequent trigram is in a prefix only of names that hold few rarer ones."""
    t = float(threshold)
    both = q.select(F.explode("grams").alias("gram")).unionAll(n.select(F.explode("grams").alias("gram")))
    rarity = both.groupBy("gram").agg(F.count("*").alias("n_names"))

    def prefix(side: DataFrame, name: str, gram: str) -> DataFrame:
        each = side.select("name", "grams", F.explode("grams").alias("gram")).join(rarity, "gram")
        place = F.row_number().over(Window.partitionBy("name").orderBy("n_names", "gram"))
        size = F.size("grams")
        # t as the score has it, in single precision; the small term keeps a pair at the threshold
        most = size - F.greatest(F.ceil(F.lit(t) * size - 1e-5), F.lit(1)) + 1
        return each.withColumn("place", place).where(F.col("place") <= most).select(
            F.col("name").alias(name), F.col("gram").alias(f"{gram}_gram"), F.col("place").alias(f"{gram}_place"), size.alias(f"{gram}_size"))

    # behind the first trigram that they share, no more can agree than the shorter rest holds
    room = 1 + F.least(F.col("q_size") - F.col("q_place"), F.col("n_size") - F.col("n_place"))
    needed = F.ceil(F.lit(t / (1 + t)) * (F.col("q_size") + F.col("n_size")) - 1e-5)
    pairs = (prefix(q, "query", "q").join(prefix(n, "name", "n"), (F.col("q_gram") == F.col("n_gram")) & (room >= needed))
             .select("query", "name").distinct())
    return (pairs.join(q.select(F.col("name").alias("query"), F.col("grams").alias("q_grams")), "query").join(n, "name"))


def similarity_join(queries: DataFrame, query_col: str, names: DataFrame, name_col: str,
                    threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """All (query, name) pairs with similarity > threshold: (query, name, similarity)."""
    t = float(threshold)
    pairs = similarity_candidates(name_trigrams(queries, query_col), name_trigrams(names, name_col), t)
    # the size bound is rounded and compared as the score is, so a pair at the threshold passes both
    q_n, n_n = F.size("q_grams"), F.size("grams")
    pairs = pairs.where(passes((F.least(q_n, n_n) / F.greatest(q_n, n_n)).cast("float"), t))
    common = F.size(F.array_intersect("q_grams", "grams"))
    out = pairs.select("query", "name", (common / (q_n + n_n - common)).cast("float").alias("similarity"))
    return out.where(passes(F.col("similarity"), t)).select(
        "query", "name", F.round(F.col("similarity").cast("double"), 6).alias("similarity"))
