"""Mixing sources to target weights by systematic sampling.

* A document's size is its number of words. Sources in code point order, null last, weigh ``weights`` in turn and
  share the sum of all sizes; a target stops at ``most`` times its source's size, and the excess is shared
  again by weight among the others until none is above.
* Every document of a source is expected target / source size times. Over the documents of a source in
  the order of (size, id) the expected copies are summed, one offset in [0, 1) is added to the sums, and a document is
  emitted once for each whole number that the sum passes in it. The order by size spreads the chosen documents
  evenly over all sizes, so a source's words come near its target. The offset depends on the source and
  ``seed`` only: reruns agree.

Null and empty texts have size 0; a source without words has target 0 and is left out. A null source is a
source. Repeated rows are separate documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, numbered, offsets, ranged, stored, word_count


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, target; ``sizes``: one row a source. Each round of sharing is one aggregate."""
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
                     % len(weights) + 1)
    sources = stored(sizes.withColumn("weight", w).withColumn("cap", F.lit(most) * F.col("source_size")), "op4-sources")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, at_cap = 0.0, -1
    while True:
        capped = F.col("cap").cast("double") <= F.lit(share) * F.col("weight")
        n, full, rest = sources.agg(F.count_if(capped), F.sum(F.when(capped, F.col("cap")).otherwise(0)),
                                    F.sum(F.when(capped, 0).otherwise(F.col("weight")))).first()
        if n == at_cap or not rest:
            break
        at_cap, share = n, (total - full) / rest
    return sources.select("source", "source_size",
                          F.least(F.col("cap").cast("double"), F.lit(float(share)) * F.col("weight")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 11,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``id_col``, size, source_size, target, copies, taken (copies x size), source, text_hash (xxhash64 of the text), number (from
    1, among rows of one id, source and text) of each document."""
    d = columns_of(docs, id_col, text_col, source_col).toDF("id", "text", "source")
    sized = d.select("id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"))
    rows = ranged(sized, ["source", "size", "id", "text_hash"], "op4-order")
    totals = rows.groupBy("source", "__part").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    totals = stored(totals, "op4-totals")
    before = offsets(totals, "__part", "n", "before", ["source"])
    share = targets(totals.groupBy("source").agg(F.sum("words").alias("source_size")), weights, most)
    plan = (before.alias("b").join(share.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
            .select(F.col("b.source").alias("source_b"), F.col("b.__part").alias("part_b"), "before", "source_size", "target"))
    here = Window.partitionBy("source", "__part").orderBy("size", "id", "text_hash")
    ranks = rows.withColumn("rank", F.row_number().over(here))
    ranks = (ranks.join(plan, ranks["source"].eqNullSafe(plan["source_b"]) & (ranks["__part"] == plan["part_b"]))
             .withColumn("rank", F.col("rank") + F.col("before"))
             .withColumn("each", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
    u = offset(F.col("source"), seed)
    copies = F.floor(F.col("each") * F.col("rank") + u) - F.floor(F.col("each") * (F.col("rank") - 1) + u)
    return (ranks.withColumn("copies", copies.cast("long"))
            .withColumn("number", F.row_number().over(Window.partitionBy("id", "source", "text_hash").orderBy("rank")))
            .select(F.col("id").alias(id_col), "size", "source_size", "target", "copies",
                    (F.col("copies") * F.col("size")).alias("taken"), F.col("source").alias(source_col), "text_hash", "number"))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as ``mixed`` says. Rows equal in id, source and text are told apart by their other
    columns (as JSON), so reruns give the same rows; further columns pass unchanged, whatever their names."""
    d = numbered(docs, [id_col, source_col], text_col)
    m = mixed.where("copies > 0").select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col("text_hash").alias("h"),
                                         F.col("number").alias("n"), "copies")
    d = d.join(m, d["row"][id_col].eqNullSafe(m["id"]) & d["row"][source_col].eqNullSafe(m["source"])
               & (d["hash"] == m["h"]) & (d["place"] == m["n"]))
    return d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


#: DuckDB SQL of ``mix_sources`` with its default parameters: the level of sharing in closed form.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
t AS (SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
levels AS (SELECT a.cap, a.weight, any_value(a.total) - sum(CASE WHEN b.cap * a.weight < a.cap * b.weight THEN b.cap ELSE 0 END) AS open,
  sum(CASE WHEN b.cap * a.weight < a.cap * b.weight THEN 0 ELSE b.weight END) AS weights FROM t a, t b GROUP BY a.source, a.cap, a.weight),
level AS (SELECT max(open::DOUBLE / weights::DOUBLE) AS share FROM levels WHERE open::DOUBLE / weights::DOUBLE <= cap::DOUBLE / weight),
g AS (SELECT source, source_size, least(cap::DOUBLE, share * weight) AS target FROM t, level),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) AS rank FROM d),
x AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS each, rank,
  ('0x' || substr(md5('11:' || coalesce('s' || g.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, (floor(each * rank + u) - floor(each * (rank - 1) + u))::BIGINT AS copies,
  (floor(each * rank + u) - floor(each * (rank - 1) + u))::BIGINT * size AS taken FROM x
"""
