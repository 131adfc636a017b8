"""Connected components of an undirected graph, by large and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each vertex's neighbours (the larger ones, or the smaller ones and itself) to the least of all."""
    pairs = (edges.union(edges.select("b", "a")) if large
             else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    out = pairs.join(least, "a")
    if large:
        out = out.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = out.select(F.col("b").alias("a"), F.col("least").alias("b")).union(least.select("a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(a, b): b is the least vertex of the component of a. Vertices without edges don't appear, nor do the
    least ones. ``edges``: columns a and b. The number of rounds grows with the logarithm of the component size."""
    edges = stored(edges.where("a <> b").distinct(), name)
    before = None
    while True:
        edges = stored(_star(_star(edges, True), False), name)
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == before or now[0] == 0:
            return edges
        before = now
