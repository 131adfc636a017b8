"""Chat formatting after the collapse of cumulative snapshots, in DataFrame functions only.

Logs often hold a conversation again and again, each time with a few turns more. Every turn gets two hashes (64
bits each) of its place in the conversation, its role and its text; their running exclusive-or is the hash of
the turns so far, whatever the order in which parts are added, so a long conversation is hashed in parts of the
sorted table. A conversation whose whole hash is that of the first turns of a longer one is dropped
(anti-join); of equal conversations the one with the least id stays. What is left is rendered, a row a
turn, so no conversation is gathered in one task.

Turns are in the order of (turn, role, text), nulls first; rows repeated in all of these are turns of their own.
Null ids make one conversation. Null roles and texts differ from empty ones but are rendered as such.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, offsets, ranged, stored


def collapse(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``id_col``, place (from 1), turn, role, text and n_turns of the turns of maximal conversations."""
    t = columns_of(turns, id_col, turn_col, role_col, text_col).toDF("conv", "turn", "role", "text")
    rows = ranged(t, ["conv", "turn", "role", "text"], "op8-turns")
    order = ["turn", "role", "text"]
    part = Window.partitionBy("conv", "__part").orderBy(*order)
    before = offsets(rows.groupBy("conv", "__part").agg(F.count("*").alias("n")), "__part", "n", "before", ["conv"])
    before = before.select(F.col("conv").alias("c"), F.col("__part").alias("p"), "before")
    rows = rows.withColumn("place", F.row_number().over(part))
    rows = rows.join(before, rows["conv"].eqNullSafe(before["c"]) & (rows["__part"] == before["p"])).drop("c", "p")
    rows = rows.withColumn("place", F.col("place") + F.col("before")).drop("before")
    content = [F.col("place"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    rows = rows.withColumns({"h1": F.xxhash64(F.lit(1), *content), "h2": F.xxhash64(F.lit(2), *content)})
    parts = rows.groupBy("conv", "__part").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    earlier = Window.partitionBy("conv").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("conv").alias("c"), F.col("__part").alias("p"), *[F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)).alias(x) for x in ("x1", "x2")])
    so_far = Window.partitionBy("conv", "__part").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = rows.drop("text", "role", "turn").join(parts, rows["conv"].eqNullSafe(parts["c"]) & (rows["__part"] == parts["p"]))
    hashed = hashed.select("conv", "place", *[F.bit_xor(h).over(so_far).bitwiseXOR(F.col(x)).alias(f"p{h[1]}") for h, x in (("h1", "x1"), ("h2", "x2"))], "h1", "h2")
    # the turns before a turn are first turns of a longer conversation
    firsts = hashed.where("place > 1").select((F.col("place") - 1).alias("n"), F.col("p1").bitwiseXOR(F.col("h1")).alias("x1"),
                                              F.col("p2").bitwiseXOR(F.col("h2")).alias("x2")).distinct()
    whole = rows.groupBy("conv").agg(F.count("*").alias("n"), F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    whole = whole.groupBy("n", "x1", "x2").agg(F.min(F.struct(F.col("conv").isNull(), "conv")).getField("conv").alias("conv"))
    kept = whole.join(firsts, ["n", "x1", "x2"], "left_anti").select(F.col("conv").alias("c"), F.col("n").alias("n_turns"))
    return (rows.join(kept, rows["conv"].eqNullSafe(kept["c"]))
            .select(F.col("conv").alias(id_col), "place", F.col("turn").alias(turn_col), F.col("role").alias(role_col), F.col("text").alias(text_col), "n_turns"))


def render(turns: DataFrame, role_col: str = "role", text_col: str = "text", opens: str = "<|", closes: str = "|>\n", ends: str = "<|end|>\n") -> DataFrame:
    """``turns`` with ``rendered``: the turns of a conversation, in order of place, make its text."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    return turns.withColumn("rendered", F.concat(F.lit(opens), role, F.lit(closes), text, F.lit(f"\n{ends}")))


def format_chats(turns: DataFrame, **columns) -> DataFrame:
    return render(collapse(turns, **columns))


#: DuckDB SQL of the query: conversations as lists of turns, and prefixes of longer lists by comparison.
SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place,
  role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT k AS n_turns, turns[:k] AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM c)),
w AS (SELECT min(conv_id) AS conv_id, n_turns, turns FROM c GROUP BY n_turns, turns),
kept AS (SELECT conv_id, w.n_turns FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.n_turns = w.n_turns AND p.turns = w.turns))
SELECT t.conv_id, t.place, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10) AS rendered,
  kept.n_turns FROM t JOIN kept ON t.conv_id IS NOT DISTINCT FROM kept.conv_id
"""
