"""Merkle manifest of a table, a tree a source, by time-forward processing.

A leaf is the digest of a row. In each source the leaves ascend by id; while several nodes remain, every ``FAN`` consecutive
ones (the last run may be shorter, even one) become the digest of their digests. What remains is the source's subroot; the
subroots in the order of their sources give the root in the same way. The null source is a source and comes first.

* A node's label is (tree, block, place): a block is ``FAN`` ^ ``height`` consecutive nodes of a level, so it never grows with
  the table. Spark's sort by label is the external priority queue: it brings each block's digests in order, and
  the sweep hands every digest to its parent as it goes, holding fewer than ``FAN`` digests a level. The blocks' tops are the
  nodes of the next round; a round climbs ``height`` levels.
* The reversed sweep brings a block the rest of its top's proof as a message that sorts before its nodes, and each
  node gets the siblings on its way to the top and then that rest. The nodes of a round are the tops of the one before it.

Digests are lowercase hexadecimal sha256; a digest's inputs are concatenated as text. Rows of one id go by their leaf, so
equal rows are interchangeable; null ids come first. Empty tables give no rows and no root. Columns that
aren't named are not read; carried ones keep their names. Long texts are hashed whole.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import offsets, ranged, stored

FAN = 3
_STEPS = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.reduce(proof, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]).cast("binary"), 256))


def proof_text(proof: Column) -> Column:
    """The siblings of a proof, level by level, left to right."""
    return F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), "")


def _parent(run: list[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


def _numbered(rows: DataFrame, order: list[str], name: str, tree: str | None) -> DataFrame:
    """``rows`` with their number (from 0) in ``order`` within the tree (all of one tree if None), without one sort of it all."""
    placed = ranged(rows, order, f"{name}-order")
    by = [tree] if tree else []
    totals = stored(placed.groupBy(*by, "__part").agg(F.count("*").alias("__n")), f"{name}-totals")
    before = offsets(totals, "__part", "__n", "__before", by).select(*[F.col(c).alias("__tree") for c in by], F.col("__part").alias("__p"), "__before")
    if tree:
        size = totals.groupBy(tree).agg(F.sum("__n").alias("__size")).withColumnRenamed(tree, "__of")
        before = before.join(size, F.col("__tree").eqNullSafe(F.col("__of"))).drop("__of")
        same = placed[tree].eqNullSafe(before["__tree"]) & (placed["__part"] == before["__p"])
    else:
        before = before.withColumn("__size", F.lit(totals.agg(F.sum("__n")).first()[0] or 0))
        same = placed["__part"] == before["__p"]
    rank = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*[c for c in order if c != tree]))
    return (placed.withColumn("__rank", rank).join(before, same)
            .withColumn("place", F.col("__rank") - 1 + F.col("__before")).withColumnRenamed("__size", "size")
            .drop("__rank", "__before", "__tree", "__p", "__part"))


def _climb(nodes: DataFrame, height: int) -> DataFrame:
    """tree, place, size, digest one round up; ``nodes``: the same of a level, size being the number of the tree's nodes there."""
    width = FAN ** height
    placed = (nodes.select("tree", F.expr(f"place div {width}").alias("block"), "place", "size", "digest")
              .repartition("tree", "block").sortWithinPartitions("tree", "block", "place"))

    def sweep(batches):
        import pyarrow as pa

        label, levels, waits, count = None, 0, [], 0
        out: tuple[list, list, list, list] = ([], [], [], [])

        def give(level, digest):  # a digest to its parent; a full run goes up at once
            while level < levels:
                waits[level].append(digest)
                if len(waits[level]) < FAN:
                    return
                digest, waits[level], level = _parent(waits[level]), [], level + 1
            for column, value in zip(out, (label[0], label[1], count, digest), strict=True):
                column.append(value)

        def close():
            for level in range(levels):
                if waits[level]:
                    run, waits[level] = waits[level], []
                    give(level + 1, _parent(run))

        for batch in batches:
            for tree, block, _, size, digest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (tree, block) != label:
                    if label:
                        close()
                    label, levels, count = (tree, block), 0, -(-size // width)
                    while levels < height and FAN ** levels < size:
                        levels += 1
                    waits = [[] for _ in range(levels)]
                give(0, digest)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types(pa), strict=True)], names=names)
                for c in out:
                    c.clear()
        if label:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types(pa), strict=True)], names=names)

    names = ["tree", "place", "size", "digest"]

    def types(pa):
        return pa.string(), pa.int64(), pa.int64(), pa.string()

    return placed.mapInArrow(sweep, "tree string, place bigint, size bigint, digest string")


def _rounds(nodes: DataFrame, height: int, name: str) -> list[DataFrame]:
    """The nodes and, round by round, what they climb to; in the last one every tree has one node."""
    out = [stored(nodes, f"{name}-0")]
    while (out[-1].agg(F.max("size")).first()[0] or 1) > 1:
        out.append(stored(_climb(out[-1], height), f"{name}-{len(out)}"))
    return out


def _descend(nodes: DataFrame, proofs: DataFrame, height: int) -> DataFrame:
    """tree, place, proof, top of ``nodes``; ``proofs``: the same of what they climb to."""
    width = FAN ** height
    block = F.expr(f"place div {width}").alias("block")
    message = proofs.select("tree", F.col("place").alias("block"), F.lit(-1).cast("bigint").alias("place"), F.lit(0).cast("bigint").alias("size"),
                            F.lit(None).cast("string").alias("digest"), "proof", "top")
    rows = nodes.select("tree", block, "place", "size", "digest", F.lit(None).cast(_STEPS).alias("proof"), F.lit(None).cast("string").alias("top"))
    placed = message.unionByName(rows).repartition("tree", "block").sortWithinPartitions("tree", "block", "place")

    def sweep(batches):
        import pyarrow as pa

        step = pa.struct([("before", pa.string()), ("after", pa.string())])
        label, rest, places, digests = None, ([], [], None), [], []

        def answers():
            """The block's nodes with their proofs, a batch at a time."""
            levels, size = [digests], label[2]
            while len(levels) <= height and FAN ** (len(levels) - 1) < size:
                up = levels[-1]
                levels.append([_parent(up[k:k + FAN]) for k in range(0, len(up), FAN)])
            levels.pop()  # the top has its message
            for low in range(0, len(places), 2_000):
                before, after, ends = [], [], [0]
                for k in range(low, min(low + 2_000, len(places))):
                    for level in levels:
                        run = k // FAN * FAN
                        before.append("".join(level[run:k]))
                        after.append("".join(level[k + 1:run + FAN]))
                        k //= FAN
                    before += rest[0]
                    after += rest[1]
                    ends.append(len(before))
                steps = pa.StructArray.from_arrays([pa.array(before, pa.string()), pa.array(after, pa.string())], fields=list(step))
                n = len(ends) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([label[0]] * n, pa.string()), pa.array(places[low:low + n], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), steps), pa.array([rest[2]] * n, pa.string())],
                    names=["tree", "place", "proof", "top"])

        for batch in batches:
            for tree, part, place, size, digest, proof, top in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place < 0:
                    if places:
                        yield from answers()
                    rest, places, digests = ([s["before"] for s in proof], [s["after"] for s in proof], top), [], []
                    continue
                label = (tree, part, size)
                places.append(place)
                digests.append(digest)
        if places:
            yield from answers()

    return placed.mapInArrow(sweep, f"tree string, place bigint, proof {_STEPS}, top string")


def _proofs(rounds: list[DataFrame], top: DataFrame, height: int, name: str) -> DataFrame:
    """tree, place, proof, top of the lowest nodes; ``top``: the same of every tree's last node."""
    for k in range(len(rounds) - 2, -1, -1):
        top = _descend(rounds[k], top, height)
        if k:
            top = stored(top, f"{name}-down-{k}")
    return top


def manifest(leaves: DataFrame, height: int = 8, source_col: str = "source", id_col: str = "doc_id", leaf_col: str = "leaf") -> tuple[DataFrame, DataFrame, str | None]:
    """Of ``leaves`` (source, id, leaf digest and columns to carry): the leaves with ``subroot`` and ``proof``, a step (before, after:
    the siblings' digests) a level up to the root; the sources with their ``subroot`` and ``size``; the root."""
    names = leaves.columns
    order = ["__source", "__id", "__leaf"]
    rows = leaves.withColumns({"__source": F.col(f"`{source_col}`").cast("string"), "__id": F.col(f"`{id_col}`"), "__leaf": F.col(f"`{leaf_col}`")})
    rows = rows.select(*order, F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"))
    rows = stored(_numbered(rows, order, "op12-leaves", "__source"), "op12-leaves")
    nodes = rows.select(F.col("__source").alias("tree"), "place", "size", F.col("__leaf").alias("digest"))
    low = _rounds(nodes, height, "op12-sources")
    subroots = low[-1].select(F.col("tree").alias("__source"), F.col("digest").alias("__leaf"))
    subroots = stored(_numbered(subroots, ["__source"], "op12-subroots", None), "op12-subroots")
    all_of = F.lit(None).cast("string")
    high = _rounds(subroots.select(all_of.alias("tree"), "place", "size", F.col("__leaf").alias("digest")), height, "op12-root")
    last = high[-1].first()
    root = last["digest"] if last else None
    empty = F.array().cast(_STEPS)
    way = _proofs(high, high[-1].select("tree", "place", empty.alias("proof"), F.col("digest").alias("top")), height, "op12-root")
    way = way.select("place", "proof").alias("w").join(subroots.alias("s"), F.col("w.place") == F.col("s.place"))
    tops = stored(way.select(F.col("s.__source").alias("tree"), F.lit(0).cast("bigint").alias("place"), F.col("w.proof").alias("proof"),
                             F.col("s.__leaf").alias("top")), "op12-tops")
    proofs = _proofs(low, tops, height, "op12-sources")
    out = rows.join(proofs, rows["__source"].eqNullSafe(proofs["tree"]) & (rows["place"] == proofs["place"]))
    sizes = rows.groupBy("__source").agg(F.count("*").alias("size")).join(tops, F.col("__source").eqNullSafe(F.col("tree")))
    return (out.select("__row.*", F.col("top").alias("subroot"), "proof"),
            sizes.select(F.col("__source").alias(source_col), F.col("top").alias("subroot"), "size"), root)


def tampered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, without its line feeds where 2 divides the crc32 of the decimal id."""
    t = F.col(f"`{text_col}`")
    return F.when(F.crc32(F.col(f"`{id_col}`").cast("string")) % 2 == 0, F.translate(t, "\n", "")).otherwise(t)


def documents_manifest(docs: DataFrame, height: int = 8) -> DataFrame:
    """Each row of ``documents`` with its leaf and proof, and whether it still folds to the root after tampering."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaves = docs.select("doc_id", "source", leaf_digest(*rest, F.col("text")).alias("leaf"),
                         F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(*rest, tampered(docs))).alias("changed"))
    rows, _, root = manifest(leaves, height)
    folded = fold(F.coalesce(F.col("changed"), F.col("leaf")), F.col("proof"))
    out = rows.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"),
                      F.sha2(proof_text(F.col("proof")).cast("binary"), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _levels(name: str, depth: int, tree: str) -> list[str]:
    """DuckDB: the levels of trees from ``name``_0 (tree key, i, n, h) up, and each node's siblings in its run."""
    ctes = []
    for k in range(depth):
        ctes.append(f"{name}_s{k} AS MATERIALIZED (SELECT {tree}, i, n, coalesce(lag(h, 2) OVER w, '') || coalesce(lag(h) OVER w, '') AS l, "
                    f"coalesce(lead(h) OVER w, '') || coalesce(lead(h, 2) OVER w, '') AS r FROM {name}_{k} WINDOW w AS (PARTITION BY {tree}, i // 3 ORDER BY i))")
        ctes.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT {tree}, i // 3 AS i, CASE WHEN n = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h, "
                    f"(n + 2) // 3 AS n FROM {name}_{k} GROUP BY {tree}, i // 3, n)")
    return ctes


def sql(depth: int = 12) -> str:
    """DuckDB SQL of ``documents_manifest`` for up to 3 ^ ``depth`` rows a source and sources."""
    def part(x):
        return f"coalesce(strlen({x}::VARCHAR) || ':' || {x}::VARCHAR, '-')"

    head = " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = ("(SELECT list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x)), lambda p: ascii(x[p + 1])::UBIGINT)), "
           "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), "
           "lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)))")
    ctes = [f"d AS MATERIALIZED (SELECT *, doc_id::VARCHAR AS x, {head} AS head FROM documents)",
            f"e AS MATERIALIZED (SELECT doc_id, source, sha256(head || {part('text')}) AS leaf, CASE WHEN xor({crc}, 4294967295::UBIGINT) % 2 = 0 "
            f"THEN sha256(head || {part(chr(40) + 'replace(text, chr(10), ' + chr(39) * 2 + ')' + chr(41))}) END AS changed FROM d)",
            "lo_0 AS MATERIALIZED (SELECT source, doc_id, leaf, changed, leaf AS h, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY source) AS n "
            "FROM e WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf))",
            *_levels("lo", depth, "source"),
            "hi_0 AS MATERIALIZED (SELECT 0 AS t, source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n "
            f"FROM lo_{depth})",
            *_levels("hi", depth, "t"),
            "p_0 AS (SELECT lo_0.source, doc_id, leaf, lo_0.i, '' AS proof, coalesce(changed, leaf) AS f FROM lo_0)"]
    k = 0
    for name, key, place in (("lo", "source", "i"), ("hi", None, "i")):
        for level in range(depth):
            same = "p.source IS NOT DISTINCT FROM s.source AND p.i = s.i" if key else "p.i = s.i"
            ctes.append(f"p_{k + 1} AS MATERIALIZED (SELECT p.source, doc_id, leaf, p.i // 3 AS i, CASE WHEN s.n > 1 THEN proof || s.l || s.r ELSE proof END AS proof, "
                        f"CASE WHEN s.n > 1 THEN sha256(s.l || f || s.r) ELSE f END AS f FROM p_{k} p JOIN {name}_s{level} s ON {same})")
            k += 1
        if name == "lo":
            ctes.append(f"p_{k + 1} AS (SELECT p.source, doc_id, leaf, s.i, proof, f FROM p_{k} p JOIN hi_0 s ON p.source IS NOT DISTINCT FROM s.source)")
            k += 1
    return (f"WITH {', '.join(ctes)} SELECT doc_id, leaf, lo_{depth}.h AS subroot, hi_{depth}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, "
            f"f = hi_{depth}.h AS verified FROM p_{k} p JOIN lo_{depth} ON p.source IS NOT DISTINCT FROM lo_{depth}.source, hi_{depth}")


SQL = sql()
