"""Near-duplicate groups by one-permutation hashing.

* A document's set holds the hashes (64 bits) of its distinct runs of ``words`` words, A-Z lower-cased; a
  text with fewer words is one run. Documents with equal sets form a class, which goes on as one vertex.
* Sketch. One hash of each run chooses a bin and its value there; the least value of a bin stands. An empty
  bin takes over the value of another, drawn by a hash of the bin and the attempt until a filled one comes
  (optimal densification). ``rows`` bins make a band; classes that agree in a whole band share a bucket.
* Candidates are stars: the members of a bucket are compared with its centre, the class whose buckets hold
  most members in all. Where the other members are then still in several components, the differences between
  them and the centre find the rest: two sets that differ little from each other, one of them far from the
  centre, must differ from the centre in the same places. So many differences must agree that, with those in
  the order of their frequency about the centre, one agrees within the first few of each (prefix filter); classes that agree in
  one of these are compared. What many share, a footer say, comes last in that order, so near misses that have it in common
  are not compared for it, and no pair of a bucket is lost.
* A link is confirmed on the full sets: 100 x intersection >= ``percent`` x union.

With the default 32 bands of 4 bins, a pair at a similarity of 0.85 shares no bucket with a probability of 6e-11.
A null or empty text, or one without words, has an empty set and no links. Repeated rows are documents of
one class. A null id is never the least of a component unless no other id is there.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stored
from .components import components
from .rolling import SEGMENT, Prefix, mix


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words; bytes.split() cuts at space and tab to carriage return."""
    w = data.lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    size = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    end = np.cumsum(size + 1) - 1
    start = end - size
    if len(w) > words:
        start, end = start[:len(w) - words + 1], end[words - 1:]
    else:
        start, end = start[:1], end[-1:]
    text, out = np.frombuffer(b" ".join(w), dtype=np.uint8), []
    long = end - start > SEGMENT  # words of a megabyte: such runs, and only they, are hashed one at a time
    if long.any():
        out.append(np.array([int.from_bytes(hashlib.blake2b(text[a:b], digest_size=8).digest(), "little")
                             for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)], dtype=np.uint64))
        start, end = start[~long], end[~long]
    at = 0
    while at < len(start):
        behind = max(int(np.searchsorted(end, start[at] + SEGMENT, side="right")), at + 1)
        lo = start[at]
        prefix = Prefix(text[lo:end[behind - 1]])
        out.append(prefix.of(start[at:behind] - lo, end[at:behind] - lo))
        at = behind
    return np.unique(np.concatenate(out))


@lru_cache(maxsize=4)
def _draws(bins: int) -> np.ndarray:
    """For each bin and attempt, the bin to take a value from."""
    i, attempt = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(4 * bins, dtype=np.uint64), indexing="ij")
    drawn = (mix(i * np.uint64(1 << 32) + attempt + np.uint64(1)) % np.uint64(bins)).astype(np.int64)
    drawn[:, 3 * bins:] = (np.arange(bins)[:, None] + np.arange(bins)) % bins  # then each in turn, so that one is found
    return drawn


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One value a bin; ``hashes`` are sorted, not empty."""
    h = np.sort(mix(hashes))
    width = (1 << 64) // bins
    edge = np.searchsorted(h, np.arange(bins, dtype=np.uint64) * np.uint64(width))
    full = edge < np.append(edge[1:], len(h))
    out = h[np.minimum(edge, len(h) - 1)]
    empty = np.flatnonzero(~full)
    if len(empty):
        draws = _draws(bins)[empty]
        out[empty] = out[draws[np.arange(len(empty)), full[draws].argmax(axis=1)]]
    return out


def _features(words: int, bands: int, rows: int):
    salt = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(bands, rows) | np.uint64(1)

    def run(batches):
        for batch in batches:
            n, digest, keys = [], [], []
            for text in batch.column("text"):
                s = shingles(text.as_py() or b"", words)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    keys.append(None)
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                v = sketch(s, bands * rows).reshape(bands, rows)
                keys.append(mix((v * salt).sum(axis=1, dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id"), "th": batch.column("th"), "n": pa.array(n, pa.int64()),
                "node": pa.array(digest, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))})
    return run


def _sets(words: int):
    def run(batches):
        for batch in batches:
            sets = [shingles(t.as_py() or b"", words).tobytes() for t in batch.column("text")]
            same = [hashlib.blake2b(s, digest_size=16).digest() == node.as_py()
                    for s, node in zip(sets, batch.column("node"), strict=True)]
            out = pa.RecordBatch.from_pydict({"node": batch.column("node"), "shingles": pa.array(sets, pa.binary())})
            yield out.filter(pa.array(same))
    return run


def _both(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each value of ``y``, whether ``x`` has it; both sorted, not empty."""
    return x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y


def _pairs(batch):
    for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
        yield np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in _pairs(batch):
                both = int(_both(x, y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _differences(percent: int):
    """The differences of each class (``y``) from its centre (``x``): runs that the centre lacks and runs that it alone has; and
    within how many of them, in whatever common order, one agrees with a partner's. Linked sets of sizes n and m differ in at most share x (n + m) runs, where share =
    (100 - percent) / (100 + percent); with d and e differences from the centre, (d + e - share x (n + m)) / 2
    of them at least are the same ones. ``least`` is a lower bound of that over all partners that may come."""
    share = (100 - percent) / (100 + percent)

    def run(batches):
        for batch in batches:
            d, far, within, runs = [], [], [], []
            for x, y in _pairs(batch):
                added, missing = y[~_both(x, y)], x[~_both(y, x)]
                both, differ = len(y) - len(added), len(added) + len(missing)
                linked = 100 * both >= percent * (len(x) + len(added))
                if linked:  # its partners are far from the centre
                    least = (differ + share * (len(x) - len(y))) / 2
                else:
                    least = max((differ - share * (len(x) + len(y))) / 2, differ - share * len(y) * (1 + 100 / percent))
                n = int(differ - max(least, 1) + 1e-6) + 1
                d.append(differ)
                far.append(not linked)
                within.append(n)
                runs.append(np.concatenate([added, missing]).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                "c": batch.column("c"), "node": batch.column("node"), "part": batch.column("part"), "n": batch.column("n"),
                "d": pa.array(d, pa.int64()), "far": pa.array(far, pa.bool_()), "within": pa.array(within, pa.int64()),
                "runs": pa.array(runs, pa.list_(pa.int64()))})
    return run


def _close(stars: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs that may be linked, of classes of one centre that are in different parts. ``stars``: c, node, part, n."""
    share = (100 - percent) / (100 + percent)
    x = sets.select(F.col("node").alias("c"), F.col("shingles").alias("x"))
    y = sets.select("node", F.col("shingles").alias("y"))
    cells = stored(stars.join(x, "c").join(y, "node").select("c", "node", "part", "n", "x", "y")
                   .mapInArrow(_differences(percent), "c binary, node binary, part long, n long, d long, far boolean, within long, runs array<long>"),
                   "op7-differences").select("c", "node", "part", "n", "d", "far", "within", F.explode("runs").alias("run"))
    mixed = (cells.groupBy("c", "run").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.max("far").alias("any_far"),
                                           F.count("*").alias("members"))
             .where("lo <> hi and any_far").select("c", "run", "members"))
    # each class's differences in the order of their frequency, those of one part first
    own = Window.partitionBy("c", "node")
    place = F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("members", "run")) - 1
    cells = stored(cells.join(mixed, ["c", "run"]).withColumn("pos", place).where("pos < within"), "op7-cells")
    other = cells.select("c", "run", *[F.col(k).alias(f"{k}_b") for k in ("node", "part", "n", "d", "far", "pos")])
    same = f"greatest(1, (d + d_b - {share!r}D * (n + n_b)) / 2)"  # so many differences agree
    return (cells.join(other, ["c", "run"])
            .where("node < node_b and part <> part_b and (far or far_b)")
            .where(f"100 * least(n, n_b) >= {percent} * greatest(n, n_b)")
            .where(f"pos <= d - {same} + 1e-6 and pos_b <= d_b - {same} + 1e-6")
            .select(F.col("node").alias("a"), F.col("node_b").alias("b")).distinct())


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, bands: int = 32, rows: int = 4,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles, component_id (least id reachable, itself included), kept (id = component_id),
    text_hash (xxhash64 of the text) and group (a name of its component, null for an empty set) of each document."""
    base = columns_of(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long"))
    base = base.select("id", F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    features = stored(base.mapInArrow(_features(words, bands, rows), "id long, th long, n long, node binary, bands array<long>"), "op7-sketch")
    classes = (features.where("node is not null").groupBy("node")
               .agg(F.min(F.struct("id", "th")).alias("one"), F.first("n").alias("n"), F.first("bands").alias("bands")))
    buckets = classes.select("node", "n", "one", F.posexplode("bands").alias("band", "key"))
    counts = buckets.groupBy("band", "key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stored(buckets.join(counts, ["band", "key"]), "op7-buckets")
    rank = shared.groupBy("node").agg(F.sum("members").alias("rank"), F.first("one").alias("one"))
    chosen = rank.select("node", "one.id", "one.th")
    sets = stored(base.join(chosen, base["id"].eqNullSafe(chosen["id"]) & (base["th"] == chosen["th"]))
                  .select("node", "text").mapInArrow(_sets(words), "node binary, shingles binary")
                  .groupBy("node").agg(F.first("shingles").alias("shingles")), "op7-sets")
    # the members of each bucket but its centre, with the centre
    ranked = shared.select("node", "band", "key", "n").join(rank.select("node", "rank"), "node")
    centre = ranked.groupBy("band", "key").agg(F.max(F.struct("rank", "node", "n")).alias("top"))
    centre = centre.select("band", "key", F.col("top.node").alias("c"), F.col("top.n").alias("n_c"))
    arms = stored(ranked.drop("rank").join(centre, ["band", "key"]).where("node <> c"), "op7-arms")

    def confirmed(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        return stored(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
                      .mapInArrow(_confirm(percent), "a binary, b binary"), "op7-links")

    def labelled(links: DataFrame) -> DataFrame:
        return components(links, "op7-parts").select(F.col("a").alias("node"), F.col("b").alias("part"))

    links = confirmed(arms.where(f"100 * least(n, n_c) >= {percent} * greatest(n, n_c)")
                      .select(F.least("c", "node").alias("a"), F.greatest("c", "node").alias("b")).distinct())
    label = labelled(links)
    # buckets whose members, the centre aside, are in several parts
    arms = arms.join(label, "node", "left").withColumn("part", F.xxhash64(F.coalesce("part", "node")))
    several = (arms.groupBy("band", "key").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
               .where("lo <> hi").select("band", "key"))
    stars = arms.join(several, ["band", "key"]).select("c", "node", "part", "n").distinct()
    more = confirmed(_close(stars, sets, percent))
    if not more.isEmpty():
        label = labelled(links.union(more))
    plain = features.select("id", "th", "n", "node")
    joined = plain.join(label, "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = joined.where("part is not null").groupBy("part").agg(F.min("id").alias("least"))
    out = joined.join(least, "part", "left")
    component = F.when(F.col("part").isNull(), F.col("id")).otherwise(F.col("least"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.col("id").eqNullSafe(component).alias("kept"), F.col("th").alias("text_hash"), F.col("part").alias("group"))
