"""Repeated-string removal by prefix-free parsing.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is removed.

* Parse. A rolling hash runs over ``trigger`` bytes; a position is a trigger where its hash is the smallest
  of ``length - trigger + 1`` consecutive positions. Triggers depend on nothing but the bytes around them, and
  every string of ``length`` bytes belongs to one trigger in it, that of its smallest hash (the first of equals).
* Dictionary. The phrase of a trigger reaches from the first to the last byte of the strings that can
  belong to it. Phrases are grouped by trigger string and whole phrase; the occurrences of one phrase in a
  batch go as a single row, so a hot phrase costs a row a batch. A phrase found twice settles all suffixes
  in it at once, and if it is its trigger's only phrase, nothing more is asked of it.
* Corpus order. Where a trigger has several phrases, the suffixes that belong to it are put in order: by
  the fingerprint (128 bits) of their first ``length`` bytes. A run of equal fingerprints is a run of the corpus' suffix
  array whose common prefixes have ``length`` bytes or more. The order between runs plays no part in the
  result and isn't made. A phrase found twice is spoken for by its first occurrence (least id, then place): a suffix
  in any other occurrence is left out, a suffix in a first one counts twice. What is left out has an equal in an
  earlier place, so it's never lost.

Null and empty texts, and texts shorter than ``length``, keep all bytes. Repeated rows are separate
documents, so each of them is a repeat of the other. A null id is an id like others.

Keys are hashes that nothing compares with the bytes again: a phrase has 64 bits besides the 64 of its trigger, and a
document is named by its id and 64 bits of a hash of id and text (without an id, by 128 bits of hashes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of
from .rolling import SEGMENT, Prefix, slide

_OCC = np.dtype([("doc", "<i8"), ("kh", "<i8"), ("p", "<i8")])
#: Keys go to the tasks that compare them in blocks: those of one bucket in a batch.
_BLOCKS = "bucket int, block binary"


def segments(n: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first own position, behind the last, first byte, behind the last) of each segment."""
    for at in range(0, max(n - length + 1, 0), SEGMENT):
        end = min(at + SEGMENT, n - length + 1)
        yield at, end, max(0, at - 2 * length), min(n, end + 3 * length)


def triggers(data: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """Rolling hashes, the smallest in each window of ``length`` bytes, trigger positions, prefix hashes."""
    width, prefix = length - trigger + 1, Prefix(data)
    h = prefix.windows(trigger)
    least = slide(h, width, np.minimum)
    pad = np.zeros(width - 1, dtype=np.uint64)
    return h, least, np.nonzero(slide(np.concatenate([pad, least, pad]), width, np.maximum) == h)[0], prefix


def first_least(h: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest (the first of equals) of every ``width`` consecutive values, by doubling."""
    span, at = 1, np.arange(len(h))
    while span < width:
        step = min(span, width - span)
        a, b = at[:-step], at[step:]
        at = np.where(h[b] < h[a], b, a)
        span += step
    return at


def phrases(data: np.ndarray, length: int, trigger: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(trigger hash, phrase hash, trigger position) of each phrase."""
    n = len(data)
    for at, end, lo, hi in segments(n, length):
        _, _, s, prefix = triggers(data[lo:hi], length, trigger)
        whole = Prefix(data[lo:hi], 1)
        behind = n if end == n - length + 1 else end
        s = s[(s + lo >= at) & (s + lo < behind)]
        first, last = reach(s, hi - lo, length, trigger)
        t = prefix.of(s, s + trigger)
        if n < 2 * length and len(s):  # phrases that both ends of a short text cut to one are one
            one = np.sort(np.unique(np.stack([t, first.astype(np.uint64), last.astype(np.uint64)]), axis=1, return_index=True)[1])
            s, t, first, last = s[one], t[one], first[one], last[one]
        yield t, whole.of(first, last + length), s + lo


def reach(s: np.ndarray, n: int, length: int, trigger: int) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last start of strings that can belong to the triggers at ``s`` in ``n`` bytes."""
    return np.maximum(s - (length - trigger), 0), np.minimum(s, n - length)


def _planes(x: np.ndarray) -> bytes:
    """First bytes, then second bytes, ...: what they have in common compresses well in the shuffle."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(data: memoryview, dtype: str, n: int) -> np.ndarray:
    wide = np.dtype(dtype)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * wide.itemsize).reshape(wide.itemsize, n).T).view(wide).ravel()


#: Of each key: hash of the trigger (or the suffix), hash of the phrase (or a second one of the suffix), the first
#: occurrence, the sum of weights, how many occurrences more there are.
_PARTS = (("k1", "<u8"), ("k2", "<u8"), ("kh", "<i8"), ("doc", "<i8"), ("p", "<i8"), ("n", "<i4"), ("more", "<i4"))


def _blocks(got: list[list], buckets: int) -> pa.RecordBatch | None:
    """One key for each different one, with its occurrences; a block for each bucket."""
    if not got[0]:
        return None
    k1, k2, weight, doc, kh, p = map(np.concatenate, got)
    occ = np.empty(len(k1), dtype=_OCC)
    occ["doc"], occ["kh"], occ["p"] = doc, kh, p
    order = np.lexsort((k2, k1))
    k1, k2, occ, weight = k1[order], k2[order], occ[order], weight[order]
    new = np.ones(len(k1), dtype=bool)
    new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(k1)))
    one = occ[first]
    parts = {"k1": k1[first], "k2": k2[first], "kh": one["kh"], "doc": one["doc"], "p": one["p"],
             "n": np.minimum(np.add.reduceat(weight, first), 2), "more": size - 1}
    bucket = ((k1[first] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    others = occ[~new]
    rest = np.concatenate([[0], np.cumsum(size - 1)])
    blocks = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        blocks.append(np.int64(b - a).tobytes() + b"".join(_planes(parts[c][a:b].astype(t)) for c, t in _PARTS) + others[rest[a]:rest[b]].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(bucket[edge[:-1]].astype(np.int32)), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _read_blocks(batches) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The keys of a partition, and their further occurrences in the keys' order."""
    got: dict[str, list] = {c: [] for c, _ in _PARTS}
    others = []
    for batch in batches:
        for block in batch.column("block"):
            data = memoryview(block.as_buffer())
            n, at = int(np.frombuffer(data, "<i8", 1)[0]), 8
            for c, t in _PARTS:
                got[c].append(_from_planes(data[at:], t, n))
                at += n * np.dtype(t).itemsize
            others.append(np.frombuffer(data[at:], dtype=_OCC))
    if not others:
        return {c: np.empty(0, dtype=t) for c, t in _PARTS}, np.empty(0, dtype=_OCC)
    return {c: np.concatenate(x) for c, x in got.items()}, np.concatenate(others)


def _compare(phrases_too: bool):
    """Occurrences whose key is found again, with flags; for phrases, also those whose trigger has several."""
    def run(batches):
        key, others = _read_blocks(batches)
        k1 = np.sort(key["k1"])
        again = np.unique(k1[1:][k1[1:] == k1[:-1]])
        keep = key["n"] > 1
        if len(again):
            keep |= again[np.minimum(np.searchsorted(again, key["k1"]), len(again) - 1)] == key["k1"]
        behind = np.cumsum(key["more"])
        x = np.flatnonzero(keep)
        if not len(x):
            return
        x = x[np.lexsort((key["p"][x], key["kh"][x], key["doc"][x], key["k2"][x], key["k1"][x]))]
        k1, k2 = key["k1"][x], key["k2"][x]
        new1 = np.concatenate([[True], k1[1:] != k1[:-1]])
        new2 = new1 | np.concatenate([[True], k2[1:] != k2[:-1]])
        of1, of2 = np.cumsum(new1) - 1, np.cumsum(new2) - 1
        settled = np.add.reduceat(key["n"][x], np.flatnonzero(new2))[of2] > 1
        several = np.bincount(of1[new2])[of1] > 1
        wanted = settled | several if phrases_too else settled
        flag = settled * _SETTLED + several * _SEVERAL + new2 * _FIRST
        x, flag = x[wanted], flag[wanted].astype(np.int64)
        more = key["more"][x]
        at = np.repeat(behind[x] - np.cumsum(more), more) + np.arange(more.sum())
        rest = others[at]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([key["doc"][x], rest["doc"]])),
            pa.array(np.concatenate([key["kh"][x], rest["kh"]])),
            pa.array(np.concatenate([(key["p"][x] << _FLAGS) | flag, (rest["p"] << _FLAGS) | np.repeat(flag & ~_FIRST, more)]))],
            names=["doc", "kh", "p"])
    return run


def _collect(batch: pa.RecordBatch, rows, buckets: int) -> Iterator[pa.RecordBatch]:
    """Blocks of keys of a batch of documents, a flush at about a million occurrences. rows: k1, k2, weight, p of a document."""
    got: list[list] = [[], [], [], [], [], []]
    held = 0
    doc, kh = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("kh").to_numpy(zero_copy_only=False)
    order = np.lexsort((kh, doc))  # so that the first occurrence of a key is the least
    for turn, i in enumerate(order.tolist()):
        for k1, k2, weight, p in rows(i):
            if len(k1):
                for to, x in zip(got, (k1, k2, weight, np.full(len(k1), doc[i]), np.full(len(k1), kh[i]), p), strict=True):
                    to.append(x)
                held += len(k1)
        if held > 1_000_000 or turn + 1 == batch.num_rows:
            if (out := _blocks(got, buckets)) is not None:
                yield out
            got, held = [[], [], [], [], [], []], 0


def _bytes(batch: pa.RecordBatch, i: int) -> np.ndarray:
    buf = batch.column("text")[i].as_buffer()
    return np.frombuffer(buf, dtype=np.uint8) if buf is not None else np.empty(0, dtype=np.uint8)


def _parse(length: int, trigger: int, buckets: int):
    def run(batches):
        for batch in batches:
            def rows(i, batch=batch):
                for t, e, s in phrases(_bytes(batch, i), length, trigger):
                    yield t, e, np.ones(len(s), dtype=np.int64), s
            yield from _collect(batch, rows, buckets)
    return run


#: Bits below a position: the phrase is found twice; its trigger has several phrases; this is its first occurrence.
_SETTLED, _SEVERAL, _FIRST, _FLAGS = 1, 2, 4, 3


def _order(length: int, trigger: int, buckets: int):
    """Fingerprints of the suffixes whose triggers have several phrases."""
    def run(batches):
        for batch in batches:
            found = batch.column("found")

            def rows(i, batch=batch, found=found):
                data, p = _bytes(batch, i), found[i].values.to_numpy(zero_copy_only=False)
                s = p >> _FLAGS
                first, last = reach(s, len(data), length, trigger)
                settled, foremost, several = ((p & flag) > 0 for flag in (_SETTLED, _FIRST, _SEVERAL))
                for at, end, lo, hi in segments(len(data), length):
                    own = data[lo:hi]
                    prefix, n = Prefix(own), hi - lo - length + 1
                    asked = np.zeros(len(own), dtype=bool)
                    near = several & (s >= lo) & (s < hi)
                    asked[s[near] - lo] = True
                    x = asked[first_least(prefix.windows(trigger), length - trigger + 1)]
                    later = settled & ~foremost & ~np.isin(s, s[foremost])  # rows that are alike share a list
                    x &= ~covered(first[later] - lo, last[later] - lo, n)
                    x = np.flatnonzero(x)
                    x = x[(x + lo >= at) & (x + lo < end)]
                    weight = 1 + covered(first[settled] - lo, last[settled] - lo, n)[x].astype(np.int64)
                    yield prefix.of(x, x + length), Prefix(own, 1).of(x, x + length), weight, x + lo
            yield from _collect(batch, rows, buckets)
    return run


def covered(lo: np.ndarray, hi: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in one of the ranges lo..hi (both included)."""
    diff = np.zeros(n + 1, dtype=np.int32)
    keep = (hi >= 0) & (lo < n)
    np.add.at(diff, np.clip(lo[keep], 0, n), 1)
    np.add.at(diff, np.clip(hi[keep] + 1, 0, n), -1)
    return np.cumsum(diff[:-1]) > 0


def _finish(length: int, trigger: int):
    def run(batches):
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans")}
            for i in range(batch.num_rows):
                data = _bytes(batch, i)
                n, lo, hi = len(data), [], []
                if (found := batch.column("found")[i].values) is not None:
                    p = found.to_numpy(zero_copy_only=False)
                    a, b = reach(p[(p & _SETTLED) > 0] >> _FLAGS, n, length, trigger)
                    lo, hi = [a[a <= b]], [b[a <= b]]
                if (starts := batch.column("starts")[i].values) is not None:
                    x = starts.to_numpy(zero_copy_only=False)
                    lo, hi = [*lo, x], [*hi, x]
                if sum(map(len, lo)):
                    gone = covered(np.concatenate(lo), np.concatenate(hi) + length - 1, n)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    kept = data[~gone].tobytes()
                else:
                    edge, kept = np.empty(0, dtype=np.int64), data.tobytes()
                out["n_bytes"].append(n)
                out["n_removed"].append(n - len(kept))
                out["n_spans"].append(len(edge) // 2)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                out["kept"].append(kept)
                out["spans"].append(edge.tolist())
            types = {"kept_sha256": pa.string(), "kept": pa.binary(), "spans": pa.list_(pa.int64())}
            got = {k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}
            yield pa.RecordBatch.from_pydict({"doc": batch.column("doc"), "isnull": batch.column("isnull"), **got})
    return run


def remove_repeats(docs: DataFrame, length: int = 200, trigger: int | None = None, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """``id_col``, n_bytes, n_removed, n_spans, kept_sha256, kept (binary: the bytes left) and spans (start and end
    of each removed run, in turn) of each document. ``trigger``: bytes of a trigger string, 5/8 of
    ``length`` by default."""
    trigger = trigger or max(1, length * 5 // 8)
    if not 1 <= trigger <= length or length - trigger > 1500:
        raise ValueError("1 <= trigger <= length, and at most 1,500 bytes between them")
    d = columns_of(docs, id_col, text_col).toDF("id", "text")
    base = d.select(F.coalesce(F.col("id").cast("long"), F.xxhash64("text", F.lit(1))).alias("doc"), F.col("id").isNull().alias("isnull"),
                    F.xxhash64("id", "text").alias("kh"),
                    F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    long_enough = base.where(F.octet_length("text") >= length)
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = "doc long, kh long, p long"
    found = (long_enough.select("doc", "kh", "text").mapInArrow(_parse(length, trigger, buckets), _BLOCKS)
             .repartition("bucket").mapInArrow(_compare(True), places)
             .groupBy("doc", "kh").agg(F.collect_list("p").alias("found")))
    both = _SEVERAL | _FIRST
    found = found.withColumn("open", F.exists("found", lambda p: p.bitwiseAND(F.lit(both)) == both))
    starts = (base.join(found.where("open"), ["doc", "kh"]).select("doc", "kh", "isnull", "text", "found")
              .mapInArrow(_order(length, trigger, buckets), _BLOCKS)
              .repartition("bucket").mapInArrow(_compare(False), places)
              .groupBy("doc", "kh").agg(F.collect_list(F.shiftright("p", _FLAGS)).alias("starts")))
    whole = base.join(found, ["doc", "kh"], "left").join(starts, ["doc", "kh"], "left")
    done = whole.select("doc", "isnull", "text", "found", "starts").mapInArrow(
        _finish(length, trigger), "doc long, isnull boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string,"
                         " kept binary, spans array<long>")
    return done.select(F.when(~F.col("isnull"), F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans",
                       "kept_sha256", "kept", "spans")
