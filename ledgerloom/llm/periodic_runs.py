"""Runs of repeated word sequences, found by dyadic square catching.

A run is a stretch of consecutive words with the smallest period q, at least ``max(shortest, exponent x q)`` words
long, that no neighbouring word extends.

* Every completed block of 2^k words is a catcher. While further words are appended, it compares the latest 2^k words
  with itself at each distance q from 2^k to 2^(k+1) - 1 (the smallest catchers also at the shorter distances); equal
  words mean that a square of period q may be growing around the two.
* A catch advances word by word to both sides while words q apart agree. The squares that a stretch holds are one
  run; what other catchers and multiples of the period report of the same stretch merges into it.

The words of many documents are appended at one time: a catcher's comparisons with all its distances are one row of a
matrix, so n words cost n comparisons a level and there are log n levels. Equality is that of hashes first and of the words
themselves in every catch, so results are exact. A run of three periods or more holds 2 q equal pairs of words, and at
least ``shortest`` - q of them, so a catcher of each level lies in any run.

Each row is by itself: repeated rows and ties give a result each. Null, empty and blank texts have no words and no runs. Columns
other than the id and the text are not read. A very long text costs n log n and is held by one task.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, columns_of
from .rolling import mix

#: Words of the smallest catchers.
SMALLEST = 8
#: Words that are appended at one time, and bytes that are given back at one time.
TOGETHER, GIVEN = 1 << 19, 1 << 23


def _grown(ids: np.ndarray, at: int, other: int, step: int, least: int, most: int) -> int:
    """How far the words from ``at`` and from ``other`` on agree, going up (step 1) or down (-1)."""
    n, width = 0, 64
    room = (most - max(at, other)) if step > 0 else min(at, other) - least + 1
    while n < room:
        w = min(width, room - n)
        if step > 0:
            differ = np.flatnonzero(ids[at + n:at + n + w] != ids[other + n:other + n + w])
            if len(differ):
                return n + int(differ[0])
        else:
            differ = np.flatnonzero(ids[at - n - w + 1:at - n + 1] != ids[other - n - w + 1:other - n + 1])
            if len(differ):
                return n + w - 1 - int(differ[-1])
        n, width = n + w, min(2 * width, 1 << 16)
    return n


def runs_of(texts: list[list[int]], shortest: int = 24, exponent: int = 3) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each list of word numbers, by start and period."""
    if shortest < 2 * SMALLEST + 7 or exponent < 3:
        raise ValueError(f"shortest must be {2 * SMALLEST + 7} or more and exponent 3 or more")
    order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
    lengths = np.array([len(texts[k]) for k in order], dtype=np.int64)
    begins = np.zeros(len(order), dtype=np.int64)  # longest first: the documents of a level come first
    np.cumsum(lengths[:-1] + 1, out=begins[1:])
    size = int(lengths.sum()) + len(order)
    ids = np.empty(size, dtype=np.int64)
    for k, (b, n) in enumerate(zip(begins.tolist(), lengths.tolist(), strict=True)):
        ids[b:b + n] = texts[order[k]]
        ids[b + n] = -1 - k  # between documents: equal to nothing
    runs: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    hashes, width, b = mix(ids.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)), 1, SMALLEST
    with np.errstate(over="ignore"):
        while True:
            docs = int(np.count_nonzero((lengths >= exponent * b) | ((b == SMALLEST) & (lengths >= shortest))))
            if not docs:
                break
            stop = int(begins[docs - 1] + lengths[docs - 1])
            while width < b:  # hashes of all windows of b words
                upper = hashes[width:]
                hashes = mix(hashes[: len(upper)] * np.uint64(0xD6E8FEB86659FD93) + upper)
                width *= 2
            _level(ids, hashes, b, stop, begins, lengths, runs, shortest, exponent)
            b *= 2
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, found in runs.items():
        first = int(begins[d])
        out[order[d]] = sorted((s - first, e - s, q) for (s, e), q in found.items())
    return out


def _level(ids, hashes, b, stop, begins, lengths, runs, shortest, exponent) -> None:
    """The catchers of ``b`` words: adds to ``runs`` {document: {(start, end): smallest period}}."""
    last = min(len(hashes), stop)
    rows = -(-last // b)
    square = np.zeros((rows + 1) * b, dtype=np.uint64)
    square[:last] = hashes[:last]
    square = square.reshape(-1, b)
    square[rows:] = 0
    near = square[1:] == square[:-1, :1]  # distances b to 2 b - 1
    if b == SMALLEST:
        near = np.hstack([square[:-1] == square[:-1, :1], near])
        near[:, 0] = False
    at, dist = np.nonzero(near)
    first = at.astype(np.int64) * b
    dist = dist.astype(np.int64) + (0 if b == SMALLEST else b)
    inside = first + dist + b <= stop
    first, dist = first[inside], dist[inside]
    if not len(first):
        return
    alive = np.ones(len(first), dtype=bool)
    if b > SMALLEST:  # multiples of periods known from smaller catchers
        for d in np.unique(np.searchsorted(begins, first, side="right") - 1).tolist():
            for (s, e), q in runs.get(d, {}).items():
                _silence(first, dist, alive, b, s, e, q, exponent)
    for k in range(len(first)):
        if not alive[k]:
            continue
        i, q = int(first[k]), int(dist[k])
        if not np.array_equal(ids[i:i + b], ids[i + q:i + q + b]):
            continue
        d = int(np.searchsorted(begins, i, side="right")) - 1
        least, most = int(begins[d]), int(begins[d] + lengths[d])
        s = i - _grown(ids, i - 1, i + q - 1, -1, least, most)
        e = i + q + b + _grown(ids, i + b, i + q + b, 1, least, most)
        if e - s >= max(shortest, exponent * q):
            found = runs[d]
            found[s, e] = min(found.get((s, e), q), q)
            _silence(first, dist, alive, b, s, e, q, 1)
        else:
            lo, hi = np.searchsorted(first, (s, e))  # other catches of the same stretch say the same
            alive[lo:hi] &= (dist[lo:hi] != q) | (first[lo:hi] + q + b > e)


def _silence(first, dist, alive, b, s, e, q, exponent) -> None:
    """Catches inside the run [s, e) at its period or multiples of it report that run again."""
    if e - s >= exponent * b:
        lo, hi = np.searchsorted(first, (s, e))
        alive[lo:hi] &= (dist[lo:hi] % q != 0) | (first[lo:hi] + dist[lo:hi] + b > e)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    gone = bytearray(len(words))
    for s, n, q in runs:
        gone[s + q:s + n] = b"\1" * (n - q)
    return b" ".join([w for w, g in zip(words, gone, strict=True) if not g])


def find_runs(docs: DataFrame, shortest: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, runs (start, length, period in words; by start, then period) and collapsed (the words that no run holds after
    its first period, joined by a blank) of each document."""
    d = columns_of(docs, id_col, text_col)
    kind = d.schema[id_col].dataType

    def search(batches):
        import pyarrow as pa

        entry = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

        def done(ids, split, numbers):
            found = runs_of(numbers, shortest, exponent)
            flat = [x for r in found for x in r]
            columns = [pa.array([x[k] for x in flat], pa.int64()) for k in range(3)]
            ends = np.concatenate([[0], np.cumsum([len(r) for r in found])]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, fields=list(entry)))
            text = [(_collapsed(w, r) if r else b" ".join(w)).decode() for w, r in zip(split, found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), runs, pa.array(text, pa.string())], names=["id", "runs", "collapsed"])

        ids, split, numbers, held, given = [], [], [], 0, 0
        known = defaultdict(int)
        known.default_factory = known.__len__
        for batch in batches:
            for k, text in enumerate(batch.column(1).to_pylist()):
                words = (text or "").encode().split()  # by blanks and \x09 to \x0D
                ids.append(batch.column(0).slice(k, 1))
                split.append(words)
                numbers.append(list(map(known.__getitem__, words)))
                held, given = held + len(words), given + len(text or "")
                if held >= TOGETHER or given >= GIVEN:
                    yield done(ids, split, numbers)
                    ids, split, numbers, held, given = [], [], [], 0, 0
                    known.clear()
        if ids:
            yield done(ids, split, numbers)

    schema = f"id {kind.simpleString()}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    out = d.mapInArrow(search, schema)
    return out.select(F.col("id").alias(id_col), "runs", "collapsed")


def greatest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as fractions; the first of equal ones, null without runs."""
    return F.reduce(runs, F.get(runs, F.lit(0)), lambda a, r: F.when(r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))


def with_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with made repetitions: where 10 divides h, the crc32 of the decimal id, and g = floor(h / 10), each word
    i >= a = g mod n becomes word a + (i - a) mod (1 + floor((n - a) / (3 + g mod 8))). Rows without an id stay."""
    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    t = F.col(f"`{text_col}`")

    def tail(words: Column) -> Column:
        n, g = F.size(words).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(places, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    repeated = F.transform(F.array(F.regexp_extract_all(t, F.lit(WORD), F.lit(0))), lambda w: F.when(F.size(w) > 0, tail(w)).otherwise(""))[0]
    return docs.withColumn(text_col, F.when((h % 10 == 0) & t.isNotNull(), repeated).otherwise(t))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a document: the number of runs, the greatest one and digests of the runs and of the collapsed text."""
    lines = F.concat(F.lit(""), F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), ""))
    top = greatest(F.col("runs"))
    return (found.withColumn("top", F.when(F.size("runs") > 0, top))
            .select(id_col, F.size("runs").cast("long").alias("n_runs"), F.col("top.start").alias("start"), F.col("top.length").alias("length"),
                    F.col("top.period").alias("period"), F.floor(F.lit(1000) * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
                    F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")))
