"""Token ids in grammar-compressed shard files (Re-Pair), and reading them back.

A shard holds whole documents in ascending order of their ids. In rounds, the most frequent pairs of neighbouring
symbols are each replaced by a new symbol; pairs never span the end of a document. The file stores the rules, the
expanded length of each rule, where each document starts among the symbols, and the symbols, so any document, or
any run of tokens in it, is decoded without the rest.

Layout, little-endian: magic "LLRP0001"; int64 counts: first symbol of a rule, rules, documents, symbols, bytes of a
symbol (2 or 4); rules (pairs of symbols); int64 expanded lengths of the rules; int64 first symbol of each document and the
end; int64 token counts of the documents; int64 ids of the documents; a byte each, whether the id is null; symbols.

Each task writes its shards under names of their own and returns a receipt row for each; only shards with a receipt
of a finished task count, so lost and repeated attempts do no harm. A null or empty text is the end id alone. Null
ids come first. Repeated rows are encoded each. An empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import state_dir
from .common import columns_of, offsets, stored
from .tokens import as_uri, chunks, encoder, write_file

MAGIC = b"LLRP0001"
#: Rounds of replacement, and least occurrences of a pair that is worth a rule.
ROUNDS, LEAST = 8, 6
#: Places of the hashed table of a round's pairs, as a power of two.
_TABLE_BITS = 18


def _places(key: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``key`` holds one of the ascending ``chosen``, and which one. A hashed table answers for nearly all; what shares a place
    in it with another of the chosen is searched for."""
    wide = chosen.dtype.type
    odd, shift = wide(0x9E3779B1), wide(8 * chosen.dtype.itemsize - _TABLE_BITS)
    table = np.full(1 << _TABLE_BITS, -1, dtype=np.int32)
    table[(chosen * odd) >> shift] = np.arange(len(chosen), dtype=np.int32)
    place = table[(key * odd) >> shift]
    near = np.flatnonzero(place >= 0)
    place, some = place[near], key[near]
    hit = chosen[place] == some
    other = np.flatnonzero(~hit)
    place[other] = np.minimum(np.searchsorted(chosen, some[other]), len(chosen) - 1)
    hit[other] = chosen[place[other]] == some[other]
    return near[hit], place[hit]


def repair(ids: np.ndarray, end: int, base: int, rounds: int = ROUNDS, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules). Rules are numbered from ``base``; pairs with ``end`` are left alone."""
    s, rules, room = ids.astype(np.uint32), [], (1 << 16) - base if base < 1 << 16 else 1 << 20
    wide, shift = (np.uint64, np.uint64(32)) if base + room > 1 << 16 else (np.uint32, np.uint32(16))
    for k in range(rounds):
        share = room // 2 if k + 1 < rounds else room
        if len(s) < 2 or not share:
            break
        key = (s[:-1].astype(wide) << shift) | s[1:].astype(wide)
        free = (s[:-1] != end) & (s[1:] != end)
        order = np.sort(key[free])
        at = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.empty(0, dtype=np.int64)
        n = np.diff(np.append(at, len(order)))
        often = np.flatnonzero(n >= least)
        if len(often) > share:
            often = often[np.argsort(-n[often], kind="stable")[:share]]
        if not len(often) or n[often].sum() * 50 < len(s):  # less than a fiftieth to gain
            break
        chosen = np.sort(order[at[often]])
        low = wide((1 << int(shift)) - 1)
        near, place = _places(key, chosen)
        # of overlapping pairs every other one, from the left
        run = np.concatenate([[0], np.flatnonzero(np.diff(near) != 1) + 1])
        first = np.zeros(len(near), dtype=np.int64)
        first[run] = run
        keep = ((np.arange(len(near)) - np.maximum.accumulate(first)) & 1) == 0
        near, place = near[keep], place[keep]
        made = base + sum(map(len, rules))
        s[near] = (made + place).astype(np.uint32)
        stay = np.ones(len(s), dtype=bool)
        stay[near + 1] = False
        s = s[stay]
        rules.append(np.stack([(chosen >> shift), (chosen & low)], axis=1).astype(np.uint32))
        room -= len(chosen)
    return s, np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32)


def expanded_lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """Tokens of every symbol below ``base`` + rules; a rule's symbols come before its own."""
    length = [1] * base
    for a, b in rules.tolist():
        length.append(length[a] + length[b])
    return np.array(length, dtype=np.int64)


def expansions(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, start, length) of every symbol below ``base`` + rules."""
    length = expanded_lengths(rules, base)
    start = np.concatenate([[0], np.cumsum(length)])
    flat = np.empty(start[-1], dtype=np.uint32)
    flat[:base] = np.arange(base)
    for k, (a, b) in enumerate(rules.tolist()):
        at, mid = start[base + k], start[base + k] + length[a]
        flat[at:mid] = flat[start[a]:start[a] + length[a]]
        flat[mid:mid + length[b]] = flat[start[b]:start[b] + length[b]]
    return flat, start[:-1], length


def pack(ids: list[int | None], texts: list[bytes], dtype: np.dtype, end: int, base: int) -> bytes:
    """A shard file of documents whose ids are in ``texts``, the end id not yet appended."""
    tail = np.array([end], dtype=dtype).tobytes()
    flat = np.frombuffer(tail.join(texts) + tail, dtype=dtype)
    tokens = np.array([len(t) // dtype.itemsize + 1 for t in texts], dtype=np.int64)
    # an end id inside a text doesn't end it, so ends are found by place
    ends = np.cumsum(tokens) - 1
    symbols, rules = repair(flat, end, base)
    at_end = np.flatnonzero(symbols == end)  # never part of a pair: as many as before
    nth = np.cumsum(flat == end)[ends] - 1
    firsts = np.concatenate([[0], at_end[nth] + 1]).astype(np.int64)
    length = expanded_lengths(rules, base)
    width = 2 if base + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    null = np.array([i is None for i in ids], dtype=np.uint8)
    return b"".join([MAGIC, np.array([base, len(rules), len(ids), len(symbols), width], dtype="<i8").tobytes(),
                     rules.astype(kind).tobytes(), length[base:].astype("<i8").tobytes(), firsts.astype("<i8").tobytes(),
                     tokens.astype("<i8").tobytes(), np.array([i or 0 for i in ids], dtype="<i8").tobytes(), null.tobytes(),
                     symbols.astype(kind).tobytes()])


class Shard:
    """A shard file's parts, and its documents."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a shard file")
        self.base, n_rules, n_docs, n_symbols, width = np.frombuffer(data, "<i8", 5, 8).tolist()
        kind, at = f"<u{width}", 48

        def take(dtype, n):
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        self.rules = take(kind, 2 * n_rules).reshape(-1, 2)
        self.lengths, self.firsts, self.tokens = take("<i8", n_rules), take("<i8", n_docs + 1), take("<i8", n_docs)
        ids, null = take("<i8", n_docs), take(np.uint8, n_docs)
        self.ids = [None if x else i for i, x in zip(ids.tolist(), null.tolist(), strict=True)]
        self.symbols = take(kind, n_symbols)
        self._flat, self._start, self._length = expansions(self.rules, self.base)

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self._length[symbols]
        shift = self._start[symbols] - np.concatenate([[0], np.cumsum(n)[:-1]])
        return self._flat[np.repeat(shift, n) + np.arange(n.sum())]

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Tokens start..stop of document i; only the symbols that hold them are expanded."""
        s = self.symbols[self.firsts[i]:self.firsts[i + 1]]
        ends = np.cumsum(self._length[s])
        stop = int(ends[-1]) if stop is None else min(stop, int(ends[-1]))
        a, b = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop, side="left")) + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(s[a:b])[start - before:stop - before]


def write_shards(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.json", end: int = 2, shard_tokens: int = 1 << 21,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` in ascending id order, rows of one id by their text (its hash first); the receipts (part, shard, file, n_docs, n_tokens), stored."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = columns_of(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    d = d.withColumn("hash", F.xxhash64("text")).repartitionByRange(n, "id", "hash").sortWithinPartitions("id", "hash", "text").drop("hash").withColumn("part", F.spark_partition_id())

    def run(batches):
        encode = encoder(vocabulary)
        base = max(encode.tokenizer.get_vocab_size(), end + 1)
        ids: list = []
        texts: list[bytes] = []
        held, shard, part = 0, 0, 0

        def flush():
            name = f"part-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.llrp"
            write_file(folder, name, pack(ids, texts, encode.dtype, end, base))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "file": [name],
                                               "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([held], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            keys, at = batch.column("id").to_pylist(), 0
            for some in chunks(x.as_py() for x in batch.column("text")):
                for t in encode.encode(some):
                    ids.append(keys[at])
                    texts.append(t)
                    at += 1
                    held += len(t) // encode.dtype.itemsize + 1
                    if held >= shard_tokens:
                        yield flush()
                        ids, texts, held, shard = [], [], 0, shard + 1
        if ids:
            yield flush()

    receipts = d.mapInArrow(run, "part int, shard int, file string, n_docs long, n_tokens long")
    return stored(receipts, "op5-receipts")


def read_shards(spark: SparkSession, folder: str, receipts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, start, n_tokens, ids_crc32, file and number (in its file) of each document in the files."""
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                shard = Shard(content.as_buffer().to_pybytes())
                n = len(shard.ids)
                crc = np.empty(n, dtype=np.int64)
                for lo in range(0, n, 4096):  # some documents at a time
                    hi = min(lo + 4096, n)
                    ids = shard.expand(shard.symbols[shard.firsts[lo]:shard.firsts[hi]]).astype("<u4")
                    at = np.concatenate([[0], np.cumsum(shard.tokens[lo:hi])]).tolist()
                    for k in range(hi - lo):
                        crc[lo + k] = zlib.crc32(ids[at[k]:at[k + 1]])
                before = np.concatenate([[0], np.cumsum(shard.tokens)[:-1]])
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array(shard.ids, pa.int64()), "before": pa.array(before), "n_tokens": pa.array(shard.tokens), "ids_crc32": pa.array(crc),
                    "file": pa.array([path.rsplit("/", 1)[1]] * n, pa.string()), "number": pa.array(np.arange(n))})

    parts = offsets(receipts.groupBy("part").agg(F.sum("n_tokens").alias("n")), "part", "n", "part_start")
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = receipts.withColumn("inside", inside).join(parts, "part").select("file", (F.col("inside") + F.col("part_start")).alias("shard_start"))
    if receipts.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` long, start long, n_tokens long, ids_crc32 long, file string, number long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.llrp").load(folder).select("path", "content")
    rows = files.mapInArrow(run, "id long, before long, n_tokens long, ids_crc32 long, file string, number long")
    return rows.join(starts, "file").select(F.col("id").alias(id_col), (F.col("shard_start") + F.col("before")).alias("start"),
                                            "n_tokens", "ids_crc32", "file", "number")


def encode_to_files(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Write ``docs`` and read the files back. The folder is a new one of the session's shared folder by default."""
    spark = docs.sparkSession
    folder = as_uri(folder or state_dir(spark, "llm-op5-shards"))
    receipts = write_shards(docs, folder, id_col=id_col, text_col=text_col, **how)
    return read_shards(spark, folder, receipts, id_col)
