"""Token counts of documents in flat token files without an index.

A file is a run of little-endian token ids, the end id behind each document, nothing else. Files are read in
blocks; each block is searched for end ids at once. What a document has in earlier blocks is stitched on with a
prefix scan over the blocks of a file (the last end before the block), and documents are numbered with one over
the counts of ends. Tokens behind a file's last end are a document without an end and are counted, too.

The writer encodes texts in the order of the input's partitions, one file a task; it returns a receipt of what it
wrote, and only files with a receipt of a finished task count. A null or empty text is the end id alone; an end id that a
text itself encodes to would end the document, and added tokens are found inside ordinary text, so the end id is one
behind the vocabulary, which no text yields. Repeated rows are counted each. An empty table gives no files and no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import state_dir
from .common import columns_of, stored
from .tokens import WordEncoder, as_uri, chunks, encoder, read_range, write_file


def flat_type(encode: WordEncoder, end: int) -> np.dtype:
    """The integers of the files: those of the ids, or wider ones where the end id needs them."""
    return encode.dtype if end < 1 << 8 * encode.dtype.itemsize else np.dtype("<u4")


def write_flat(docs: DataFrame, folder: str, vocabulary: str, end: int, id_col: str = "doc_id", text_col: str = "text",
               file_bytes: int = 64 << 20) -> DataFrame:
    """Receipts (file, number in the file, id), stored."""
    d = columns_of(docs, id_col, text_col).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")

    def run(batches):
        encode = encoder(vocabulary)
        if end < len(encode.opens):
            raise ValueError(f"{end} is an id of the vocabulary, which a text can give")
        kind = flat_type(encode, end)
        tail = np.array([end], dtype=kind).tobytes()
        parts: list[bytes] = []
        ids: list = []
        held = 0

        def flush():
            name = f"tokens-{uuid.uuid4().hex}.bin"
            write_file(folder, name, b"".join(parts))
            return pa.RecordBatch.from_pydict({"file": pa.array([name] * len(ids), pa.string()), "number": pa.array(np.arange(len(ids))),
                                               "id": pa.array(ids, pa.int64())})

        for batch in batches:
            keys, at = batch.column("id").to_pylist(), 0
            for some in chunks(x.as_py() for x in batch.column("text")):
                for t in encode.encode(some):
                    if kind != encode.dtype:
                        t = np.frombuffer(t, dtype=encode.dtype).astype(kind).tobytes()
                    parts += (t, tail)
                    held += len(t) + len(tail)
                    ids.append(keys[at])
                    at += 1
                if held >= file_bytes:
                    yield flush()
                    parts, ids, held = [], [], 0
        if ids:
            yield flush()

    return stored(d.mapInArrow(run, "file string, number long, id long"), "op3-receipts")


def count_tokens(spark: SparkSession, folder: str, end: int, width: int = 2, block_tokens: int = 1 << 20) -> DataFrame:
    """file, number, start (in tokens of the file), n_tokens (with the end id) of each document in the files of ``folder``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.bin").load(folder).select("path", "length")
    step, kind = block_tokens * width, f"<u{width}"
    blocks = (files.where("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("file"), F.expr(f"length div {width}").alias("all"),
                                               F.explode(F.sequence(F.lit(0), F.expr(f"cast((length - 1) div {step} as int)"))).alias("block"))
              .repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file", "block"))

    def run(batches):
        for batch in batches:
            for file, everything, block in zip(*(batch.column(c).to_pylist() for c in ("file", "all", "block")), strict=True):
                x = np.frombuffer(read_range(folder, file, block * step, step), dtype=kind)
                at = np.flatnonzero(x == end).astype(np.int64) + block * block_tokens
                last = block * block_tokens + len(x) == everything
                if last and (not len(at) or at[-1] != everything - 1):
                    at = np.append(at, everything - 1)  # no end id behind the last document
                yield pa.RecordBatch.from_pydict({"file": [file], "block": pa.array([block], pa.int32()), "n": pa.array([len(at)], pa.int64()),
                                                  "last": pa.array([int(at[-1]) if len(at) else None], pa.int64()), "ends": pa.array([at], pa.list_(pa.int64()))})

    found = blocks.mapInArrow(run, "file string, block int, n long, last long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumns({"begin": F.coalesce(F.max("last").over(before) + 1, F.lit(0)), "first": F.coalesce(F.sum("n").over(before), F.lit(0))})
    rows = found.select("file", "begin", "first", "ends", F.posexplode("ends").alias("k", "at"))
    start = F.when(F.col("k") == 0, F.col("begin")).otherwise(F.get("ends", F.col("k") - 1) + 1)
    return rows.select("file", (F.col("first") + F.col("k")).alias("number"), start.alias("start"), (F.col("at") - start + 1).alias("n_tokens"))


def counts_by_document(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end: int | None = None, id_col: str = "doc_id",
                       text_col: str = "text") -> DataFrame:
    """``id_col``, n_tokens, file, number and start of each document, as counted in the files written of ``docs``.
    ``end``: the first id behind the vocabulary by default."""
    spark, encode = docs.sparkSession, encoder(vocabulary)
    end = len(encode.opens) if end is None else end
    folder = as_uri(state_dir(spark, "llm-op3-tokens"))
    receipts = write_flat(docs, folder, vocabulary, end, id_col, text_col)
    if receipts.isEmpty():
        return spark.createDataFrame([], f"`{id_col}` long, n_tokens long, start long, file string, number long")
    found = count_tokens(spark, folder, end, flat_type(encode, end).itemsize)
    receipts = receipts.hint("merge")  # a row a document: too many to broadcast, however small their files
    return found.join(receipts, ["file", "number"]).select(F.col("id").alias(id_col), "n_tokens", "start", "file", "number")
