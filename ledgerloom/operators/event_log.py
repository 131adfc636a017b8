"""The raw backup as an append-only log: one folder a micro-batch, partitioned by a hash of the emitter.

A batch only adds files, and a retried one replaces its own folder, so nothing that is stored is rewritten. The rows
of some emitters are read from their hash partitions alone (partition pruning), with the emitter pushed to the
Parquet scan's join; how many other emitters the log holds doesn't matter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .latest import latest_per_key

_BUCKET = "emitter_bucket"
_PLACE = (T.StructField("run", T.StringType()), T.StructField("batch", T.LongType()), T.StructField(_BUCKET, T.IntegerType()))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files at or under ``path``; 0 when there is nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


def data_files(spark: SparkSession, path: str) -> int:
    """How many data files lie directly in the folder ``path``."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    return sum(s.isFile() and s.getPath().getName()[0] not in "_." for s in listed)


def run_name(run: str | None) -> str:
    """A folder name for a run (a stream's checkpoint folder)."""
    return hashlib.md5((run or "").encode()).hexdigest()[:16]


def no_rows(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table, made without Python workers."""
    return spark.range(0).select([F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


class EventLog:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, emitter: str = "emitter_contract_id", buckets: int = 16,
                 kind: str = "event_name"):
        """``kind``: the column that the rows of a file are sorted by, so a reader of one kind skips the others' pages."""
        self.spark, self.root, self.schema, self.emitter, self.buckets, self.kind = spark, root.rstrip("/"), schema, emitter, buckets, kind

    def _bucket(self, emitter: Column) -> Column:
        return F.pmod(F.xxhash64(emitter), F.lit(self.buckets)).cast("int")

    def append(self, rows: DataFrame, run: str | None, batch_id: int) -> None:
        placed = rows.select(*self.schema.names).withColumn(_BUCKET, self._bucket(F.col(self.emitter)))
        placed = placed.hint("rebalance", _BUCKET)  # a file or a few a bucket; a hot emitter is split
        placed = placed.sortWithinPartitions(_BUCKET, self.kind)
        placed.write.mode("overwrite").partitionBy(_BUCKET).parquet(self._folder(run, batch_id))

    def _folder(self, run: str | None, batch_id: int) -> str:
        return f"{self.root}/run={run_name(run)}/batch={batch_id}"

    def of_batch(self, run: str | None, batch_id: int) -> DataFrame:
        """The rows that ``append`` wrote for a batch."""
        full = T.StructType([*self.schema.fields, _PLACE[-1]])
        return self.spark.read.schema(full).parquet(self._folder(run, batch_id)).select(*self.schema.names)

    def _rows(self) -> DataFrame:
        full = T.StructType([*self.schema.fields, *_PLACE])
        if not exists(self.spark, self.root):
            return no_rows(self.spark, full)
        return self.spark.read.schema(full).option("basePath", self.root).parquet(self.root)

    def read(self) -> DataFrame:
        """Every event once: of re-delivered ones the row of the newest ledger, then of the last batch."""
        return latest_per_key(self._rows(), ["id"], ("-ledger_sequence", "-batch")).select(*self.schema.names)

    def of_emitters(self, emitters: DataFrame, col: str, run: str | None, but_batch: int) -> DataFrame:
        """The rows (re-delivered ones too) of ``emitters`` in all batches but ``but_batch`` of ``run``, which the caller has at hand."""
        wanted = emitters.select(F.col(col).alias("__emitter"), self._bucket(F.col(col)).alias("__bucket")).distinct()
        buckets = [r[0] for r in wanted.select("__bucket").distinct().collect()]  # ``buckets`` numbers at most
        here = (F.col("run") == F.lit(run_name(run))) & (F.col("batch") == F.lit(but_batch))
        rows = self._rows().where(F.col(_BUCKET).isin(buckets) & ~here)
        return rows.join(wanted, rows[self.emitter] == wanted["__emitter"], "left_semi").select(*self.schema.names)
