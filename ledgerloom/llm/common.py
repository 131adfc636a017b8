"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir, state_dir

#: A word: a run of characters other than space and the control characters tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's source to the executors' Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-src-"), "ledgerloom_src.zip")  # the driver serves it
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(name)
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns with any name cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def numbered(docs: DataFrame, by: list[str], text_col: str) -> DataFrame:
    """row (a struct of all columns, so that none clashes), hash (xxhash64 of the text) and place (from 1) among the rows equal in ``by``
    and text, in the order of their JSON: rows that share it are the same."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash"))
    same = Window.partitionBy(*[F.col("row")[c] for c in by], "hash").orderBy("rest")
    rest = F.to_json(F.struct(*[F.col("row")[c].alias(f"c{k}") for k, c in enumerate(docs.columns) if c not in (*by, text_col)], F.lit(0).alias("z")))
    return rows.withColumn("rest", rest).withColumn("place", F.row_number().over(same)).drop("rest")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder of ``spark.checkpoint.dir`` and read back: cuts lineage
    in a way that survives lost executors, and fixes values that depend on the partitioning."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{state_dir(spark, f'llm-{name}')}/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranged(df: DataFrame, order: list[str], name: str, part: str = "__part") -> DataFrame:
    """``df`` range-partitioned by ``order``, with the number of its partition as a stored column.

    The stored copy makes the partition numbers fixed, so running sums can be taken inside a
    partition and shifted by the totals of the partitions before it (``offsets``)."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = df.repartitionByRange(n, *order).withColumn(part, F.spark_partition_id())
    return stored(out, name)


def offsets(totals: DataFrame, part: str, value: str, out: str, by: list[str] = ()) -> DataFrame:
    """Exclusive running sum of ``value`` over the partitions (one row a partition and ``by`` key)."""
    w = Window.orderBy(part) if not by else Window.partitionBy(*by).orderBy(part)
    before = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return totals.select(*by, part, F.coalesce(before, F.lit(0)).alias(out))
