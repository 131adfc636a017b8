"""Latest row per key (``DISTINCT ON (k) ... ORDER BY k, seq DESC``) and per-key sequence numbers.

``latest_per_key`` is ``row_number() == 1``: Spark plans it as a partial ``WindowGroupLimit``
before the shuffle and a final one after it, so every map task sends at most one row per key;
a key holding a large share of the rows does not land whole in one reducer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OrderSpec = Sequence["str | Column"]


def _order_cols(order: OrderSpec) -> list[Column]:
    out = []
    for o in order:
        if isinstance(o, Column):
            out.append(o)
        elif o.startswith("-"):
            out.append(F.col(o[1:]).desc_nulls_first())  # DESC puts NULLs first, as in PostgreSQL
        else:
            out.append(F.col(o).asc_nulls_last())
    return out


def order_cols(order: OrderSpec) -> list[Column]:
    """'-col' = descending (NULLs first), 'col' = ascending (NULLs last), Columns pass through."""
    return _order_cols(order)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: OrderSpec = ("-ledger_sequence", "-id"),
                   n: int = 1) -> DataFrame:
    """First ``n`` rows of each key under ``order`` (default: newest ledger, then greatest id)."""
    w = Window.partitionBy(*keys).orderBy(*_order_cols(order))
    rn = "__rn"
    return df.withColumn(rn, F.row_number().over(w)).where(F.col(rn) <= n).drop(rn)


def sequence_index(df: DataFrame, key, major: str, minor, out: str = "version_index",
                   base: int = 0, major_desc: bool = False) -> DataFrame:
    """``ROW_NUMBER() OVER (PARTITION BY key ORDER BY major[, minor...]) - 1 + base`` without sorting
    a whole key in one task.

    The index is split in two: per (key, major) the number of rows (a partial aggregate), a running
    sum of those counts over ``major`` within the key (one small row per key and major value), and
    the row number inside (key, major). A hot key is thus spread over its ``major`` values (ledgers),
    and only the small count table is ordered per key. ``key`` may be a list of columns and ``minor``
    an order spec (see ``order_cols``); ``major_desc`` orders the major column descending (NULLs
    first), otherwise ascending (NULLs last).
    """
    keys = [key] if isinstance(key, str) else list(key)
    minor_order = [minor] if isinstance(minor, str) else list(minor)
    major_sort = F.col(major).desc_nulls_first() if major_desc else F.col(major).asc_nulls_last()
    counts = df.groupBy(*keys, major).agg(F.count(F.lit(1)).alias("__n"))
    w_prefix = Window.partitionBy(*keys).orderBy(major_sort).rowsBetween(Window.unboundedPreceding, -1)
    renamed = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    offsets = counts.select(*renamed, F.col(major).alias("__m"),
                            F.coalesce(F.sum("__n").over(w_prefix), F.lit(0)).alias("__off"))
    w_in = Window.partitionBy(*keys, major).orderBy(*_order_cols(minor_order))
    local = df.withColumn("__rn", F.row_number().over(w_in))
    # null-safe equality: a NULL key is one group, as in the window form
    cond = F.col(major).eqNullSafe(F.col("__m"))
    for i, k in enumerate(keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    joined = local.join(offsets, on=cond, how="left")
    return joined.withColumn(out, (F.col("__off") + F.col("__rn") - 1 + base).cast("bigint")) \
        .drop(*[f"__k{i}" for i in range(len(keys))], "__m", "__off", "__rn")


def global_index(df: DataFrame, order: OrderSpec, out: str, partitions: int | None = None) -> DataFrame:
    """``df`` with ``out``: each row's position (from 0) in the ascending order of the columns ``order``, in one job.

    The rows are range partitioned and sorted inside each partition, written once with ``checkpoint()``
    (so both uses below see identical partitions even if executors are lost), then each row's index
    is its position inside its partition plus the row count of all earlier partitions. The count
    table has one row per partition, so it is broadcast with a known bound.
    """
    by = [F.col(c).asc() for c in order]
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(n, *by).sortWithinPartitions(*by).checkpoint(eager=True)
    mono = F.monotonically_increasing_id()
    local = ordered.select("*", F.spark_partition_id().alias("__pid"), mono.alias("__mono"))
    # monotonically_increasing_id = (partition id << 33) + position inside the partition
    local = local.withColumn("__pos", F.col("__mono") - F.shiftleft(F.col("__pid").cast("bigint"), 33))
    counts = local.groupBy("__pid").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("__pid").alias("__opid"),
                            F.coalesce(F.sum("__cnt").over(w), F.lit(0)).alias("__off"))
    placed = local.join(F.broadcast(offsets), local["__pid"] == offsets["__opid"])
    return placed.withColumn(out, (F.col("__off") + F.col("__pos")).cast("bigint")).drop("__pid", "__mono", "__pos", "__opid", "__off")
