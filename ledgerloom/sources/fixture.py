"""Stored fixture streams: the bridge output written once as Parquet and then scanned like the
provider's tables (explicit schema, ledger-sorted files, so start-ledger predicates prune row groups).

The copy lives in the shared folder named by ``spark.checkpoint.dir``; it is written to a private
folder and renamed into place, so concurrent first users cannot observe a half-written table.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.event_log import stored_bytes
from ..schemas import CHAIN_EVENTS, LEDGER_ENTRIES
from ..session import checkpoint_dir
from . import bridge

_VERSION = "v1"
#: Bytes of the driver's table behind each file of a derived stream.
_PART_BYTES = 8 << 20


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def _store(spark: SparkSession, source: str, derive, ledger: str, schema: StructType, target: str) -> None:
    """The rows that ``derive`` makes of the driver's table ``source``, as files in ledger order. The driver's narrow rows are
    shuffled and sorted by the ledger that they will have, and widened behind that, as the files are written."""
    if _exists(spark, f"{target}/_SUCCESS"):
        return
    tmp = f"{target}.tmp-{uuid.uuid4().hex[:8]}"
    n = max(spark.sparkContext.defaultParallelism, -(-stored_bytes(spark, source) // _PART_BYTES), 1)
    key = F.expr(ledger)
    rows = derive(spark.read.parquet(source), lambda narrow: narrow.repartitionByRange(n, key).sortWithinPartitions(key))
    rows.select([rows[f.name].cast(f.dataType).alias(f.name) for f in schema.fields]).write.mode("overwrite").parquet(tmp)
    fs, src = _fs(spark, tmp)
    _, dst = _fs(spark, target)
    if not fs.exists(dst):
        fs.rename(src, dst)
    if not _exists(spark, f"{target}/_SUCCESS"):
        raise RuntimeError(f"fixture table {target} was not written")


def _target(spark: SparkSession, sf_dir: str, table: str) -> str:
    key = hashlib.sha1(f"{_VERSION}:{sf_dir.rstrip('/')}".encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/ledgerloom/fixture-{key}/{table}"


def events_path(spark: SparkSession, sf_dir: str) -> str:
    """The chain_events path for the driver's ``events`` in ``sf_dir``."""
    path = _target(spark, sf_dir, "chain_events")
    _store(spark, f"{sf_dir}/events.parquet", bridge.chain_events, bridge.EVENT_LEDGER, CHAIN_EVENTS, path)
    return path


def entries_path(spark: SparkSession, sf_dir: str) -> str:
    """The ledger_entries path for the driver's ``orders`` in ``sf_dir``."""
    path = _target(spark, sf_dir, "ledger_entries")
    _store(spark, f"{sf_dir}/orders.parquet", bridge.ledger_entries, bridge.ENTRY_LEDGER, LEDGER_ENTRIES, path)
    return path


def fixture_paths(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """(chain_events path, ledger_entries path) for the driver tables in ``sf_dir``."""
    return events_path(spark, sf_dir), entries_path(spark, sf_dir)
