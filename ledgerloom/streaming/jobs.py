"""Operational jobs around the streaming ingest: replay, full rebuild with audit, and the
incremental batch ingest of the minimal pipeline's table.

Phases run one after another (each stream run ends with ``availableNow``), which gives the
barriers the shell orchestration waited and slept for.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit as A
from ..operators import decode as D
from ..operators.sinks import KeyedTable, load_stamp
from ..schemas import CHAIN_EVENTS
from .ingest import RegistryIngest


def replay(ingest: RegistryIngest, source_path: str, checkpoint_root: str, start_at: int | None = None,
           max_files_per_trigger: int | None = None) -> RegistryIngest:
    """Re-run the stream from ``start_at`` with a fresh checkpoint, keeping the tables and the
    membership set; keyed merges make it idempotent and the full set lets every event pass."""
    ingest.run(source_path, f"{checkpoint_root}/replay-{uuid.uuid4().hex[:8]}", start_at, max_files_per_trigger)
    return ingest


def rebuild(spark: SparkSession, source_path: str, state_root: str, root_registry: str,
            registries_root: str | None = None, start_at: int | None = None,
            max_files_per_trigger: int | None = None) -> RegistryIngest:
    """Fresh sink tables (a new state folder), stream replayed from the start. An existing
    membership table can be kept by passing its folder."""
    ing = RegistryIngest(spark, state_root, root_registry, registries_root=registries_root)
    ing.run(source_path, f"{state_root}/_checkpoint", start_at, max_files_per_trigger)
    return ing


class AuditFailed(RuntimeError):
    pass


def rebuild_and_audit(spark: SparkSession, source_path: str, state_root: str, root_registry: str,
                      expected_members: int | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """Rebuild, check the membership set size, audit, replay once if real drops remain, re-audit,
    and fail if any remain. Audit rows explained as sub_reg bookkeeping (superseded or non-root
    announcements) are reported but are not drops; an announcement of a member that is not stored is one. Returns the final audit rows."""
    ing = rebuild(spark, source_path, state_root, root_registry, max_files_per_trigger=max_files_per_trigger)
    if expected_members is not None:
        n = ing.registries.read().count()
        if n != expected_members:
            raise AuditFailed(f"registries has {n} rows, expected {expected_members}")

    def audit() -> DataFrame:
        return A.audit_dropped(ing.table("raw_events_backup"), ing.registries.read(), ing.sink_ids())

    def real_drops(a: DataFrame) -> int:
        rows = A.audit_reasons(a, ing.table("raw_events_backup"), ing.registries.read(), root_registry)
        return rows.where(F.col("reason") == A.DROPPED).count()

    if real_drops(audit()) > 0:
        replay(ing, source_path, f"{state_root}/_replays", max_files_per_trigger=max_files_per_trigger)
        if real_drops(audit()) > 0:
            raise AuditFailed("events still missing after replay")
    return audit()


def incremental_ingest(spark: SparkSession, events_path: str, state_root: str, checkpoint: str,
                       max_files_per_trigger: int | None = None, buckets: int = 8) -> dict:
    """Batch-path ingest of the minimal pipeline's event table: every run processes the files that
    arrived since the last run (file-source offsets in the checkpoint replace the hand-kept high
    water), decodes deploy and publish events (last entry wins, absent key -> ''), stamps them
    with the load time and inserts them first-wins. Returns the target tables."""
    empty = spark.createDataFrame([], CHAIN_EVENTS)
    dep_schema = load_stamp(D.decode_batch(empty, "deploy")).schema
    pub_schema = load_stamp(D.decode_batch(empty, "publish")).schema
    targets = {"deploys": KeyedTable(spark, f"{state_root}/deploys", ["id"], dep_schema, buckets=buckets),
               "publishes": KeyedTable(spark, f"{state_root}/publishes", ["id"], pub_schema, buckets=buckets)}
    for table in targets.values():
        table.run = checkpoint
    inserted: dict[str, int] = {"deploys": 0, "publishes": 0}

    def each(batch: DataFrame, batch_id: int) -> None:
        b = batch.persist()
        for name, ev in (("deploys", "deploy"), ("publishes", "publish")):
            _, n = targets[name].insert_ignore(load_stamp(D.decode_batch(b, ev)), batch_id, ("ledger_sequence", "id"))
            inserted[name] += n
        b.unpersist()

    reader = spark.readStream.schema(CHAIN_EVENTS)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    q = (reader.parquet(events_path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return {"tables": targets, "inserted": inserted}
