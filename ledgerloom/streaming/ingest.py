"""Structured Streaming ingest of the event stream into the keyed registry tables.

Each micro-batch (``foreachBatch``):
1. normalises the batch (coarse filter) and appends it to the raw backup, a log partitioned by emitter; all else reads the batch there,
   a column and a kind of event at a time, so no wide row is held in memory;
2. notes which of the root registry's announcements are of members that are not stored yet (written once a batch, so a
   retry sees the same), then upserts them all into ``registries`` (keyed by contract id);
3. gates the batch by a semi join against the set, and back-fills: rows of the new members alone are read from
   the raw backup's earlier batches, wherever in the stream they came;
4. upserts the passing rows into the six typed sinks (keyed by id).

An event is passed on when it comes after its emitter's announcement, or else by the announcement itself, so the final
tables equal the batch semi join whatever the arrival order or batch split. Nothing is parked: a batch costs
its own rows and those of the members it adds, however many events of strangers the backup holds. Sink writes are idempotent keyed
merges recorded with the batch id, so a retried batch (after a failure) changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators.event_log import EventLog, exists, run_name
from ..operators.sinks import KeyedTable
from ..schemas import CHAIN_EVENTS
from ..sources.readers import read_events

TYPED = ("deploy", "publish", "register", "rename", "update_address", "update_owner")
SINK_NAMES = {"deploy": "deployed_contracts", "publish": "published_wasms", "register": "registered_contracts",
              "rename": "rename", "update_address": "update_address", "update_owner": "update_owner"}


@dataclass
class RegistryIngest:
    spark: SparkSession
    state_root: str
    root_registry: str
    buckets: int = 8
    registries_root: str | None = None      # kept across replays (the membership set)
    ledger_range: int = 10_000              # ledgers per bucket of the id-keyed event tables
    metrics: list = field(default_factory=list)

    def __post_init__(self):
        s = self.spark
        empty = s.createDataFrame([], CHAIN_EVENTS)
        raw = D.normalize_events(empty)
        self.raw_log = EventLog(s, f"{self.state_root}/raw_events_backup", raw.schema)
        # the typed tables are keyed by id, and an id belongs to one ledger: bucket them by ledger range
        # so a batch of new events rewrites only the newest buckets
        by_ledger = {"range_col": "ledger_sequence", "range_width": self.ledger_range}
        sub = D.decode_sub_reg(raw, self.root_registry)
        self.registries = KeyedTable(s, self.registries_root or f"{self.state_root}/registries", ["contract_id"],
                                     sub.schema, ["ledger_sequence", "id"], self.buckets)
        self.sinks = {e: KeyedTable(s, f"{self.state_root}/{SINK_NAMES[e]}", ["id"], D.decode_event(raw, e).schema,
                                    ["ledger_sequence", "id"], **by_ledger) for e in TYPED}
        self.run_id: str | None = None

    # ---- one micro-batch ----------------------------------------------------------------------------
    def _new_members(self, announced: DataFrame, batch_id: int) -> DataFrame:
        """Announced members that were not stored before the batch; the answer of its first attempt is kept for further ones."""
        path = f"{self.state_root}/_new_members/run={run_name(self.run_id)}/batch={batch_id}"
        if not exists(self.spark, f"{path}/_SUCCESS"):
            ids = announced.select("contract_id").distinct()
            new = ids.join(self.registries.read().select("contract_id"), "contract_id", "left_anti")
            new.write.mode("overwrite").parquet(path)
        return self.spark.read.schema("contract_id string").parquet(path)

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        self.raw_log.append(D.normalize_events(batch), self.run_id, batch_id)
        raw = self.raw_log.of_batch(self.run_id, batch_id)
        announced = D.decode_sub_reg(raw, self.root_registry).where(F.col("contract_id").isNotNull())
        new = self._new_members(announced, batch_id)
        self.registries.upsert(announced, batch_id)
        members = self.registries.read().select(F.col("contract_id").alias("__member"))
        needed = [*D.COMMON_COLS, "event_name", "data"]
        passed = raw.join(members, raw["emitter_contract_id"] == members["__member"], "left_semi").select(*needed)
        n_new = new.count()
        if n_new:  # what was delivered before too is stored once: the sinks are keyed
            passed = passed.unionByName(self.raw_log.of_emitters(new, "contract_id", self.run_id, batch_id).select(*needed))
        for e in TYPED:
            self.sinks[e].upsert(D.decode_event(passed, e), batch_id, persist=False)
        self.metrics.append({"batch_id": batch_id, "new_members": n_new})

    # ---- running ------------------------------------------------------------------------------------
    def run(self, source_path: str, checkpoint: str, start_at: int | None = None,
            max_files_per_trigger: int | None = None) -> None:
        """Process everything available now and stop (``trigger(availableNow=True)``); a later call
        with the same checkpoint continues where this one stopped."""
        self.run_id = checkpoint
        for table in (self.registries, *self.sinks.values()):
            table.run = checkpoint
        stream = read_events(self.spark, source_path, start_at, streaming=True,
                             max_files_per_trigger=max_files_per_trigger)
        q = (stream.writeStream.foreachBatch(self.process_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))

    def table(self, name: str) -> DataFrame:
        if name == "registries":
            return self.registries.read()
        if name == "raw_events_backup":
            return self.raw_log.read()
        for e, sink in SINK_NAMES.items():
            if sink == name:
                return self.sinks[e].read()
        raise KeyError(name)

    def sink_ids(self) -> DataFrame:
        out = self.registries.read().select("id", F.lit("sub_reg").alias("event_name"))
        for e in TYPED:
            out = out.unionByName(self.sinks[e].read().select("id", F.lit(e).alias("event_name")))
        return out


def write_stream_files(df: DataFrame, folder: str, files: int, seq_col: str = "ledger_sequence",
                       descending: bool = False) -> None:
    """Lay a stored stream out as ``files`` Parquet files in ledger ranges (the arrival units of a
    file-source stream). With ``descending`` the files arrive newest ledgers first."""
    spark = df.sparkSession
    order = F.col(seq_col).desc() if descending else F.col(seq_col).asc()
    parts = df.repartitionByRange(files, order).sortWithinPartitions(order)
    if not descending:
        parts.write.mode("errorifexists").parquet(folder)
        return
    # one write per range so file modification times follow the (descending) arrival order
    staged = f"{folder}-staged"
    parts.write.mode("errorifexists").parquet(staged)
    ranges = spark.read.schema(df.schema).parquet(staged).select(F.spark_partition_id().alias("p"), seq_col)
    bounds = ranges.groupBy("p").agg(F.min(seq_col).alias("lo"), F.max(seq_col).alias("hi")).orderBy(
        F.col("lo").desc()).collect()   # one row per file: bounded by ``files``
    staged_df = spark.read.schema(df.schema).parquet(staged)
    for i, b in enumerate(bounds):
        (staged_df.where((F.col(seq_col) >= b["lo"]) & (F.col(seq_col) <= b["hi"])).coalesce(1)
         .write.mode("append").parquet(folder))
