"""Structured Streaming ingest of the contract lifecycle: the ledger-entry stream into three keyed tables, and upgrade events
of the event stream into a fourth.

Tables: ``wasm_uploads`` and ``contract_deploys`` (keyed by entry id), ``wasm_binaries`` (keyed by content hash, the newest upload wins) and
``contract_upgrades`` (keyed by event id). The two streams have a checkpoint each and stop and go on by themselves: either
everything available now, or continuously with a processing-time trigger. A batch that was under way when its stream stopped is
done again and changes nothing (keyed merges recorded with the batch id).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import decode as D
from ..operators.latest import latest_per_key
from ..operators.sinks import KeyedTable
from ..schemas import CHAIN_EVENTS, LEDGER_ENTRIES
from ..sources.readers import scan_from


@dataclass
class ArchiveIngest:
    spark: SparkSession
    state_root: str
    buckets: int = 8
    ledger_range: int = 10_000              # ledgers per bucket of the tables keyed by id

    def __post_init__(self):
        s = self.spark
        entries, events = s.createDataFrame([], LEDGER_ENTRIES), s.createDataFrame([], CHAIN_EVENTS)
        by_ledger = {"range_col": "ledger_sequence", "range_width": self.ledger_range}

        def keyed(name: str, rows: DataFrame, key: str, **where) -> KeyedTable:
            return KeyedTable(s, f"{self.state_root}/{name}", [key], rows.schema, ["ledger_sequence", "id"], **where)

        self.uploads = keyed("wasm_uploads", D.wasm_uploads(entries), "id", **by_ledger)
        self.binaries = keyed("wasm_binaries", D.wasm_binary_rows(entries), "wasm_hash", buckets=self.buckets)
        self.deploys = keyed("contract_deploys", D.contract_deploys(entries), "id", **by_ledger)
        self.upgrades = keyed("contract_upgrades", D.upgrade_events(events), "id", **by_ledger)

    def process_entries(self, batch: DataFrame, batch_id: int) -> None:
        # each table reads its kind of entry from the stream's files; of a hash's uploads one is kept before anything else is done
        self.uploads.upsert(D.wasm_uploads(batch), batch_id, persist=False)
        binaries = D.wasm_binary_rows(batch).where(F.col("wasm_hash").isNotNull())
        self.binaries.upsert(latest_per_key(binaries, ["wasm_hash"], ("-ledger_sequence", "-id")), batch_id)
        self.deploys.upsert(D.contract_deploys(batch), batch_id)

    def process_events(self, batch: DataFrame, batch_id: int) -> None:
        self.upgrades.upsert(D.upgrade_events(batch), batch_id)

    def _start(self, schema, path, checkpoint, each, start_at, seq_col, max_files, every) -> StreamingQuery:
        reader = self.spark.readStream.schema(schema)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        writer = scan_from(reader.parquet(path), start_at, seq_col).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()

    def start_entries(self, path: str, checkpoint: str, start_at: int | None = None, max_files_per_trigger: int | None = None,
                      every: str | None = None) -> StreamingQuery:
        """The ledger-entry stream, from where ``checkpoint`` stands; ``every`` (say '10 seconds') keeps it running until it is stopped."""
        for table in (self.uploads, self.binaries, self.deploys):
            table.run = checkpoint
        return self._start(LEDGER_ENTRIES, path, checkpoint, self.process_entries, start_at, "last_modified_ledger_sequence", max_files_per_trigger, every)

    def start_events(self, path: str, checkpoint: str, start_at: int | None = None, max_files_per_trigger: int | None = None,
                     every: str | None = None) -> StreamingQuery:
        """The event stream's upgrades, likewise."""
        self.upgrades.run = checkpoint
        return self._start(CHAIN_EVENTS, path, checkpoint, self.process_events, start_at, "ledger_sequence", max_files_per_trigger, every)

    def run(self, entries_path: str, events_path: str, checkpoint_root: str, max_files_per_trigger: int | None = None) -> None:
        """Everything available now in both streams."""
        queries = [self.start_entries(entries_path, f"{checkpoint_root}/entries", max_files_per_trigger=max_files_per_trigger),
                   self.start_events(events_path, f"{checkpoint_root}/events", max_files_per_trigger=max_files_per_trigger)]
        for q in queries:
            q.awaitTermination()

    def table(self, name: str) -> DataFrame:
        if name == "wasm_binaries":
            return self.binaries.read().drop("id")
        return {"wasm_uploads": self.uploads, "contract_deploys": self.deploys, "contract_upgrades": self.upgrades}[name].read()
