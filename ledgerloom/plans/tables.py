"""The registry catalogue in batch form: from the two change streams to every keyed table and view.

In batch it is one lazy plan per table, derived from the streams on each use (``RegistryTables``). ``StoredTables`` has the
same tables and views over what the streaming jobs wrote: no event is filtered, parsed or gated again, and predicates on
names, channels and ids go down to the scans of the stored tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import views as V
from ..operators.gate import membership_gate, membership_set
from ..operators.latest import latest_per_key

TYPED_EVENTS = ("deploy", "publish", "register", "rename", "update_address", "update_owner")
from ..sources import bridge
from ..sources.fixture import entries_path, events_path
from ..sources.readers import read_events, read_ledger_entries


class RegistryTables:
    def __init__(self, chain_events: DataFrame, ledger_entries: DataFrame | None, root_registry: str,
                 dedupe_ids: bool = False):
        self.chain_events = chain_events
        self.ledger_entries = ledger_entries
        self.root_registry = root_registry
        self.dedupe_ids = dedupe_ids

    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str) -> "RegistryTables":
        """Tables over the fixture streams derived from the driver's ``events`` and ``orders``.

        A derived stream is written once per data folder, when it is first read (see ``sources.fixture``), and then
        scanned like the provider's stored tables."""
        return FixtureTables(spark, sf_dir)

    @classmethod
    def from_store(cls, spark: SparkSession, root: str, root_registry: str) -> "StoredTables":
        """The tables that ``RegistryIngest`` wrote under ``root`` and ``ArchiveIngest`` under ``root``/archive."""
        from ..streaming.archive import ArchiveIngest
        from ..streaming.ingest import RegistryIngest

        return StoredTables(RegistryIngest(spark, root, root_registry), ArchiveIngest(spark, f"{root}/archive"))

    # ---- event pipeline -----------------------------------------------------------------
    @cached_property
    def raw(self) -> DataFrame:
        """raw_events_backup: coarse-filtered, normalised events (before the gate)."""
        raw = D.normalize_events(self.chain_events)
        if self.dedupe_ids:
            raw = latest_per_key(raw, ["id"], ("-ledger_sequence",))
        return raw

    @cached_property
    def sub_reg(self) -> DataFrame:
        return D.decode_sub_reg(self.raw, self.root_registry)

    @cached_property
    def registries(self) -> DataFrame:
        """Keyed by contract_id; the newest announcement of a member wins. One row per registry
        (a small table read by the gate and every channel join)."""
        s = self.sub_reg.where(F.col("contract_id").isNotNull())
        return latest_per_key(s, ["contract_id"], ("-ledger_sequence", "-id"))

    @cached_property
    def members(self) -> DataFrame:
        """The membership set: every announced contract id (= the registries' keys)."""
        return membership_set(self.registries)

    @cached_property
    def gated(self) -> DataFrame:
        return membership_gate(self.raw, self.members)

    def typed(self, event_name: str) -> DataFrame:
        return D.decode_event(self.gated, event_name)

    @cached_property
    def deployed(self) -> DataFrame:
        return self.typed("deploy")

    @cached_property
    def published(self) -> DataFrame:
        return self.typed("publish")

    @cached_property
    def registered(self) -> DataFrame:
        return self.typed("register")

    @cached_property
    def renamed(self) -> DataFrame:
        return self.typed("rename")

    @cached_property
    def address_updates(self) -> DataFrame:
        return self.typed("update_address")

    @cached_property
    def owner_updates(self) -> DataFrame:
        return self.typed("update_owner")

    # ---- contract lifecycle (archive) -----------------------------------------------------
    @cached_property
    def uploads(self) -> DataFrame:
        return D.wasm_uploads(self.ledger_entries)

    @cached_property
    def wasm_binaries(self) -> DataFrame:
        """Keyed by wasm_hash: re-uploads collapse, the newest (ledger, entry id) wins."""
        rows = D.wasm_binary_rows(self.ledger_entries).where(F.col("wasm_hash").isNotNull())
        return latest_per_key(rows, ["wasm_hash"], ("-ledger_sequence", "-id")).drop("id")

    @cached_property
    def deploys(self) -> DataFrame:
        return D.contract_deploys(self.ledger_entries)

    @cached_property
    def upgrades(self) -> DataFrame:
        return D.upgrade_events(self.chain_events)

    # ---- views -------------------------------------------------------------------------------
    @cached_property
    def published_with_channel(self) -> DataFrame:
        return V.with_channel(self.published, self.registries)

    @cached_property
    def registered_with_channel(self) -> DataFrame:
        return V.with_channel(self.registered, self.registries)

    @cached_property
    def latest_published(self) -> DataFrame:
        return V.latest_published(self.published_with_channel)

    @cached_property
    def wasm_versions(self) -> DataFrame:
        return V.wasm_versions(self.uploads, self.published)

    @cached_property
    def versions(self) -> DataFrame:
        return V.versions(self.deploys, self.upgrades, self.published, self.registries)

    @cached_property
    def contracts(self) -> DataFrame:
        return V.contracts(self.registered_with_channel, self.deployed)

    @cached_property
    def contracts_enriched(self) -> DataFrame:
        return V.contracts_enriched(self.contracts, self.versions)

    def sink_ids(self) -> DataFrame:
        """(id, event_name) of every row that reached a downstream sink. Each typed sink holds
        exactly the gated rows of its event kind (decoding keeps every row), so the six typed sinks
        are read as one scan of the gated rows; sub_reg rows are the stored registries."""
        typed = self.gated.where(F.col("event_name").isin(*TYPED_EVENTS)).select("id", "event_name")
        return typed.unionByName(self.registries.select("id", F.lit("sub_reg").alias("event_name")))


class FixtureTables(RegistryTables):
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.root_registry, self.dedupe_ids = bridge.root_registry(), False

    @cached_property
    def chain_events(self) -> DataFrame:
        return read_events(self.spark, events_path(self.spark, self.sf_dir))

    @cached_property
    def ledger_entries(self) -> DataFrame:
        return read_ledger_entries(self.spark, entries_path(self.spark, self.sf_dir))


class StoredTables(RegistryTables):
    """The catalogue over stored tables. A view reads each table that it needs once or twice; the newest version of a table when the
    plan is made is the one that it reads."""

    def __init__(self, ingest, archive):
        super().__init__(None, None, ingest.root_registry)
        self.ingest, self.archive = ingest, archive

    @cached_property
    def raw(self) -> DataFrame:
        return self.ingest.table("raw_events_backup")

    @cached_property
    def registries(self) -> DataFrame:
        return self.ingest.table("registries")

    def typed(self, event_name: str) -> DataFrame:
        return self.ingest.sinks[event_name].read()

    @cached_property
    def uploads(self) -> DataFrame:
        return self.archive.table("wasm_uploads")

    @cached_property
    def wasm_binaries(self) -> DataFrame:
        return self.archive.table("wasm_binaries")

    @cached_property
    def deploys(self) -> DataFrame:
        return self.archive.table("contract_deploys")

    @cached_property
    def upgrades(self) -> DataFrame:
        return self.archive.table("contract_upgrades")

    def sink_ids(self) -> DataFrame:
        return self.ingest.sink_ids()
