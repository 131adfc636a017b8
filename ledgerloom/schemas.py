"""Explicit schemas of the inputs and keyed tables (never inferred from JSON)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

CHAIN_EVENTS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("type", T.StringType(), True),
    T.StructField("topics", T.StringType(), True),
    T.StructField("data", T.StringType(), True),
    T.StructField("contract_id", T.StringType(), True),
    T.StructField("transaction_hash", T.StringType(), False),
    T.StructField("ledger_sequence", T.LongType(), False),
    T.StructField("ledger_closed_at", T.TimestampNTZType(), False),
    T.StructField("in_successful_contract_call", T.BooleanType(), True),
    T.StructField("transaction_successful", T.BooleanType(), True),
    T.StructField("operation_body", T.StringType(), True),
])

LEDGER_ENTRIES = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("last_modified_ledger_sequence", T.LongType(), False),
    T.StructField("ledger_closed_at", T.TimestampNTZType(), False),
    T.StructField("transaction_hash", T.StringType(), True),
    T.StructField("ledger_entry_type", T.StringType(), True),
    T.StructField("change_type", T.StringType(), True),
    T.StructField("entry_data", T.StringType(), True),
])

# Metadata entries read from a binary's custom section: key/value text pairs.
META_ENTRIES = T.StructType([
    T.StructField("wasm_hash", T.StringType(), True),
    T.StructField("entries", T.ArrayType(T.StructType([
        T.StructField("key", T.StringType(), True),
        T.StructField("val", T.StringType(), True),
    ])), True),
])


@dataclass(frozen=True)
class TableSpec:
    """A keyed table: primary key columns and the order that decides which row of a key wins
    (greatest wins). ``not_null`` lists columns a row must fill to be accepted."""
    name: str
    keys: tuple[str, ...]
    order: tuple[str, ...] = ("ledger_sequence", "id")
    not_null: tuple[str, ...] = field(default_factory=tuple)


COMMON = ("id", "transaction_hash", "ledger_sequence", "created_at", "emitter_contract_id")

# Target tables of the batch ingest path (deploys / publishes), with their declared constraints.
BATCH_DEPLOYS = TableSpec("deploys", ("id",), ("ledger_sequence", "id"),
                          ("id", "transaction_hash", "ledger_sequence", "created_at"))
BATCH_PUBLISHES = TableSpec("publishes", ("id",), ("ledger_sequence", "id"),
                            ("id", "transaction_hash", "ledger_sequence", "created_at"))
