"""Projections and payload decoders: raw normalisation, the seven typed event tables, the batch
ingest decoders, the archive projections of ledger entries, and small JSON projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import VALUE_TAGS, computed_once, decode_pairs, json_scalar, parse_pairs, parse_variant
from .filters import filter_created, filter_system, registry_candidates, with_topic_name

# Fixed values: (payload key, value tag, output column) of each event kind, and how many payload
# positions the streaming pipeline probes for it.
SUB_REG_SPEC = (("contract_id", "address", "contract_id"), ("name", "string", "registry_channel"))
DEPLOY_SPEC = (("wasm_name", "string", "wasm_name"), ("version", "string", "wasm_version"),
               ("deployer", "address", "deployer"), ("contract_id", "address", "contract_id"),
               ("registry", "address", "registry_contract_id"))
PUBLISH_SPEC = (("author", "address", "author"), ("version", "string", "wasm_version"),
                ("wasm_hash", "bytes", "wasm_hash"), ("wasm_name", "string", "wasm_name"))
REGISTER_SPEC = (("contract_name", "string", "contract_name"), ("contract_id", "address", "contract_id"),
                 ("sac", "bool", "sac"), ("wasm_hash", "bytes", "wasm_hash"))
RENAME_SPEC = (("old_name", "string", "old_name"), ("new_name", "string", "new_name"))
UPDATE_ADDRESS_SPEC = (("contract_name", "string", "contract_name"), ("new_address", "address", "new_address"))
UPDATE_OWNER_SPEC = (("contract_name", "string", "contract_name"), ("new_owner", "address", "new_owner"))

# Event name -> (spec, positions probed).
STREAM_DECODERS = {
    "sub_reg": (SUB_REG_SPEC, 2),
    "deploy": (DEPLOY_SPEC, 5),
    "publish": (PUBLISH_SPEC, 4),
    "register": (REGISTER_SPEC, 4),
    "rename": (RENAME_SPEC, 2),
    "update_address": (UPDATE_ADDRESS_SPEC, 2),
    "update_owner": (UPDATE_OWNER_SPEC, 2),
}

# Batch-ingest decoders (every position, last entry wins, absent key -> '').
DEPLOY_BATCH_SPEC = (("contract_id", "address", "contract_id"), ("contract_name", "string", "contract_name"),
                     ("deployer", "address", "deployer"), ("version", "string", "version"),
                     ("wasm_name", "string", "wasm_name"))
PUBLISH_BATCH_SPEC = (("author", "address", "author"), ("version", "string", "version"),
                      ("wasm_name", "string", "wasm_name"), ("wasm_hash", "bytes", "wasm_hash"))

COMMON_COLS = ("id", "transaction_hash", "ledger_sequence", "created_at", "emitter_contract_id")


def normalize_events(events: DataFrame, keep_operation_body: bool = True) -> DataFrame:
    """Raw backup rows: coarse filter, then rename and extract ``event_name``.
    ``operation_body`` is kept so deploy details can be served from the backup."""
    cols = [F.col("id"), F.col("transaction_hash"), F.col("ledger_sequence"),
            F.col("ledger_closed_at").alias("created_at"), F.col("event_name"),
            F.col("contract_id").alias("emitter_contract_id"), F.col("data"), F.col("topics")]
    if keep_operation_body:
        cols.append(F.col("operation_body"))
    return registry_candidates(events).select(*cols)


def decode_event(raw: DataFrame, event_name: str, with_emitter: bool = True) -> DataFrame:
    """Typed rows of one event kind from normalised rows (the pipeline's CASE banks)."""
    spec, max_pos = STREAM_DECODERS[event_name]
    common = list(COMMON_COLS if with_emitter else COMMON_COLS[:4])
    branch = raw.where(F.col("event_name") == F.lit(event_name))
    parsed = branch.select(*common, parse_pairs("data").alias("_pairs"))
    return parsed.select(*common, *decode_pairs(F.col("_pairs"), spec, max_pos))


def decode_sub_reg(raw: DataFrame, root_registry: str) -> DataFrame:
    """sub_reg events announced by the root registry: (id, tx, seq, created_at, contract_id,
    registry_channel)."""
    rooted = raw.where(F.col("emitter_contract_id") == F.lit(root_registry))
    return decode_event(rooted, "sub_reg", with_emitter=False)


def decode_batch(events: DataFrame, event_name: str) -> DataFrame:
    """Batch-ingest decoders over the stored event rows (id, type, topics, data, ...): every payload
    position is scanned, the last entry with a key wins, and a key that never occurs gives ''."""
    spec = {"deploy": DEPLOY_BATCH_SPEC, "publish": PUBLISH_BATCH_SPEC}[event_name]
    base = with_topic_name(events.select("id", "transaction_hash", "ledger_sequence", "topics", "data"), "__event").where(
        F.col("__event") == F.lit(event_name))
    parsed = base.select("id", "transaction_hash", "ledger_sequence", parse_pairs("data").alias("_pairs"))
    return parsed.select("id", "transaction_hash", "ledger_sequence",
                         *decode_pairs(F.col("_pairs"), spec, None, pick="last", missing_default=""))


def wasm_uploads(entries: DataFrame) -> DataFrame:
    return filter_created(entries, "contract_code").select(
        "id", F.col("last_modified_ledger_sequence").alias("ledger_sequence"),
        F.col("ledger_closed_at").alias("closed_at"), "transaction_hash",
        json_scalar("entry_data", "$.contract_code.hash").alias("wasm_hash"))


def wasm_binary_rows(entries: DataFrame) -> DataFrame:
    """Bytecode rows keyed by content hash (before the keyed merge collapses re-uploads).
    ``id`` is kept only to order re-uploads of one hash."""
    v = parse_variant("entry_data")
    return (filter_created(entries, "contract_code")
            .select("id", "last_modified_ledger_sequence", "ledger_closed_at", "entry_data", v.alias("_v"))
            .select(json_scalar("entry_data", "$.contract_code.hash", F.col("_v")).alias("wasm_hash"),
                    json_scalar("entry_data", "$.contract_code.code", F.col("_v")).alias("wasm"),
                    F.col("last_modified_ledger_sequence").alias("ledger_sequence"),
                    F.col("ledger_closed_at").alias("closed_at"), "id"))


def contract_deploys(entries: DataFrame) -> DataFrame:
    """Contract instances created in ledger entries; wasm_hash is NULL for asset contracts."""
    base = computed_once(filter_created(entries, "contract_data").select(
        "id", "last_modified_ledger_sequence", "ledger_closed_at", "transaction_hash", "entry_data"), _v=parse_variant("entry_data"))
    return (base.where(json_scalar("entry_data", "$.contract_data.key", F.col("_v")) == F.lit("ledger_key_contract_instance"))
            .select("id", F.col("last_modified_ledger_sequence").alias("ledger_sequence"),
                    F.col("ledger_closed_at").alias("closed_at"), "transaction_hash",
                    json_scalar("entry_data", "$.contract_data.contract", F.col("_v")).alias("contract_id"),
                    json_scalar("entry_data", "$.contract_data.val.contract_instance.executable.wasm", F.col("_v"))
                    .alias("wasm_hash")))


def upgrade_events(events: DataFrame) -> DataFrame:
    """executable_update system events: old/new executable kind and hash."""
    base = filter_system(events).withColumnRenamed("__topics", "_v")
    return base.select(
        "id", "transaction_hash", "ledger_sequence", F.col("ledger_closed_at").alias("created_at"),
        F.col("contract_id").alias("upgraded_contract_id"),
        json_scalar("topics", "$[1].vec[0].symbol", F.col("_v")).alias("old_executable_kind"),
        json_scalar("topics", "$[1].vec[1].bytes", F.col("_v")).alias("old_wasm_hash"),
        json_scalar("topics", "$[2].vec[0].symbol", F.col("_v")).alias("new_executable_kind"),
        json_scalar("topics", "$[2].vec[1].bytes", F.col("_v")).alias("new_wasm_hash"))


def json_passthrough(df: DataFrame, col: str) -> DataFrame:
    """Re-parse a JSON text column. Rows whose text is not valid JSON are flagged (``<col>_valid``
    false) instead of failing the whole job; NULL text stays NULL and valid."""
    parsed = F.try_parse_json(F.col(col))
    return df.withColumn(f"{col}_valid", F.col(col).isNull() | parsed.isNotNull())


def sub_document(text_col: str, path: str) -> Column:
    """A sub-document as compact JSON text (objects included)."""
    return F.get_json_object(F.col(text_col), path)


# Metadata keys surfaced for a published binary.
META_KEYS = ("rsver", "rssdkver", "rssdk_spec_shaking", "cliver", "source_repo", "binver")


def payload_entries(col: str = "data") -> Column:
    """A payload's entries in their order as (key, val): val is the text of the first tag that holds a scalar."""
    return F.transform(parse_pairs(col), lambda p: F.struct(p["k"].alias("key"), F.coalesce(*[p[t] for t in VALUE_TAGS]).alias("val")))


def meta_fold(entries: DataFrame, entries_col: str = "entries", keys=META_KEYS) -> DataFrame:
    """Fold a list of (key, val) entries into the named metadata fields; a later duplicate key
    wins and unknown keys are dropped."""
    e = F.col(entries_col)

    def last_value(key: str):
        # F.filter treats a two-argument lambda as (element, index): bind the key by closure
        return F.try_element_at(F.filter(e, lambda x: x["key"] == F.lit(key)), F.lit(-1))["val"].alias(key)

    fields = [last_value(k) for k in keys]
    others = [c for c in entries.columns if c != entries_col]
    return entries.select(*others, *fields)
