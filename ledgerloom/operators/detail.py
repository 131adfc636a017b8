"""Detail lookups for a DataFrame of requested keys (one key or millions, one join either way).

Results are flat records: a ``detail`` row per found key and one ``version`` row per history entry
(with its position), emitted once per history, instead of an array per key or a key x history
product; no key's history is gathered into a single row or task.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decode import sub_document
from .latest import latest_per_key, sequence_index

# Outcome labels of a deploy-detail lookup.
FOUND, NOT_FOUND, NO_DEPLOY_BODY = "found", "not_found", "no_deploy_body"
# What a lookup says of a key that it doesn't find ({column} stands for the requested value).
WASM_ERROR = "Wasm '{wasm_name}' not found"
WASM_VERSION_ERROR = "Wasm '{wasm_name}' version '{wasm_version}' not found"
CONTRACT_ERROR = "Contract '{contract_name}' not found"


def _keys(keys: DataFrame, cols: list[str]) -> DataFrame:
    return keys.select(*[F.col(c).alias(f"__req_{c}") for c in cols]).distinct()


def _lookup(details: DataFrame, keys: DataFrame, cols: list[str], error: str) -> DataFrame:
    """A row for every requested key: its values, ``status``, the ``error`` of a key not found, and the columns of its
    detail. ``details`` has at most one row a key. A key with a null in it is never found."""
    req = _keys(keys, cols)
    found = details.select(F.struct(*[F.col(c) for c in details.columns]).alias("__detail"))
    cond = None
    for c in cols:
        e = F.col("__detail")[c] == F.col(f"__req_{c}")
        cond = e if cond is None else cond & e
    out = req.join(found, cond, "left")
    parts = [F.coalesce(F.col(f"__req_{p[1:-1]}"), F.lit("")) if p.startswith("{") else F.lit(p)
             for p in re.split(r"(\{\w+\})", error) if p]
    missing = F.col("__detail").isNull()
    return out.select(*[F.col(f"__req_{c}").alias(f"requested_{c}") for c in cols],
                      F.when(missing, F.lit(NOT_FOUND)).otherwise(F.lit(FOUND)).alias("status"),
                      F.when(missing, F.concat(*parts)).alias("error"), "__detail.*")


DETAIL_COLS = ("id", "transaction_hash", "ledger_sequence", "created_at", "channel", "author", "wasm_version",
               "wasm_name", "wasm_hash")


def _wasm_details(source: DataFrame, keys: DataFrame, kcols: list[str]) -> DataFrame:
    """The newest matching row of each requested key."""
    req = _keys(keys, kcols)
    cond = None
    for c in kcols:
        e = source[c] == req[f"__req_{c}"]
        cond = e if cond is None else cond & e
    hit = source.join(req, cond, "left_semi").select(*DETAIL_COLS)
    return latest_per_key(hit, kcols, ("-ledger_sequence", "-id"))


def wasm_lookup(source: DataFrame, keys: DataFrame, version: bool = False) -> DataFrame:
    """Status, error and published detail of every requested (wasm_name, channel[, wasm_version]) key, found or not;
    ``source`` as in ``wasm_detail``. A found key's history is ``wasm_detail``'s."""
    kcols = ["wasm_name", "channel"] + (["wasm_version"] if version else [])
    return _lookup(_wasm_details(source, keys, kcols), keys, kcols, WASM_VERSION_ERROR if version else WASM_ERROR)


def contract_lookup(enriched: DataFrame, keys: DataFrame) -> DataFrame:
    """Status, error and newest enriched row of every requested (contract_name, channel) key, found or not. A found
    key's history is ``contract_detail``'s."""
    return _lookup(_contract_details(enriched, keys), keys, ["contract_name", "channel"], CONTRACT_ERROR)


def wasm_detail(source: DataFrame, published_with_channel: DataFrame, keys: DataFrame,
                version: bool = False) -> DataFrame:
    """Published detail for requested (wasm_name, channel[, wasm_version]) keys.

    ``source`` is the latest view (latest detail) or the channel view (a given version). Output
    records: ``record='detail'`` (one per found key; with several matches the newest wins) and
    ``record='version'`` (each publish of a found (name, channel), ``pos`` from 0 in ledger DESC,
    version DESC order; emitted once per (name, channel), not once per requested key)."""
    kcols = ["wasm_name", "channel"] + (["wasm_version"] if version else [])
    detail = _wasm_details(source, keys, kcols)
    found = detail.select(F.col("wasm_name").alias("__f_name"), F.col("channel").alias("__f_channel")).distinct()
    v = published_with_channel.join(found, (published_with_channel["wasm_name"] == found["__f_name"])
                                    & (published_with_channel["channel"] == found["__f_channel"]), "left_semi")
    v = sequence_index(v, ["wasm_name", "channel"], "ledger_sequence", ("-wasm_version", "-id"), out="pos",
                       major_desc=True)
    null_s = F.lit(None).cast("string")
    vrec = v.select(F.lit("version").alias("record"), "pos",
                    null_s.alias("id"), null_s.alias("transaction_hash"),
                    F.lit(None).cast("bigint").alias("ledger_sequence"),
                    F.lit(None).cast("timestamp_ntz").alias("created_at"),
                    "channel", "author", "wasm_version", "wasm_name", "wasm_hash")
    drec = detail.select(F.lit("detail").alias("record"), F.lit(0).cast("bigint").alias("pos"), *DETAIL_COLS)
    return drec.unionByName(vrec)


def _contract_details(enriched: DataFrame, keys: DataFrame) -> DataFrame:
    req = _keys(keys, ["contract_name", "channel"])
    hit = enriched.join(req, (enriched["contract_name"] == req["__req_contract_name"])
                        & (enriched["channel"] == req["__req_channel"]), "left_semi")
    return latest_per_key(hit, ["contract_name", "channel"], ("-ledger_sequence", "-id"))


def contract_detail(enriched: DataFrame, versions_df: DataFrame, keys: DataFrame) -> DataFrame:
    """Newest enriched row per requested (contract_name, channel) (``record='detail'``) and the
    version history of each found contract id, once per id (``record='version'``)."""
    top = _contract_details(enriched, keys)
    ids = top.where(F.col("contract_id").isNotNull()).select(F.col("contract_id").alias("__cid")).distinct()
    h = versions_df.join(ids, versions_df["contract_id"] == ids["__cid"], "left_semi")
    null_s = F.lit(None).cast("string")
    drec = top.select(F.lit("detail").alias("record"), "id", "transaction_hash", "ledger_sequence", "created_at",
                      "contract_id", "contract_name", "channel", "sac", "deployer", "wasm_version", "wasm_name",
                      "wasm_channel", F.lit(None).cast("bigint").alias("version_index"), null_s.alias("kind"),
                      null_s.alias("wasm_hash"))
    hrec = h.select(F.lit("version").alias("record"), null_s.alias("id"), "transaction_hash", "ledger_sequence",
                    "created_at", "contract_id", null_s.alias("contract_name"), null_s.alias("channel"),
                    F.lit(None).cast("boolean").alias("sac"), null_s.alias("deployer"), "wasm_version", "wasm_name",
                    "wasm_channel", "version_index", "kind", "wasm_hash")
    return drec.unionByName(hrec)


def deploy_detail(registered_with_channel: DataFrame, deployed: DataFrame, raw: DataFrame,
                  keys: DataFrame) -> DataFrame:
    """Deploy body of the newest registration per requested (contract_name, channel).

    Registration -> newest deploy event of that contract -> the raw deploy event of the same
    transaction (greatest id). ``status`` is found / not_found / no_deploy_body; requested keys
    without a registration are returned with status not_found."""
    req = _keys(keys, ["contract_name", "channel"])
    r = registered_with_channel.join(req, (registered_with_channel["contract_name"] == req["__req_contract_name"])
                                     & (registered_with_channel["channel"] == req["__req_channel"]), "left_semi")
    r = latest_per_key(r, ["contract_name", "channel"], ("-ledger_sequence", "-id")).select(
        "contract_id", "contract_name", "channel")
    d = latest_per_key(deployed.select("contract_id", "deployer", "transaction_hash", "ledger_sequence", "id"),
                       ["contract_id"], ("-ledger_sequence", "-id"))
    d = d.select(F.col("contract_id").alias("__d_cid"), "deployer", F.col("transaction_hash").alias("__d_tx"))
    body = latest_per_key(raw.where(F.col("event_name") == "deploy")
                          .select("transaction_hash", "operation_body", "id"), ["transaction_hash"], ("-id",))
    body = body.select(F.col("transaction_hash").alias("__b_tx"), "operation_body")
    joined = (r.join(d, r["contract_id"] == d["__d_cid"], "left")
              .join(body, F.col("__d_tx") == body["__b_tx"], "left"))
    found = joined.select("contract_id", "contract_name", "channel", "deployer", "operation_body")
    out = req.join(found, (req["__req_contract_name"] == found["contract_name"])
                   & (req["__req_channel"] == found["channel"]), "left")
    status = (F.when(F.col("contract_name").isNull(), F.lit(NOT_FOUND))
              .when(F.col("operation_body").isNull(), F.lit(NO_DEPLOY_BODY)).otherwise(F.lit(FOUND)))
    return out.select(F.col("__req_contract_name").alias("requested_name"),
                      F.col("__req_channel").alias("requested_channel"),
                      "contract_id", "contract_name", "channel", "deployer", "operation_body",
                      status.alias("status"))


def replay_plan(contract_list: DataFrame, registered_with_channel: DataFrame, deployed: DataFrame,
                raw: DataFrame, channel: str = "root") -> DataFrame:
    """For every contract list row in ``channel``: the host-function call of its deploy, ready to be
    re-submitted (one row per list row, as the replay walks the list)."""
    rows = contract_list.where(F.col("channel") == F.lit(channel)).select(
        F.col("id").alias("list_id"), F.col("contract_name").alias("__name"), F.col("channel").alias("__ch"))
    keys = rows.select(F.col("__name").alias("contract_name"), F.col("__ch").alias("channel"))
    det = deploy_detail(registered_with_channel, deployed, raw, keys).where(F.col("status") == FOUND)
    det = det.select(F.col("requested_name").alias("__dn"), F.col("requested_channel").alias("__dc"),
                     sub_document("operation_body", "$.invoke_host_function").alias("invoke_host_function"))
    out = rows.join(det, (rows["__name"] == det["__dn"]) & (rows["__ch"] == det["__dc"]))
    return out.select("list_id", F.col("__name").alias("contract_name"), "invoke_host_function")


def list_registries(registries: DataFrame) -> DataFrame:
    return registries.select("contract_id", F.col("registry_channel").alias("channel"), "ledger_sequence",
                             "created_at").orderBy(F.col("channel").asc_nulls_last())
