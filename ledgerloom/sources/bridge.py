"""Fixture bridge: derive the two chain change streams from the driver's star tables.

``chain_events`` is derived from ``events`` and ``ledger_entries`` from ``orders`` (FIXTURES.md §3).
The expressions are kept once, as SQL expression text: Spark applies them stage by stage with
``selectExpr`` (a plain projection pipeline, no temp views), and the oracle renders the same text
as nested SELECTs for DuckDB. Both engines therefore see identical fixture rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

ROOT_REGISTRY_SEED = "registry0"


def root_registry() -> str:
    """Root registry id of the fixture: 'C' + upper(md5('registry0'))."""
    return "C" + hashlib.md5(ROOT_REGISTRY_SEED.encode()).hexdigest().upper()


_ROOT_SQL = "concat('C', upper(md5('registry0')))"

# The ledgers of the derived rows, as functions of the driver's rows.
EVENT_LEDGER = "1000 + CAST(floor(event_id / 5) AS BIGINT)"
ENTRY_LEDGER = "1000 + o_orderkey % 2000"

# Stage 1: base quantities per driver event.
EVENT_STAGE_B = [
    "event_id AS n", "user_id AS u", "ts",
    f"{EVENT_LEDGER} AS ledger",
    "(event_id * 7 + user_id) % 20 AS k",
    "concat(event_type, '-', CAST(user_id % 7 AS STRING)) AS nm",
    "CASE WHEN event_id % 29 = 0 THEN NULL "
    "ELSE concat(CAST(event_id % 3 AS STRING), '.', CAST(event_id % 12 AS STRING), '.', CAST(event_id % 4 AS STRING)) END AS ver",
    "md5(concat('wasm', CAST(event_id % 40 AS STRING))) AS whash",
    "concat('C', upper(md5(concat('contract', CAST(user_id AS STRING))))) AS cid",
    "concat('G', upper(md5(concat('acct', CAST(user_id % 30 AS STRING))))) AS acct",
]

# Stage 2: event kind, emitter and the shared payload entries.
EVENT_STAGE_E = [
    "*",
    "CASE WHEN k <= 4 THEN 'publish' WHEN k <= 8 THEN 'deploy' WHEN k <= 13 THEN 'register' "
    "WHEN k = 14 THEN 'rename' WHEN k = 15 THEN 'update_address' WHEN k = 16 THEN 'update_owner' "
    "WHEN k = 17 THEN 'sub_reg' WHEN k = 18 THEN 'transfer' ELSE 'executable_update' END AS sym",
    "CASE WHEN k = 19 THEN cid "
    f"WHEN k = 17 AND n % 4 <> 0 THEN {_ROOT_SQL} "
    "ELSE concat('C', upper(md5(concat('registry', CAST(u % 16 AS STRING))))) END AS emitter",
    "concat('{\"key\":{\"symbol\":\"wasm_name\"},\"val\":{\"string\":\"', nm, '\"}}') AS p_name",
    "CASE WHEN ver IS NULL THEN '{\"key\":{\"symbol\":\"memo\"},\"val\":{\"string\":\"none\"}}' "
    "ELSE concat('{\"key\":{\"symbol\":\"version\"},\"val\":{\"string\":\"', ver, '\"}}') END AS p_ver",
]

# Stage 3: the two halves of each payload.
EVENT_STAGE_D = [
    "*",
    "CASE sym "
    "WHEN 'publish' THEN concat('{\"key\":{\"symbol\":\"author\"},\"val\":{\"address\":\"', acct, '\"}}') "
    "WHEN 'deploy' THEN concat('{\"key\":{\"symbol\":\"contract_id\"},\"val\":{\"address\":\"', cid, '\"}},"
    "{\"key\":{\"symbol\":\"deployer\"},\"val\":{\"address\":\"', acct, '\"}},"
    "{\"key\":{\"symbol\":\"registry\"},\"val\":{\"address\":\"', emitter, '\"}}') "
    "WHEN 'register' THEN concat('{\"key\":{\"symbol\":\"contract_id\"},\"val\":{\"address\":\"', cid, '\"}},"
    "{\"key\":{\"symbol\":\"contract_name\"},\"val\":{\"string\":\"', nm, '\"}}') "
    "WHEN 'rename' THEN concat('{\"key\":{\"symbol\":\"old_name\"},\"val\":{\"string\":\"', nm, '\"}}') "
    "WHEN 'sub_reg' THEN concat('{\"key\":{\"symbol\":\"contract_id\"},\"val\":{\"address\":\"', "
    "concat('C', upper(md5(concat('registry', CAST(n % 13 AS STRING))))), '\"}}') "
    "ELSE concat('{\"key\":{\"symbol\":\"contract_name\"},\"val\":{\"string\":\"', nm, '\"}}') END AS a1",
    "CASE sym "
    "WHEN 'publish' THEN concat(p_ver, ',{\"key\":{\"symbol\":\"wasm_hash\"},\"val\":{\"bytes\":\"', whash, '\"}},', p_name) "
    "WHEN 'deploy' THEN concat(p_ver, ',', p_name) "
    "WHEN 'register' THEN concat('{\"key\":{\"symbol\":\"sac\"},\"val\":{\"bool\":', "
    "CASE WHEN u % 11 = 0 THEN 'true' ELSE 'false' END, '}},{\"key\":{\"symbol\":\"wasm_hash\"},\"val\":{\"bytes\":\"', whash, '\"}}') "
    "WHEN 'rename' THEN concat('{\"key\":{\"symbol\":\"new_name\"},\"val\":{\"string\":\"', nm, '-new\"}}') "
    "WHEN 'update_owner' THEN concat('{\"key\":{\"symbol\":\"new_owner\"},\"val\":{\"address\":\"', acct, '\"}}') "
    "WHEN 'sub_reg' THEN concat('{\"key\":{\"symbol\":\"name\"},\"val\":{\"string\":\"', "
    "CASE WHEN n % 13 = 0 THEN 'root' WHEN n % 13 = 1 THEN 'unverified' ELSE concat('ch', CAST(n % 13 AS STRING)) END, '\"}}') "
    "ELSE concat('{\"key\":{\"symbol\":\"new_address\"},\"val\":{\"address\":\"', cid, '\"}}') END AS a2",
]

_TX = "md5(concat('tx', CAST(ledger AS STRING), '/', CAST(n % 2 AS STRING)))"

# Stage 4: the event rows.
EVENT_STAGE_OUT = [
    f"concat(CAST(ledger AS STRING), '-', {_TX}, '-op-', "
    "CASE WHEN n % 17 = 0 THEN 'none' ELSE CAST(n % 3 AS STRING) END, '-event-', CAST(n % 5 AS STRING)) AS id",
    "CASE WHEN sym = 'executable_update' THEN 'system' ELSE 'contract' END AS type",
    "CASE WHEN sym = 'executable_update' "
    "THEN concat('[{\"symbol\":\"executable_update\"},{\"vec\":[{\"symbol\":\"Wasm\"},{\"bytes\":\"', "
    "md5(concat('wasm', CAST((n + 1) % 50 AS STRING))), '\"}]},{\"vec\":[{\"symbol\":\"Wasm\"},{\"bytes\":\"', "
    "md5(concat('wasm', CAST(n % 50 AS STRING))), '\"}]}]') "
    "ELSE concat('[{\"symbol\":\"', sym, '\"}]') END AS topics",
    "CASE WHEN n % 2 = 0 THEN concat('{\"map\":[', a1, ',', a2, ']}') ELSE concat('{\"map\":[', a2, ',', a1, ']}') END AS data",
    "emitter AS contract_id",
    f"{_TX} AS transaction_hash",
    "ledger AS ledger_sequence", "ts AS ledger_closed_at",
    "n % 31 <> 0 AS in_successful_contract_call", "n % 37 <> 0 AS transaction_successful",
    "concat('{\"invoke_host_function\":{\"fn\":\"', sym, '\",\"n\":', CAST(n AS STRING), '}}') AS operation_body",
]

EVENT_STAGES = [EVENT_STAGE_B, EVENT_STAGE_E, EVENT_STAGE_D, EVENT_STAGE_OUT]

LEDGER_ENTRY_STAGE = [
    "concat(CAST(1000 + o_orderkey % 2000 AS STRING), '-', md5(concat('le', CAST(o_orderkey AS STRING)))) AS id",
    f"{ENTRY_LEDGER} AS last_modified_ledger_sequence",
    "o_orderdate AS ledger_closed_at",
    "md5(concat('letx', CAST(o_orderkey AS STRING))) AS transaction_hash",
    "CASE o_orderkey % 3 WHEN 0 THEN 'contract_code' WHEN 1 THEN 'contract_data' ELSE 'account' END AS ledger_entry_type",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'updated' ELSE 'created' END AS change_type",
    "CASE o_orderkey % 3 "
    "WHEN 0 THEN concat('{\"contract_code\":{\"hash\":\"', md5(concat('wasm', CAST(o_orderkey % 50 AS STRING))), "
    "'\",\"code\":\"0061736d01000000', md5(CAST(o_orderkey % 50 AS STRING)), '\"}}') "
    "WHEN 1 THEN concat('{\"contract_data\":{\"contract\":\"', concat('C', upper(md5(concat('contract', CAST(o_orderkey % 150 AS STRING))))), '\",\"key\":', "
    "CASE WHEN o_orderkey % 7 = 0 THEN '{\"symbol\":\"Counter\"}' ELSE '\"ledger_key_contract_instance\"' END, "
    "',\"val\":{\"contract_instance\":{\"executable\":', "
    "CASE WHEN o_orderkey % 11 = 0 THEN '\"stellar_asset\"' ELSE concat('{\"wasm\":\"', md5(concat('wasm', CAST(o_orderkey % 50 AS STRING))), '\"}') END, '}}}}') "
    "ELSE '{\"account\":{}}' END AS entry_data",
]


def chain_events(events: DataFrame, placed=lambda narrow: narrow) -> DataFrame:
    """Event stream rows derived from the driver's ``events`` table; ``placed`` may shuffle its narrow rows first."""
    df = placed(events.select("event_id", "user_id", "ts", "event_type"))
    for stage in EVENT_STAGES:
        df = df.selectExpr(*stage)
    return df


def ledger_entries(orders: DataFrame, placed=lambda narrow: narrow) -> DataFrame:
    """Ledger-entry change rows derived from the driver's ``orders`` table; ``placed`` may shuffle its narrow rows first."""
    return placed(orders.select("o_orderkey", "o_orderdate")).selectExpr(*LEDGER_ENTRY_STAGE)


def chain_events_sql(source: str = "events") -> str:
    sql = f"SELECT event_id, user_id, ts, event_type FROM {source}"
    for stage in EVENT_STAGES:
        sql = f"SELECT {', '.join(stage)} FROM ({sql}) s"
    return sql


def ledger_entries_sql(source: str = "orders") -> str:
    return f"SELECT {', '.join(LEDGER_ENTRY_STAGE)} FROM {source}"
