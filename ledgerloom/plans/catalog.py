"""Registered queries: name -> (Spark query(spark, sf_dir), DuckDB oracle SQL or None).

Every query reads the driver tables of ``sf_dir`` (through the fixture bridge) and runs over the
whole tables. Parameters (start ledgers, cursors, search terms, page sizes) are fixed arguments of
the operators, as a caller of the service would pass them.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonpath import VALUE_TAGS, json_scalar
from ..functions.trigram import similarity
from ..operators import audit as A
from ..operators import decode as D
from ..operators import detail as DT
from ..operators import filters as FL
from ..operators import paging as P
from ..operators import search as S
from ..operators.event_log import data_files, stored_bytes
from ..operators.gate import route_counts
from ..operators.latest import latest_per_key
from ..operators.views import legacy_published
from ..session import state_dir
from ..sources import bridge, readers
from ..sources.fixture import events_path, fixture_paths
from ..streaming.archive import ArchiveIngest
from ..streaming.ingest import RegistryIngest, write_stream_files
from . import oracle as O
from .tables import RegistryTables

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}

ROOT = bridge.root_registry()
START_AT = 2000            # start ledger of the scans (inclusive)
LATEST_AS_OF = 2500        # stream end recorded when a "latest" job started
SEARCH_TERM = "click"
PAGE_CURSOR = "1500-0a-op-1-event-0"
EXPORT_PAGE = 50
NEXT_PAGE = 10


def query(name: str, oracle: str | None):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def _t(spark: SparkSession, sf_dir: str) -> RegistryTables:
    return RegistryTables.from_fixture(spark, sf_dir)


_STORES: dict = {}


def _s(spark: SparkSession, sf_dir: str) -> RegistryTables:
    """The stored tables: both streaming jobs run once over a folder's streams in a session, then the tables are read."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        events, entries = fixture_paths(spark, sf_dir)
        root = state_dir(spark, "store")
        RegistryIngest(spark, root, ROOT).run(events, f"{root}/_checkpoint")
        ArchiveIngest(spark, f"{root}/archive").run(entries, events, f"{root}/archive/_checkpoints")
        _STORES[key] = root
    return RegistryTables.from_store(spark, _STORES[key], ROOT)


def _batch_events(t: RegistryTables) -> DataFrame:
    """The minimal pipeline's sink: one emitter, successful rows (input of the batch ingest)."""
    ev = FL.filter_successful(FL.filter_emitter(t.chain_events, t.root_registry))
    return ev.select("id", "type", "topics", "data", "transaction_hash", "in_successful_contract_call",
                     "transaction_successful", "ledger_sequence", "ledger_closed_at")


W = O.with_ctes
#: Read over the stored tables, as are lists, search, details, the audit and what is exported of them; decoders and sinks
#: start from the streams.
VIEWS = ("published_with_channel", "registered_with_channel", "latest_published", "wasm_versions", "versions", "contracts", "contracts_enriched")
EV_COLS = ("id, type, topics, data, contract_id, transaction_hash, ledger_sequence, ledger_closed_at, "
           "in_successful_contract_call, transaction_successful, operation_body")

# ---- sources --------------------------------------------------------------------------------


@query("scan_events_from", W(f"SELECT {EV_COLS} FROM chain_events WHERE ledger_sequence >= {START_AT}",
                             "chain_events"))
def q_scan_events_from(spark, sf):
    return readers.scan_from(_t(spark, sf).chain_events, START_AT)


@query("scan_ledger_entries", W(f"SELECT * FROM ledger_entries WHERE last_modified_ledger_sequence >= {START_AT}",
                                "ledger_entries"))
def q_scan_ledger_entries(spark, sf):
    return readers.scan_from(_t(spark, sf).ledger_entries, START_AT, "last_modified_ledger_sequence")


@query("scan_latest_only", W(f"SELECT {EV_COLS} FROM chain_events WHERE ledger_sequence > (SELECT coalesce(max(ledger_sequence), 0) "
                             f"FROM chain_events WHERE ledger_sequence <= {LATEST_AS_OF})", "chain_events"))
def q_scan_latest_only(spark, sf):
    """A job that began when the stream ended at ``LATEST_AS_OF``, restarted: it goes by the end that it recorded then."""
    ev, state = _t(spark, sf).chain_events, state_dir(spark, "latest-job")
    readers.recorded_end(ev.where(F.col("ledger_sequence") <= LATEST_AS_OF), state)
    return readers.scan_latest_only(ev, readers.recorded_end(ev, state))


@query("high_water", W("SELECT CAST(coalesce(max(d.ledger_sequence), 0) AS BIGINT) AS deploys, "
                       "CAST((SELECT coalesce(max(ledger_sequence), 0) FROM batch_publishes) AS BIGINT) AS publishes, "
                       "CAST(least(coalesce(max(d.ledger_sequence), 0), "
                       "(SELECT coalesce(max(ledger_sequence), 0) FROM batch_publishes)) AS BIGINT) AS read_from "
                       "FROM batch_deploys d", "batch_deploys", "batch_publishes"))
def q_high_water(spark, sf):
    t = _t(spark, sf)
    be = _batch_events(t)
    return readers.high_waters({"deploys": D.decode_batch(be, "deploy"), "publishes": D.decode_batch(be, "publish")})


LAG_AT = 1500   # the publish target lags behind (e.g. it was dropped and is being re-filled)


@query("incremental_batch", W(
    "SELECT b.id, b.ledger_sequence, b.target, b.read_bound, CAST(greatest(b.read_bound, s.mx) + "
    "CASE WHEN s.n < 5000 THEN 1 ELSE 0 END AS BIGINT) AS next_high_water FROM ("
    "SELECT e.id, e.ledger_sequence, CASE e.event_name WHEN 'deploy' THEN 'deploys' ELSE 'publishes' END AS target, "
    "CASE e.event_name WHEN 'deploy' THEN h.d ELSE h.p END AS read_bound FROM batch e, hw h "
    "WHERE e.event_name IN ('deploy', 'publish') AND e.ledger_sequence >= "
    "CASE e.event_name WHEN 'deploy' THEN h.d ELSE h.p END) b, "
    "(SELECT coalesce(max(ledger_sequence), 0) AS mx, count(*) AS n FROM batch) s",
    "batch_deploys", "batch_publishes", "batch_events").replace(
    "\nSELECT b.id",
    ", hw AS (SELECT (SELECT coalesce(max(ledger_sequence), 0) FROM batch_deploys WHERE ledger_sequence < "
    f"{START_AT}) AS d, (SELECT coalesce(max(ledger_sequence), 0) FROM batch_publishes WHERE ledger_sequence < "
    f"{LAG_AT}) AS p), batch AS (SELECT id, ledger_sequence, "
    f"{O.sql_json_scalar('topics', '$[0].symbol')} AS event_name FROM batch_events "
    "WHERE ledger_sequence >= (SELECT least(d, p) FROM hw) ORDER BY ledger_sequence, id LIMIT 5000)\nSELECT b.id", 1))
def q_incremental_batch(spark, sf):
    """One run of the batch ingest against targets loaded up to different ledgers: one shared read of
    5,000 events from the lower high water, each target keeping rows from its own inclusive bound."""
    t = _t(spark, sf)
    be = _batch_events(t)
    deploys = D.decode_batch(be, "deploy").where(F.col("ledger_sequence") < START_AT)
    publishes = D.decode_batch(be, "publish").where(F.col("ledger_sequence") < LAG_AT)
    return readers.incremental_step(be, {"deploys": ("deploy", deploys), "publishes": ("publish", publishes)},
                                    5000, FL.topic_name())


CATCH_UP_LIMIT = 500


@query("incremental_catch_up", W(
    "SELECT id, ledger_sequence, CASE event_name WHEN 'deploy' THEN 'deploys' ELSE 'publishes' END AS target, "
    f"CAST((place - 1) // {CATCH_UP_LIMIT} AS INTEGER) AS run FROM (SELECT id, ledger_sequence, event_name, "
    "row_number() OVER (ORDER BY ledger_sequence, id) AS place FROM (SELECT id, ledger_sequence, "
    f"{O.sql_json_scalar('topics', '$[0].symbol')} AS event_name FROM batch_events) e, hw WHERE ledger_sequence > least(d.seq, p.seq) "
    "OR (ledger_sequence = least(d.seq, p.seq) AND id > least(d, p).id)) x, hw WHERE (event_name = 'deploy' AND (ledger_sequence > d.seq "
    "OR (ledger_sequence = d.seq AND id > d.id))) OR (event_name = 'publish' AND (ledger_sequence > p.seq OR (ledger_sequence = p.seq AND id > p.id)))",
    "batch_deploys", "batch_publishes", "batch_events").replace("\nSELECT id, ledger_sequence, CASE",
    ", hw AS (SELECT coalesce((SELECT max({'seq': ledger_sequence, 'id': id}) FROM batch_deploys WHERE ledger_sequence < " f"{START_AT}), "
    "{'seq': 0, 'id': ''}) AS d, coalesce((SELECT max({'seq': ledger_sequence, 'id': id}) FROM batch_publishes WHERE ledger_sequence < "
    f"{LAG_AT}), " "{'seq': 0, 'id': ''}) AS p)\nSELECT id, ledger_sequence, CASE", 1))
def q_incremental_catch_up(spark, sf):
    """Every run of the batch ingest until the stream's end, 500 events a run, from targets loaded up to different ledgers."""
    be = _batch_events(_t(spark, sf))
    deploys = D.decode_batch(be, "deploy").where(F.col("ledger_sequence") < START_AT)
    publishes = D.decode_batch(be, "publish").where(F.col("ledger_sequence") < LAG_AT)
    return readers.incremental_reads(be, {"deploys": ("deploy", deploys), "publishes": ("publish", publishes)}, CATCH_UP_LIMIT,
                                     FL.topic_name(), state_dir(spark, "catch-up"))


# ---- filters ----------------------------------------------------------------------------------

@query("filter_successful", W("SELECT id, ledger_sequence FROM chain_events WHERE in_successful_contract_call = true "
                              "AND transaction_successful = true", "chain_events"))
def q_filter_successful(spark, sf):
    return FL.filter_successful(_t(spark, sf).chain_events).select("id", "ledger_sequence")


@query("filter_not_like", W("SELECT id, ledger_sequence FROM chain_events WHERE id NOT LIKE '%-op-none-%'",
                            "chain_events"))
def q_filter_not_like(spark, sf):
    return FL.filter_not_like(_t(spark, sf).chain_events).select("id", "ledger_sequence")


@query("filter_topic_in", W(f"SELECT id, {O.sql_json_scalar('topics', '$[0].symbol')} AS event_name FROM chain_events "
                            f"WHERE {O.sql_json_scalar('topics', '$[0].symbol')} IN "
                            "('deploy','publish','register','rename','update_address','update_owner','sub_reg')",
                            "chain_events"))
def q_filter_topic_in(spark, sf):
    return FL.filter_topic_in(_t(spark, sf).chain_events).select("id", FL.topic_name().alias("event_name"))


@query("filter_emitter", W("SELECT * FROM batch_events", "batch_events"))
def q_filter_emitter(spark, sf):
    return _batch_events(_t(spark, sf))


@query("filter_system", W("SELECT id, upgraded_contract_id FROM upgrades", "upgrades"))
def q_filter_system(spark, sf):
    ev = _t(spark, sf).chain_events
    return FL.filter_system(ev).select("id", F.col("contract_id").alias("upgraded_contract_id"))


@query("filter_created", W("SELECT id, ledger_entry_type FROM ledger_entries WHERE change_type = 'created' "
                           "AND ledger_entry_type IN ('contract_code', 'contract_data')", "ledger_entries"))
def q_filter_created(spark, sf):
    le = _t(spark, sf).ledger_entries
    return FL.filter_created(le, "contract_code").unionByName(FL.filter_created(le, "contract_data")) \
        .select("id", "ledger_entry_type")


@query("route_counts", W("SELECT event_name, count(*) AS n_events FROM gated GROUP BY event_name", "gated"))
def q_route_counts(spark, sf):
    return route_counts(_t(spark, sf).gated)


# ---- projections and decoders --------------------------------------------------------------------

@query("normalize_events", W("SELECT * FROM raw", "raw"))
def q_normalize_events(spark, sf):
    return _t(spark, sf).raw


@query("decode_sub_reg", W("SELECT * FROM sub_reg", "sub_reg"))
def q_decode_sub_reg(spark, sf):
    return _t(spark, sf).sub_reg


for _name, _attr, _cte in [("decode_deploy", "deployed", "deployed"), ("decode_publish", "published", "published"),
                           ("decode_register", "registered", "registered"), ("decode_rename", "renamed", "renamed"),
                           ("decode_update_address", "address_updates", "address_updates"),
                           ("decode_update_owner", "owner_updates", "owner_updates"),
                           ("wasm_uploads", "uploads", "uploads"), ("wasm_binaries", "wasm_binaries", "wasm_binaries"),
                           ("contract_deploys", "deploys", "deploys"), ("upgrade_events", "upgrades", "upgrades"),
                           ("registries", "registries", "registries"),
                           ("published_with_channel", "published_with_channel", "published_with_channel"),
                           ("registered_with_channel", "registered_with_channel", "registered_with_channel"),
                           ("latest_published", "latest_published", "latest_published"),
                           ("wasm_versions", "wasm_versions", "wasm_versions"),
                           ("versions", "versions", "versions"), ("contracts", "contracts", "contracts"),
                           ("contracts_enriched", "contracts_enriched", "contracts_enriched")]:
    query(_name, W(f"SELECT * FROM {_cte}", _cte))(
        (lambda attr, of: (lambda spark, sf: getattr(of(spark, sf), attr)))(_attr, _s if _attr in VIEWS else _t))


@query("membership_table", W("SELECT DISTINCT contract_id FROM sub_reg WHERE contract_id IS NOT NULL", "sub_reg"))
def q_membership_table(spark, sf):
    return _t(spark, sf).members


@query("membership_gate", W("SELECT id, event_name, emitter_contract_id FROM gated", "gated"))
def q_membership_gate(spark, sf):
    return _t(spark, sf).gated.select("id", "event_name", "emitter_contract_id")


@query("decode_deploy_batch", W("SELECT * FROM batch_deploys", "batch_deploys"))
def q_decode_deploy_batch(spark, sf):
    return D.decode_batch(_batch_events(_t(spark, sf)), "deploy")


@query("decode_publish_batch", W("SELECT * FROM batch_publishes", "batch_publishes"))
def q_decode_publish_batch(spark, sf):
    return D.decode_batch(_batch_events(_t(spark, sf)), "publish")


@query("json_passthrough", W("SELECT id, operation_body, coalesce(json_valid(operation_body), true) AS "
                             "operation_body_valid FROM raw",
                             "raw"))
def q_json_passthrough(spark, sf):
    return D.json_passthrough(_t(spark, sf).raw.select("id", "operation_body"), "operation_body")


FOLD_KEYS = ("wasm_name", "version", "author", "contract_id", "contract_name")


def _fold_sql(key: str) -> str:
    """The text of the last entry with the key."""
    hits = (f"list_filter(entries, lambda e: (CASE WHEN json_type(e, '$.key.symbol') NOT IN ('OBJECT','ARRAY') "
            f"THEN json_extract_string(e, '$.key.symbol') END) = '{key}')[-1]")
    tags = ", ".join(f"CASE WHEN json_type({hits}, '$.val.{t}') NOT IN ('OBJECT','ARRAY') THEN json_extract_string({hits}, '$.val.{t}') END"
                     for t in VALUE_TAGS)
    return f"coalesce({tags}) AS {key}"


@query("meta_fold", W(f"SELECT id, event_name, {', '.join(map(_fold_sql, FOLD_KEYS))} FROM (SELECT *, CAST(json_extract(data, '$.map[*]') AS VARCHAR[]) "
                      "AS entries FROM raw) s", "raw"))
def q_meta_fold(spark, sf):
    """The (key, val) entries of every payload folded into fields: the last of a key wins, others are dropped."""
    rows = _t(spark, sf).raw.select("id", "event_name", D.payload_entries("data").alias("entries"))
    return D.meta_fold(rows, "entries", FOLD_KEYS)


@query("json_scalar", W(f"SELECT id, {O.sql_json_scalar('topics', '$[0].symbol')} AS topic0, "
                        f"{O.sql_json_scalar('topics', '$[1].vec')} AS topic1_vec, "
                        f"{O.sql_json_scalar('topics', '$[2].vec[1].bytes')} AS new_hash FROM chain_events",
                        "chain_events"))
def q_json_scalar(spark, sf):
    ev = _t(spark, sf).chain_events
    v = F.try_parse_json("topics")
    return ev.select("id", "topics", v.alias("_v")).select(
        "id", json_scalar("topics", "$[0].symbol", F.col("_v")).alias("topic0"),
        json_scalar("topics", "$[1].vec", F.col("_v")).alias("topic1_vec"),
        json_scalar("topics", "$[2].vec[1].bytes", F.col("_v")).alias("new_hash"))


@query("g_json_scalar", "SELECT event_id, CASE WHEN json_type(props, '$.k') NOT IN ('OBJECT', 'ARRAY') "
                        "THEN json_extract_string(props, '$.k') END AS k FROM events")
def q_g_json_scalar(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    return ev.select("event_id", json_scalar("props", "$.k").alias("k"))


@query("decode_hex", W("SELECT wasm_hash, CAST(octet_length(unhex(wasm)) AS BIGINT) AS n_bytes, "
                       "lower(hex(unhex(wasm))) = lower(wasm) AS roundtrip FROM wasm_binaries", "wasm_binaries"))
def q_decode_hex(spark, sf):
    b = _t(spark, sf).wasm_binaries
    raw = F.try_to_binary(F.col("wasm"), F.lit("hex"))
    return b.select("wasm_hash", F.octet_length(raw).cast("bigint").alias("n_bytes"),
                    (F.lower(F.hex(raw)) == F.lower(F.col("wasm"))).alias("roundtrip"))


# ---- views, windows, joins ------------------------------------------------------------------------

@query("legacy_published", W("SELECT id, transaction_hash, ledger_sequence, author, version, wasm_name, wasm_hash "
                             "FROM (SELECT *, row_number() OVER (PARTITION BY wasm_name ORDER BY ledger_sequence ASC, "
                             "version DESC NULLS FIRST, id DESC) AS rn FROM batch_publishes) s WHERE rn = 1",
                             "batch_publishes"))
def q_legacy_published(spark, sf):
    pubs = D.decode_batch(_batch_events(_t(spark, sf)), "publish")
    return legacy_published(pubs).select("id", "transaction_hash", "ledger_sequence", "author", "version",
                                         "wasm_name", "wasm_hash")


@query("latest_per_key", W("SELECT wasm_hash, wasm_name, wasm_version, emitter_contract_id, ledger_sequence, id FROM ("
                           "SELECT *, row_number() OVER (PARTITION BY wasm_hash ORDER BY ledger_sequence DESC, "
                           "id DESC) AS rn FROM published) s WHERE rn = 1", "published"))
def q_latest_per_key(spark, sf):
    from ..operators.views import latest_publish_per_hash
    return latest_publish_per_hash(_s(spark, sf).published)


@query("g_latest_per_key", "SELECT l_partkey, l_orderkey, l_linenumber, l_quantity, l_shipdate FROM ("
                           "SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC NULLS FIRST, "
                           "l_orderkey DESC NULLS FIRST, l_linenumber DESC NULLS FIRST) AS rn FROM lineitem) s "
                           "WHERE rn = 1")
def q_g_latest_per_key(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber",
                                                              "l_quantity", "l_shipdate")
    return latest_per_key(li, ["l_partkey"], ("-l_shipdate", "-l_orderkey", "-l_linenumber"))


# ---- audit --------------------------------------------------------------------------------------------

_AUDIT_SQL = ("SELECT raw.event_name, raw.emitter_contract_id, raw.ledger_sequence, raw.transaction_hash, raw.id "
              "FROM raw JOIN registries g ON g.contract_id = raw.emitter_contract_id "
              "WHERE NOT EXISTS (SELECT 1 FROM sink_ids s WHERE s.id = raw.id AND s.event_name = raw.event_name) "
              "ORDER BY raw.ledger_sequence, raw.event_name")


@query("audit_dropped", W(_AUDIT_SQL, "raw", "registries", "sink_ids"))
def q_audit_dropped(spark, sf):
    t = _s(spark, sf)
    return A.audit_dropped(t.raw, t.registries, t.sink_ids())


@query("audit_summary", W(
    "SELECT a.event_name, CASE WHEN a.event_name = 'sub_reg' AND a.emitter_contract_id <> '" + ROOT + "' "
    "THEN 'sub_reg_non_root' WHEN a.event_name = 'sub_reg' AND m.member IS NULL THEN 'sub_reg_without_member' "
    "WHEN a.event_name = 'sub_reg' AND EXISTS (SELECT 1 FROM registries s WHERE s.contract_id = m.member "
    "AND row(s.ledger_sequence, s.id) > row(a.ledger_sequence, a.id)) THEN 'sub_reg_superseded' ELSE 'dropped' END AS reason, "
    "count(*) AS n_rows, count(DISTINCT m.member) AS n_distinct_members FROM (" + _AUDIT_SQL + ") a "
    "LEFT JOIN (SELECT id, " + O.sql_case_bank("data", "contract_id", "address", 2) + " AS member FROM raw "
    "WHERE event_name = 'sub_reg') m ON m.id = a.id GROUP BY 1, 2", "raw", "registries", "sink_ids"))
def q_audit_summary(spark, sf):
    t = _s(spark, sf)
    return A.audit_summary(A.audit_dropped(t.raw, t.registries, t.sink_ids()), t.raw, t.registries, t.root_registry)


@query("g_anti_audit", "SELECT o_orderkey, o_orderstatus FROM orders o WHERE NOT EXISTS "
                       "(SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey)")
def q_g_anti_audit(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_orderstatus")
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey")
    return o.join(li, o["o_orderkey"] == li["l_orderkey"], "left_anti")


# ---- lists, search, pages ----------------------------------------------------------------------------

_SIM_NAME = O.similarity_sql("wasm_name", f"'{SEARCH_TERM}'")
_SIM_CHANNEL = O.similarity_sql("channel", f"'{SEARCH_TERM}'")
_RANK = (f"greatest(CAST({_SIM_NAME} AS DOUBLE), CAST({_SIM_CHANNEL} AS DOUBLE), "
         f"CASE WHEN wasm_hash = '{SEARCH_TERM}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, "
         f"CASE WHEN author = '{SEARCH_TERM}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)")


@query("search_published", W(
    f"SELECT id, author, wasm_version, wasm_name, wasm_hash, channel, round(rank, 6) AS rank FROM ("
    f"SELECT *, {_RANK} AS rank FROM latest_published WHERE "
    f"(CAST({_SIM_NAME} AS DOUBLE) > 0.2 OR wasm_hash = '{SEARCH_TERM}' OR author = '{SEARCH_TERM}' "
    f"OR CAST({_SIM_CHANNEL} AS DOUBLE) > 0.2)) s ORDER BY rank DESC, ledger_sequence, id LIMIT 200",
    "latest_published"))
def q_search_published(spark, sf):
    return S.search_published(_s(spark, sf).latest_published, SEARCH_TERM, 200, None)


@query("search_published_page", W(
    "SELECT id, author, wasm_version, wasm_name, wasm_hash, channel, CAST(0.0 AS DOUBLE) AS rank "
    "FROM latest_published WHERE ledger_sequence >= 1500 AND (ledger_sequence > 1500 OR id >= '" + PAGE_CURSOR +
    "-z') ORDER BY ledger_sequence, id LIMIT 10", "latest_published"))
def q_search_published_page(spark, sf):
    return S.search_published(_s(spark, sf).latest_published, None, 10, PAGE_CURSOR)


@query("trigram_similarity", W(
    f"SELECT id, wasm_name, channel, round(CAST({O.similarity_sql('wasm_name', 'channel')} AS DOUBLE), 6) AS name_channel, "
    f"round(CAST({_SIM_NAME} AS DOUBLE), 6) AS name_term FROM published_with_channel", "published_with_channel"))
def q_trigram_similarity(spark, sf):
    p = _s(spark, sf).published_with_channel
    return p.select("id", "wasm_name", "channel",
                    F.round(similarity("wasm_name", "channel").cast("double"), 6).alias("name_channel"),
                    F.round(similarity("wasm_name", F.lit(SEARCH_TERM)).cast("double"), 6).alias("name_term"))


_PART_SIM = O.similarity_sql("q.query", "n.name")


@query("g_similarity_join", (
    "WITH q AS (SELECT DISTINCT p_type AS query FROM part WHERE p_type IS NOT NULL), "
    "n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL) "
    f"SELECT q.query, n.name, round(CAST({_PART_SIM} AS DOUBLE), 6) AS similarity FROM q, n "
    f"WHERE CAST({_PART_SIM} AS DOUBLE) > 0.2"))
def q_g_similarity_join(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet")
    return S.similarity_join(part, "p_type", part, "p_name")


@query("similarity_join", W(
    f"SELECT * FROM (WITH q AS (SELECT DISTINCT contract_name AS query FROM registered "
    f"WHERE contract_name IS NOT NULL), "
    f"n AS (SELECT DISTINCT wasm_name AS name FROM published WHERE wasm_name IS NOT NULL) "
    f"SELECT q.query, n.name, round(CAST({_PART_SIM} AS DOUBLE), 6) AS similarity FROM q, n "
    f"WHERE CAST({_PART_SIM} AS DOUBLE) > 0.2) s", "registered", "published"))
def q_similarity_join(spark, sf):
    """Which published wasm names resemble each registered contract name."""
    t = _s(spark, sf)
    return S.similarity_join(t.registered, "contract_name", t.published, "wasm_name")


@query("list_contracts", W("SELECT id, contract_id, channel, contract_name, sac, deployer, wasm_version, wasm_name, "
                           "wasm_channel FROM contracts_enriched ORDER BY ledger_sequence, id LIMIT 200",
                           "contracts_enriched"))
def q_list_contracts(spark, sf):
    return P.list_contracts(_s(spark, sf).contracts_enriched, 200, None)


@query("keyset_page", W("SELECT id, ledger_sequence, event_name FROM raw WHERE ledger_sequence >= 1500 AND "
                        f"(ledger_sequence > 1500 OR id >= '{PAGE_CURSOR}-z') ORDER BY ledger_sequence, id LIMIT 200",
                        "raw"))
def q_keyset_page(spark, sf):
    return P.keyset_page(_s(spark, sf).raw.select("id", "ledger_sequence", "event_name"), 200, PAGE_CURSOR)


@query("g_keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 3000 "
                        "ORDER BY o_orderkey LIMIT 200")
def q_g_keyset_page(spark, sf):
    """A 200-row page of orders after key 3000, as a top-k over a pushed range predicate."""
    o = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    return o.where(F.col("o_orderkey") >= 3000).orderBy("o_orderkey").limit(200)


@query("legacy_page", W("SELECT id, author, version, wasm_name, wasm_hash FROM (SELECT *, row_number() OVER ("
                        "PARTITION BY wasm_name ORDER BY ledger_sequence ASC, version DESC NULLS FIRST, id DESC) AS rn "
                        "FROM batch_publishes) s WHERE rn = 1 ORDER BY ledger_sequence, id LIMIT 200",
                        "batch_publishes"))
def q_legacy_page(spark, sf):
    pubs = D.decode_batch(_batch_events(_t(spark, sf)), "publish")
    return P.legacy_page(pubs, 200, None)


# Fixed values: (column, JSON key) of a row of the legacy list.
_LEGACY_FIELDS = [("author", "author"), ("version", "version"), ("wasm_name", "wasm_name"), ("wasm_hash", "wasm_hash")]


def _envelope_sql(fields: list[tuple[str, str]], page: str, limit: int) -> str:
    packed = ", ".join(f"{k} := {c}" for c, k in fields)
    return (f"SELECT concat('{{\"result\":[', coalesce(string_agg(to_json(struct_pack({packed}))::VARCHAR, ',' ORDER BY ledger_sequence, id), ''), "
            f"'],\"next\":', CASE WHEN count(*) = {limit} THEN to_json(max_by(id, row(ledger_sequence, id)))::VARCHAR ELSE 'null' END, '}}') "
            f"AS json FROM {page}")


@query("legacy_next_page", W(
    "SELECT * FROM (WITH earliest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wasm_name ORDER BY ledger_sequence ASC, "
    "version DESC NULLS FIRST, id DESC) AS rn FROM batch_publishes) s WHERE rn = 1), "
    f"first_page AS (SELECT * FROM earliest ORDER BY ledger_sequence, id LIMIT {NEXT_PAGE}), "
    "bound AS (SELECT max_by(CAST(split_part(id, '-', 1) AS BIGINT), row(ledger_sequence, id)) AS ledger, "
    "max_by(concat(split_part(id, '-', 1), '-', split_part(id, '-', 2), '-z'), row(ledger_sequence, id)) AS least_id "
    f"FROM first_page HAVING count(*) = {NEXT_PAGE}), "
    "next_page AS (SELECT earliest.* FROM earliest, bound WHERE (ledger_sequence, id) >= (ledger, least_id) "
    f"ORDER BY ledger_sequence, id LIMIT {NEXT_PAGE}) {_envelope_sql(_LEGACY_FIELDS, 'next_page', NEXT_PAGE)}) s", "batch_publishes"))
def q_legacy_next_page(spark, sf):
    """The response behind the first page, fetched with that page's ``next``."""
    pubs = D.decode_batch(_batch_events(_t(spark, sf)), "publish")
    cursor = P.next_of(P.legacy_rows(pubs, NEXT_PAGE, None), NEXT_PAGE)
    page = P.legacy_rows(pubs, NEXT_PAGE, cursor)
    return P.json_envelope(page if cursor else page.where("false"), _LEGACY_FIELDS, NEXT_PAGE)


@query("list_contracts_next", W(
    f"SELECT * FROM (WITH first_page AS (SELECT * FROM contracts_enriched ORDER BY ledger_sequence, id LIMIT {NEXT_PAGE}), "
    "bound AS (SELECT max_by(CAST(split_part(id, '-', 1) AS BIGINT), row(ledger_sequence, id)) AS ledger, "
    f"max_by(concat(id, '-z'), row(ledger_sequence, id)) AS least_id FROM first_page HAVING count(*) = {NEXT_PAGE}), "
    "next_page AS (SELECT e.id, ledger_sequence, contract_id, contract_name FROM contracts_enriched e, bound "
    f"WHERE (ledger_sequence, e.id) >= (ledger, least_id) ORDER BY ledger_sequence, e.id LIMIT {NEXT_PAGE}) "
    f"SELECT *, CASE WHEN count(*) OVER () = {NEXT_PAGE} THEN last_value(id) OVER (ORDER BY ledger_sequence, id ROWS BETWEEN "
    "UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS next_cursor FROM next_page) s", "contracts_enriched"))
def q_list_contracts_next(spark, sf):
    """The page behind the first one and where the one behind it starts."""
    enriched = _s(spark, sf).contracts_enriched.select("id", "ledger_sequence", "contract_id", "contract_name")
    cursor = P.next_of(P.keyset_page(enriched, NEXT_PAGE, None), NEXT_PAGE)
    page = P.keyset_page(enriched, NEXT_PAGE, cursor)
    return P.with_next_cursor(page if cursor else page.where("false"), NEXT_PAGE)


@query("page_export", W(f"SELECT id, ledger_sequence, contract_name, CAST(row_number() OVER (ORDER BY ledger_sequence, "
                        f"id) - 1 AS BIGINT) AS row_index, CAST((row_number() OVER (ORDER BY ledger_sequence, id) - 1) "
                        f"// {EXPORT_PAGE} AS BIGINT) AS page FROM contracts_enriched", "contracts_enriched"))
def q_page_export(spark, sf):
    e = _s(spark, sf).contracts_enriched.select("id", "ledger_sequence", "contract_name")
    return P.page_export(e, EXPORT_PAGE)


@query("list_registries", W("SELECT contract_id, registry_channel AS channel, ledger_sequence, created_at "
                            "FROM registries ORDER BY channel", "registries"))
def q_list_registries(spark, sf):
    return DT.list_registries(_s(spark, sf).registries)


# ---- details -------------------------------------------------------------------------------------------

_WD_VERSION = ("SELECT 'version' AS record, CAST(row_number() OVER (PARTITION BY wasm_name, channel ORDER BY "
               "ledger_sequence DESC, wasm_version DESC NULLS FIRST, id DESC) - 1 AS BIGINT) AS pos, "
               "CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS transaction_hash, "
               "CAST(NULL AS BIGINT) AS ledger_sequence, CAST(NULL AS TIMESTAMP) AS created_at, channel, author, "
               "wasm_version, wasm_name, wasm_hash FROM published_with_channel p WHERE EXISTS (SELECT 1 FROM found f "
               "WHERE f.wasm_name = p.wasm_name AND f.channel = p.channel)")
_WD_DETAIL_COLS = "id, transaction_hash, ledger_sequence, created_at, channel, author, wasm_version, wasm_name, wasm_hash"


@query("wasm_detail", W(
    "SELECT * FROM (WITH found AS (SELECT l.* FROM latest_published l WHERE EXISTS (SELECT 1 FROM "
    "published_with_channel k WHERE k.wasm_name = l.wasm_name AND k.channel = l.channel)) "
    f"SELECT 'detail' AS record, CAST(0 AS BIGINT) AS pos, {_WD_DETAIL_COLS} FROM found UNION ALL {_WD_VERSION}) s",
    "latest_published", "published_with_channel"))
def q_wasm_detail(spark, sf):
    t = _s(spark, sf)
    keys = t.published_with_channel.select("wasm_name", "channel")
    return DT.wasm_detail(t.latest_published, t.published_with_channel, keys)


@query("wasm_detail_version", W(
    "SELECT * FROM (WITH found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wasm_name, channel, "
    "wasm_version ORDER BY ledger_sequence DESC, id DESC) AS rn FROM published_with_channel WHERE wasm_version "
    "IS NOT NULL AND wasm_name IS NOT NULL AND channel IS NOT NULL) s WHERE rn = 1) "
    f"SELECT 'detail' AS record, CAST(0 AS BIGINT) AS pos, {_WD_DETAIL_COLS} FROM found UNION ALL {_WD_VERSION}) s",
    "published_with_channel"))
def q_wasm_detail_version(spark, sf):
    t = _s(spark, sf)
    keys = t.published_with_channel.select("wasm_name", "channel", "wasm_version")
    return DT.wasm_detail(t.published_with_channel, t.published_with_channel, keys, version=True)


@query("contract_detail", W(
    "SELECT * FROM (WITH top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_name, channel "
    "ORDER BY ledger_sequence DESC, id DESC) AS rn FROM contracts_enriched WHERE contract_name IS NOT NULL "
    "AND channel IS NOT NULL) s WHERE rn = 1) "
    "SELECT 'detail' AS record, id, transaction_hash, ledger_sequence, created_at, contract_id, contract_name, "
    "channel, sac, deployer, wasm_version, wasm_name, wasm_channel, CAST(NULL AS BIGINT) AS version_index, "
    "CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS wasm_hash FROM top UNION ALL "
    "SELECT 'version', NULL, transaction_hash, ledger_sequence, created_at, contract_id, NULL, NULL, NULL, NULL, "
    "wasm_version, wasm_name, wasm_channel, version_index, kind, wasm_hash FROM versions v "
    "WHERE v.contract_id IN (SELECT contract_id FROM top)) s", "contracts_enriched", "versions"))
def q_contract_detail(spark, sf):
    t = _s(spark, sf)
    keys = t.registered_with_channel.select("contract_name", "channel")
    return DT.contract_detail(t.contracts_enriched, t.versions, keys)


_DEPLOY_DETAIL = (
    "WITH req AS (SELECT DISTINCT contract_name, channel FROM registered_with_channel), "
    "r AS (SELECT contract_id, contract_name, channel FROM (SELECT *, row_number() OVER (PARTITION BY contract_name, "
    "channel ORDER BY ledger_sequence DESC, id DESC) AS rn FROM registered_with_channel) s WHERE rn = 1), "
    "d AS (SELECT contract_id, deployer, transaction_hash FROM (SELECT *, row_number() OVER (PARTITION BY contract_id "
    "ORDER BY ledger_sequence DESC, id DESC) AS rn FROM deployed) s WHERE rn = 1), "
    "b AS (SELECT transaction_hash, operation_body FROM (SELECT *, row_number() OVER (PARTITION BY transaction_hash "
    "ORDER BY id DESC) AS rn FROM raw WHERE event_name = 'deploy') s WHERE rn = 1), "
    "found AS (SELECT r.contract_id, r.contract_name, r.channel, d.deployer, b.operation_body FROM r "
    "LEFT JOIN d ON d.contract_id = r.contract_id LEFT JOIN b ON b.transaction_hash = d.transaction_hash) "
    "SELECT req.contract_name AS requested_name, req.channel AS requested_channel, found.contract_id, "
    "found.contract_name, found.channel, found.deployer, found.operation_body, "
    "CASE WHEN found.contract_name IS NULL THEN 'not_found' WHEN found.operation_body IS NULL THEN 'no_deploy_body' "
    "ELSE 'found' END AS status FROM req LEFT JOIN found ON req.contract_name = found.contract_name "
    "AND req.channel = found.channel")


@query("deploy_detail", W(f"SELECT * FROM ({_DEPLOY_DETAIL}) s", "registered_with_channel", "deployed", "raw"))
def q_deploy_detail(spark, sf):
    t = _s(spark, sf)
    keys = t.registered_with_channel.select("contract_name", "channel")
    return DT.deploy_detail(t.registered_with_channel, t.deployed, t.raw, keys)


# Requested keys of the lookups: those that exist, and names of the other kind in the same channels, of which most don't.
_CONTRACT_KEYS = ("SELECT contract_name, channel FROM registered_with_channel UNION "
                  "SELECT wasm_name, channel FROM published_with_channel")


def _contract_keys(t: RegistryTables) -> DataFrame:
    others = t.published_with_channel.select(F.col("wasm_name").alias("contract_name"), "channel")
    return t.registered_with_channel.select("contract_name", "channel").union(others)


def _lookup_sql(key_cols: list[str], keys: str, details: str, cols: str, error: str) -> str:
    same = " AND ".join(f"d.{c} = r.{c}" for c in key_cols)
    asked = ", ".join(f"r.{c} AS requested_{c}" for c in key_cols)
    return (f"SELECT {asked}, CASE WHEN d.id IS NULL THEN 'not_found' ELSE 'found' END AS status, "
            f"CASE WHEN d.id IS NULL THEN {error} END AS error, {', '.join(f'd.{c.strip()}' for c in cols.split(','))} "
            f"FROM ({keys}) r LEFT JOIN ({details}) d ON {same}")


@query("wasm_lookup", W(_lookup_sql(
    ["wasm_name", "channel"], "SELECT wasm_name, channel FROM published_with_channel UNION SELECT contract_name, channel FROM registered_with_channel",
    "SELECT * FROM latest_published", _WD_DETAIL_COLS, "concat('Wasm ''', r.wasm_name, ''' not found')"),
    "latest_published", "published_with_channel", "registered_with_channel"))
def q_wasm_lookup(spark, sf):
    t = _s(spark, sf)
    others = t.registered_with_channel.select(F.col("contract_name").alias("wasm_name"), "channel")
    return DT.wasm_lookup(t.latest_published, t.published_with_channel.select("wasm_name", "channel").union(others))


@query("wasm_lookup_version", W(_lookup_sql(
    ["wasm_name", "channel", "wasm_version"],
    "SELECT DISTINCT p.wasm_name, p.channel, l.wasm_version FROM published_with_channel p JOIN latest_published l USING (wasm_name)",
    "SELECT * FROM published_with_channel QUALIFY row_number() OVER (PARTITION BY wasm_name, channel, wasm_version "
    "ORDER BY ledger_sequence DESC, id DESC) = 1", _WD_DETAIL_COLS,
    "concat('Wasm ''', r.wasm_name, ''' version ''', r.wasm_version, ''' not found')"), "latest_published", "published_with_channel"))
def q_wasm_lookup_version(spark, sf):
    """Whether each channel that has a name has the name's newest version too."""
    t = _s(spark, sf)
    newest = t.latest_published.select("wasm_name", "wasm_version")
    keys = t.published_with_channel.select("wasm_name", "channel").distinct().join(newest, "wasm_name")
    return DT.wasm_lookup(t.published_with_channel, keys, version=True)


@query("contract_lookup", W(_lookup_sql(
    ["contract_name", "channel"], _CONTRACT_KEYS,
    "SELECT * FROM contracts_enriched QUALIFY row_number() OVER (PARTITION BY contract_name, channel ORDER BY ledger_sequence DESC, id DESC) = 1",
    "id, transaction_hash, ledger_sequence, created_at, contract_id, contract_name, channel, sac, deployer, wasm_version, wasm_name, wasm_channel",
    "concat('Contract ''', r.contract_name, ''' not found')"),
    "contracts_enriched", "registered_with_channel", "published_with_channel"))
def q_contract_lookup(spark, sf):
    t = _s(spark, sf)
    return DT.contract_lookup(t.contracts_enriched, _contract_keys(t))


_DEPLOY_LOOKUP = _DEPLOY_DETAIL.replace("SELECT DISTINCT contract_name, channel FROM registered_with_channel", _CONTRACT_KEYS)


@query("deploy_lookup", W(f"SELECT * FROM ({_DEPLOY_LOOKUP}) s", "registered_with_channel", "published_with_channel", "deployed", "raw"))
def q_deploy_lookup(spark, sf):
    """``deploy_detail`` of keys of which some don't exist."""
    t = _s(spark, sf)
    return DT.deploy_detail(t.registered_with_channel, t.deployed, t.raw, _contract_keys(t))


@query("replay_plan", W(
    f"SELECT l.id AS list_id, l.contract_name, json_extract(dd.operation_body, '$.invoke_host_function')::VARCHAR "
    f"AS invoke_host_function FROM contracts_enriched l JOIN ({_DEPLOY_DETAIL}) dd "
    f"ON dd.requested_name = l.contract_name AND dd.requested_channel = l.channel "
    f"WHERE l.channel = 'root' AND dd.status = 'found'",
    "contracts_enriched", "registered_with_channel", "deployed", "raw"))
def q_replay_plan(spark, sf):
    t = _s(spark, sf)
    return DT.replay_plan(t.contracts_enriched, t.registered_with_channel, t.deployed, t.raw, "root")


def queries() -> dict[str, QueryFn]:
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}


# ---- sinks ----------------------------------------------------------------------------------------------

from ..operators import sinks as SK  # noqa: E402

SPLIT_AT = 2000      # micro-batch boundary used by the multi-run sink jobs
REREAD_FROM = 1990   # inclusive re-read of the batch ingest (at-least-once boundary)


@query("upsert_latest", W("SELECT * FROM registries", "registries"))
def q_upsert_latest(spark, sf):
    """Registries maintained by two upsert micro-batches (plus a retried batch and a replay)."""
    t = _t(spark, sf)
    rows = t.sub_reg.where(F.col("contract_id").isNotNull())
    kt = SK.KeyedTable(spark, state_dir(spark, "registries"), ["contract_id"], rows.schema,
                       order=["ledger_sequence", "id"], buckets=8)
    kt.upsert(rows.where(F.col("ledger_sequence") < SPLIT_AT), 0)
    kt.upsert(rows.where(F.col("ledger_sequence") >= SPLIT_AT), 1)
    kt.upsert(rows.where(F.col("ledger_sequence") >= SPLIT_AT), 1)   # retried batch: no-op
    kt.upsert(rows, 2)                                                # full replay: idempotent
    return kt.read()


_LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]


@query("g_upsert", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, CASE WHEN l_returnflag = 'R' "
                   "THEN l_quantity + 1 ELSE l_quantity END AS l_quantity, l_returnflag FROM lineitem")
def q_g_upsert(spark, sf):
    """lineitem loaded, then its returned lines re-sent with a corrected quantity: last write wins.
    The driver's lineitem declares no key; (order, line, part, supplier, ship date) identifies a row
    (unique at every scale of the test data)."""
    li = spark.read.parquet(f"{sf}/lineitem.parquet").select(*_LI_KEY, "l_quantity", "l_returnflag")
    kt = SK.KeyedTable(spark, state_dir(spark, "lineitem"), _LI_KEY, li.schema, buckets=16)
    kt.upsert(li, 0)
    kt.upsert(li.where(F.col("l_returnflag") == "R").withColumn("l_quantity", F.col("l_quantity") + 1), 1)
    return kt.read()


@query("insert_ignore", W("SELECT * FROM batch_deploys", "batch_deploys"))
def q_insert_ignore(spark, sf):
    """Batch-path deploys loaded by two overlapping runs (the second re-reads from an inclusive
    boundary); first write wins, so the overlap is not inserted twice."""
    deploys = D.decode_batch(_batch_events(_t(spark, sf)), "deploy")
    kt = SK.KeyedTable(spark, state_dir(spark, "deploys"), ["id"], deploys.schema, buckets=8)
    kt.insert_ignore(deploys.where(F.col("ledger_sequence") < SPLIT_AT), 0, ("ledger_sequence", "id"))
    kt.insert_ignore(deploys.where(F.col("ledger_sequence") >= REREAD_FROM), 1, ("ledger_sequence", "id"))
    return kt.read()


@query("versioned_write", W("SELECT * FROM contracts_enriched", "contracts_enriched"))
def q_versioned_write(spark, sf):
    """Target table written as version N while N-1 stays readable; a rollback restores N-1, old
    versions are pruned."""
    e = _s(spark, sf).contracts_enriched
    kt = SK.KeyedTable(spark, state_dir(spark, "contracts_enriched"), ["id"], e.schema, buckets=8)
    kt.overwrite(e)                                   # version 1
    kt.overwrite(e.where(F.col("sac")))               # version 2 (a bad load)
    kt.rollback(1)                                    # readers back on version 1
    kt.vacuum(keep=1)
    return kt.read()


_SPLIT_SQL = (
    "SELECT id, transaction_hash, ledger_sequence, contract_id, CASE WHEN id IS NULL THEN 'null_id' "
    "WHEN transaction_hash IS NULL THEN 'null_transaction_hash' WHEN ledger_sequence IS NULL THEN "
    "'null_ledger_sequence' WHEN count(*) OVER (PARTITION BY id) > 1 THEN 'duplicate_key' ELSE 'ok' END "
    f"AS constraint_status FROM (SELECT * FROM batch_deploys WHERE ledger_sequence < {SPLIT_AT} UNION ALL "
    f"SELECT * FROM batch_deploys WHERE ledger_sequence >= {REREAD_FROM}) u")


@query("constraint_split", W(_SPLIT_SQL, "batch_deploys"))
def q_constraint_split(spark, sf):
    deploys = D.decode_batch(_batch_events(_t(spark, sf)), "deploy")
    cand = deploys.where(F.col("ledger_sequence") < SPLIT_AT).unionByName(
        deploys.where(F.col("ledger_sequence") >= REREAD_FROM))
    cand = cand.select("id", "transaction_hash", "ledger_sequence", "contract_id")
    return SK.constraint_split(cand, ["id"], ["id", "transaction_hash", "ledger_sequence"])


@query("load_stamp", W("SELECT *, true AS stamped FROM batch_deploys", "batch_deploys"))
def q_load_stamp(spark, sf):
    """Rows stamped with the load time: one moment for all rows, not before the query was asked for and not in the future."""
    asked = F.lit(datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None) - datetime.timedelta(minutes=1))
    stamped = SK.load_stamp(D.decode_batch(_batch_events(_t(spark, sf)), "deploy"))
    return stamped.withColumn("stamped", (F.col("created_at") >= asked) & (F.col("created_at") <= F.localtimestamp())).drop("created_at")


_MANIFEST_SQL = ("SELECT wasm_name, wasm_version, wasm_hash, channel, concat(coalesce(wasm_name, 'None'), '@', "
                 "coalesce(wasm_version, 'None'), '.wasm') AS file_name FROM latest_published "
                 "WHERE channel IS DISTINCT FROM 'unverified'")


@query("artifact_manifest", W(_MANIFEST_SQL, "latest_published"))
def q_artifact_manifest(spark, sf):
    return SK.artifact_manifest(_s(spark, sf).latest_published)


@query("artifact_catalog", W(
    "SELECT path, file_name, wasm_name, wasm_version FROM (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS "
    "file_name, regexp_extract(regexp_extract(path, '([^/]+)$', 1), '^(.*)@([^@]*)\\.wasm$', 1) AS wasm_name, "
    "regexp_extract(regexp_extract(path, '([^/]+)$', 1), '^(.*)@([^@]*)\\.wasm$', 2) AS wasm_version FROM ("
    f"SELECT concat('artifacts/', file_name) AS path FROM ({_MANIFEST_SQL}) m) p) q "
    "WHERE wasm_name <> '' AND wasm_version <> ''", "latest_published"))
def q_artifact_catalog(spark, sf):
    """Reload side of the export: parse the exported file names back into (name, version)."""
    m = SK.artifact_manifest(_s(spark, sf).latest_published)
    return readers.artifact_catalog(m.select(F.concat(F.lit("artifacts/"), F.col("file_name")).alias("path")))


# Fixed values: (column, JSON key) of a contract list row in the output envelope.
_JSON_FIELDS = [("channel", "channel"), ("contract_id", "contract_id"), ("contract_name", "contract_name"),
                ("deployer", "deployer"), ("wasm_version", "wasm_version"), ("wasm_name", "wasm_name"),
                ("wasm_channel", "wasm_channel"), ("sac", "is_stellar_asset_contract")]


@query("json_rows", W(
    "SELECT to_json(struct_pack(" + ", ".join(f"{k} := {c}" for c, k in _JSON_FIELDS) + "))::VARCHAR AS json "
    "FROM (SELECT * FROM contracts_enriched ORDER BY ledger_sequence, id LIMIT 200) p", "contracts_enriched"))
def q_json_rows(spark, sf):
    return SK.json_rows(P.list_contracts(_s(spark, sf).contracts_enriched, 200, None), _JSON_FIELDS)


@query("json_envelope", W(_envelope_sql(_JSON_FIELDS, "(SELECT * FROM contracts_enriched ORDER BY ledger_sequence, id LIMIT 200) p", 200),
                          "contracts_enriched"))
def q_json_envelope(spark, sf):
    return P.json_envelope(P.keyset_page(_s(spark, sf).contracts_enriched, 200, None), _JSON_FIELDS, 200)


# ---- streaming ------------------------------------------------------------------------------------------

from ..streaming import jobs as SJ  # noqa: E402

STREAM_FILES = 4
STREAM_FILE_BYTES = 32 << 20
_RUNS: dict = {}


def _stream_source(spark, sf) -> tuple[RegistryTables, str, int]:
    """The fixture event stream laid out as ledger-ordered files, and how many of them are an arrival unit of the stream: a fourth,
    in files that don't grow with it."""
    key = ("source", id(spark), sf)
    if key not in _RUNS:
        t = _t(spark, sf)
        folder = state_dir(spark, "stream-source")
        each = -(-stored_bytes(spark, events_path(spark, sf)) // (STREAM_FILES * STREAM_FILE_BYTES)) or 1
        write_stream_files(t.chain_events, folder, STREAM_FILES * each)
        _RUNS[key] = (t, folder, each)
    return _RUNS[key]


def _stream_run(spark, sf) -> RegistryIngest:
    """One availableNow run of the streaming ingest over the fixture stream, one arrival unit per batch."""
    key = ("ingest", id(spark), sf)
    if key not in _RUNS:
        t, folder, each = _stream_source(spark, sf)
        root = state_dir(spark, "stream-tables")
        ing = RegistryIngest(spark, root, t.root_registry, ledger_range=500)
        ing.run(folder, f"{root}/_checkpoint", max_files_per_trigger=each)
        _RUNS[key] = ing
    return _RUNS[key]


@query("stream_pipeline", W("SELECT * FROM published", "published"))
def q_stream_pipeline(spark, sf):
    return _stream_run(spark, sf).table("published_wasms")


@query("stream_gate", W("SELECT * FROM registered", "registered"))
def q_stream_gate(spark, sf):
    """Events gated by the membership set the same stream builds: exact for any arrival order."""
    return _stream_run(spark, sf).table("registered_contracts")


@query("stream_registries", W("SELECT * FROM registries", "registries"))
def q_stream_registries(spark, sf):
    return _stream_run(spark, sf).table("registries")


@query("stream_deployed", W("SELECT * FROM deployed", "deployed"))
def q_stream_deployed(spark, sf):
    return _stream_run(spark, sf).table("deployed_contracts")


@query("stream_renamed", W("SELECT * FROM renamed", "renamed"))
def q_stream_renamed(spark, sf):
    return _stream_run(spark, sf).table("rename")


@query("stream_address_updates", W("SELECT * FROM address_updates", "address_updates"))
def q_stream_address_updates(spark, sf):
    return _stream_run(spark, sf).table("update_address")


@query("stream_owner_updates", W("SELECT * FROM owner_updates", "owner_updates"))
def q_stream_owner_updates(spark, sf):
    return _stream_run(spark, sf).table("update_owner")


@query("stream_raw_backup", W("SELECT * FROM raw", "raw"))
def q_stream_raw_backup(spark, sf):
    """The raw backup as the stream wrote it, ahead of the gate."""
    return _stream_run(spark, sf).table("raw_events_backup")


def _archive_run(spark, sf) -> ArchiveIngest:
    """Both archive streams, stopped when half the files have come and started again for the rest."""
    key = ("archive", spark.sparkContext.applicationId, sf)
    if key not in _RUNS:
        t = _t(spark, sf)
        root = state_dir(spark, "archive")
        for rows, name, seq in ((t.ledger_entries, "entries", "last_modified_ledger_sequence"), (t.chain_events, "events", "ledger_sequence")):
            rows.where(F.col(seq) < SPLIT_AT).write.parquet(f"{root}/{name}")
        half = -(-max(data_files(spark, f"{root}/{name}") for name in ("entries", "events")) // 2)   # two batches
        ArchiveIngest(spark, f"{root}/tables", ledger_range=500).run(f"{root}/entries", f"{root}/events", f"{root}/_ckpt", max_files_per_trigger=half)
        for rows, name, seq in ((t.ledger_entries, "entries", "last_modified_ledger_sequence"), (t.chain_events, "events", "ledger_sequence")):
            rows.where(F.col(seq) >= SPLIT_AT).write.mode("append").parquet(f"{root}/{name}")
        again = ArchiveIngest(spark, f"{root}/tables", ledger_range=500)
        again.run(f"{root}/entries", f"{root}/events", f"{root}/_ckpt")
        _RUNS[key] = again
    return _RUNS[key]


@query("stream_uploads", W("SELECT * FROM uploads", "uploads"))
def q_stream_uploads(spark, sf):
    return _archive_run(spark, sf).table("wasm_uploads")


@query("stream_wasm_binaries", W("SELECT * FROM wasm_binaries", "wasm_binaries"))
def q_stream_wasm_binaries(spark, sf):
    return _archive_run(spark, sf).table("wasm_binaries")


@query("stream_deploys", W("SELECT * FROM deploys", "deploys"))
def q_stream_deploys(spark, sf):
    return _archive_run(spark, sf).table("contract_deploys")


@query("stream_upgrades", W("SELECT * FROM upgrades", "upgrades"))
def q_stream_upgrades(spark, sf):
    return _archive_run(spark, sf).table("contract_upgrades")


@query("replay", W("SELECT * FROM deployed", "deployed"))
def q_replay(spark, sf):
    """Replay with a fresh checkpoint and the retained membership set, over tables that have lost their odd ledgers: repaired."""
    t, folder, each = _stream_source(spark, sf)
    root = state_dir(spark, "replay")
    ing = RegistryIngest(spark, root, t.root_registry, ledger_range=500)
    ing.run(folder, f"{root}/_checkpoint")
    sink = ing.sinks["deploy"]
    sink.overwrite(sink.read().where(F.col("ledger_sequence") % 2 == 0))
    SJ.replay(ing, folder, f"{root}/_replays", max_files_per_trigger=2 * each)
    return ing.table("deployed_contracts")


@query("rebuild_and_audit", W(_AUDIT_SQL, "raw", "registries", "sink_ids"))
def q_rebuild_and_audit(spark, sf):
    """Full rebuild into fresh tables, member-count check, audit (replay and re-audit on drops)."""
    t, folder, each = _stream_source(spark, sf)
    expected = t.members.count()
    return SJ.rebuild_and_audit(spark, folder, state_dir(spark, "rebuild"), t.root_registry,
                                expected_members=expected, max_files_per_trigger=2 * each)


@query("incremental_progress", W("SELECT * FROM batch_deploys", "batch_deploys"))
def q_incremental_progress(spark, sf):
    """Scheduled batch ingest: two runs over files arriving in between; first write wins."""
    t = _t(spark, sf)
    ev = FL.filter_successful(FL.filter_emitter(t.chain_events, t.root_registry))
    src = state_dir(spark, "minimal-events")
    ckpt = f"{src}-checkpoint"
    state = f"{src}-tables"
    ev.where(F.col("ledger_sequence") < SPLIT_AT).write.parquet(src)
    first = data_files(spark, src)
    SJ.incremental_ingest(spark, src, state, ckpt, max_files_per_trigger=-(-first // 2))    # two batches each
    ev.where(F.col("ledger_sequence") >= SPLIT_AT).write.mode("append").parquet(src)
    res = SJ.incremental_ingest(spark, src, state, ckpt, max_files_per_trigger=-(-(data_files(spark, src) - first) // 2))
    return res["tables"]["deploys"].read().drop("created_at")


@query("raw_backup", W("SELECT id, transaction_hash, ledger_sequence, created_at, emitter_contract_id, event_name "
                       "FROM raw WHERE event_name IN ('publish', 'sub_reg')", "raw"))
def q_raw_backup(spark, sf):
    """Raw backup written partitioned by event name, then read back for two kinds only: the other
    partitions are pruned at planning time."""
    path = state_dir(spark, "raw-backup")
    SK.write_raw_backup(_t(spark, sf).raw, path, mode="errorifexists")
    back = spark.read.parquet(path).where(F.col("event_name").isin("publish", "sub_reg"))
    return back.select("id", "transaction_hash", "ledger_sequence", "created_at", "emitter_contract_id", "event_name")


@query("raw_backup_all", W("SELECT id, transaction_hash, ledger_sequence, created_at, event_name, emitter_contract_id, data, "
                           "topics, operation_body FROM raw", "raw"))
def q_raw_backup_all(spark, sf):
    """The whole raw backup, written and read back: all kinds, all columns."""
    path, raw = state_dir(spark, "raw-backup-all"), _t(spark, sf).raw
    SK.write_raw_backup(raw, path, mode="errorifexists")
    return spark.read.schema(raw.schema).parquet(path).select("id", "transaction_hash", "ledger_sequence", "created_at", "event_name",
                                                              "emitter_contract_id", "data", "topics", "operation_body")


@query("unnest_arrays", W("SELECT id, transaction_hash, ledger_sequence, contract_id, deployer FROM batch_deploys",
                          "batch_deploys"))
def q_unnest_arrays(spark, sf):
    """Bulk-load path: deploy rows packed into parallel arrays per 200-row page, then unnested."""
    cols = ["id", "transaction_hash", "ledger_sequence", "contract_id", "deployer"]
    deploys = D.decode_batch(_batch_events(_t(spark, sf)), "deploy").select(*cols)
    pages = P.page_export(deploys, 200)
    payload = SK.bulk_payloads(pages, "page", cols)
    return SK.unnest_arrays(payload, cols)


@query("sql_similarity", W(
    f"SELECT id, wasm_name, round(CAST({_SIM_NAME} AS DOUBLE), 6) AS name_term FROM published_with_channel "
    f"WHERE CAST({_SIM_NAME} AS DOUBLE) > 0.2", "published_with_channel"))
def q_sql_similarity(spark, sf):
    """The similarity function called from Spark SQL (temporary SQL function, no Python UDF)."""
    from ..functions.sql import register_sql_functions
    register_sql_functions(spark)
    p = _s(spark, sf).published_with_channel
    return spark.sql(
        "SELECT id, wasm_name, round(CAST(similarity(wasm_name, :term) AS DOUBLE), 6) AS name_term FROM {p} "
        "WHERE CAST(similarity(wasm_name, :term) AS DOUBLE) > 0.2", args={"term": SEARCH_TERM}, p=p)
