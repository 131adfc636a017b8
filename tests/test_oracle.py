"""Registered queries against their DuckDB oracle on the smallest tables."""
import os

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from ledgerloom.plans import catalog
from ledgerloom.operators.filters import REGISTRY_EVENTS
from oracle_harness import compare, duck

FAST = ["latest_published", "registries", "membership_gate", "decode_deploy", "decode_register", "versions",
        "contracts_enriched", "audit_dropped", "search_published", "legacy_page", "list_contracts",
        "wasm_detail", "deploy_detail", "json_scalar", "decode_publish_batch", "similarity_join",
        "g_latest_per_key", "page_export", "artifact_catalog", "json_rows"]
NAMES = sorted(E.oracle_sql()) if os.environ.get("LEDGERLOOM_FULL_ORACLE") else FAST


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    r = compare(spark, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL, con)
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["hash_match"], r


def test_whole_raw_backup(spark, con):
    name = "raw_backup_all"
    test_matches_oracle(spark, con, name)
    kinds = E.queries()[name](spark, SF_SMALL).select("event_name").distinct().collect()
    assert {r[0] for r in kinds} == set(REGISTRY_EVENTS)


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "wasm_name" in df.columns


def test_every_query_has_an_oracle():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.queries()) == set(catalog.oracle_sql())
