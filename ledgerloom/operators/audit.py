"""Loss audit: events of known registries that reached no downstream sink.

The seven conditional left joins with an all-NULL test are one anti join against the union of all
sinks' (id, event_name); the anti join shuffles on the id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import pair_value, parse_pairs
from .filters import REGISTRY_EVENTS

# Classification labels of audit rows.
REREGISTERED = "sub_reg_superseded"
NON_ROOT_SUB_REG = "sub_reg_non_root"
WITHOUT_MEMBER = "sub_reg_without_member"
DROPPED = "dropped"


def audit_dropped(raw: DataFrame, registries: DataFrame, sink_ids: DataFrame) -> DataFrame:
    reg = registries.select(F.col("contract_id").alias("__reg"))
    known = raw.join(reg, raw["emitter_contract_id"] == reg["__reg"], "left_semi") \
        .where(F.col("event_name").isin(list(REGISTRY_EVENTS)))
    known = known.select("event_name", "emitter_contract_id", "ledger_sequence", "transaction_hash", "id")
    missing = known.join(sink_ids, on=["id", "event_name"], how="left_anti")
    return missing.select("event_name", "emitter_contract_id", "ledger_sequence", "transaction_hash", "id") \
        .orderBy("ledger_sequence", "event_name")


def audit_reasons(dropped: DataFrame, raw: DataFrame, registries: DataFrame, root_registry: str) -> DataFrame:
    """Audit rows with ``member`` (whom a sub_reg announces) and ``reason``. A sub_reg row is explained when it came from a
    registry other than the root (never stored), when it names no member, or when the stored row of its member is a later
    announcement; a root announcement whose member is not stored, or only as of an earlier one, was lost. All else is a drop."""
    sub = raw.where(F.col("event_name") == "sub_reg").select(
        "id", pair_value(parse_pairs("data"), "contract_id", "address", 2).alias("member"))
    stored = registries.select(F.col("contract_id").alias("member"),
                               F.struct("ledger_sequence", "id").alias("__stored"))
    d = dropped.join(sub, on="id", how="left").join(stored, on="member", how="left")
    later = F.col("__stored") > F.struct("ledger_sequence", "id")
    reason = (F.when(F.col("event_name") != "sub_reg", F.lit(DROPPED))
              .when(F.col("emitter_contract_id") != F.lit(root_registry), F.lit(NON_ROOT_SUB_REG))
              .when(F.col("member").isNull(), F.lit(WITHOUT_MEMBER))
              .when(later, F.lit(REREGISTERED)).otherwise(F.lit(DROPPED)))
    return d.withColumn("reason", reason).drop("__stored")


def audit_summary(dropped: DataFrame, raw: DataFrame, registries: DataFrame, root_registry: str) -> DataFrame:
    """Counts of audit rows by event name and reason, and of the distinct members behind sub_reg rows."""
    return audit_reasons(dropped, raw, registries, root_registry).groupBy("event_name", "reason").agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct("member").alias("n_distinct_members"))
