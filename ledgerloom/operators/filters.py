"""Row filters of the registry pipelines, as column predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.jsonpath import computed_once, json_scalar, parse_variant

# The seven registry event names kept by the pipeline.
REGISTRY_EVENTS = ("deploy", "publish", "register", "rename", "update_address", "update_owner", "sub_reg")
# Id marker of events that belong to no operation.
NO_OP_MARKER = "-op-none-"
UPGRADE_EVENT = "executable_update"


def successful() -> Column:
    """Both success flags are true (NULL drops the row)."""
    return (F.col("in_successful_contract_call") == F.lit(True)) & (F.col("transaction_successful") == F.lit(True))


def not_no_op() -> Column:
    return ~F.col("id").like(f"%{NO_OP_MARKER}%")


def topic_name(topics="topics") -> Column:
    """``JSON_VALUE(topics, '$[0].symbol')``."""
    return json_scalar(topics, "$[0].symbol")


def with_topic_name(df: DataFrame, out: str = "event_name") -> DataFrame:
    """``df`` with the first topic's symbol; topics are parsed once a row."""
    parsed = computed_once(df, __topics=parse_variant("topics"))
    return parsed.withColumn(out, json_scalar("topics", "$[0].symbol", F.col("__topics"))).drop("__topics")


def filter_successful(df: DataFrame) -> DataFrame:
    return df.where(successful())


def filter_not_like(df: DataFrame) -> DataFrame:
    return df.where(not_no_op())


def filter_topic_in(df: DataFrame, names=REGISTRY_EVENTS, name_col: str | None = None) -> DataFrame:
    """Keep rows whose first topic symbol is one of ``names``. With ``name_col`` (a stored,
    already extracted name) the IN list is pushed to the Parquet scan."""
    if name_col:
        return df.where(F.col(name_col).isin(list(names)))
    return with_topic_name(df).where(F.col("event_name").isin(list(names))).drop("event_name")


def filter_emitter(df: DataFrame, contract_id: str, col: str = "contract_id") -> DataFrame:
    return df.where(F.col(col) == F.lit(contract_id))


def filter_system(df: DataFrame, event: str = UPGRADE_EVENT) -> DataFrame:
    """Host-emitted system events of one kind (successful, with an operation), with ``__topics``, their parsed topics."""
    system = df.where((F.col("type") == F.lit("system")) & successful() & not_no_op())
    parsed = computed_once(system, __topics=parse_variant("topics"))
    return parsed.where(json_scalar("topics", "$[0].symbol", F.col("__topics")) == F.lit(event))


def filter_created(df: DataFrame, entry_type: str) -> DataFrame:
    return df.where((F.col("ledger_entry_type") == F.lit(entry_type)) & (F.col("change_type") == F.lit("created")))


def registry_candidates(events: DataFrame) -> DataFrame:
    """Coarse filter: successful, has an operation, first topic is a registry event, which is added as ``event_name``."""
    return with_topic_name(events.where(successful() & not_no_op())).where(F.col("event_name").isin(list(REGISTRY_EVENTS)))
