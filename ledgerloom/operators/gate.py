"""Membership gate: keep events whose emitter belongs to the registry set the stream itself builds.

In batch (and after any replay with the full set) the gate is a plain semi join: whether an event
passes does not depend on when its registry was announced. The set is the distinct announced
contract ids; Spark broadcasts it if its bytes, known from the files or measured while the query runs, are few.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def membership_set(sub_reg: DataFrame, key: str = "contract_id") -> DataFrame:
    """Distinct member ids (the dynamic table); NULL ids never match and are left out."""
    return sub_reg.where(F.col(key).isNotNull()).select(key).distinct()


def membership_gate(events: DataFrame, members: DataFrame, on: str = "emitter_contract_id",
                    key: str = "contract_id") -> DataFrame:
    m = members.select(F.col(key).alias("__member"))
    return events.join(m, events[on] == m["__member"], "left_semi")


def route_counts(gated: DataFrame, name_col: str = "event_name") -> DataFrame:
    """Rows per branch of the router (one aggregate; map-side partial counts)."""
    return gated.groupBy(name_col).agg(F.count(F.lit(1)).alias("n_events"))
