"""Keyset pages, list cursors and the all-pages export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cursor import keyset_predicate, parse_cursor, parse_legacy_cursor, validate_limit
from .latest import global_index
from .views import legacy_published


def keyset_page(df: DataFrame, limit: int | None = None, cursor: str | None = None,
                seq_col: str = "ledger_sequence", id_col: str = "id") -> DataFrame:
    """Rows at or after the cursor bound in (seq, id) order, at most ``limit``."""
    limit = validate_limit(limit)
    ledger, bound = parse_cursor(cursor)
    return (df.where(keyset_predicate(ledger, bound, seq_col, id_col))
            .orderBy(F.col(seq_col).asc(), F.col(id_col).asc()).limit(limit))


def with_next_cursor(page: DataFrame, limit: int, seq_col: str = "ledger_sequence",
                     id_col: str = "id") -> DataFrame:
    """Add ``next_cursor``: the id of the last row when the page is full, else NULL. The page holds
    at most ``limit`` (<= 200) rows, so the whole-page window is bounded."""
    w = Window.partitionBy()
    last = F.max_by(F.col(id_col), F.struct(F.col(seq_col), F.col(id_col))).over(w)
    return page.withColumn("next_cursor", F.when(F.count(F.lit(1)).over(w) == F.lit(limit), last))


def next_of(page: DataFrame, limit: int) -> str | None:
    """``next`` of a page, for the caller to pass as the cursor of the page behind it; None behind the last."""
    row = with_next_cursor(page, limit).select("next_cursor").first()
    return row and row["next_cursor"]


def json_envelope(page: DataFrame, fields: Sequence[tuple[str, str]], limit: int, seq_col: str = "ledger_sequence",
                  id_col: str = "id") -> DataFrame:
    """One row: the page's response as JSON, ``{"result": [...], "next": ...}``, its rows in (seq, id) order with the
    given (column, JSON key) pairs. The page holds at most ``limit`` (<= 200) rows, which bounds the array."""
    row = F.struct(F.col(seq_col), F.col(id_col), F.struct(*[F.col(c).alias(k) for c, k in fields]).alias("__row"))
    at = page.agg(F.sort_array(F.collect_list(row)).alias("rows"), F.count(F.lit(1)).alias("n"),
                  F.max_by(F.col(id_col), F.struct(F.col(seq_col), F.col(id_col))).alias("last"))
    return at.select(F.to_json(F.struct(F.transform("rows", lambda r: r["__row"]).alias("result"),
                                        F.when(F.col("n") == F.lit(limit), F.col("last")).alias("next")),
                               {"ignoreNullFields": "false"}).alias("json"))


def list_contracts(enriched: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    page = keyset_page(enriched, limit, cursor)
    return page.select("id", "contract_id", "channel", "contract_name", "sac", "deployer", "wasm_version",
                       "wasm_name", "wasm_channel")


def legacy_rows(publishes: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    """A page of the legacy published list: earliest publish per name, legacy cursor (skips the transaction)."""
    limit = validate_limit(limit, legacy=True)
    ledger, bound = parse_legacy_cursor(cursor)
    picked = legacy_published(publishes)
    return (picked.where(keyset_predicate(ledger, bound))
            .orderBy(F.col("ledger_sequence").asc(), F.col("id").asc()).limit(limit))


def legacy_page(publishes: DataFrame, limit: int | None = None, cursor: str | None = None) -> DataFrame:
    return legacy_rows(publishes, limit, cursor).select("id", "author", "version", "wasm_name", "wasm_hash")


def page_export(df: DataFrame, limit: int, seq_col: str = "ledger_sequence", id_col: str = "id",
                partitions: int | None = None) -> DataFrame:
    """Every page of a (seq, id)-ordered list in one job: adds ``row_index`` (0-based global position)
    and ``page`` (= row_index div limit).

    No global ``row_number()`` (that would pull the whole list into one task), see ``global_index``.
    """
    limit = validate_limit(limit)
    out = global_index(df, (seq_col, id_col), "row_index", partitions)
    return out.withColumn("page", F.floor(F.col("row_index") / F.lit(limit)).cast("bigint"))
