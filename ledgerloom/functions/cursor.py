"""Argument checks and keyset cursors for list pages.

Row ids have the form ``<ledger>-<tx hash>-op-<op>-event-<event>``. A cursor is the id of the last
row of the previous page; the next page starts at the bound derived from it, compared as
``(ledger_sequence, id) >= (ledger, bound)``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page-size limits of the two list flavours.
MAX_LIMIT = 200
MIN_LIMIT_NEW = 1
MIN_LIMIT_LEGACY = 2
DEFAULT_LIMIT = 200

#: The ledger of a cursor: digits alone (no blanks, no underscores), that fit 64 bits.
_LEDGER = r"\+?[0-9]+"


def validate_limit(limit: int | None, legacy: bool = False) -> int:
    if limit is None:
        return DEFAULT_LIMIT
    lo = MIN_LIMIT_LEGACY if legacy else MIN_LIMIT_NEW
    if isinstance(limit, bool) or not isinstance(limit, int) or not lo <= limit <= MAX_LIMIT:
        raise ValueError(f"Limit must be an integer between {lo} and {MAX_LIMIT}")
    return limit


def parse_cursor(cursor: str | None) -> tuple[int, str]:
    """New-style cursor: bound = the whole cursor + '-z', so the next page starts right after
    that event. No cursor gives (0, '')."""
    if cursor is None:
        return 0, ""
    parts = cursor.split("-", 2)
    if len(parts) < 2 or not re.fullmatch(_LEDGER, parts[0]) or int(parts[0]) >= 1 << 63:
        raise ValueError("Invalid cursor")
    return int(parts[0]), f"{cursor}-z"


def parse_legacy_cursor(cursor: str | None) -> tuple[int, str]:
    """Legacy cursor: bound = '<ledger>-<tx>-z', which skips the rest of that transaction."""
    if not cursor:
        return 0, ""
    parts = cursor.split("-")
    try:
        ledger = int(parts[0])
    except ValueError:
        raise ValueError("Invalid cursor") from None
    if ledger < 0:
        raise ValueError("Invalid cursor")
    tx = parts[1] if len(parts) > 1 else "undefined"
    return ledger, f"{parts[0]}-{tx}-z"


def keyset_predicate(ledger: int, bound: str, seq_col: str = "ledger_sequence",
                     id_col: str = "id") -> Column:
    """``(seq, id) >= (ledger, bound)`` written so that ``seq >= ledger`` reaches the scan."""
    seq, rid = F.col(seq_col), F.col(id_col)
    return (seq >= F.lit(ledger)) & ((seq > F.lit(ledger)) | (rid >= F.lit(bound)))


def cursor_bound_col(cursor: Column) -> Column:
    """Column form of ``parse_cursor`` for a DataFrame of cursors: struct(ledger, bound);
    NULL fields for an invalid cursor."""
    parts = F.split(cursor, "-", 3)
    ledger = parts.getItem(0).try_cast("bigint")
    ok = (F.size(parts) >= 2) & parts.getItem(0).rlike(f"^{_LEDGER}$") & ledger.isNotNull()
    return F.struct(F.when(ok, ledger).alias("ledger"),
                    F.when(ok, F.concat(cursor, F.lit("-z"))).alias("bound"))
