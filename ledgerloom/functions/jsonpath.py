"""JSON scalar extraction and tagged key/value payload decoding as native column expressions.

``json_scalar`` follows SQL ``JSON_VALUE``: a scalar at the path comes back as text, an object,
an array, a JSON null or a missing path give NULL, and malformed JSON gives NULL instead of
failing the job. Plain ``get_json_object`` would return the text of an object, so the value
goes through a VARIANT and its type is checked. A VARIANT takes no object that repeats a key, which JSON
allows; of such a text only the value at the path goes through a VARIANT, the first one of a repeated key that is not null.

Payloads have the shape ``{"map":[{"key":{"symbol":K},"val":{TAG:V}}, ...]}``. They are parsed
once per row into an array of structs whose leaves are VARIANT, and every
field is then picked with higher-order functions over that one array, never by re-parsing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The value tags a payload entry can carry.
VALUE_TAGS = ("string", "address", "bytes", "bool")

PAIRS_TYPE = (
    "array<struct<key: struct<symbol: variant>, "
    "val: struct<string: variant, address: variant, bytes: variant, bool: variant>>>"
)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def variant_scalar(v: Column) -> Column:
    """Text of a scalar VARIANT; NULL for objects, arrays, JSON null and SQL NULL."""
    t = F.schema_of_variant(v)
    return F.when(~(t.startswith("OBJECT") | t.startswith("ARRAY")),
                  F.try_variant_get(v, "$", "string"))


def parse_variant(text) -> Column:
    """Parse JSON text once into a VARIANT (NULL when malformed)."""
    return F.try_parse_json(_col(text))


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with further columns, worked out once a row. Catalyst copies a plain column's expression into each filter and
    projection above it, and a filter works out each copy; what a generator makes it leaves where it is."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def json_scalar(text, path: str, parsed: Column | None = None) -> Column:
    """``JSON_VALUE(text, path)``. Pass ``parsed`` (the text's VARIANT column) to reuse one parse for
    several paths over the same text."""
    v = parsed if parsed is not None else parse_variant(text)
    value = variant_scalar(F.try_variant_get(v, path, "variant"))
    return F.coalesce(value, F.when(v.isNull(), _unparsed_scalar(text, path)))


def _is_json(text) -> Column:
    """The text is one JSON value, keys repeated or not: it closes no object put around it."""
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    return F.from_json(F.concat(F.lit('{"v":'), _col(text), F.lit("}")), "v string", strict)["v"].isNotNull()


def _unparsed_scalar(text, path: str) -> Column:
    """``json_scalar`` of a text without a VARIANT: a repeated key somewhere, or malformed (NULL). The path is asked of
    an array around the text, as a wildcard keeps the quotes of strings."""
    found = F.get_json_object(F.concat(F.lit("["), _col(text), F.lit("]")), "$[*]" + path[1:])
    return F.when(_is_json(text), variant_scalar(F.try_parse_json(found)))


def parse_pairs(text) -> Column:
    """Parse a payload once to ``array<struct<k, string, address, bytes, bool>>`` holding the
    scalar text of the key symbol and of each tag (NULL when absent or not a scalar); the whole
    array is NULL when the payload is malformed. Of a key that an object repeats, the
    first value that is not a JSON null counts, as in ``json_scalar``."""
    entries = F.try_variant_get(parse_variant(text), "$.map", PAIRS_TYPE)
    pairs = F.transform(entries, lambda e: F.struct(
        variant_scalar(e["key"]["symbol"]).alias("k"),
        *[variant_scalar(e["val"][t]).alias(t) for t in VALUE_TAGS]))
    # without a VARIANT: a repeated key, or malformed; each entry's text is asked for each of its values
    texts = F.from_json(F.get_json_object(_col(text), "$.map"), "array<string>")
    again = F.transform(texts, lambda e: F.struct(
        json_scalar(e, "$.key.symbol").alias("k"), *[json_scalar(e, f"$.val.{t}").alias(t) for t in VALUE_TAGS]))
    return F.coalesce(pairs, F.when(parse_variant(text).isNull() & _is_json(text), again))


def pair_value(pairs: Column, key: str, tag: str, max_pos: int | None = None,
               pick: str = "first", missing_default: str | None = None) -> Column:
    """Value of ``key`` with tag ``tag`` from a parsed payload.

    pick='first' with max_pos=N is the SQL CASE bank over positions 0..N-1: the first entry whose
    symbol equals ``key`` decides, and a wrong tag there gives NULL (no further probing).
    pick='last' scans every position and the last matching entry wins (a loop that assigns).
    ``missing_default`` is returned when no entry has the key at all (a present key with the
    wrong tag still gives NULL).
    """
    arr = pairs if max_pos is None else F.slice(pairs, 1, max_pos)
    hits = F.filter(arr, lambda e: e["k"] == F.lit(key))
    if pick == "first":
        hit = F.get(hits, 0)
    elif pick == "last":
        hit = F.try_element_at(hits, F.lit(-1))
    else:
        raise ValueError(f"pick must be 'first' or 'last', got {pick!r}")
    value = hit[tag]
    if missing_default is None:
        return value
    # absent key -> default; present key with another tag -> NULL
    return F.when(F.exists(F.coalesce(arr, F.array()), lambda e: e["k"] == F.lit(key)), value) \
        .otherwise(F.lit(missing_default))


def decode_pairs(pairs: Column, spec, max_pos: int | None, pick: str = "first",
                 missing_default: str | None = None) -> list[Column]:
    """One column per ``(key, tag, out_name)`` in ``spec``; tag 'bool' is cast to boolean."""
    cols = []
    for key, tag, out in spec:
        v = pair_value(pairs, key, tag, max_pos, pick, missing_default)
        if tag == "bool" and missing_default is None:
            v = v.try_cast("boolean")
        cols.append(v.alias(out))
    return cols


# ---- DuckDB text of the same functions, used by the SQL oracle -------------------------------

def sql_json_scalar(text_sql: str, path: str) -> str:
    return (f"CASE WHEN json_type({text_sql}, '{path}') NOT IN ('OBJECT', 'ARRAY') "
            f"THEN json_extract_string({text_sql}, '{path}') END")


def sql_case_bank(text_sql: str, key: str, tag: str, max_pos: int) -> str:
    """The hand-expanded CASE bank over positions, as the reference pipeline writes it."""
    arms = " ".join(
        f"WHEN {sql_json_scalar(text_sql, f'$.map[{i}].key.symbol')} = '{key}' "
        f"THEN {sql_json_scalar(text_sql, f'$.map[{i}].val.{tag}')}"
        for i in range(max_pos))
    return f"CASE {arms} END"
