import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import cursor as C
from ledgerloom.functions.jsonpath import json_scalar, pair_value, parse_pairs
from ledgerloom.functions.trigram import passes, similarity
from ledgerloom.operators.filters import registry_candidates


def test_json_scalar_is_json_value(spark):
    rows = [('[{"symbol":"deploy"}]',), ('[{"symbol":{"x":1}}]',), ('[{"symbol":[1]}]',), ('[{"symbol":null}]',),
            ('[{"other":1}]',), ("not json",), (None,), ('[{"symbol":7}]',), ('[{"symbol":true}]',)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(json_scalar("t", "$[0].symbol")).collect()]
    assert got == ["deploy", None, None, None, None, None, None, "7", "true"]


def test_json_scalar_of_a_text_that_repeats_a_key(spark):
    want = {'[{"symbol":"deploy","x":1,"x":2}]': "deploy", '[{"symbol":"deploy"},{"vec":[{"a":1,"a":2}]}]': "deploy",
            '[{"symbol":"a","symbol":"b"}]': "a", ' [{"b":1,"b":2,"symbol":"say \\"{x}\\""}] ': 'say "{x}"',
            '[{"symbol":"[1]","b":1,"b":2}]': "[1]", '[{"symbol":"7","b":1,"b":2}]': "7", '[{"symbol":7,"b":1,"b":2}]': "7",
            '[{"symbol":true,"b":1,"b":2}]': "true", '[{"symbol":{"x":1},"b":1,"b":2}]': None, '[{"symbol":[1],"b":1,"b":2}]': None,
            '[{"symbol":{"x":1,"x":2}}]': None, '[{"symbol":null,"b":1,"b":2}]': None, '[{"other":1,"other":2}]': None,
            # malformed
            '[{"symbol":"x","b":1,"b":2}': None, '[{"symbol":"x","b":1,"b":2}] junk': None, '[{"symbol":"x","b":1,"b":2}]]': None,
            '[{"symbol":"x","b":1,"b":2}],[1]': None, '[{"symbol":"x","b":1,"b":2}]},{"v":1': None, '[{"symbol":"x","b":1,"b":2}],"v":1': None, "[{'symbol':'x'}]": None,
            '[{"symbol":"x","b":NaN}]': None, '[{"symbol":"x"} {"b":1}]': None, "": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r[0]: r[1] for r in df.select("t", json_scalar("t", "$[0].symbol")).collect()} == want
    assert {r[0]: r[1] for r in df.select("t", F.try_parse_json("t").alias("v")).select("t", json_scalar("t", "$[0].symbol", F.col("v"))).collect()} == want


def test_events_with_a_repeated_key_stay(spark):
    rows = [("1", True, True, '[{"symbol":"deploy"},{"map":[{"k":1,"k":2}]}]'), ("2", True, True, '[{"symbol":"other","x":1,"x":2}]'),
            ("3", True, True, '[{"symbol":"deploy"}')]
    events = spark.createDataFrame(rows, "id string, in_successful_contract_call boolean, transaction_successful boolean, topics string")
    assert [r["id"] for r in registry_candidates(events).collect()] == ["1"]


def _decode(spark, data, key, tag, max_pos=None, pick="first", default=None):
    df = spark.createDataFrame([(data,)], "data string")
    return df.select(pair_value(parse_pairs("data"), key, tag, max_pos, pick, default)).first()[0]


def test_case_bank_first_match_and_bounds(spark):
    d = ('{"map":[{"key":{"symbol":"a"},"val":{"string":"first"}},{"key":{"symbol":"b"},"val":{"string":"x"}},'
         '{"key":{"symbol":"a"},"val":{"string":"second"}}]}')
    assert _decode(spark, d, "a", "string", 2) == "first"          # first entry wins
    assert _decode(spark, d, "a", "string", None, "last") == "second"  # assigning loop: last wins
    assert _decode(spark, d, "b", "string", 1) is None              # beyond the probe bound
    assert _decode(spark, d, "a", "address", 4) is None             # wrong tag: NULL, no further probing


def test_batch_decoder_defaults(spark):
    d = '{"map":[{"key":{"symbol":"a"},"val":{"address":"G1"}}]}'
    assert _decode(spark, d, "missing", "string", None, "last", "") == ""   # absent key -> ''
    assert _decode(spark, d, "a", "string", None, "last", "") is None       # present, other tag -> NULL
    assert _decode(spark, "garbage", "a", "string", 2) is None                # malformed payload


def test_object_valued_tag_is_null(spark):
    d = '{"map":[{"key":{"symbol":"a"},"val":{"string":{"nested":1}}}]}'
    assert _decode(spark, d, "a", "string", 2) is None


def test_similarity_values(spark):
    df = spark.createDataFrame([("word", "two words"), ("abcde", "abcde"), (None, "x"), ("", "x"), ("!!", "")],
                               "a string, b string")
    got = [r[0] for r in df.select(similarity("a", "b")).collect()]
    assert round(got[0], 6) == 0.363636 and got[1] == 1.0 and got[2] is None and got[3] == 0.0 and got[4] == 0.0


def test_threshold_in_single_precision(spark):
    # 1/5 in single precision is slightly above 0.2 as double: it passes
    df = spark.createDataFrame([(1, 5)], "c int, u int")
    assert df.select(passes((F.col("c") / F.col("u")).cast("float"))).first()[0] is True


def test_cursors():
    assert C.parse_cursor(None) == (0, "")
    assert C.parse_cursor("12-abc-op-1-event-2") == (12, "12-abc-op-1-event-2-z")
    for bad in ("12", "x-abc", "-1-abc"):
        with pytest.raises(ValueError):
            C.parse_cursor(bad)
    assert C.parse_legacy_cursor("12-abc-op-1-event-2") == (12, "12-abc-z")
    assert C.validate_limit(None) == 200
    for bad in (0, 201, "5"):
        with pytest.raises(ValueError):
            C.validate_limit(bad)
    with pytest.raises(ValueError):
        C.validate_limit(1, legacy=True)


def test_sql_similarity_function(spark):
    from ledgerloom.functions.sql import register_sql_functions
    register_sql_functions(spark)
    r = spark.sql("SELECT similarity('word', 'two words') AS s, similarity(NULL, 'x') AS n, "
                  "similarity('', 'x') AS z").first()
    assert round(r["s"], 6) == 0.363636 and r["n"] is None and r["z"] == 0.0


def test_cursor_column_form(spark):
    df = spark.createDataFrame([("12-abc-op-1-event-2",), ("12",), ("x-y",), (None,)], "c string")
    got = [tuple(r[0]) if r[0] is not None else None for r in df.select(C.cursor_bound_col(F.col("c"))).collect()]
    assert got[0] == (12, "12-abc-op-1-event-2-z")
    assert got[1] == (None, None) and got[2] == (None, None)


def test_pairs_take_the_first_value_of_a_repeated_key(spark):
    from ledgerloom.functions.jsonpath import pair_value, parse_pairs
    entry = '{"map":[{"key":{"symbol":"k"},"val":%s}]}'
    want = {entry % '{"string":"a","string":"b"}': "a", entry % '{"string":"a"},"val":{"string":"b"}': "a",
            entry % '{"string":"a"}}],"map":[{"key":{"symbol":"k"},"val":{"string":"b"}': "a",
            entry % '{"string":{"x":1},"string":"b"}': None, entry % '{"string":"a","address":"b"}': "a", entry % '"a"': None,
            entry % '{"string":null,"string":"b"}': "b",  # a JSON null is no value
            entry % '{"string":"a","string":"b"}' + "x": None,
            '{"map":{"key":1}}': None, '{"map":[1,{"key":{"symbol":"k"},"val":{"string":"a"}}]}': "a", "[1]": None, "": None}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r[0]: r[1] for r in df.select("t", pair_value(parse_pairs("t"), "k", "string", 4)).collect()}
    assert got == want


def test_cursors_hold_digits_alone(spark):
    odd = ["1_0-a", " 10-a", "10 -a", "1e3-a", "99999999999999999999-a", "-5-a"]
    for c in odd:
        with pytest.raises(ValueError):
            C.parse_cursor(c)
    df = spark.createDataFrame([(c,) for c in [*odd, "+10-a"]], "c string")
    got = [r[0]["ledger"] for r in df.select(C.cursor_bound_col(F.col("c"))).collect()]
    assert got == [None] * len(odd) + [10] and C.parse_cursor("+10-a") == (10, "+10-a-z")
