import json
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import decode as D
from ledgerloom.operators import detail as DT
from ledgerloom.operators import paging as P
from ledgerloom.operators import search as S
from ledgerloom.operators import sinks as SK
from ledgerloom.operators.latest import latest_per_key, sequence_index
from ledgerloom.sources.readers import artifact_catalog, reload_artifacts


def test_latest_desc_puts_nulls_first(spark):
    df = spark.createDataFrame([("n", 5, "1.0", "a"), ("n", 5, None, "b"), ("n", 4, "9.9", "c")],
                               "wasm_name string, ledger_sequence long, wasm_version string, id string")
    row = latest_per_key(df, ["wasm_name"], ("-ledger_sequence", "-wasm_version", "-id")).first()
    assert row["id"] == "b"   # same ledger, NULL version sorts first under DESC


def test_text_versions_compare_as_text(spark):
    df = spark.createDataFrame([("n", 5, "0.9.0", "a"), ("n", 5, "0.10.0", "b")],
                               "wasm_name string, ledger_sequence long, wasm_version string, id string")
    assert latest_per_key(df, ["wasm_name"], ("-ledger_sequence", "-wasm_version", "-id")).first()["id"] == "a"


def test_sequence_index_equals_row_number(spark):
    rnd = random.Random(7)
    rows = [(f"k{rnd.randint(0, 3)}", rnd.randint(0, 30), f"s{i:04d}") for i in range(500)]
    rows += [(None, 3, "s9999")]
    df = spark.createDataFrame(rows, "k string, seq long, sid string")
    got = sequence_index(df, "k", "seq", "sid").select("sid", "version_index")
    w = Window.partitionBy("k").orderBy("seq", "sid")
    want = df.select("sid", (F.row_number().over(w) - 1).cast("long").alias("version_index"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_page_export_matches_global_order(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 50), f"{i:05d}-x") for i in range(777)]
    df = spark.createDataFrame(rows, "ledger_sequence long, id string")
    got = P.page_export(df, 50, partitions=5).select("id", "row_index", "page").collect()
    ordered = sorted(rows)
    want = {r[1]: i for i, r in enumerate(ordered)}
    assert len(got) == 777
    assert all(r["row_index"] == want[r["id"]] and r["page"] == want[r["id"]] // 50 for r in got)


def test_keyset_pages_concatenate_to_full_list(spark):
    rows = [(l, f"{l}-{t}-op-1-event-{e}") for l in range(5) for t in ("a", "b") for e in range(3)]
    df = spark.createDataFrame(rows, "ledger_sequence long, id string")
    seen, cursor = [], None
    while True:
        page = [r["id"] for r in P.keyset_page(df, 4, cursor).collect()]
        seen += page
        if len(page) < 4:
            break
        cursor = page[-1]
    assert seen == [r[1] for r in sorted(rows)]


def test_similarity_join_equals_brute_force(spark):
    names = ["red widget", "blue bolt", "small ring", "red ring", "widgets", "bolt", "x", None]
    queries = ["red", "ring", "widget", "zzz"]
    ndf = spark.createDataFrame([(n,) for n in names], "name string")
    qdf = spark.createDataFrame([(q,) for q in queries], "q string")
    got = {(r["query"], r["name"]): r["similarity"] for r in S.similarity_join(qdf, "q", ndf, "name").collect()}
    from ledgerloom.functions.trigram import similarity
    import itertools
    pair_rows = list(itertools.product(queries, sorted({n for n in names if n is not None})))
    pairs = spark.createDataFrame(pair_rows, "q string, name string")   # brute force on a literal fixture
    brute = pairs.select("q", "name", similarity("q", "name").cast("double").alias("s")).where("s > 0.2")
    want = {(r["q"], r["name"]): round(r["s"], 6) for r in brute.collect()}
    assert got == want and len(want) > 0


def test_constraint_split_statuses(spark):
    df = spark.createDataFrame([("a", "t", 1), ("a", "t", 2), (None, "t", 3), ("b", None, 4), ("c", "t", 5)],
                               "id string, transaction_hash string, ledger_sequence long")
    got = {r["ledger_sequence"]: r["constraint_status"] for r in
           SK.constraint_split(df, ["id"], ["id", "transaction_hash", "ledger_sequence"]).collect()}
    assert got == {1: "duplicate_key", 2: "duplicate_key", 3: "null_id", 4: "null_transaction_hash", 5: "ok"}


def test_unnest_arrays(spark):
    df = spark.createDataFrame([(["a", "b"], [1, 2])], "ids array<string>, seqs array<long>")
    assert [tuple(r) for r in SK.unnest_arrays(df, ["ids", "seqs"]).collect()] == [("a", 1), ("b", 2)]


def test_meta_fold_last_duplicate_wins(spark):
    df = spark.createDataFrame([("h", [("rsver", "1"), ("junk", "x"), ("rsver", "2"), ("binver", "7")])],
                               "wasm_hash string, entries array<struct<key:string,val:string>>")
    r = D.meta_fold(df).first()
    assert r["rsver"] == "2" and r["binver"] == "7" and r["cliver"] is None


def test_artifact_catalog_right_split(spark):
    paths = ["/d/a@b@1.0.wasm", "/d/plain.wasm", "/d/@1.wasm", "/d/n@.wasm", "/d/ok@2.wasm", "/d/sub/x@1.wasm"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = {(r["wasm_name"], r["wasm_version"]) for r in artifact_catalog(df, top_dir="/d").collect()}
    assert got == {("a@b", "1.0"), ("ok", "2")}


def test_artifact_manifest_keeps_null_channel(spark):
    df = spark.createDataFrame([("n", "1", "h", None), ("m", "2", "h", "unverified"), (None, None, "h", "root")],
                               "wasm_name string, wasm_version string, wasm_hash string, channel string")
    got = sorted(r["file_name"] for r in SK.artifact_manifest(df).collect())
    assert got == ["None@None.wasm", "n@1.wasm"]


def test_artifacts_reloaded_from_a_folder(spark, tmp_path):
    for name in ("a@b@1.0.wasm", "ok@2.wasm", "plain.wasm", "n@.wasm", "@3.wasm", "ok@3.txt", "sub/x@1.wasm"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"\0asm")
    got = {(r["file_name"], r["wasm_name"], r["wasm_version"]) for r in reload_artifacts(spark, str(tmp_path)).collect()}
    assert got == {("a@b@1.0.wasm", "a@b", "1.0"), ("ok@2.wasm", "ok", "2")}


def test_artifact_folder_is_compared_whole(spark):
    df = spark.createDataFrame([("file:/d/a@1.wasm",), ("/x/d/b@1.wasm",), ("hdfs://host:8020/d/c@1.wasm",)], "path string")
    assert {r["wasm_name"] for r in artifact_catalog(df, top_dir="/d/").collect()} == {"a", "c"}


def test_envelope_and_next(spark):
    rows = [(l, f"{l}-{t}-op-1-event-0", None if t == "a" else t) for l in range(5) for t in ("a", "b")]
    df = spark.createDataFrame(rows, "ledger_sequence long, id string, name string")
    seen, cursor = [], None
    while True:
        page = P.keyset_page(df, 4, cursor)
        got = json.loads(P.json_envelope(page, [("name", "n")], 4).first()["json"])
        seen += [x["n"] for x in got["result"]]
        cursor = P.next_of(page, 4)
        assert got["next"] == cursor
        if cursor is None:
            break
    assert seen == [None, "b"] * 5
    assert P.json_envelope(df.limit(0), [("name", "n")], 4).first()["json"] == '{"result":[],"next":null}'


def test_legacy_cursor_skips_the_transaction(spark):
    rows = [(l, f"{l}-{t}-op-1-event-{e}", f"{l}{t}{e}", "1", "me", "h") for l in (3, 4) for t in ("a", "b") for e in (0, 1)]
    df = spark.createDataFrame(rows, "ledger_sequence long, id string, wasm_name string, version string, author string, wasm_hash string")
    cursor = P.next_of(P.legacy_rows(df, 3, None), 3)
    assert cursor == "3-b-op-1-event-0"
    assert [r["wasm_name"] for r in P.legacy_rows(df, 3, cursor).collect()] == ["4a0", "4a1", "4b0"]


def test_lookups_have_a_row_for_every_key(spark):
    cols = "id string, transaction_hash string, ledger_sequence long, created_at timestamp_ntz, channel string, author string, " \
           "wasm_version string, wasm_name string, wasm_hash string"
    rows = [(f"{i}", "t", i, None, "root", "a", v, "n", "h") for i, v in ((1, "1"), (2, "2"), (3, None))]
    source = spark.createDataFrame(rows, cols)
    keys = spark.createDataFrame([("n", "root", "1"), ("n", "root", "9"), ("n", "other", "1"), (None, "root", "1"), ("n", "root", "1")],
                                 "wasm_name string, channel string, wasm_version string")
    got = {tuple(r)[:3]: (r["status"], r["error"], r["id"]) for r in DT.wasm_lookup(source, keys, version=True).collect()}
    missing = "Wasm 'n' version '{}' not found"
    assert got == {("n", "root", "1"): ("found", None, "1"), ("n", "root", "9"): ("not_found", missing.format(9), None),
                   ("n", "other", "1"): ("not_found", missing.format(1), None), (None, "root", "1"): ("not_found", "Wasm '' version '1' not found", None)}
    got = {tuple(r)[:2]: (r["status"], r["id"]) for r in DT.wasm_lookup(source, keys).collect()}
    assert got == {("n", "root"): ("found", "3"), ("n", "other"): ("not_found", None), (None, "root"): ("not_found", None)}


def test_deploy_outcomes(spark):
    registered = spark.createDataFrame([("c1", "n1", "root", 1, "1"), ("c2", "n2", "root", 1, "2"), ("c3", "n3", "root", 1, "3")],
                                       "contract_id string, contract_name string, channel string, ledger_sequence long, id string")
    deployed = spark.createDataFrame([("c1", "d", "t1", 1, "1"), ("c2", "d", "t2", 1, "2")],
                                     "contract_id string, deployer string, transaction_hash string, ledger_sequence long, id string")
    raw = spark.createDataFrame([("t1", "body", "1", "deploy"), ("t2", None, "2", "deploy")],
                                "transaction_hash string, operation_body string, id string, event_name string")
    keys = spark.createDataFrame([(f"n{i}", "root") for i in range(1, 5)], "contract_name string, channel string")
    got = {r["requested_name"]: r["status"] for r in DT.deploy_detail(registered, deployed, raw, keys).collect()}
    assert got == {"n1": "found", "n2": "no_deploy_body", "n3": "no_deploy_body", "n4": "not_found"}
