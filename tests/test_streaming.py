import glob
import hashlib
import os
import re
import shutil
import time
from collections import Counter

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from ledgerloom.operators import filters as FL
from ledgerloom.plans.tables import RegistryTables
from ledgerloom.session import state_dir
from ledgerloom.sources.fixture import fixture_paths
from ledgerloom.sources.readers import incremental_reads, read_events, recorded_end, scan_latest_only, stream_end
from ledgerloom.streaming.archive import ArchiveIngest
from ledgerloom.streaming.ingest import RegistryIngest, write_stream_files


def _ids(df):
    return sorted(r[0] for r in df.select("id").collect())


def test_gate_is_independent_of_arrival_order(spark):
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    want_pub, want_reg = _ids(t.published), _ids(t.registries)
    for descending in (False, True):
        src = state_dir(spark, "t-stream-src")
        write_stream_files(t.chain_events, src, 3, descending=descending)
        root = state_dir(spark, "t-stream")
        ing = RegistryIngest(spark, root, t.root_registry, buckets=4)
        ing.run(src, f"{root}/_ckpt", max_files_per_trigger=1)
        assert _ids(ing.table("published_wasms")) == want_pub
        assert _ids(ing.table("registries")) == want_reg
        assert len(ing.metrics) == 3


def test_start_latest_skips_backlog(spark):
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    src = state_dir(spark, "t-latest-src")
    ev = t.chain_events
    mid = 1100
    ev.where(F.col("ledger_sequence") <= mid).write.parquet(src)
    end = stream_end(read_events(spark, src))
    ev.where(F.col("ledger_sequence") > mid).write.mode("append").parquet(src)
    out = state_dir(spark, "t-latest-out")
    q = (scan_latest_only(read_events(spark, src, streaming=True), end).writeStream.format("parquet")
         .option("checkpointLocation", f"{out}-ckpt").trigger(availableNow=True).start(out))
    q.awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == ev.where(F.col("ledger_sequence") > end).count() > 0


def test_duplicated_delivery_is_idempotent(spark):
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    src = state_dir(spark, "t-dup-src")
    write_stream_files(t.chain_events, src, 2)
    t.chain_events.where(F.col("ledger_sequence") % 2 == 0).write.mode("append").parquet(src)  # re-delivered rows
    root = state_dir(spark, "t-dup")
    ing = RegistryIngest(spark, root, t.root_registry, buckets=4)
    ing.run(src, f"{root}/_ckpt", max_files_per_trigger=2)
    assert _ids(ing.table("published_wasms")) == _ids(t.published)
    assert _ids(ing.table("raw_events_backup")) == _ids(t.raw)


def test_audit_of_complete_pipeline_has_only_classified_rows(spark):
    from ledgerloom.operators.audit import audit_dropped, audit_summary
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    summary = audit_summary(audit_dropped(t.raw, t.registries, t.sink_ids()), t.raw, t.registries, t.root_registry).collect()
    assert summary and {r["event_name"] for r in summary} == {"sub_reg"}
    assert {r["reason"] for r in summary} <= {"sub_reg_superseded", "sub_reg_non_root"}


def test_audit_reports_a_lost_registration(spark):
    """Gone, or stored only as of an earlier announcement: a drop each; a superseded announcement is none."""
    from ledgerloom.operators.audit import audit_dropped, audit_reasons
    member = '{{"map":[{{"key":{{"symbol":"contract_id"}},"val":{{"address":"{}"}}}}]}}'
    rows = [("1", 1, "root", member.format("root")), ("2", 2, "root", member.format("a")), ("3", 3, "root", member.format("a")),
            ("4", 4, "root", member.format("gone")), ("5", 5, "root", member.format("old")), ("6", 6, "a", member.format("x")),
            ("7", 7, "root", "{}")]
    raw = spark.createDataFrame([(i, q, e, d, "sub_reg", "t") for i, q, e, d in rows],
                                "id string, ledger_sequence long, emitter_contract_id string, data string, event_name string, transaction_hash string")
    stored = spark.createDataFrame([("root", 1, "1"), ("a", 3, "3"), ("old", 0, "0")], "contract_id string, ledger_sequence long, id string")
    sinks = stored.select("id", F.lit("sub_reg").alias("event_name"))
    got = {r["id"]: r["reason"] for r in audit_reasons(audit_dropped(raw, stored, sinks), raw, stored, "root").collect()}
    assert got == {"2": "sub_reg_superseded", "4": "dropped", "5": "dropped", "6": "sub_reg_non_root", "7": "sub_reg_without_member"}


def test_strangers_are_neither_parked_nor_read(spark):
    """New members are back-filled from the log; a batch without new members reads none of it, whatever it holds."""
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    root = state_dir(spark, "t-gate")
    ing = RegistryIngest(spark, root, t.root_registry, buckets=4)
    reads = []
    plain = ing.raw_log.of_emitters
    ing.raw_log.of_emitters = lambda *a: (reads.append(a), plain(*a))[1]
    ev = t.chain_events.persist()
    first, rest = ev.where(FL.topic_name() != "sub_reg"), ev.where(FL.topic_name() == "sub_reg")
    ing.process_batch(first, 0)     # all of strangers so far
    assert not reads and ing.table("published_wasms").count() == 0
    ing.process_batch(rest, 1)
    assert len(reads) == 1 and _ids(ing.table("published_wasms")) == _ids(t.published)
    before = _ids(ing.table("registered_contracts"))
    ing.process_batch(rest, 2)      # known members again
    ing.process_batch(first, 3)
    assert len(reads) == 1 and _ids(ing.table("registered_contracts")) == before == _ids(t.registered)
    assert _ids(ing.table("raw_events_backup")) == _ids(t.raw)
    assert [m["new_members"] for m in ing.metrics] == [0, t.members.count(), 0, 0]


def test_a_batch_that_failed_behind_its_members_back_fills_again(spark):
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    ing = RegistryIngest(spark, state_dir(spark, "t-retry"), t.root_registry, buckets=4)
    ing.process_batch(t.chain_events.where(FL.topic_name() != "sub_reg"), 0)
    write, ing.sinks["publish"].upsert = ing.sinks["publish"].upsert, None
    announced = t.chain_events.where(FL.topic_name() == "sub_reg")
    with pytest.raises(TypeError):
        ing.process_batch(announced, 1)     # members are stored, publishes not
    ing.sinks["publish"].upsert = write
    ing.process_batch(announced, 1)
    assert _ids(ing.table("published_wasms")) == _ids(t.published) and _ids(ing.table("deployed_contracts")) == _ids(t.deployed)


def test_stored_views_equal_the_batch_views_and_read_each_table_twice_at_most(spark):
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    events, entries = fixture_paths(spark, SF_SMALL)
    root = state_dir(spark, "t-store")
    RegistryIngest(spark, root, t.root_registry).run(events, f"{root}/_ckpt")
    ArchiveIngest(spark, f"{root}/archive").run(entries, events, f"{root}/_archive-ckpt")
    s = RegistryTables.from_store(spark, root, t.root_registry)
    for view in ("latest_published", "versions", "contracts_enriched", "wasm_versions"):
        stored, batch = getattr(s, view), getattr(t, view)
        assert stored.columns == batch.columns
        assert sorted(map(str, stored.collect())) == sorted(map(str, batch.collect()))
        scans = Counter(re.findall(r"Location: \S+ \[([^\],]*?)/v=", stored._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))))
        assert scans and max(scans.values()) <= 2, scans
    plan = s.published_with_channel.where("wasm_name = 'click-1'")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(wasm_name,click-1)" in plan and "parse_json" not in plan


def test_archive_streams_go_on_after_a_stop_between_batches(spark):
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    root = state_dir(spark, "t-archive")
    write_stream_files(t.ledger_entries, f"{root}/entries", 3, "last_modified_ledger_sequence")
    write_stream_files(t.chain_events, f"{root}/events", 2)
    ing = ArchiveIngest(spark, f"{root}/tables", buckets=4, ledger_range=500)
    q = ing.start_entries(f"{root}/entries", f"{root}/c/entries", max_files_per_trigger=1, every="1 second")
    try:
        for _ in range(240):
            if any(p["numInputRows"] for p in q.recentProgress):
                break
            time.sleep(0.25)
    finally:
        q.stop()
    assert 0 < ing.table("wasm_uploads").count()
    again = ArchiveIngest(spark, f"{root}/tables", buckets=4, ledger_range=500)
    again.run(f"{root}/entries", f"{root}/events", f"{root}/c")
    assert _ids(again.table("wasm_uploads")) == _ids(t.uploads) and _ids(again.table("contract_deploys")) == _ids(t.deploys)
    assert _ids(again.table("contract_upgrades")) == _ids(t.upgrades)
    assert sorted(map(str, again.table("wasm_binaries").collect())) == sorted(map(str, t.wasm_binaries.collect()))


def test_a_ledger_fuller_than_the_limit_is_read_on(spark):
    rows = [(f"1000-tx-op-0-event-{k:05d}", 1000, "deploy" if k % 3 else "publish") for k in range(12_000)]
    rows += [(f"1001-tx-op-0-event-{k}", 1001, "deploy") for k in range(5)]
    ev = spark.createDataFrame(rows, "id string, ledger_sequence bigint, event string")
    none = ev.limit(0)
    got = incremental_reads(ev, {"deploys": ("deploy", none), "publishes": ("publish", none)}, 5_000, F.col("event"), state_dir(spark, "t-limit"))
    assert got.count() == got.select("id").distinct().count() == 12_005 and got.agg(F.max("run")).first()[0] == 2
    ahead = ev.where("event = 'publish' and id < '1000-tx-op-0-event-06000'")
    got = incremental_reads(ev, {"deploys": ("deploy", none), "publishes": ("publish", ahead)}, 5_000, F.col("event"), state_dir(spark, "t-limit"))
    assert got.where("target = 'publishes'").count() == 2_000 and got.where("target = 'deploys'").count() == 8_005


def test_the_stream_end_is_recorded_once(spark):
    state = state_dir(spark, "t-end")
    ev = spark.range(5).selectExpr("id as ledger_sequence")
    assert recorded_end(ev, state) == 4
    assert recorded_end(spark.range(50).selectExpr("id as ledger_sequence"), state) == 4
    assert recorded_end(ev.limit(0), state_dir(spark, "t-end")) == 0


def test_catch_up_takes_the_same_jobs_however_many_runs_there_are(spark):
    ev = spark.range(3_000).selectExpr("lpad(id, 6, '0') id", "1000 + id div 7 ledger_sequence", "if(id % 3 = 0, 'publish', 'deploy') event")
    none, jobs = ev.limit(0), []
    for limit in (1_000, 20):
        group = f"t-catch-up-{limit}"
        spark.sparkContext.setJobGroup(group, group)
        got = incremental_reads(ev, {"deploys": ("deploy", none), "publishes": ("publish", none)}, limit, F.col("event"), state_dir(spark, "t-runs"))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
        want = {(f"{i:06d}", 1000 + i // 7, "deploys" if i % 3 else "publishes", i // limit) for i in range(3_000)}
        assert {tuple(r) for r in got.select("id", "ledger_sequence", "target", "run").collect()} == want
    assert jobs[1] <= jobs[0] + 2    # a listing of many folders is a job
    spark.sparkContext.setJobGroup("tests", "tests")


def test_a_derived_stream_is_shuffled_narrow_and_written_when_it_is_read(spark, tmp_path):
    """Only what the ledger and the rows are made of goes through the shuffle; the payloads are made behind it."""
    from ledgerloom.sources import bridge
    from ledgerloom.session import checkpoint_dir, local_path
    placed = bridge.chain_events(spark.read.parquet(f"{SF_SMALL}/events.parquet"), lambda d: d.repartitionByRange(4, F.expr(bridge.EVENT_LEDGER)))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    below = placed._jdf.queryExecution().explainString(mode).split("Exchange rangepartitioning")[1]
    assert "invoke_host_function" not in below and "md5" not in below
    (tmp_path / "in").mkdir()
    for name in ("events", "orders"):
        shutil.copytree(f"{SF_SMALL}/{name}.parquet", tmp_path / "in" / f"{name}.parquet") if os.path.isdir(f"{SF_SMALL}/{name}.parquet") \
            else shutil.copy(f"{SF_SMALL}/{name}.parquet", tmp_path / "in" / f"{name}.parquet")
    folders = lambda table: set(glob.glob(f"{local_path(checkpoint_dir(spark))}/ledgerloom/fixture-*/{table}"))
    before = folders("chain_events"), folders("ledger_entries")
    t = RegistryTables.from_fixture(spark, str(tmp_path / "in"))
    assert t.ledger_entries.count() > 0
    assert folders("chain_events") == before[0] and len(folders("ledger_entries")) == len(before[1]) + 1
    assert t.chain_events.count() > 0 and len(folders("chain_events")) == len(before[0]) + 1


def test_a_batch_is_not_read_back_from_the_log(spark):
    """The rows of new members come from the batch at hand and from earlier batches only."""
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    ing = RegistryIngest(spark, state_dir(spark, "t-once"), t.root_registry, buckets=4)
    back = []
    plain = ing.raw_log.of_emitters
    ing.raw_log.of_emitters = lambda *a: (back.append(plain(*a)), back[-1])[1]
    ing.process_batch(t.chain_events, 0)
    assert len(back) == 1 and back[0].count() == 0 and _ids(ing.table("published_wasms")) == _ids(t.published)


def test_pairs_of_a_hot_hash_are_dealt_to_many_tasks(spark):
    from ledgerloom.operators.views import wasm_versions
    u = spark.range(64).selectExpr("if(id < 60, 'hot', concat('u', id)) wasm_hash", "cast(id as string) id", "id ledger_sequence", "current_timestamp() closed_at", "'t' transaction_hash")
    p = spark.range(40).selectExpr("if(id < 39, 'hot', 'other') wasm_hash", "cast(id as string) id", "'t' transaction_hash", "id ledger_sequence", "current_timestamp() created_at",
                                   "'a' author", "'n' wasm_name", "'1' wasm_version", "'r' emitter_contract_id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = wasm_versions(u, p).withColumn("task", F.spark_partition_id())
        pairs = got.groupBy("upload_id", "publish_id").count()
        assert pairs.count() == got.count() == 60 * 39 + 4 and got.where("publish_id is null").count() == 4
        assert got.where("wasm_hash = 'hot'").select("task").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _uploads(spark, rows):
    return spark.createDataFrame(rows, "wasm_hash string, id string").selectExpr("wasm_hash", "id", "1L ledger_sequence", "current_timestamp() closed_at", "'t' transaction_hash")


def _publishes(spark, rows):
    return spark.createDataFrame(rows, "wasm_hash string, id string").selectExpr(
        "wasm_hash", "id", "'t' transaction_hash", "1L ledger_sequence", "current_timestamp() created_at", "'a' author", "'n' wasm_name", "'1' wasm_version", "'r' emitter_contract_id")


@pytest.mark.parametrize("part_pairs, part_rows, block_rows", [(1 << 27, 1 << 16, 256), (50, 9, 4), (200, 1000, 7)])
def test_pairs_are_whole_however_a_hash_is_dealt(spark, monkeypatch, part_pairs, part_rows, block_rows):
    """Many of both sides, of one alone, of none; hashes and ids that are null, ids that repeat."""
    from ledgerloom.operators import views as V
    for name, n in (("_PART_PAIRS", part_pairs), ("_PART_ROWS", part_rows), ("_BLOCK_ROWS", block_rows)):
        monkeypatch.setattr(V, name, n, raising=False)
    numbers = {"both": (40, 30), "uploads": (60, 1), "publishes": (1, 70), "bare": (50, 0), "strange": (0, 45), "one": (1, 1), None: (33, 21)}
    u = [(h, f"u{h}{k % 35}") for h, (n, _) in numbers.items() for k in range(n)] + [("both", None), ("both", None)]
    p = [(h, f"p{h}{k % 25}") for h, (_, n) in numbers.items() for k in range(n)] + [("both", None)]
    want = Counter((h, a, b) for h, a in u for b in ([y for x, y in p if x is not None and x == h] or ["none"]))
    got = V.wasm_versions(_uploads(spark, u), _publishes(spark, p)).select("wasm_hash", "upload_id", "publish_id", "author").collect()
    assert Counter((r[0], r[1], r[2] if r.author else "none") for r in got) == want


def test_pairs_are_stored_in_runs(spark, tmp_path):
    """A publish's pairs with a block of uploads are together, and uploads come again in short cycles, so files grow much slower than pairs."""
    from ledgerloom.operators.views import wasm_versions
    u, p = ([("h", f"{side}{k:05d}-{hashlib.md5(str(k).encode()).hexdigest()}") for k in range(n)] for side, n in (("u", 600), ("p", 900)))
    wasm_versions(_uploads(spark, u), _publishes(spark, p)).write.parquet(str(tmp_path / "pairs"))
    rows = changes = size = 0
    for f in glob.glob(f"{tmp_path}/pairs/*.parquet"):
        ids = pq.read_table(f, columns=["publish_id"])["publish_id"].to_pylist()
        rows, changes, size = rows + len(ids), changes + sum(a != b for a, b in zip(ids, ids[1:])), size + os.path.getsize(f)
    assert rows == 600 * 900 and changes < rows / 50 and size < rows


def _formatted(spark, df):
    return df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_a_batch_is_read_from_the_log_by_kind_and_not_held_in_memory(spark):
    """A sink's rows come from the stored batch: the narrow columns and its kind alone, nothing persisted on the way."""
    from ledgerloom.session import local_path
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    ing = RegistryIngest(spark, state_dir(spark, "t-narrow"), t.root_registry, buckets=4)
    plain, plans, held = ing.sinks["publish"].upsert, [], []

    def upsert(batch, *how, **more):
        plans.append(_formatted(spark, batch))
        held.append(spark.sparkContext._jsc.getPersistentRDDs().size())
        return plain(batch, *how, **more)

    ing.sinks["publish"].upsert = upsert
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    ing.process_batch(t.chain_events, 0)
    assert held == [before] and "InMemoryTableScan" not in plans[0]
    assert "EqualTo(event_name,publish)" in plans[0] and "operation_body:" not in plans[0]
    assert sorted(map(str, ing.table("published_wasms").collect())) == sorted(map(str, t.published.collect()))
    files = glob.glob(f"{local_path(ing.raw_log.root)}/run=*/batch=0/emitter_bucket=*/*.parquet")
    for f in files:
        kinds = [r[0] for r in spark.read.parquet(f).coalesce(1).select("event_name").collect()]
        assert kinds == sorted(kinds)
    assert sorted(map(str, ing.raw_log.of_batch(None, 0).collect())) == sorted(map(str, t.raw.collect()))


def test_an_archive_batch_is_not_held_in_memory(spark):
    """Tables read their kinds of entries from the files; of a hash's uploads one reaches the keyed table."""
    t = RegistryTables.from_fixture(spark, SF_SMALL)
    ing = ArchiveIngest(spark, state_dir(spark, "t-archive-narrow"), buckets=4)
    given = {}
    for name in ("uploads", "binaries", "deploys"):
        table = getattr(ing, name)

        def upsert(batch, *how, plain=table.upsert, name=name, **more):
            given[name] = (_formatted(spark, batch), batch.count())
            return plain(batch, *how, **more)

        table.upsert = upsert
    ing.process_entries(t.ledger_entries, 0)
    assert given["binaries"][1] == t.wasm_binaries.count() < t.uploads.count() == given["uploads"][1]
    assert all("InMemoryTableScan" not in plan for plan, _ in given.values())
    assert _ids(ing.table("wasm_uploads")) == _ids(t.uploads) and _ids(ing.table("contract_deploys")) == _ids(t.deploys)
    assert sorted(map(str, ing.table("wasm_binaries").collect())) == sorted(map(str, t.wasm_binaries.collect()))
