import glob

import pytest
from pyspark.sql import types as T

from ledgerloom.operators.sinks import KeyedTable
from ledgerloom.session import state_dir

SCH = T.StructType([T.StructField("k", T.StringType()), T.StructField("ledger_sequence", T.LongType()),
                    T.StructField("id", T.StringType()), T.StructField("v", T.StringType())])


def _rows(t):
    return sorted(tuple(r) for r in t.read().collect())


def test_upsert_last_wins_and_is_idempotent(spark):
    kt = KeyedTable(spark, state_dir(spark, "t-upsert"), ["k"], SCH, ["ledger_sequence", "id"], buckets=4)
    b1 = spark.createDataFrame([("a", 1, "1", "x"), ("b", 2, "2", "y"), ("a", 3, "3", "z")], SCH)
    b2 = spark.createDataFrame([("a", 2, "9", "older"), ("c", 5, "5", "w")], SCH)
    kt.upsert(b1, 0)
    kt.upsert(b2, 1)
    before = _rows(kt)
    kt.upsert(b2, 1)          # retried batch id: no-op
    kt.upsert(b1, 2)          # replayed data: same result
    assert _rows(kt) == before == [("a", 3, "3", "z"), ("b", 2, "2", "y"), ("c", 5, "5", "w")]


def test_insert_ignore_first_wins(spark):
    kt = KeyedTable(spark, state_dir(spark, "t-ins"), ["k"], SCH, buckets=4)
    _, n1 = kt.insert_ignore(spark.createDataFrame([("a", 1, "1", "x"), ("a", 0, "0", "earlier")], SCH), 0,
                             ("ledger_sequence", "id"))
    _, n2 = kt.insert_ignore(spark.createDataFrame([("a", 9, "9", "late"), ("b", 2, "2", "y")], SCH), 1,
                             ("ledger_sequence", "id"))
    assert (n1, n2) == (1, 1)
    assert _rows(kt) == [("a", 0, "0", "earlier"), ("b", 2, "2", "y")]


def test_versions_rollback_and_vacuum(spark):
    kt = KeyedTable(spark, state_dir(spark, "t-ver"), ["k"], SCH, buckets=2)
    kt.overwrite(spark.createDataFrame([("a", 1, "1", "v1")], SCH))
    kt.overwrite(spark.createDataFrame([("a", 1, "1", "v2"), ("b", 1, "2", "v2")], SCH))
    assert len(_rows(kt)) == 2
    kt.rollback(1)
    assert _rows(kt) == [("a", 1, "1", "v1")]
    assert kt.vacuum(keep=1) == [2]
    assert _rows(kt) == [("a", 1, "1", "v1")]


def test_upsert_over_random_splits_equals_latest_per_key(spark):
    """Property: any split of the rows into ordered micro-batches gives the latest row per key."""
    import random

    from ledgerloom.operators.latest import latest_per_key
    rnd = random.Random(11)
    rows = [(f"k{rnd.randint(0, 9)}", rnd.randint(0, 20), f"{i:03d}", f"v{i}") for i in range(120)]
    want = sorted(tuple(r) for r in latest_per_key(spark.createDataFrame(rows, SCH), ["k"],
                                                   ("-ledger_sequence", "-id")).collect())
    for trial in range(2):
        shuffled = rows[:]
        rnd.shuffle(shuffled)
        cuts = sorted(rnd.sample(range(1, len(rows)), 3))
        parts = [shuffled[a:b] for a, b in zip([0] + cuts, cuts + [len(rows)])]
        kt = KeyedTable(spark, state_dir(spark, "t-prop"), ["k"], SCH, ["ledger_sequence", "id"], buckets=3)
        for i, part in enumerate(parts):
            kt.upsert(spark.createDataFrame(part, SCH), i)
        assert _rows(kt) == want


def test_failed_attempt_does_not_block_a_retry(spark):
    t = KeyedTable(spark, state_dir(spark, "retry"), ["id"], T.StructType([T.StructField("id", T.StringType())]))
    batch = spark.createDataFrame([("a",), ("b",)], "id string")
    commit, t._commit = t._commit, lambda m: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        t.upsert(batch, 0)
    t._commit = commit
    t.upsert(batch, 0)
    assert t.read().count() == 2
    assert len(t.vacuum()) == 1 and t.read().count() == 2


def test_batch_ids_count_within_a_run(spark):
    t = KeyedTable(spark, state_dir(spark, "runs"), ["id"], T.StructType([T.StructField("id", T.StringType())]))
    t.run = "first"
    t.upsert(spark.createDataFrame([("a",)], "id string"), 3)
    t.upsert(spark.createDataFrame([("b",)], "id string"), 3)  # a retried batch is applied once
    assert t.read().count() == 1
    t.run = "replay"
    t.upsert(spark.createDataFrame([("b",)], "id string"), 0)
    assert t.read().count() == 2


def test_similarity_join_keeps_pairs_at_the_threshold(spark):
    from ledgerloom.operators.search import similarity_join
    got = similarity_join(spark.createDataFrame([("a",)], "q string"), "q", spark.createDataFrame([("a bcdefgh",)], "n string"), "n")
    assert got.count() == 1


def _files(kt):
    from ledgerloom.session import local_path
    m = kt.manifest()
    return {int(b): len(glob.glob(f"{local_path(kt.root)}/v={v}/__bucket={b}/*.parquet")) for b, v in m["buckets"].items()}


def test_a_full_bucket_is_written_by_many_tasks(spark, monkeypatch):
    """All ledgers in one range, as when the rows grow and the ledgers don't: no task, and no file, holds the whole bucket."""
    from ledgerloom.operators import sinks
    monkeypatch.setattr(sinks, "_FILE_ROWS", 100)
    rows = spark.range(2_000).selectExpr("cast(id as string) k", "1 + id % 3 ledger_sequence", "cast(id as string) id", "'v' v")
    for where in ({"range_col": "ledger_sequence", "range_width": 500}, {"buckets": 2}):
        kt = KeyedTable(spark, state_dir(spark, "t-full"), ["k"], SCH, ["ledger_sequence", "id"], **where)
        kt.upsert(rows, 0)
        assert min(_files(kt).values()) > 3
        assert _rows(kt) == sorted(tuple(r) for r in rows.collect())
    kt.overwrite(rows.where("id < 1000"))
    assert min(_files(kt).values()) > 1


def test_ranges_get_wider_instead_of_more(spark):
    kt = KeyedTable(spark, state_dir(spark, "t-wide"), ["k"], SCH, ["ledger_sequence", "id"], range_col="ledger_sequence", range_width=10)
    rows = spark.range(3_000).selectExpr("cast(id as string) k", "id ledger_sequence", "cast(id as string) id", "'v' v")
    kt.upsert(rows.where("id < 500"), 0)
    assert len(_files(kt)) == 50
    kt.upsert(rows.where("id >= 500"), 1)
    kt.upsert(rows.where("id >= 500"), 1)     # a retried batch
    kt.upsert(rows.where("id % 7 = 0").selectExpr("k", "ledger_sequence", "id", "'again' v"), 2)
    assert len(_files(kt)) <= 64
    kt.insert_ignore(rows.where("id < 100"), 3)
    assert _rows(kt) == sorted((str(i), i, str(i), "v" if i % 7 else "again") for i in range(3_000))
    old = kt.manifest()["version"]
    kt.overwrite(rows.where("id < 100"))
    kt.rollback(old)
    kt.upsert(rows.where("id = 2999").selectExpr("k", "ledger_sequence", "id", "'last' v"), 4)
    assert kt.read().where("v = 'last'").count() == 1 and kt.read().count() == 3_000


def test_the_raw_backup_of_a_frequent_kind_is_split(spark):
    from ledgerloom.operators.sinks import write_raw_backup
    from ledgerloom.session import local_path
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "20k")
    try:
        raw = spark.range(0, 40_000, 1, 8).selectExpr("md5(cast(id as string)) id", "if(id % 100 = 0, 'deploy', 'publish') event_name")
        path = state_dir(spark, "t-backup")
        write_raw_backup(raw, path)
    finally:
        spark.conf.unset(key)
    assert len(glob.glob(f"{local_path(path)}/event_name=publish/*.parquet")) > 3
    assert spark.read.parquet(path).groupBy("event_name").count().sort("event_name").collect() == [("deploy", 400), ("publish", 39_600)]
