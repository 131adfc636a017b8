"""Scans of the change streams and the small position lookups around them.

Real deployments read the provider's stored Parquet with an explicit schema; the start position
is a plain predicate on the stored ``ledger_sequence`` column, so it reaches the Parquet reader as
a pushed filter and row groups below the start are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.event_log import exists
from ..operators.latest import global_index
from ..schemas import CHAIN_EVENTS, LEDGER_ENTRIES


def read_events(spark: SparkSession, path: str, start_at: int | None = None,
                streaming: bool = False, max_files_per_trigger: int | None = None) -> DataFrame:
    """Event stream from ``start_at`` (inclusive), batch or Structured Streaming."""
    if streaming:
        reader = spark.readStream.schema(CHAIN_EVENTS)
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
        df = reader.parquet(path)
    else:
        df = spark.read.schema(CHAIN_EVENTS).parquet(path)
    return scan_from(df, start_at)


def read_ledger_entries(spark: SparkSession, path: str, start_at: int | None = None,
                        streaming: bool = False) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    df = reader.schema(LEDGER_ENTRIES).parquet(path)
    return scan_from(df, start_at, "last_modified_ledger_sequence")


def scan_from(df: DataFrame, start_at: int | None, seq_col: str = "ledger_sequence") -> DataFrame:
    """Rows at or after ``start_at``; no bound when None."""
    return df if start_at is None else df.where(F.col(seq_col) >= F.lit(int(start_at)))


def stream_end(df: DataFrame, seq_col: str = "ledger_sequence") -> int:
    """Present end of a stored stream (one aggregate row); 0 when empty."""
    return int(df.agg(F.coalesce(F.max(seq_col), F.lit(0))).first()[0])


def recorded_end(df: DataFrame, state: str, seq_col: str = "ledger_sequence") -> int:
    """The stream's end when a job first started: found once, kept in the job's folder ``state`` and read from there on every restart."""
    spark, path = df.sparkSession, f"{state}/stream_end"
    if not exists(spark, f"{path}/_SUCCESS"):
        df.agg(F.coalesce(F.max(seq_col), F.lit(0)).cast("bigint").alias("end")).write.mode("overwrite").parquet(path)
    return int(spark.read.schema("end bigint").parquet(path).first()[0])


def scan_latest_only(df: DataFrame, as_of_end: int, seq_col: str = "ledger_sequence") -> DataFrame:
    """``start_at: latest``: only rows after the stream's end at the time the job started
    (``as_of_end``, e.g. from ``stream_end`` before the stream is started)."""
    return df.where(F.col(seq_col) > F.lit(int(as_of_end)))


def high_water(df: DataFrame, seq_col: str = "ledger_sequence") -> Column:
    """Aggregate expression: highest sequence in a target table, 0 when empty."""
    return F.coalesce(F.max(seq_col), F.lit(0)).cast("bigint")


def high_waters(targets: dict[str, DataFrame], seq_col: str = "ledger_sequence") -> DataFrame:
    """One row: per-target high water columns plus their minimum (the shared read start)."""
    tagged = None
    for name, df in targets.items():
        part = df.select(F.lit(name).alias("_target"), F.col(seq_col).cast("bigint").alias("_seq"))
        tagged = part if tagged is None else tagged.unionByName(part)
    out = tagged.agg(*[
        F.coalesce(F.max(F.when(F.col("_target") == name, F.col("_seq"))), F.lit(0)).cast("bigint").alias(name)
        for name in targets])
    return out.withColumn("read_from", F.least(*[F.col(n) for n in targets]))


def read_increment(events: DataFrame, from_inclusive, limit: int,
                   seq_col: str = "ledger_sequence", id_col: str = "id") -> DataFrame:
    """Next batch: ``seq >= from ORDER BY seq, id LIMIT n`` (id breaks ties, so the batch is
    deterministic). ``from_inclusive`` may be an int or a one-row DataFrame column value."""
    bound = F.lit(int(from_inclusive)) if isinstance(from_inclusive, int) else from_inclusive
    return events.where(F.col(seq_col) >= bound).orderBy(seq_col, id_col).limit(int(limit))


#: Scheme and host of a path, which a listing may add.
_STORE = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def read_artifact_paths(spark: SparkSession, directory: str) -> DataFrame:
    """Paths of ``*.wasm`` files directly inside ``directory`` (no sub-folders)."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", "*.wasm")
          .option("recursiveFileLookup", "false").load(directory).select("path"))
    return df


def artifact_catalog(paths: DataFrame, path_col: str = "path", top_dir: str | None = None) -> DataFrame:
    """Split ``<name>@<version>.wasm`` file names from the right on '@'; files that do not have
    that shape (or whose name or version is empty) are skipped. With ``top_dir`` only files
    directly inside it are kept."""
    p = F.col(path_col)
    fname = F.regexp_extract(p, r"([^/]+)$", 1)
    name = F.regexp_extract(fname, r"^(.*)@([^@]*)\.wasm$", 1)
    version = F.regexp_extract(fname, r"^(.*)@([^@]*)\.wasm$", 2)
    out = paths.select(p.alias("path"), fname.alias("file_name"),
                       name.alias("wasm_name"), version.alias("wasm_version"))
    cond = (F.col("wasm_name") != "") & (F.col("wasm_version") != "")
    if top_dir is not None:
        parent = F.regexp_extract(F.col("path"), r"^(.*)/[^/]+$", 1)
        cond = cond & (F.regexp_replace(parent, _STORE, "") == F.regexp_replace(F.lit(top_dir.rstrip("/")), _STORE, ""))
    return out.where(cond)


def reload_artifacts(spark: SparkSession, directory: str) -> DataFrame:
    """path, file_name, wasm_name and wasm_version of the artifact files directly inside ``directory``."""
    return artifact_catalog(read_artifact_paths(spark, directory), top_dir=directory)


def incremental_step(events: DataFrame, targets: dict, limit: int, name_col_expr: Column,
                     seq_col: str = "ledger_sequence", id_col: str = "id") -> DataFrame:
    """One run of the batch ingest: high water per target (0 when empty), one shared read from the
    smallest of them (``seq >= min ORDER BY seq, id LIMIT n``), and routing with each target's own
    inclusive bound. ``targets`` maps target name -> (event name, target table). Returns the routed
    rows with ``target``, the target's bound ``read_bound``, and the target's next high water
    ``next_high_water`` (max of the old one and the batch's highest sequence; +1 when the batch was
    shorter than ``limit``, i.e. the end of the stream was reached).

    The high waters and the batch statistics are one-row aggregates read as scalars, so the bounds
    are literal predicates (pushed to the scan) rather than joins."""
    hw = high_waters({name: tbl for name, (_, tbl) in targets.items()}, seq_col).first().asDict()
    batch = read_increment(events, int(hw["read_from"]), limit, seq_col, id_col).persist()
    stats = batch.agg(F.coalesce(F.max(seq_col), F.lit(0)).alias("mx"), F.count(F.lit(1)).alias("n")).first()
    at_end = 1 if stats["n"] < int(limit) else 0
    routed = None
    for name, (event, _) in targets.items():
        bound = int(hw[name])
        part = batch.where((name_col_expr == F.lit(event)) & (F.col(seq_col) >= F.lit(bound))).select(
            F.col(id_col), F.col(seq_col), F.lit(name).alias("target"), F.lit(bound).cast("bigint").alias("read_bound"),
            F.lit(max(bound, int(stats["mx"])) + at_end).cast("bigint").alias("next_high_water"))
        routed = part if routed is None else routed.unionByName(part)
    return routed


def progress_of(targets: dict[str, DataFrame], seq_col: str = "ledger_sequence", id_col: str = "id") -> dict[str, tuple[int, str]]:
    """(sequence, id) of the last row in each target, (0, '') when empty: one aggregate a target, read as scalars."""
    out = {}
    for name, df in targets.items():
        last = df.agg(F.max(F.struct(F.col(seq_col).cast("bigint").alias("seq"), F.col(id_col).alias("id"))).alias("last")).first()["last"]
        out[name] = (int(last["seq"]), last["id"]) if last else (0, "")
    return out


def after(place: tuple[int, str], seq_col: str = "ledger_sequence", id_col: str = "id") -> Column:
    """Rows behind ``place`` in (sequence, id) order; the bound on the sequence alone reaches the scan."""
    seq, row_id = F.lit(int(place[0])), F.lit(place[1])
    return (F.col(seq_col) >= seq) & ((F.col(seq_col) > seq) | (F.col(id_col) > row_id))


def incremental_reads(events: DataFrame, targets: dict, limit: int, name_col_expr: Column, state: str,
                      seq_col: str = "ledger_sequence", id_col: str = "id") -> DataFrame:
    """All runs of the batch ingest up to the stream's end: each reads the next ``limit`` events in (sequence, id) order behind the least
    advanced target and gives every target its own, those behind its own progress. ``targets``: name -> (event name, table).

    Progress is a (sequence, id) pair, so a sequence with more than ``limit`` events is read on where the last run stopped, and nothing is
    read twice. An event's run follows from its place among all events behind the least advanced target, so the runs are
    laid out in one job, whatever their number. Each run's rows are written under ``state``; the result has id, sequence, target and run of all of them."""
    spark = events.sparkSession
    done = progress_of({name: table for name, (_, table) in targets.items()}, seq_col, id_col)
    path = f"{state}/runs"
    schema = f"`{id_col}` string, `{seq_col}` bigint, target string, run int"
    target = F.coalesce(*[F.when((name_col_expr == F.lit(event)) & after(done[name], seq_col, id_col), F.lit(name)) for name, (event, _) in targets.items()])
    behind = events.where(after(min(done.values()), seq_col, id_col))
    rows = behind.select(id_col, F.col(seq_col).cast("bigint").alias(seq_col), target.alias("target"))
    placed = global_index(rows, (seq_col, id_col), "__place")
    run = F.floor(F.col("__place") / F.lit(int(limit))).cast("int")
    placed.withColumn("run", run).drop("__place").write.mode("overwrite").partitionBy("run").parquet(path)
    return spark.read.schema(schema).option("basePath", path).parquet(path).where("target is not null")
