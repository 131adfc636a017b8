"""Keyed sinks on plain Parquet: upsert (last wins), insert-ignore (first wins), versioned snapshots.

A ``KeyedTable`` is a folder of versions. Rows are spread over ``buckets`` hash buckets of the
key; a merge rewrites only the buckets its batch touches, into a new version folder, and then
commits a small manifest naming, for every bucket, the version that holds its current rows.
Readers open the newest manifest; a version stays readable until it falls out of the retained
manifests (``vacuum``). The manifest also records the last applied batch id, so a retried
micro-batch is a no-op. Nothing is ever overwritten in place, and no path is written while it is
being read.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .event_log import no_rows, stored_bytes
from .latest import latest_per_key

_ARRIVAL = "__arrival"
_BUCKET = "__bucket"
_SALT = "__salt"
#: Range buckets that a table holds at most (their width doubles when they would be more), and rows, or stored bytes, that a write puts in one file.
_MOST_RANGES, _FILE_ROWS, _FILE_BYTES = 64, 250_000, 64 << 20


def _hfs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole file or none: written under another name, then moved; an existing file is never replaced."""
    folder, name = path.rsplit("/", 1)
    fs, p = _hfs(spark, path)
    _, tmp = _hfs(spark, f"{folder}/_{name}-{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(tmp, p):
        fs.delete(tmp, False)
        raise FileExistsError(f"{path}: another writer committed this version")


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _hfs(spark, path)
    stream = fs.open(p)
    try:
        reader = spark._jvm.java.io.BufferedReader(spark._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines, line = [], reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


class KeyedTable:
    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: T.StructType,
                 order: Sequence[str] = (), buckets: int = 16, range_col: str | None = None,
                 range_width: int = 10_000):
        """``order`` decides which row of a key wins (greatest wins); ties, and keys without an
        order, go to the later batch (last write wins).

        Buckets are ``hash(key) mod buckets`` by default. With ``range_col`` a bucket is a range of
        that column (``floor(col / range_width)``); use it when the column is a function of the key
        and grows with arrival, e.g. the ledger of an event id: a micro-batch of new events then
        touches only the newest buckets instead of rewriting every hash bucket. ``range_width`` is the width to begin with: it
        doubles when the table would have more than 64 ranges (all rows are then rewritten once), so their number stays bounded.
        A bucket of many rows is written as several files by as many tasks."""
        self.spark, self.root = spark, root.rstrip("/")
        self.keys, self.schema, self.order, self.buckets = list(keys), schema, list(order), buckets
        self.range_col, self.range_width = range_col, int(range_width)
        self.run: str | None = None  # whose batch ids ``batch_id`` counts, e.g. a stream's checkpoint folder

    # ---- manifest -------------------------------------------------------------------------------
    def _manifests(self) -> list[int]:
        fs, p = _hfs(self.spark, f"{self.root}/_manifest")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p)
                      if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        versions = self._manifests()
        if not versions:
            return {"version": 0, "batch_id": None, "buckets": {}}
        v = versions[-1] if version is None else version
        return json.loads(_read_text(self.spark, f"{self.root}/_manifest/{v:020d}.json"))

    def _commit(self, m: dict) -> None:
        _write_text(self.spark, f"{self.root}/_manifest/{m['version']:020d}.json", json.dumps(m))

    # ---- read -------------------------------------------------------------------------------------
    def read(self, version: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        return self._rows(self._folders(self.manifest(version), buckets))

    def _folders(self, m: dict, buckets: Sequence[int] | None = None) -> list[str]:
        return [f"{self.root}/v={ver}/{_BUCKET}={b}" for b, ver in m["buckets"].items() if buckets is None or int(b) in buckets]

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return no_rows(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def bucket_of(self, width: int | None = None) -> Column:
        if self.range_col:
            return F.floor(F.col(self.range_col) / F.lit(width or self.range_width)).cast("bigint")
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("bigint")

    # ---- writes -----------------------------------------------------------------------------------
    def _place(self, batch: DataFrame, m: dict) -> tuple[dict, dict[int, float], list[str]]:
        """Where ``batch`` goes: the manifest to build on (without buckets when its ranges get wider), the files' worth of rows in
        each bucket written (by a count a bucket; no rows are read here), and the stored folders to merge the batch with."""
        width, wider = m.get("width", self.range_width), 1
        rows = batch.groupBy(self.bucket_of(width).alias("b")).agg(F.count(F.lit(1))).collect()
        held = {int(b) for b in m["buckets"]} | {b for b, _ in rows}
        while self.range_col and len({b // wider for b in held}) > _MOST_RANGES:
            wider *= 2
        folders = self._folders(m, [b for b, _ in rows] if wider == 1 else None)
        files: dict[int, float] = {}
        for b, n in rows:
            files[b // wider] = files.get(b // wider, 0) + n / _FILE_ROWS
        for folder in folders:
            b = int(folder.rsplit("=", 1)[1]) // wider
            files[b] = files.get(b, 0) + stored_bytes(self.spark, folder) / _FILE_BYTES
        return m if wider == 1 else {**m, "width": width * wider, "buckets": {}}, files if rows else {}, folders

    def _write_version(self, df: DataFrame, m: dict, batch_id, files: dict[int, float]) -> dict:
        version, width = m["version"] + 1, m.get("width", self.range_width)
        out = df.withColumn(_BUCKET, self.bucket_of(width))
        split = [x for b, n in files.items() if n > 1 for x in (F.lit(b).cast("bigint"), F.lit(math.ceil(n)))]
        salts = F.coalesce(F.try_element_at(F.create_map(*split), F.col(_BUCKET)), F.lit(1)) if split else F.lit(1)
        out = out.withColumn(_SALT, F.pmod(F.hash(*self.keys), salts))
        out = out.repartition(max(math.ceil(sum(files.values())), 1), _BUCKET, _SALT).drop(_SALT)
        attempt = f"{version}-{uuid.uuid4().hex[:12]}"  # a failed attempt's folder never blocks a retry
        target = f"{self.root}/v={attempt}"
        out.write.mode("errorifexists").partitionBy(_BUCKET).parquet(target)
        # the buckets written are the partition folders present (a listing, not a Spark job)
        fs, p = _hfs(self.spark, target)
        touched = [int(st.getPath().getName().split("=", 1)[1]) for st in fs.listStatus(p)
                   if st.isDirectory() and st.getPath().getName().startswith(f"{_BUCKET}=")]
        buckets = dict(m["buckets"])
        for b in touched:
            buckets[str(b)] = attempt
        new = {"version": version, "batch_id": batch_id, "run": self.run, "width": width, "buckets": buckets}
        self._commit(new)
        return new

    def _applied(self, m: dict, batch_id) -> bool:
        """Batch ids are only compared inside a run: a replay with a fresh checkpoint starts at 0 again."""
        return (batch_id is not None and m["batch_id"] is not None and m.get("run") == self.run
                and batch_id <= m["batch_id"])

    def _conform(self, df: DataFrame) -> DataFrame:
        return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def upsert(self, batch: DataFrame, batch_id: int | None = None, persist: bool = True) -> dict:
        """Last write wins per key: the row with the greatest ``order`` (then the later batch). The batch is read twice, by a count
        of its rows by bucket and by the merge; with ``persist`` off (rows of stored files, whose buckets need no decoding) it isn't kept in between."""
        m = self.manifest()
        if self._applied(m, batch_id):
            return m
        b = self._conform(batch).withColumn(_ARRIVAL, F.lit(1))
        if persist:
            b.persist()
        base, files, folders = self._place(b, m)
        if not files:
            b.unpersist()
            return m
        both = self._rows(folders).withColumn(_ARRIVAL, F.lit(0)).unionByName(b) if folders else b
        winners = latest_per_key(both, self.keys, tuple(f"-{c}" for c in self.order) + (f"-{_ARRIVAL}",))
        new = self._write_version(winners.drop(_ARRIVAL), base, batch_id, files)
        b.unpersist()
        return new

    def insert_ignore(self, batch: DataFrame, batch_id: int | None = None,
                      first_order: Sequence[str] = ()) -> tuple[dict, int]:
        """First write wins (``ON CONFLICT DO NOTHING``): batch rows whose key is already stored are
        dropped; inside the batch the first row per key in ``first_order`` is kept. Returns the
        new manifest and the number of inserted rows."""
        m = self.manifest()
        if self._applied(m, batch_id):
            return m, 0
        b = self._conform(batch).persist()
        base, files, folders = self._place(b, m)
        if not files:
            b.unpersist()
            return m, 0
        first = latest_per_key(b, self.keys, tuple(first_order) or tuple(self.keys))
        current = self._rows(folders)
        fresh = first.join(current.select(*self.keys), on=self.keys, how="left_anti").select(*self.schema.names).persist()
        inserted = fresh.count()   # the rows this batch adds (the batch is small next to the table)
        merged = current.unionByName(fresh)
        new = self._write_version(merged, base, batch_id, files)
        fresh.unpersist()
        b.unpersist()
        return new, inserted

    def overwrite(self, df: DataFrame) -> dict:
        """A full new version (every bucket rewritten); older versions stay until vacuumed."""
        m = self.manifest()
        rows = self._conform(df).persist()
        base, files, _ = self._place(rows, {"version": m["version"], "batch_id": None, "buckets": {}})
        new_m = self._write_version(rows, base, m["batch_id"], files)
        rows.unpersist()
        return new_m

    def rollback(self, to_version: int) -> dict:
        """Commit a new manifest equal to an older one (its version folders are still present)."""
        old = self.manifest(to_version)
        m = self.manifest()
        new = {**old, "version": m["version"] + 1, "batch_id": m["batch_id"], "run": m.get("run")}
        fs, _ = _hfs(self.spark, self.root)
        for v in set(old["buckets"].values()):
            if not fs.exists(_hfs(self.spark, f"{self.root}/v={v}")[1]):
                raise ValueError(f"version {to_version} has been vacuumed")
        self._commit(new)
        return new

    def vacuum(self, keep: int = 2) -> list[int]:
        """Delete version folders that the newest ``keep`` manifests don't name, those of failed attempts too;
        their version numbers. Not to be run while a write is under way."""
        live = {str(x) for v in self._manifests()[-keep:] for x in self.manifest(v)["buckets"].values()}
        fs, root = _hfs(self.spark, self.root)
        removed = []
        for status in fs.listStatus(root) if fs.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("v=") and name[2:] not in live:
                fs.delete(status.getPath(), True)
                removed.append(int(name[2:].split("-")[0]))
        return sorted(removed)


def constraint_split(df: DataFrame, keys: Sequence[str], not_null: Sequence[str]) -> DataFrame:
    """Tag each row with ``constraint_status``: 'ok', 'null_<col>' (first violated NOT NULL column)
    or 'duplicate_key' (key occurs more than once in the batch). Good and bad rows can then be
    routed with a filter instead of failing the load. Keys are counted with a partial aggregate, and only those that
    occur more than once are joined back, so no key's rows are gathered in one task."""
    often = (df.groupBy(*[F.col(c).alias(f"__key_{i}") for i, c in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n"))
             .where(F.col("__n") > 1).withColumn("__often", F.lit(True)).drop("__n"))
    same = [F.col(c).eqNullSafe(F.col(f"__key_{i}")) for i, c in enumerate(keys)]
    status = F.when(F.col("__often"), F.lit("duplicate_key")).otherwise(F.lit("ok"))
    for c in reversed(list(not_null)):
        status = F.when(F.col(c).isNull(), F.lit(f"null_{c}")).otherwise(status)
    return df.join(often, same, "left").select(*[F.col(c) for c in df.columns], status.alias("constraint_status"))


def unnest_arrays(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows from parallel arrays (bulk-insert payload): element i of every array forms row i."""
    return df.select(F.inline(F.arrays_zip(*[F.col(c) for c in columns])))


def load_stamp(df: DataFrame, col: str = "created_at") -> DataFrame:
    """Stamp rows with the load time instead of ledger time (one value per query run)."""
    return df.withColumn(col, F.localtimestamp())


def artifact_manifest(latest_list: DataFrame) -> DataFrame:
    """Binaries to export: every listed row whose channel is not 'unverified' (a NULL channel is
    kept), with file name ``<name>@<version>.wasm`` (a missing part is written as 'None', as the
    export script formats it)."""
    keep = latest_list.where(~F.col("channel").eqNullSafe(F.lit("unverified")))
    fname = F.concat(F.coalesce(F.col("wasm_name"), F.lit("None")), F.lit("@"),
                     F.coalesce(F.col("wasm_version"), F.lit("None")), F.lit(".wasm"))
    return keep.select("wasm_name", "wasm_version", "wasm_hash", "channel", fname.alias("file_name"))


def json_rows(df: DataFrame, fields: Sequence[tuple[str, str]]) -> DataFrame:
    """One JSON object per row with the given (column, json key) pairs; NULLs are written as null."""
    st = F.struct(*[F.col(c).alias(k) for c, k in fields])
    return df.select(F.to_json(st, {"ignoreNullFields": "false"}).alias("json"))


def write_raw_backup(raw: DataFrame, path: str, mode: str = "append") -> None:
    """Raw backup ahead of the gate, partitioned by event name so each typed reader (and the audit
    of one kind) prunes to its partition."""
    # a file or a few a kind: the rows of a frequent one are split over tasks
    raw.hint("rebalance", "event_name").write.mode(mode).partitionBy("event_name").parquet(path)


def bulk_payloads(df: DataFrame, page_col: str, columns: Sequence[str]) -> DataFrame:
    """Parallel arrays per page (the bulk-insert payload). ``page_col`` must come from
    ``page_export`` with a page size <= 200, which bounds every array."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("row_index"), *[F.col(c) for c in columns])))
    grouped = df.groupBy(page_col).agg(ordered.alias("__rows"))
    return grouped.select(page_col, *[F.col("__rows")[c].alias(c) for c in columns])
