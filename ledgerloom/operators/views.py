"""Derived views over the keyed tables: channel enrichment, latest publish, version history,
contracts and their enrichment. Each view is a DataFrame function; Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .latest import latest_per_key, sequence_index

#: ``wasm_versions``: pairs of a part, rows of one side of it, parts that a hash's uploads are dealt to at least, and rows of a block.
_PART_PAIRS, _PART_ROWS, _LEAST_PARTS, _BLOCK_ROWS = 1 << 27, 1 << 16, 2, 256


def with_channel(df: DataFrame, registries: DataFrame, emitter_col: str = "emitter_contract_id",
                 how: str = "inner") -> DataFrame:
    """Attach the registry channel of the emitting registry (``channel``)."""
    reg = registries.select(F.col("contract_id").alias("__reg_id"), F.col("registry_channel").alias("channel"))
    return df.join(reg, df[emitter_col] == reg["__reg_id"], how).drop("__reg_id")


def latest_published(published_with_channel: DataFrame, per_channel: bool = False) -> DataFrame:
    """Newest publish per wasm name across all channels (newest ledger, then the greatest version
    text with NULL first, then the greatest id). ``per_channel`` keys by (name, channel) instead."""
    keys = ["wasm_name", "channel"] if per_channel else ["wasm_name"]
    return latest_per_key(published_with_channel, keys, ("-ledger_sequence", "-wasm_version", "-id"))


def legacy_published(publishes: DataFrame) -> DataFrame:
    """Legacy list pick: per wasm name the EARLIEST ledger (ascending), then greatest version."""
    return latest_per_key(publishes, ["wasm_name"], ("ledger_sequence", "-version", "-id"))


def _places(uploads: DataFrame, published: DataFrame) -> DataFrame:
    """How many parts the uploads (``__us``) and publishes (``__ps``) of a hash are dealt to, for hashes with many of them only: each of
    these has thousands of rows, so the table is thousands of times smaller than its input. It is written when the view is made, as both
    sides read it (``checkpoint()``)."""
    nu = uploads.groupBy("wasm_hash").agg(F.count(F.lit(1)).cast("double").alias("__nu"))
    np = published.groupBy(F.col("wasm_hash").alias("__hash")).agg(F.count(F.lit(1)).cast("double").alias("__np"))
    n = nu.join(np, nu["wasm_hash"] == np["__hash"], "full").select(
        F.coalesce("wasm_hash", "__hash").alias("__hash"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("__nu", "__np")])
    n = n.withColumn("__m", F.ceil(F.col("__nu") * F.col("__np") / _PART_PAIRS))
    many = (F.col("__m") > 1) | (F.greatest("__nu", "__np") > _PART_ROWS)

    def parts(own: str, other: str, least: int):  # near squares: the fewest copies for so many pairs a part
        return F.greatest(F.lit(least), F.ceil(F.col(own) / _PART_ROWS), F.least(
            "__m", F.ceil(F.sqrt(F.col("__m") * F.col(own) / F.greatest(F.col(other), F.lit(1.0)))))).cast("int")
    few = n.where(many).select("__hash", parts("__nu", "__np", _LEAST_PARTS).alias("__us"), parts("__np", "__nu", 1).alias("__ps"))
    return few.checkpoint(eager=True)


def _blocks(rows: DataFrame, tasks: int, order: str, columns: list[str], out: str, *also: str) -> DataFrame:
    """The rows of each part of a hash as arrays (``out``) of ``_BLOCK_ROWS`` at most."""
    part = ["wasm_hash", "__u", "__p"]
    number = F.row_number().over(Window.partitionBy(*part).orderBy(order))
    numbered = rows.repartition(tasks, *part).withColumn("__block", F.floor((number - 1) / _BLOCK_ROWS))
    return numbered.groupBy(*part, *also, "__block").agg(F.collect_list(F.struct(*columns)).alias(out)).drop("__block")


def wasm_versions(uploads: DataFrame, published: DataFrame) -> DataFrame:
    """One row per (upload x publish of the same hash); uploads never published are kept. Uploads of a hash are dealt to parts, and so are
    its publishes when they are many; a task makes the pairs of one part of each, block by block: a block's uploads come again and
    again in the same order for each publish, so that stored columns are runs and short cycles over few values."""
    published = published.where(F.col("wasm_hash").isNotNull())
    u = uploads.select(F.col("wasm_hash"), F.col("id").alias("upload_id"),
                       F.col("ledger_sequence").alias("uploaded_ledger_sequence"),
                       F.col("closed_at").alias("uploaded_at"),
                       F.col("transaction_hash").alias("upload_transaction_hash"))
    p = published.select(F.col("wasm_hash"), F.col("id").alias("publish_id"),
                         F.col("transaction_hash").alias("publish_transaction_hash"),
                         F.col("ledger_sequence").alias("publish_ledger_sequence"),
                         F.col("created_at").alias("published_at"), "author", "wasm_name", "wasm_version",
                         F.col("emitter_contract_id").alias("publish_registry_contract_id"))
    places = _places(uploads, published)
    # as many tasks as the pairs ask for, however small the rows are that go there
    tasks = max(int(u.sparkSession.conf.get("spark.sql.shuffle.partitions")), places.agg(F.sum(F.col("__us") * F.col("__ps"))).first()[0] or 0)
    places = F.broadcast(places)
    us, ps = F.coalesce("__us", F.lit(_LEAST_PARTS)), F.coalesce("__ps", F.lit(1))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    ub = u.join(places, u["wasm_hash"].eqNullSafe(places["__hash"]), "left").select(
        *u.columns, (ps == 1).alias("__whole"), mine("upload_id", us).alias("__u"), each(ps).alias("__p"))
    pb = p.join(places, p["wasm_hash"] == places["__hash"], "left").select(
        *p.columns, mine("publish_id", ps).alias("__p"), each(us).alias("__u"))
    ub = _blocks(ub, tasks, "upload_id", u.columns[1:], "__uploads", "__whole")
    pb = _blocks(pb, tasks, "publish_id", p.columns[1:], "__publishes")
    pairs = ub.join(pb.hint("merge"), ["wasm_hash", "__u", "__p"], "left")
    # of several parts of a hash's publishes one may be empty; its uploads have their pairs in the others
    pairs = pairs.where(F.col("__publishes").isNotNull() | F.col("__whole"))
    # transform() is not compiled into the join's loop, which would hold all pairs of a block of uploads: a publish's are held at a time
    rows = pairs.select("wasm_hash", "__uploads", F.inline_outer(F.transform("__publishes", lambda x: x)))
    rows = rows.select("wasm_hash", *p.columns[1:], F.inline("__uploads"))
    return rows.select(*u.columns, *p.columns[1:])


def version_rows(deploys: DataFrame, upgrades: DataFrame) -> DataFrame:
    """Initial deploys with a wasm (asset contracts have none) plus every upgrade."""
    initial = deploys.where(F.col("wasm_hash").isNotNull()).select(
        "contract_id", F.lit("initial").alias("kind"), "wasm_hash", F.col("id").alias("source_id"),
        "ledger_sequence", "transaction_hash", F.col("closed_at").alias("created_at"))
    upgrade = upgrades.select(
        F.col("upgraded_contract_id").alias("contract_id"), F.lit("upgrade").alias("kind"),
        F.col("new_wasm_hash").alias("wasm_hash"), F.col("id").alias("source_id"),
        "ledger_sequence", "transaction_hash", "created_at")
    return initial.unionByName(upgrade)


def latest_publish_per_hash(published: DataFrame) -> DataFrame:
    return latest_per_key(
        published.select("wasm_hash", "wasm_name", "wasm_version", "emitter_contract_id", "ledger_sequence", "id"),
        ["wasm_hash"], ("-ledger_sequence", "-id"))


def versions(deploys: DataFrame, upgrades: DataFrame, published: DataFrame, registries: DataFrame) -> DataFrame:
    """Per-contract version history: ``version_index`` counts from 0 in (ledger, source id) order;
    name, version and channel come from the newest publish of the same hash."""
    t = sequence_index(version_rows(deploys, upgrades), "contract_id", "ledger_sequence", "source_id")
    p = latest_publish_per_hash(published).select(
        F.col("wasm_hash").alias("__p_hash"), "wasm_name", "wasm_version",
        F.col("emitter_contract_id").alias("__p_emitter"))
    reg = registries.select(F.col("contract_id").alias("__r_id"), F.col("registry_channel").alias("wasm_channel"))
    out = (t.join(p, t["wasm_hash"] == p["__p_hash"], "left")
           .join(reg, F.col("__p_emitter") == reg["__r_id"], "left"))
    return out.select("contract_id", "version_index", "kind", "wasm_hash", "wasm_name", "wasm_version",
                      "wasm_channel", "source_id", "ledger_sequence", "transaction_hash", "created_at")


def contracts(registered_with_channel: DataFrame, deployed: DataFrame) -> DataFrame:
    """Registered contracts with deployer and registry of their newest deploy event."""
    d = latest_per_key(deployed.select("contract_id", "deployer", "registry_contract_id", "ledger_sequence", "id"),
                       ["contract_id"], ("-ledger_sequence", "-id"))
    d = d.select(F.col("contract_id").alias("__d_id"), "deployer", "registry_contract_id")
    r = registered_with_channel
    out = r.join(d, r["contract_id"] == d["__d_id"], "left")
    return out.select("id", "transaction_hash", "ledger_sequence", "created_at", "contract_id", "contract_name",
                      "channel", "sac", "wasm_hash", "deployer", "registry_contract_id")


def contracts_enriched(contracts_df: DataFrame, versions_df: DataFrame) -> DataFrame:
    """Contracts with name/version/channel of the wasm they currently run (newest version row)."""
    latest = latest_per_key(versions_df.select("contract_id", "wasm_name", "wasm_version", "wasm_channel",
                                               "version_index"),
                            ["contract_id"], ("-version_index",))
    latest = latest.select(F.col("contract_id").alias("__v_id"), "wasm_version", "wasm_name", "wasm_channel")
    c = contracts_df
    out = c.join(latest, c["contract_id"] == latest["__v_id"], "left")
    return out.select("id", "transaction_hash", "ledger_sequence", "created_at", "contract_id", "contract_name",
                      "channel", "sac", "deployer", "wasm_version", "wasm_name", "wasm_channel")
