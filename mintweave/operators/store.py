"""Tables kept across scans.  Natural keys are enforced by joins, tables are plain Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.operators.skew import DAY, first_n, previous_row

# Stored table -> natural key.
KEYS = {
    "tokens": ["mint"],
    "launches": ["mint"],
    "creators": ["address"],
    "creator_launches": ["creator", "mint"],
    "wallets": ["address"],
    "wallet_launch_history": ["wallet", "mint"],
    "trades": ["signature", "wallet", "mint", "is_buy"],
    "funding_events": ["signature", "recipient"],
    "wallet_relationships": ["source", "target", "relation", "mint"],
}


def upsert_by_key(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Newest row per key by ``version``.  A mergeable maximum: repeated keys combine before the shuffle."""
    rest = [c for c in new.columns if c not in keys and c != version]
    newest = F.max(F.struct(version, *rest)).alias("_n")
    return old.unionByName(new).groupBy(*keys).agg(newest).select(*keys, "_n.*")


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet, once each."""
    return new.dropDuplicates(keys).join(old.select(*keys).distinct(), keys, "left_anti")


def replace_clusters(old: DataFrame, new: DataFrame) -> DataFrame:
    """All clusters of the scanned launches are replaced, the others stay."""
    return old.join(new.select("mint").distinct(), "mint", "left_anti").unionByName(new)


def mint_bucket(mint: Column, buckets: int = 256) -> Column:
    """Storage partition of a launch: a bounded number of folders however many launches there are."""
    return F.pmod(F.xxhash64(mint), F.lit(buckets)).cast("int")


def save_clusters(spark: SparkSession, path: str, new: DataFrame, buckets: int = 256) -> None:
    """Store clusters so that a rescanned launch keeps only its newest ones.

    Rows of the touched buckets are read, merged and written to their own
    folders; the merge result is materialised first because it replaces its input.
    """
    from mintweave.session import cut

    fresh = new.withColumn("bucket", mint_bucket(F.col("mint"), buckets))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    stored = spark.read.parquet(path) if there else None
    merged = fresh if stored is None else replace_clusters(
        stored.join(fresh.select("bucket").distinct(), "bucket", "left_semi").select(*fresh.columns), fresh
    )
    cut(merged, "clusters").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def score_rows(risk: DataFrame, scanned_at: Column) -> DataFrame:
    """One score row per scan; coordination is the larger of funding and buying."""
    return risk.select(
        "mint", scanned_at.alias("created_at"), F.col("bundle_score").alias("score"), "confidence", "overall_risk",
        F.greatest("funding_coordination", "buy_coordination").alias("coordination"), "classification",
    )


def recent_scores(scores: DataFrame, n: int = 5) -> DataFrame:
    return first_n(scores, ["mint"], [F.col("created_at").desc(), F.col("score").desc()], n)


def score_delta(scores: DataFrame, key: str = "mint", width: int = DAY) -> DataFrame:
    """Change of score against the previous scan of the same launch."""
    out = previous_row(scores, key, ["created_at", "score"], ["score"], width=width)
    return out.withColumn("previous_score", F.col("prev.score")).withColumn("delta", F.col("score") - F.col("prev.score")).drop("prev")


def known_fingerprints(stored: DataFrame, exclude: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Stored fingerprints of other launches, newest first; a limit is optional."""
    rows = stored.filter("members_hash is not null")
    if exclude is not None:
        rows = rows.join(exclude.select("mint").distinct(), "mint", "left_anti")
    return rows if limit is None else rows.orderBy(F.col("created_at").desc(), "mint", "cluster_id").limit(limit)


def wallet_launches(history: DataFrame) -> DataFrame:
    """Launches per wallet, one row each: a busy wallet may have any number."""
    return history.select("wallet", "mint").distinct()


def creator_launches(launches: DataFrame) -> DataFrame:
    return launches.select("creator", "mint").distinct()


def scan_runs(log: DataFrame) -> DataFrame:
    """Latest state of each run in an append log (run_id, mint, depth, status, at, error)."""
    last = F.max(F.struct("at", "status", "error"))
    return log.groupBy("run_id", "mint", "depth").agg(F.min("at").alias("started_at"), last.alias("_l")).select(
        "run_id", "mint", "depth", "started_at", F.col("_l.status").alias("status"), F.col("_l.error").alias("error"),
        (F.col("_l.at") - F.col("started_at")).alias("duration"),
    )


def store_stats(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("stored_table"), "rows")
        out = row if out is None else out.unionByName(row)
    return out


def watch_registry(log: DataFrame) -> DataFrame:
    """Active watches: the last action per (mint, channel) wins."""
    last = F.max(F.struct("at", "active"))
    return log.groupBy("mint", "channel").agg(F.min("at").alias("added_at"), last.alias("_l")).filter("_l.active").select(
        "mint", "channel", "added_at", F.col("_l.at").alias("changed_at")
    )


def ttl_of(key: Column) -> Column:
    out = None
    for prefix, seconds in P.TTL_BY_PREFIX.items():
        hit = key.startswith(prefix)
        out = F.when(hit, seconds) if out is None else out.when(hit, seconds)
    return out.otherwise(P.TTL_DEFAULT)


def expire_by_ttl(entries: DataFrame, as_of: int) -> DataFrame:
    """Entries still valid at ``as_of``."""
    return entries.filter(F.col("stored_at") > F.lit(as_of) - ttl_of(F.col("key")))


def watch_alerts(scores: DataFrame, step: int = P.WATCH_SCORE_STEP, exit_level: int = P.WATCH_EXIT_LEVEL, width: int = DAY, edge: bool = True) -> DataFrame:
    """Alerts of watched launches over their stored scans.

    ``scores`` (watch, created_at, score, graduated, sell_score).  The first scan
    compares with 0.  With ``edge`` graduation and exits alert when they begin;
    otherwise on every scan they hold.
    """
    out = previous_row(scores, "watch", ["created_at", "score"], ["score", "graduated", "sell_score"], width=width)
    c = F.col
    before = F.coalesce(c("prev.score"), F.lit(0))
    moved = F.abs(c("score") - before) >= step
    graduated, exiting = c("graduated"), c("sell_score") >= exit_level
    if edge:
        graduated = graduated & ~F.coalesce(c("prev.graduated"), F.lit(False))
        exiting = exiting & ~F.coalesce(c("prev.sell_score") >= exit_level, F.lit(False))
    reasons = F.array_compact(F.array(F.when(moved, "score moved"), F.when(graduated, "graduated"), F.when(exiting, "coordinated selling")))
    return out.select("watch", "created_at", before.alias("previous_score"), "score", F.array_join(reasons, "; ").alias("reason")).filter("reason <> ''")
