"""Live jobs.  Each has a batch twin that gives the same rows on the same input.

Time in the state is event time: every stateful job carries a watermark, so its
state is bounded by the lateness allowed and not by the length of the stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mintweave import params as P


def new_launches(events: DataFrame) -> DataFrame:
    """Batch form: create events of successful transactions, one per signature."""
    return _as_launch(events).dropDuplicates(["signature"])


def _as_launch(events: DataFrame) -> DataFrame:
    return events.filter(F.col("success") & F.col("mint").isNotNull()).select(
        "mint", F.coalesce("creator", "user").alias("creator"), "symbol", "name", "signature",
        F.coalesce(F.nullif(F.col("timestamp"), F.lit(0)), F.col("block_time")).alias("block_time"),
        F.coalesce("is_mayhem_mode", F.lit(False)).alias("mayhem"), "event_ts",
    )


def stream_new_launches(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Create events from the feed; repeats within the lateness are dropped."""
    return _as_launch(events).withWatermark("event_ts", lateness).dropDuplicatesWithinWatermark(["signature"])


def trade_volume(trades: DataFrame, window: str = "1 hour") -> DataFrame:
    """Trades, buys and quote volume per launch and tumbling window."""
    return trades.groupBy("mint", F.window("event_ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("trades"), F.count(F.when(F.col("is_buy"), 1)).alias("buys"), F.sum("quote_amount").alias("volume")
    ).select("mint", F.unix_seconds("w.start").alias("window_start"), "trades", "buys", "volume")


def stream_trade_volume(trades: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    return trade_volume(trades.withWatermark("event_ts", lateness), window)


# --- watch alerts ---------------------------------------------------------------------------

ALERT = "watch LONG, created_at LONG, previous_score INT, score INT, reason STRING"


def stream_watch_alerts(
    scores: DataFrame, step: int = P.WATCH_SCORE_STEP, exit_level: int = P.WATCH_EXIT_LEVEL, edge: bool = True, lateness: str = "1 hour"
) -> DataFrame:
    """Alerts per watch as scans arrive; the state per watch is its last score and flags.

    ``scores``: watch, created_at, score, graduated, sell_score, event_ts.
    """

    def step_watch(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        score, graduated, exiting = state.get if state.exists else (0, False, False)
        out = []
        # One watch's scans of one micro-batch; scans of a watch are minutes apart.
        for row in pd.concat(list(batches)).sort_values(["created_at", "score"]).itertuples():
            selling = row.sell_score >= exit_level
            reasons = [
                text
                for text, hit in (
                    ("score moved", abs(row.score - score) >= step),
                    ("graduated", row.graduated and not (edge and graduated)),
                    ("coordinated selling", selling and not (edge and exiting)),
                )
                if hit
            ]
            if reasons:
                out.append((key[0], row.created_at, score, row.score, "; ".join(reasons)))
            score, graduated, exiting = int(row.score), bool(row.graduated), bool(selling)
        state.update((score, graduated, exiting))
        yield pd.DataFrame(out, columns=["watch", "created_at", "previous_score", "score", "reason"])

    return (
        scores.withWatermark("event_ts", lateness)
        .groupBy("watch")
        .applyInPandasWithState(step_watch, ALERT, "score INT, graduated BOOLEAN, exiting BOOLEAN", "append", "NoTimeout")
    )


# --- discovery ----------------------------------------------------------------------------------

BENIGN = ("CEX-FUNDED USERS", "MAYHEM ACTIVITY", "INSUFFICIENT DATA")


def discovery_stages(launches: DataFrame, report: DataFrame, as_of: int, limits: dict = P.DISCOVERY) -> DataFrame:
    """How far each new launch gets: detected, valid, enough_activity, suspicious.

    ``report``: mint, buyers, bundle_score, confidence, classification.
    """
    c = F.col
    age = F.lit(as_of) - c("block_time")
    valid = age <= limits["max_age"]
    active = valid & (F.coalesce("buyers", F.lit(0)) >= limits["min_buyers"])
    suspicious = (
        active & (c("bundle_score") >= limits["min_score"]) & (c("confidence") >= limits["min_confidence"]) & ~c("classification").isin(*BENIGN)
    )
    return launches.join(report, "mint", "left").select(
        "mint", "signature", "bundle_score", "confidence", "classification",
        valid.alias("valid"), active.alias("enough_activity"), F.coalesce(suspicious, F.lit(False)).alias("suspicious"),
    )


def funnel_counters(stages: DataFrame) -> DataFrame:
    def n(column: str):
        return F.count(F.when(F.col(column), 1))

    return stages.agg(
        F.count(F.lit(1)).alias("detected"), n("valid").alias("valid"), n("enough_activity").alias("enough_activity"),
        n("enough_activity").alias("analysed"), n("suspicious").alias("suspicious"), n("suspicious").alias("alerted"),
    )


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Idempotent sink: a replayed batch replaces its own folder."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")


def alerts_sink(alerts: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append alerts as Parquet, one folder per micro-batch."""
    return (
        alerts.writeStream.foreachBatch(lambda df, batch_id: write_batch(df, path, batch_id))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": f"{P.WATCH_SECONDS} seconds"}))
        .start()
    )


def stream_discovery_funnel(
    launches: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, as_of: int, limits: dict = P.DISCOVERY, **trigger
) -> StreamingQuery:
    """Scan the new launches of every micro-batch and store how far each got.

    ``scan`` turns a batch of launches into report rows, e.g. by ``launch_scan``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(discovery_stages(batch, scan(batch), as_of, limits), path, batch_id)

    return (
        launches.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


# --- buyer windows -----------------------------------------------------------------------------------


def stream_buyer_windows(trades: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep each buyer's first buy per launch as trades arrive.

    A micro-batch adds its own minima; late earlier buys simply win the minimum,
    so nothing has to stay in memory.  Read the counts with ``buyer_windows``.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch.filter("is_buy").groupBy("mint", "wallet").agg(F.min("block_time").alias("block_time")), path, batch_id)

    return trades.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def buyer_windows(spark: SparkSession, path: str, launches: DataFrame, windows: dict[str, float] = P.WINDOWS) -> DataFrame:
    """Distinct buyers per window from the stored first buys."""
    first = spark.read.parquet(path).groupBy("mint", "wallet").agg(F.min("block_time").alias("block_time"))
    after = first.join(launches.select("mint", "created_at"), "mint").withColumn("_s", F.greatest(F.lit(0), F.col("block_time") - F.col("created_at")))
    return after.groupBy("mint").agg(*[F.count(F.when(F.col("_s") <= limit, 1)).alias(name) for name, limit in windows.items()])
