"""Streams fed file by file give the rows of their batch twins."""

import random

from pyspark.sql import functions as F

from mintweave.operators.store import watch_alerts
from mintweave.streaming import streams as L

T0 = 1_750_000_000


def feed(spark, rows, schema, folder, files=4):
    """Write ``rows`` as consecutive files and open them as a stream, one file per micro-batch."""
    for i in range(files):
        part = rows[i * len(rows) // files : (i + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    return df.withColumn("event_ts", F.timestamp_seconds("created_at"))


def run(spark, df, out):
    df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(str(out))


def test_watch_alerts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i % 4, T0 + i * 120, rng.randrange(100), rng.random() < 0.3, rng.randrange(100)) for i in range(200)]
    schema = "watch long, created_at long, score int, graduated boolean, sell_score int"
    for edge in (True, False):
        live = run(spark, L.stream_watch_alerts(feed(spark, rows, schema, tmp_path / f"in{edge}"), edge=edge), tmp_path / f"out{edge}")
        batch = watch_alerts(spark.createDataFrame(rows, schema), edge=edge)
        assert sorted(map(tuple, live.collect())) == sorted(map(tuple, batch.select(*live.columns).collect()))


def test_new_launches_are_seen_once(spark, tmp_path):
    rows = [(f"m{i % 50}", "u", None, "N", "S", f"s{i % 50}", T0 + i % 50, T0 + i % 50, False, i % 7 != 0 or i >= 50) for i in range(100)]
    schema = "mint string, user string, creator string, name string, symbol string, signature string, timestamp long, created_at long, is_mayhem_mode boolean, success boolean"
    events = feed(spark, rows, schema, tmp_path / "in").withColumn("block_time", F.col("created_at"))
    live = run(spark, L.stream_new_launches(events), tmp_path / "out")
    assert sorted(r.signature for r in live.collect()) == sorted({r[5] for r in rows})
    assert {r.creator for r in live.collect()} == {"u"}


def test_buyer_windows_accept_late_earlier_buys(spark, tmp_path):
    rows = [("m", f"w{i}", True, T0 + 400 - i, T0 + 400 - i) for i in range(40)] + [("m", "w0", True, T0 + 3, T0 + 3), ("m", "w1", False, T0 + 1, T0 + 1)]
    df = feed(spark, rows, "mint string, wallet string, is_buy boolean, block_time long, created_at long", tmp_path / "in")
    out = str(tmp_path / "out")
    L.stream_buyer_windows(df, out, out + "-state").awaitTermination()
    got = L.buyer_windows(spark, out, spark.createDataFrame([("m", T0)], "mint string, created_at long")).first()
    assert (got.ultra_early, got.launch, got.full) == (1, 1, 40)


def test_replayed_batches_replace_themselves(spark, tmp_path):
    df = spark.createDataFrame([("m", 1)], "mint string, n int")
    for _ in range(2):
        L.write_batch(df, str(tmp_path / "sink"), 3)
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 1
