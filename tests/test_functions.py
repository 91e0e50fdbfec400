"""Scalar and grouped expressions against values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from mintweave.functions import scalars as S
from mintweave.operators.holders import gini
from mintweave.operators.tape import describe_distribution


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return row.select(expr.alias("x")).first().x


def agg(spark, values, expr):
    return spark.createDataFrame([(float(v),) for v in values], "v double").agg(expr(F.col("v")).alias("x")).first().x


def test_amount_similarity(spark):
    assert agg(spark, [5.0], S.amount_similarity) == 0.0
    assert agg(spark, [5, 5.01, 4.99, 5.02, 5], S.amount_similarity) > 0.9
    assert agg(spark, [0.1, 3, 12, 0.7, 25], S.amount_similarity) < 0.2


def test_timing_similarity(spark):
    assert agg(spark, [100, 101, 102], lambda c: S.timing_similarity(c, 60)) > 0.9
    assert agg(spark, [0, 30, 60], lambda c: S.timing_similarity(c, 60)) == pytest.approx(0.0)


def test_describe_matches_linear_interpolation(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3, 10)] + [("b", 7.0)], "k string, v double")
    rows = {r.k: r for r in describe_distribution(df, ["k"], "v").collect()}
    a = rows["a"]
    assert (a.p25, a.median, a.p75) == (1.75, 2.5, 4.75)
    assert a.p90 == pytest.approx(7.9)
    assert a.stdev == pytest.approx(math.sqrt(((1 - 4) ** 2 + 4 + 1 + 36) / 4))
    assert (rows["b"].stdev, rows["b"].median, rows["b"].n) == (0.0, 7.0, 1)


def test_gini(spark):
    df = spark.createDataFrame([("even", 1.0)] * 4 + [("one", v) for v in (0.0, 0.0, 0.0, 100.0)], "k string, v double")
    rows = {r.k: r.gini for r in gini(df, ["k"], "v").collect()}
    assert rows["even"] == pytest.approx(0.0)
    assert rows["one"] == pytest.approx(0.75)


def test_rounding_is_half_even(spark):
    for value, want in ((0.285, 28), (0.5, 50), (0.125, 12), (0.135, 14), (1.7, 100), (-1.0, 0)):
        assert one(spark, S.scale_to_100(F.lit(value))) == want


def test_null_is_not_skipped(spark):
    assert one(spark, S.clamp(F.lit(None).cast("double"))) is None
    assert one(spark, S.seconds_after(F.lit(10).cast("long"), F.lit(None).cast("long"))) is None
    assert one(spark, S.seconds_after(F.lit(10).cast("long"), F.lit(0).cast("long"))) is None  # zero is unknown


def test_labels_follow_keyword_order(spark):
    want = {"Binance 7": "CEX", "PumpSwap": "DEX", "pump.fun fees": "PUMPFUN", "Wormhole exchange": "CEX", "Treasury": "VAULT", "Bob": None}
    df = spark.createDataFrame([(k,) for k in want], "l string")
    assert {r.l: r.e for r in df.select("l", S.label_to_entity(F.col("l")).alias("e")).collect()} == want


def test_durations(spark):
    for seconds, text in ((0.25, "250ms"), (42.4, "42s"), (154, "2m 34s"), (7260, "2h 1m"), (90000, "1d 1h"), (-61, "-1m 1s")):
        assert one(spark, S.human_duration(F.lit(float(seconds)))) == text
    assert one(spark, S.human_duration(F.lit(None).cast("double"))) == "unknown"


def test_entropy_and_overlap(spark):
    assert one(spark, S.normalized_entropy(F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(1.0)
    assert one(spark, S.normalized_entropy(F.array(F.lit(3.0)))) == 0.0
    assert one(spark, S.overlap_coefficient(F.array(F.lit("a")), F.array(*[F.lit(x) for x in "abcd"]))) == 1.0
