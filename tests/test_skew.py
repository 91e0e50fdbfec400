"""The bucketed building blocks against brute force, with a key that holds most rows."""

import random
import statistics

import pytest

from mintweave.operators import skew


def hot_rows(n=600, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.7 else f"k{rng.randrange(5)}", rng.randrange(0, 40) * 10, rng.randrange(3), i) for i in range(n)]


@pytest.mark.parametrize("width", [1, 50, 10_000])
def test_ordered_position(spark, width):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, t long, s int, i int")
    got = {r.i: r.pos for r in skew.ordered_position(df, ["k"], "t", ["s", "i"], out="pos", width=width).collect()}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])
        assert [got[r[3]] for r in ordered] == list(range(len(ordered)))


@pytest.mark.parametrize("heavy", [0, 60, 500_000])
def test_shadowed_rows_do_not_count_towards_the_look_back(spark, heavy):
    rng = random.Random(9)
    usable = [(k, t, 0, i, True) for k, t, _, i in hot_rows(200, 7)]
    told = [(k, rng.randrange(0, 40) * 10, 0, i, False) for k, _, _, i, _ in usable]
    alone = [(k, t, 0, 1000 + i, False) for k, t, _, i in hot_rows(150, 8)]
    probes = [(k, t, 0, i) for k, t, _, i in hot_rows(120, 11)] + [("nobody", 5, 0, -1)]
    left = spark.createDataFrame(probes, "k string, t long, slot long, p int")
    right = spark.createDataFrame(usable + told + alone, "k string, t long, slot long, i int, ok boolean")
    from pyspark.sql import functions as F

    out = skew.last_before(
        left, right, on="k", order=["t", "slot"], ties=["i"], payload=["i"], usable=F.col("ok"), lookback=3, shadow="i", width=50, heavy=heavy
    )
    got = {r.p: (r.hit.i if r.hit else None, r._seen_any) for r in out.collect()}
    rows = usable + alone
    for k, t, _, p in probes:
        before = sorted((r for r in rows if r[0] == k and r[1] < t), key=lambda r: (r[1], r[3]))
        hits = [r[3] for r in before[-3:] if r[4]]
        assert got[p] == (hits[-1] if hits else None, any(r[0] == k for r in rows)), (k, t)


@pytest.mark.parametrize("width", [1, 50, 10_000])
@pytest.mark.parametrize("lookback", [None, 1, 4])
def test_last_before(spark, width, lookback):
    rng = random.Random(5)
    rows = [(k, t, 0, i, rng.random() < 0.5) for k, t, _, i in hot_rows(300, 7)]
    probes = [(k, t, 0, i) for k, t, _, i in hot_rows(150, 11)] + [("nobody", 5, 0, -1)]
    left = spark.createDataFrame(probes, "k string, t long, slot long, p int")
    right = spark.createDataFrame(rows, "k string, t long, slot long, i int, ok boolean")
    from pyspark.sql import functions as F

    usable = F.col("ok") if lookback else None
    out = skew.last_before(left, right, on="k", order=["t", "slot"], ties=["i"], payload=["i"], usable=usable, lookback=lookback, width=width)
    got = {r.p: (r.hit.i if r.hit else None, r._seen_any) for r in out.collect()}
    for k, t, _, p in probes:
        before = sorted((r for r in rows if r[0] == k and r[1] < t), key=lambda r: (r[1], r[3]))
        if lookback:
            before = [r for r in before[-lookback:] if r[4]]
        assert got[p] == (before[-1][3] if before else None, any(r[0] == k for r in rows))


@pytest.mark.parametrize("heavy", [0, 100, 10_000])
def test_last_before_with_and_without_heavy_keys(spark, heavy):
    rows = [(k, t, 0, i) for k, t, _, i in hot_rows(300, 7)]
    probes = [*((k, t, 0, i) for k, t, _, i in hot_rows(150, 11)), ("nobody", 5, 0, -1), (None, 5, 0, -2)]
    left = spark.createDataFrame(probes, "k string, t long, slot long, p int")
    right = spark.createDataFrame([(*r, r[3] * 2) for r in rows], "k string, t long, slot long, i int, more int")
    out = skew.last_before(left, right, on="k", order=["t", "slot"], ties=["i"], payload=["i", "t", "more"], width=50, heavy=heavy)
    assert out.columns == [*left.columns, "hit", "_seen_any"]
    got = {r.p: (tuple(r.hit) if r.hit else None, r._seen_any) for r in out.collect() if r.k is not None}
    for k, t, _, p in probes[:-1]:
        before = max(((r[1], r[3]) for r in rows if r[0] == k and r[1] < t), default=None)
        assert got[p] == (before and (before[1], before[0], before[1] * 2), any(r[0] == k for r in rows))


def test_ordinary_keys_cross_one_exchange(spark):
    left = spark.createDataFrame([("a", 5, 0, 1)], "k string, t long, slot long, p int")
    right = spark.createDataFrame([("a", 3, 0, 1)], "k string, t long, slot long, i int")
    out = skew.last_before(left, right, on="k", order=["t", "slot"], ties=["i"], payload=["i"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_exact_percentiles_on_a_large_group(spark):
    rng = random.Random(1)
    values = [round(rng.expovariate(0.1), 3) for _ in range(9000)] + [5.0] * 3000
    rng.shuffle(values)
    df = spark.createDataFrame([("a", v) for v in values] + [("b", v) for v in values[:7]], "k string, v double")
    got = {(r.k, r.fraction): r.value for r in skew.exact_percentiles(df, ["k"], "v", [0.25, 0.5, 0.9]).collect()}
    for key, group in (("a", values), ("b", values[:7])):
        ordered = sorted(group)
        for f in (0.25, 0.5, 0.9):
            at = f * (len(ordered) - 1)
            lo = int(at)
            want = ordered[lo] + (ordered[min(lo + 1, len(ordered) - 1)] - ordered[lo]) * (at - lo)
            assert got[key, f] == pytest.approx(want)
    assert got["a", 0.5] == pytest.approx(statistics.median(values))


def test_value_ranks(spark):
    rng = random.Random(2)
    values = [rng.randrange(200) for _ in range(3000)]
    df = spark.createDataFrame([("a", float(v)) for v in values], "k string, v double")
    for r in skew.value_ranks(df, ["k"], "v", splits=8).collect():
        assert r.copies == values.count(int(r.v))
        assert r.below == sum(v < r.v for v in values)


def test_previous_row(spark):
    rows = hot_rows(200, 9)
    df = spark.createDataFrame(rows, "k string, t long, s int, i int")
    got = {r.i: (r.prev.i if r.prev else None) for r in skew.previous_row(df, "k", ["t", "s", "i"], ["i"], width=70).collect()}
    for key in {r[0] for r in rows}:
        ordered = [r[3] for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:])]
        assert [got[i] for i in ordered] == [None, *ordered[:-1]]
