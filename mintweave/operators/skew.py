"""Ordered work over keys of any size.

One mint, wallet or exchange may own a third of all rows, so nothing here sorts
or collects a whole key in one task.  Keys are cut into time buckets; each
bucket is ordered on its own and the small per-bucket summaries carry the
running state across.  The number of buckets per key is bounded by the time
span of the data, not by its volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mintweave.session import cut

DAY = 86400
# Rows of one key that a task orders whole; keys with more are cut into time buckets.
HEAVY = 500_000


def bucket_of(time: Column, width: int) -> Column:
    return F.floor(F.coalesce(time, F.lit(0)) / F.lit(width)).cast("long")


def ordered_position(
    df: DataFrame, keys: list[str], time: str, ties: list[str], *, out: str, width: int = DAY
) -> DataFrame:
    """Exact 0-based position of each row in ``(time, ties)`` order within ``keys``."""
    rows = df.withColumn("_bucket", bucket_of(F.col(time), width))
    groups = [*keys, "_bucket"]
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*groups)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = Window.partitionBy(*groups).orderBy(F.coalesce(F.col(time), F.lit(0)), *ties)
    return (
        rows.withColumn("_local", F.row_number().over(local))
        .join(offsets, groups)
        .withColumn(out, F.col("_offset") + F.col("_local") - 1)
        .drop("_bucket", "_local", "_offset")
    )


def first_n(df: DataFrame, keys: list[str], order: list[Column | str], n: int, *, out: str = "position") -> DataFrame:
    """The first ``n`` rows per key with their 1-based position.

    The rank filter becomes a group limit before the shuffle, so a hot key ships
    at most ``n`` rows per input partition.
    """
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= n)


def last_before(
    probes: DataFrame,
    rows: DataFrame,
    *,
    on: str,
    order: list[str],
    ties: list[str],
    payload: list[str],
    out: str = "hit",
    usable: Column | None = None,
    lookback: int | None = None,
    shadow: str | None = None,
    width: int = DAY,
    heavy: int = HEAVY,
) -> DataFrame:
    """As-of join: the newest usable row strictly before each probe.

    ``order`` (first column: epoch seconds) exists on both sides.  ``usable``
    marks the rows that may be returned; the others only count towards
    ``lookback``, which limits the search to the newest ``lookback`` rows.
    ``shadow``: a row that is not usable does not count where a usable row of its
    key has the same value in that column.
    Linear in both inputs: a union, one ordered pass per ``(on, bucket)``, and a
    carry over the per-bucket summaries, instead of an inequality join.
    Only keys of more than ``heavy`` rows are cut into buckets: all others cross
    one exchange and need no summaries.  Both inputs are read twice, so callers
    write them once (``session.cut``) where they are costly.

    Adds to ``probes`` the struct column ``out`` (null when there is no hit) and
    the flag ``_seen_any``: the key has some row, at whatever time.
    """
    # If every row is usable, the newest row is always inside the look-back.
    counted = usable is not None and lookback is not None
    usable = F.lit(True) if usable is None else usable
    limits = dict(lookback=lookback if counted else None, shadow=shadow if counted else None)
    large = heavy_keys(probes, rows, on, heavy)
    if large.isEmpty():
        return _last_before_whole(probes, rows, on, order, ties, payload, out, usable, **limits)
    some = {k: [df.join(large, on, k) for df in (probes, rows)] for k in ("left_anti", "left_semi")}
    # a null key meets no row; the anti join keeps it
    whole = _last_before_whole(*some["left_anti"], on, order, ties, payload, out, usable, **limits)
    probes, rows = some["left_semi"]
    if limits["shadow"] is not None:
        told = rows.filter(usable).select(on, shadow).distinct()
        rows = rows.filter(usable).unionByName(rows.filter(~usable).join(told, [on, shadow], "left_anti"))
    left = probes.select(
        F.col(on).alias("_on"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.lit(0).alias("_kind"),
        F.struct(*probes.columns).alias("_probe"),
    )
    right = rows.filter(F.col(on).isNotNull()).select(
        F.col(on).alias("_on"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)],
        F.lit(1).alias("_kind"),
        F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)]).alias("_tie"),
        F.when(usable, F.struct(*payload)).alias("_payload"),
    )
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_bucket", bucket_of(F.col("_o0"), width))
    sort = [f"_o{i}" for i in range(len(order))]
    by_key = Window.partitionBy("_on")
    earlier = by_key.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    local = (
        Window.partitionBy("_on", "_bucket")
        .orderBy(*sort, "_kind", "_tie")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    row_count = F.count(F.when(F.col("_kind") == 1, 1))
    any_row = (F.sum("_rows").over(by_key) > 0).alias("_seen_any")
    groups = ["_on", "_bucket"]

    if not counted:
        # The summary combines map-side, so only one row per bucket and partition travels.
        newest = F.max(F.when(F.col("_payload").isNotNull(), F.struct(*sort, "_tie", "_payload")))
        summary = (
            both.groupBy(*groups)
            .agg(row_count.alias("_rows"), newest.alias("_top"))
            .select(*groups, any_row, F.last("_top._payload", ignorenulls=True).over(earlier).alias("_carry"))
        )
        hits = both.withColumn("_last", F.last("_payload", ignorenulls=True).over(local)).filter("_kind = 0")
        cut_up = hits.join(summary, groups).select("_probe.*", F.coalesce("_last", "_carry").alias(out), "_seen_any")
        return whole.unionByName(cut_up.select(*whole.columns))

    hit = F.when(F.col("_payload").isNotNull(), F.struct("_seen", "_payload"))
    scanned = both.withColumn("_seen", row_count.over(local)).withColumn(
        "_last", F.last(hit, ignorenulls=True).over(local)
    )
    summary = (
        scanned.groupBy(*groups)
        .agg(F.max("_seen").alias("_rows"), F.max_by("_last", "_last._seen").alias("_tail"))
        .withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
        .withColumn("_carry", _rebased("_tail", "_base"))
        .select(*groups, any_row, "_base", F.last("_carry", ignorenulls=True).over(earlier).alias("_carry"))
    )
    best = scanned.filter("_kind = 0").join(summary, groups).withColumn(
        "_best", F.coalesce(_rebased("_last", "_base"), F.col("_carry"))
    )
    recent = F.col("_best._seen") > F.col("_base") + F.col("_seen") - lookback
    cut_up = best.select("_probe.*", F.when(recent, F.col("_best._payload")).alias(out), "_seen_any")
    return whole.unionByName(cut_up.select(*whole.columns))


def heavy_keys(probes: DataFrame, rows: DataFrame, on: str, heavy: int) -> DataFrame:
    """Keys with more than ``heavy`` rows on both sides together; at most one in ``heavy`` rows, so the table is small."""
    keys = probes.select(on).unionByName(rows.select(on)).filter(F.col(on).isNotNull())
    return cut(keys.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > heavy).select(on), "heavy")


def _last_before_whole(probes, rows, on, order, ties, payload, out, usable, lookback=None, shadow=None) -> DataFrame:
    """``last_before`` for keys that one task can order: one exchange, each column travels once."""
    c = F.col
    placed = {n: f"_o{i}" for i, n in enumerate(order)} | {n: f"_t{i}" for i, n in enumerate(ties) if n not in order}
    rest = [n for n in payload if n not in placed]
    kept = [n for n in probes.columns if n != on and n not in order]
    left = probes.select(
        c(on).alias("_on"), *[c(n).alias(placed[n]) for n in order], F.lit(0).alias("_kind"), F.struct(*kept).alias("_probe") if kept else F.lit(None).alias("_probe")
    )
    right = rows.filter(c(on).isNotNull()).select(
        c(on).alias("_on"), *[c(n).alias(x) for n, x in placed.items()], F.lit(1).alias("_kind"), F.when(usable, F.struct(F.lit(True).alias("_ok"), *rest)).alias("_rest")
    )
    both = left.unionByName(right, allowMissingColumns=True)
    sort = [placed[n] for n in order]
    others = [x for x in placed.values() if x not in sort]
    before = Window.partitionBy("_on").orderBy(*sort, "_kind", *others, "_rest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if shadow is not None:
        # the exchange by key serves this window too
        told = F.max(c("_rest").isNotNull()).over(Window.partitionBy("_on", placed[shadow]))
        both = both.withColumn("_told", told).filter("_kind = 0 or _rest is not null or not _told").drop("_told")
    row = F.struct(*[c(placed[n] if n in placed else f"_rest.{n}").alias(n) for n in payload])
    found = c("_last")
    if lookback is not None:
        both = both.withColumn("_n", F.sum("_kind").over(before))
        row = F.struct(c("_n"), row.alias("_row"))
        found = F.when(c("_last._n") > c("_n") - lookback, c("_last._row"))
    last = F.last(F.when(c("_rest").isNotNull(), row), ignorenulls=True).over(before)
    seen = (F.max("_kind").over(Window.partitionBy("_on")) == 1) & c("_on").isNotNull()
    hits = both.withColumn("_last", last).withColumn("_any", seen).filter("_kind = 0")
    back = {n: c(f"_probe.{n}") for n in kept} | {on: c("_on")} | {n: c(placed[n]) for n in order}
    return hits.select(*[back[n].alias(n) for n in probes.columns], F.when(c("_on").isNotNull(), found).alias(out), c("_any").alias("_seen_any"))


def _rebased(column: str, base: str) -> Column:
    c = F.col(column)
    return F.when(
        c.isNotNull(),
        F.struct((F.col(base) + c["_seen"]).alias("_seen"), c["_payload"].alias("_payload")),
    )


def exact_percentiles(df: DataFrame, keys: list[str], value: str, fractions: list[float]) -> DataFrame:
    """Exact linear-interpolated percentiles for groups of any size.

    A mergeable sketch brackets every wanted rank; only the values inside the
    bracket are counted and ordered.  Returns ``keys, fraction, value``.
    """
    accuracy = 1000
    margin = 2.0 / accuracy
    small = 2 * accuracy  # below this the sketch's rank error spans whole elements
    points = sorted({min(1.0, max(0.0, f + s * margin)) for f in fractions for s in (-1, 1)})
    marks = df.groupBy(*keys).agg(
        F.count(value).alias("_n"),
        F.percentile_approx(value, [float(p) for p in points], accuracy).alias("_marks"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
    )
    spans = F.array(
        *[
            F.struct(
                F.lit(f).alias("fraction"),
                (F.lit(f) * (F.col("_n") - 1)).alias("k"),
                F.when(F.col("_n") <= small, F.col("_min"))
                .otherwise(F.col("_marks")[points.index(max(0.0, f - margin))])
                .alias("lo"),
                F.when(F.col("_n") <= small, F.col("_max"))
                .otherwise(F.col("_marks")[points.index(min(1.0, f + margin))])
                .alias("hi"),
            )
            for f in fractions
        ]
    )
    # Pre-aggregated: repeated values collapse before the shuffle.
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = counted.join(marks.filter(F.col("_n") > 0).select(*keys, "_n", spans.alias("_spans")), keys).select(
        *keys, value, "_c", F.explode("_spans").alias("_s")
    )
    below = placed.groupBy(*keys, F.col("_s.fraction").alias("fraction")).agg(
        F.coalesce(F.sum(F.when(F.col(value) < F.col("_s.lo"), F.col("_c"))), F.lit(0)).alias("_below")
    )
    inside = placed.filter((F.col(value) >= F.col("_s.lo")) & (F.col(value) <= F.col("_s.hi"))).select(
        *keys, F.col("_s.fraction").alias("fraction"), F.col("_s.k").alias("_k"), value, "_c"
    )
    run = Window.partitionBy(*keys, "fraction").orderBy(value)
    ranked = (
        inside.join(below, [*keys, "fraction"])
        .withColumn("_end", F.col("_below") + F.sum("_c").over(run))
        .withColumn("_start", F.col("_end") - F.col("_c"))
    )
    low, high = F.floor("_k"), F.ceil("_k")

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col(value)))

    return (
        ranked.groupBy(*keys, "fraction")
        .agg(at(low).alias("_lo"), at(high).alias("_hi"), F.first("_k").alias("_k"))
        .select(
            *keys,
            "fraction",
            F.when(F.floor("_k") == F.ceil("_k"), F.col("_lo"))
            .otherwise(F.col("_lo") * (F.ceil("_k") - F.col("_k")) + F.col("_hi") * (F.col("_k") - F.floor("_k")))
            .alias("value"),
        )
    )


def value_ranks(df: DataFrame, keys: list[str], value: str, splits: int = 32) -> DataFrame:
    """Rows per distinct value with the number of rows below it: ``keys, value, copies, below``.

    Equal values collapse before the shuffle; the distinct values of a large key
    are cut at sketch quantiles so that no task orders a whole key.
    """
    marks = [i / splits for i in range(1, splits)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, marks, 1000).alias("_cuts"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    x = F.col(value)
    placed = counted.join(cuts, keys).withColumn("_slice", F.size(F.filter("_cuts", lambda c: c < x))).drop("_cuts")
    groups = [*keys, "_slice"]
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy(*groups).agg(F.sum("copies").alias("_n")).select(
        *groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    inner = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        placed.withColumn("_before", F.coalesce(F.sum("copies").over(inner), F.lit(0)))
        .join(base, groups)
        .select(*keys, value, "copies", (F.col("_base") + F.col("_before")).alias("below"))
    )


def previous_row(df: DataFrame, key: str, order: list[str], values: list[str], *, width: int = DAY) -> DataFrame:
    """``lag`` for keys of any size: adds ``prev`` (struct of ``values``) from the row before in ``order``."""
    groups = [key, "_bucket"]
    rows = df.withColumn("_bucket", bucket_of(F.col(order[0]), width))
    inner = Window.partitionBy(*groups).orderBy(*order)
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tail = rows.groupBy(*groups).agg(F.max(F.struct(*order, F.struct(*values).alias("_v"))).alias("_t")).select(
        *groups, F.last("_t._v").over(earlier).alias("_carry")
    )
    return (
        rows.withColumn("_lag", F.lag(F.struct(*values)).over(inner))
        .join(tail, groups)
        .withColumn("prev", F.coalesce("_lag", "_carry"))
        .drop("_bucket", "_lag", "_carry")
    )
