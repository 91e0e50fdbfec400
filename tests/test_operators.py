"""Operators on small hand-made tapes."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from mintweave.operators import clusters as K
from mintweave.operators import entities as E
from mintweave.operators import execution as X
from mintweave.operators import funding as M
from mintweave.operators import graph as G
from mintweave.operators import history as H
from mintweave.operators import launchwise as L
from mintweave.operators import scoring as R
from mintweave.operators import sells as Z
from mintweave.operators import store as D
from mintweave.operators import tape as T
from mintweave.operators import wallets as W

TRADE = "mint string, wallet string, signature string, slot long, block_time long, leg int, is_buy boolean, quote_amount double, token_amount double, mayhem boolean, fee_payer string, tx_success boolean, real_token_reserves long"
T0 = 1_750_000_000


def trade(wallet, t, *, mint="m", sig=None, slot=None, buy=True, quote=1.0, token=10.0, mayhem=False, payer=None):
    return (mint, wallet, sig or f"{mint}-{wallet}-{t}", slot if slot is not None else t, T0 + t, 0, buy, quote, token, mayhem, payer or wallet, True, 790_000_000_000_000)


def tape(spark, *rows):
    return spark.createDataFrame(list(rows), TRADE)


def launch(spark, *mints):
    return spark.createDataFrame([(m, T0) for m in mints or ("m",)], "mint string, created_at long")


def test_windows(spark):
    rows = [trade(f"w{i}", t) for i, t in enumerate((2, 8, 45, 200, 2000))]
    counts = T.window_counts(tape(spark, *rows), launch(spark)).first()
    assert (counts.ultra_early, counts.early, counts.full) == (2, 3, 5)
    line = T.timeline_counts(tape(spark, *rows), launch(spark)).first()
    assert (line.t10, line.t60) == (2, 3)


def test_slots(spark):
    got = T.slot_analysis(tape(spark, *[trade(f"w{i}", 1, slot=5) for i in range(4)])).first()
    assert (got.wallets_sharing_a_slot, got.distinct_slots) == (4, 1)


def test_row_order_and_names_do_not_matter(spark):
    rows = [trade(f"w{i % 7}", (i * 37) % 100, mint=f"m{i % 3}", sig=f"s{i}", buy=i % 4 != 0) for i in range(60)]
    a = {tuple(r) for r in T.trade_index(tape(spark, *rows)).select("mint", "signature", "trade_index").collect()}
    b = {tuple(r) for r in T.trade_index(tape(spark, *reversed(rows)).repartition(7)).select("mint", "signature", "trade_index").collect()}
    assert a == b


def test_execution(spark):
    rows = [trade(f"w{i}", i, payer="boss") for i in range(3)] + [trade("x", 9, payer="relay")]
    both = tape(spark, *rows)
    sponsors = X.sponsor_members(both)
    assert {r.source for r in sponsors.collect()} == {"boss"}
    members = spark.createDataFrame([("m", 1, f"w{i}") for i in range(3)], "mint string, cluster_id int, wallet string")
    assert X.execution_strength(members, sponsors, X.atomic_members(both)).first().shared_signer == 1.0


def test_atomic_share(spark):
    rows = [trade("w0", 1, sig="one"), trade("w1", 1, sig="one")] + [trade(f"w{i}", i) for i in range(2, 8)]
    members = spark.createDataFrame([("m", 1, f"w{i}") for i in range(8)], "mint string, cluster_id int, wallet string")
    got = X.atomic_stats(members, X.atomic_members(tape(spark, *rows))).first()
    assert (got.atomic_size, got.atomic_share) == (2, 0.25)


TRANSFER = "source string, recipient string, asset string, amount double, signature string, slot long, block_time long, recipient_before double, recipient_after double"


def transfers(spark, *rows):
    return spark.createDataFrame([(s, r, "SOL", float(a), f"t{i}", T0 + t, T0 + t, 0.0, float(a)) for i, (s, r, a, t) in enumerate(rows)], TRANSFER)


def test_asof_funding(spark):
    first = T.first_buys(tape(spark, trade("w", 4), trade("sender", 4)))
    got = {r.wallet: r for r in M.asof_funding(first, transfers(spark, ("f", "w", 5, -30), ("old", "w", 9, -900), ("late", "w", 1, 50), ("sender", "z", 1, -5))).collect()}
    w = got["w"]
    assert (w.direct_funder, w.funding_amount, w.funding_to_buy_seconds, w.observed) == ("f", 5.0, 34.0, True)
    assert got["sender"].direct_funder is None


def test_fee_payer_is_the_last_resort(spark):
    first = T.first_buys(tape(spark, trade("w", 4, payer="boss"), trade("v", 5)))
    sol = spark.createDataFrame([("m-w-4", "boss", -2_000_000_000)], "signature string, address string, delta long")
    funding = M.asof_funding(first, transfers(spark, ("f", "v", 1, -9)))
    got = {r.wallet: r for r in M.fee_payer_fallback(funding, first, sol).collect()}
    assert (got["w"].direct_funder, got["w"].funding_amount, got["w"].funding_to_buy_seconds) == ("boss", 2.0, 0.0)
    assert got["v"].direct_funder == "f"


def paths(spark, moves, labels=(), **kw):
    t = transfers(spark, *moves)
    funding = M.asof_funding(T.first_buys(tape(spark, trade("w", 100))), t)
    known = spark.createDataFrame([(a, "x", k, "registry", 1.0, False) for a, k in labels] or [("-", "x", "VAULT", "r", 1.0, False)], "address string, label string, entity_type string, source string, confidence double, verify boolean")
    every = t.select(F.lit("m").alias("mint"), "source", F.col("recipient").alias("wallet"))
    return M.funding_paths(funding, t, M.assess_sources(every, known), **kw).first()


def test_paths(spark):
    chain = [("a", "b", 1, 10), ("b", "c", 1, 20), ("c", "w", 1, 30)]
    assert paths(spark, chain).path == ["a", "b", "c", "w"]
    assert paths(spark, chain, max_hops=2).path == ["b", "c", "w"]
    stopped = paths(spark, chain, labels=[("b", "CEX")])
    assert (stopped.path, stopped.root_type) == (["b", "c", "w"], "CEX")
    assert paths(spark, [("c", "b", 1, 10), ("b", "c", 1, 20), ("c", "w", 1, 30)]).path == ["b", "c", "w"]  # cycle
    later = [("a", "c", 1, 60), ("z", "c", 1, 10), ("c", "w", 1, 30)]
    assert paths(spark, later).path == ["z", "c", "w"]  # money that came later explains nothing
    assert paths(spark, later, causal=False).path == ["a", "c", "w"]


def test_assessment(spark):
    pairs = spark.createDataFrame([("big", f"w{i}") for i in range(60)] + [("small", "w1"), ("cex", "w1"), ("prog", "w2"), ("busy", "w3")], "address string, recipient string")
    known = spark.createDataFrame([("cex", "X", "CEX", "r", 0.8, True), ("prog", "Y", "PROGRAM", "r", 1.0, False)], "address string, label string, entity_type string, source string, confidence double, verify boolean")
    busy = spark.createDataFrame([("busy", 5000)], "address string, activity long")
    got = {r.address: (r.entity_type, r.weight, r.shared) for r in E.assess_funders(pairs, known, E.fanout(pairs), busy).collect()}
    assert got == {
        "big": ("INFRASTRUCTURE", 0.2, True), "small": ("FUNDER", 1.0, False), "cex": ("CEX", 0.2, True),
        "prog": ("PROGRAM", 0.0, True), "busy": ("INFRASTRUCTURE", 0.2, True),
    }


def test_exit_groups_are_anchored(spark):
    times = [0, 100, 150, 260, 900]
    rows = [trade(f"w{i}", 1) for i in range(5)] + [trade(f"w{i}", 1000 + t, buy=False) for i, t in enumerate(times)]
    members = spark.createDataFrame([("m", 1, f"w{i}") for i in range(5)], "mint string, cluster_id int, wallet string")
    got = sorted(r.members for r in Z.sync_exit_groups(members, Z.wallet_exits(tape(spark, *rows))).collect())
    assert got == [["w0", "w1"], ["w2", "w3"]]


@pytest.mark.parametrize("sells, low, high", [((600, 605, 610), 0.7, 1.0), ((600, 40000, 90000), 0.0, 0.2)])
def test_sell_coordination(spark, sells, low, high):
    rows = [trade(f"w{i}", 1) for i in range(3)] + [trade(f"w{i}", t, buy=False) for i, t in enumerate(sells)]
    members = spark.createDataFrame([("m", 1, f"w{i}") for i in range(3)], "mint string, cluster_id int, wallet string")
    assert low <= Z.sell_coordination(members, Z.wallet_exits(tape(spark, *rows))).first().sell_coordination <= high


def test_mayhem_activity(spark):
    rows = tape(spark, *[trade(f"w{i}", i, mayhem=i < 2) for i in range(4)])
    flags = launch(spark).withColumn("is_mayhem", F.lit(False))
    assert T.mayhem_separation(rows, flags).first().activity == 50


def test_mayhem_activity_at_a_half(spark):
    # 23 of 40 is 57.5 %: rounded half to even it is 58, but 23 / 40 * 100 is 57.49999999999999
    rows = tape(spark, *[trade(f"w{i}", i, mayhem=i < 23) for i in range(40)])
    flags = launch(spark).withColumn("is_mayhem", F.lit(False))
    assert T.mayhem_separation(rows, flags).first().activity == 58


def test_mayhem_of_a_launch_listed_twice(spark):
    rows = tape(spark, *[trade(f"w{i}", i, mayhem=i < 1) for i in range(4)])
    flags = spark.createDataFrame([("m", T0, False), ("m", T0, False), ("m", T0, True)], "mint string, created_at long, is_mayhem boolean")
    assert sorted(r.trades for r in T.mayhem_separation(rows, flags).collect()) == [4, 8]


def test_profile_of_a_launch_listed_twice(spark):
    from mintweave.plans import summaries as U

    rows = tape(spark, *[trade(f"w{i}", i, mayhem=i < 1) for i in range(4)])
    schema = "mint string, creator string, name string, symbol string, created_at long, quote_mint string, curve_complete boolean, graduated_at long, pool string, is_mayhem boolean, real_token_reserves long, initial_real_tokens long"
    made = [("m", c, c, c, T0, None, False, None, None, False, 1, 2) for c in ("a", "b")]
    got = U.launch_profile(spark.createDataFrame(made, schema), rows, T0 + 10).collect()
    assert sorted((r.creator, r.trades, r.mayhem_enabled, r.mayhem_activity) for r in got) == [("a", 4, True, 25), ("b", 4, True, 25)]


@pytest.mark.parametrize("crowded", [0, 15, 1000])
def test_behaviour_neighbours_of_small_and_crowded_launches(spark, crowded):
    from mintweave.operators import graph as G

    rng = random.Random(3)
    rows = [(m, f"w{i}", i, *(rng.uniform(0, 1.2) for _ in G.FEATURES)) for m, n in (("small", 9), ("large", 30)) for i in range(n)]
    table = spark.createDataFrame(rows, "mint string, wallet string, position int, " + ", ".join(f"{f} double" for f in G.FEATURES))
    got = sorted(tuple(r) for r in G.behaviour_neighbours(table, crowded=crowded).collect())
    near = [(x[0], x[1], y[1]) for x in rows for y in rows if x[0] == y[0] and sum((p - q) ** 2 for p, q in zip(x[3:], y[3:])) <= 0.75**2]
    assert got == sorted(near)


def random_parts(seed, wallets=30, mints=40, bot=True):
    rng = random.Random(seed)
    parts = {(f"w{rng.randrange(wallets)}", f"m{rng.randrange(mints)}") for _ in range(260)}
    if bot:  # one wallet on every launch
        parts |= {("w0", f"m{i}") for i in range(mints)}
    return parts


@pytest.mark.parametrize("hot", [3, 10, 1000])
def test_overlap_pairs_match_brute_force(spark, hot):
    parts = random_parts(4)
    df = spark.createDataFrame(sorted(parts), "wallet string, mint string")
    sets = {w: {m for x, m in parts if x == w} for w in {p[0] for p in parts}}
    want = {}
    for mint in {p[1] for p in parts}:
        for a, b in itertools.combinations(sorted(w for w in sets if mint in sets[w]), 2):
            la, lb = sets[a] - {mint}, sets[b] - {mint}
            if la & lb:
                want[mint, a, b] = len(la & lb) / min(len(la), len(lb))
    got = {(r.mint, r.a, r.b): r.overlap for r in H.wallet_overlap_pairs(df, df, hot).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("hot, crowded", [(3, 0), (1000, 0), (10, 8), (1000, 8)])
def test_overlap_pairs_are_the_same_on_small_and_crowded_launches(spark, hot, crowded):
    df = spark.createDataFrame(sorted(random_parts(4)), "wallet string, mint string")
    whole, split = (sorted(H.wallet_overlap_pairs(df, df, hot, n).collect()) for n in (10_000, crowded))
    assert whole == split and len(whole) > 100


@pytest.mark.parametrize("k, hot", [(1, 5), (2, 5), (3, 5), (3, 20), (3, 1000)])
def test_recurring_groups_match_brute_force(spark, k, hot):
    parts = random_parts(8)
    df = spark.createDataFrame(sorted(parts), "wallet string, mint string")
    by = {m: {w for w, x in parts if x == m} for m in {p[1] for p in parts}}
    want = {(a, b): len(by[a] & by[b]) for a in by for b in by if a != b and len(by[a] & by[b]) >= k}
    assert {(r.mint, r.other_mint): r.wallets for r in H.recurring_groups(df, df, k, hot).collect()} == want


@pytest.mark.parametrize("k, hot, crowded", [(1, 1000, 0), (3, 1000, 0), (3, 5, 8), (2, 1000, 8), (3, 1000, 8)])
def test_recurring_groups_are_the_same_on_small_and_crowded_launches(spark, k, hot, crowded):
    df = spark.createDataFrame(sorted(random_parts(8)), "wallet string, mint string")
    whole, split = (sorted(H.recurring_groups(df, df, k, hot, n).collect()) for n in (10_000, crowded))
    assert whole == split and len(whole) > 10


@pytest.mark.parametrize("threshold", [0.3, 0.6])
def test_recurring_clusters(spark, threshold):
    shape = ("small", "single_funder", "high", "high", "low")
    rows = [("a", 1, *shape, "h", ["1", "2", "3"]), ("b", 1, *shape, "h", ["2", "3", "4"]), ("c", 1, "small", "x", "x", "x", "x", "h", ["1", "9", "8"]), ("d", 1, *shape, "h", ["7", "6", "5"])]
    df = spark.createDataFrame(rows, "mint string, cluster_id int, size_bucket string, topology string, timing_bucket string, purchase_bucket string, age_bucket string, members_hash string, members array<string>")
    got = {r.mint: (r.matches, round(r.best_similarity, 6)) for r in H.match_recurring(df, df, threshold).collect()}
    if threshold == 0.6:
        assert got == {"a": (1, 0.8), "b": (1, 0.8)}
    else:
        assert got["a"] == (2, 0.8) and got["d"] == (2, 0.4)


@pytest.mark.parametrize("threshold", [0.2, 0.3, 0.4])
def test_recurring_clusters_by_shape_alone(spark, threshold):
    """Below 0.4 pairs without a shared member count when enough buckets agree."""
    rng = random.Random(4)
    rows = [(f"m{i}", 1, *(rng.choice("xy") for _ in range(5)), "h", [f"{i}a", f"{i}b", rng.choice(["s", f"{i}c"])]) for i in range(24)]
    df = spark.createDataFrame(rows, "mint string, cluster_id int, size_bucket string, topology string, timing_bucket string, purchase_bucket string, age_bucket string, members_hash string, members array<string>")
    want = {}
    for x in rows:
        sims = [0.6 * len(set(x[8]) & set(y[8])) / 3 + 0.4 * sum(p == q for p, q in zip(x[2:7], y[2:7])) / 5 for y in rows if y[0] != x[0]]
        hits = [v for v in sims if v >= threshold - 1e-12]
        if hits:
            want[x[0]] = (len(hits), round(max(hits), 9))
    assert {r.mint: (r.matches, round(r.best_similarity, 9)) for r in H.match_recurring(df, df, threshold).collect()} == want


@pytest.mark.parametrize("heavy", [0, 3, 10**6])
def test_newest_inflows_match_brute_force(spark, heavy):
    """Equal times, doubled transfers and keys of any size: one event per (time, slot, signature, source), newest first."""
    rng = random.Random(8)
    buys = [(f"m{i}", rng.choice(["a", "b", "c", None]), rng.randrange(12), 0) for i in range(30)]
    sent = [(f"s{rng.randrange(3)}", rng.choice(["a", "b", "d", None]), float(rng.randrange(3)), f"x{rng.randrange(2)}", rng.randrange(12), rng.randrange(2)) for _ in range(60)]
    first = spark.createDataFrame(buys, "mint string, wallet string, block_time long, slot long")
    money = spark.createDataFrame(sent + sent[:20], "source string, recipient string, amount double, signature string, block_time long, slot long")
    want = set()
    for mint, wallet, time, slot in buys:
        events = {}
        for source, recipient, amount, signature, t, s in sent:
            if wallet is not None and recipient == wallet and (t, s) < (time, slot):
                events[t, s, signature, source] = max(amount, events.get((t, s, signature, source), 0.0))
        for k, (key, amount) in enumerate(sorted(events.items(), reverse=True)[:3]):
            want.add((mint, wallet, *key, amount, k + 1))
    got = [(r.mint, r.wallet, r.block_time, r.slot, r.signature, r.source, r.amount, r.event) for r in G.funding_events(first, money, width=4, heavy=heavy).collect()]
    assert len(got) == len(want) and set(got) == want and {g[-1] for g in got} == {1, 2, 3}


def test_buyers_keep_their_whole_position(spark):
    rows = [trade("a", 1), trade("a", 2, buy=False, token=4.0), trade("b", 3, buy=False), trade("c", 4, token=2.0)]
    assert sorted(tuple(r) for r in T.buyer_positions(tape(spark, *rows)).collect()) == [("m", "a", 6.0), ("m", "c", 2.0)]


def test_paths_end_where_nobody_paid_the_address(spark, monkeypatch):
    """Chains whose address has no inflow leave the search; with none left no as-of join is made for the further hops."""
    from mintweave.operators import funding

    joins = []
    monkeypatch.setattr(funding, "last_before", lambda *a, _run=funding.last_before, **k: joins.append(1) or _run(*a, **k))
    given = [("m", "w1", "f1", 50, 0), ("m", "w2", "f2", 50, 0), ("m", "w3", None, None, None)]
    found = spark.createDataFrame(given, "mint string, wallet string, direct_funder string, funding_time long, funding_slot long")
    sent = spark.createDataFrame([("g", "f1", 40, 0, "s"), (None, "g", 10, 0, "s"), ("late", "f1", 60, 0, "s")], "source string, recipient string, block_time long, slot long, signature string")
    judged = spark.createDataFrame([("f1", "FUNDER"), ("f2", "FUNDER")], "address string, entity_type string")
    got = {r.wallet: (r.path, r.root, r.hops) for r in M.funding_paths(found, sent, judged, max_hops=4).collect()}
    assert got == {"w1": (["g", "f1", "w1"], "g", 2), "w2": (["f2", "w2"], "f2", 1)} and len(joins) == 1


def test_no_hidden_buyer_limit(spark):
    """A launch of 150 buyers is numbered whole, and sponsor groups follow the limit given."""
    rows = [trade(f"w{i:03d}", i, payer="boss" if i >= 110 else None) for i in range(150)]
    df = tape(spark, *rows)
    assert sorted((r.position, r.wallet) for r in T.first_buyers(df, None).collect()) == [(i + 1, f"w{i:03d}") for i in range(150)]
    assert X.sponsor_members(df, 100).count() == 0 and X.sponsor_members(df, 150).count() == 40


def test_explanation_keeps_the_order_of_equal_parts(spark):
    base = {s: 1.0 for s in K.SIGNALS} | dict(fresh_share=0.0, mayhem_share=0.0, atomic_share=0.0, atomic_size=0, funder_is_infrastructure=False)
    df = R.bundle_score(spark.createDataFrame([("m", 1, *base.values())], ["mint", "cluster_id", *base]))
    labels = [r.label for r in R.top_contributions(df).orderBy("rank").collect()]
    lines = R.score_explanation(df).first().lines
    assert [line.split(" ", 1)[1] for line in lines[: len(labels)]] == labels


def test_contributions_are_ranked_inside_their_row(spark):
    """Equal points keep their order, parts without points are left out, and no row is sorted against another."""
    part = "array<struct<name:string,label:string,points:double,max_points:double,raw_signal:double>>"
    parts = [("a", "A", 1.0, 9.0, 0.1), ("b", "B", 3.0, 9.0, 0.1), ("c", "C", 0.0, 9.0, 0.1), ("d", "D", 3.0, 9.0, 0.1), ("e", "E", 2.0, 9.0, 0.1)]
    df = spark.createDataFrame([("m", 1, parts), ("m", 2, [])], f"mint string, cluster_id int, contributions {part}")
    out = R.top_contributions(df, 3)
    assert [tuple(r)[:4] for r in out.orderBy("rank").collect()] == [("m", 1, 1, "b"), ("m", 1, 2, "d"), ("m", 1, 3, "e")]
    assert "Window" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("hot", [2, 15, 10_000])
def test_recurring_clusters_match_brute_force(spark, hot):
    rng = random.Random(12)
    rows = []
    for i in range(40):
        members = {"bot"} if rng.random() < 0.8 else set()
        while len(members) < rng.choice([3, 3, 4, 6]):
            members.add(f"w{rng.randrange(25)}")
        size = "small" if len(members) <= 3 else "medium"
        rows.append((f"m{i % 30}", i, size, rng.choice(["x", "y"]), "high", "high", "low", "h", sorted(members)))
    df = spark.createDataFrame(rows, "mint string, cluster_id int, size_bucket string, topology string, timing_bucket string, purchase_bucket string, age_bucket string, members_hash string, members array<string>")
    want = {}
    for x in rows:
        for y in rows:
            both = len(set(x[8]) & set(y[8]))
            if x[0] != y[0] and both:
                sim = 0.6 * both / min(len(x[8]), len(y[8])) + 0.4 * sum(p == q for p, q in zip(x[2:7], y[2:7])) / 5
                if sim >= 0.6 - 1e-12:
                    want.setdefault((x[0], x[1]), {})[y[0]] = max(sim, want.get((x[0], x[1]), {}).get(y[0], 0))
    got = {(r.mint, r.cluster_id): (r.matches, round(r.best_similarity, 9)) for r in H.match_recurring(df, df, 0.6, hot_degree=hot).collect()}
    assert got == {k: (len(v), round(max(v.values()), 9)) for k, v in want.items()}


@pytest.mark.parametrize("crowded, hot", [(3, 10_000), (4, 5), (32, 10_000)])
def test_recurring_clusters_of_every_size_match_brute_force(spark, crowded, hot):
    """Clusters of one, two and more than ``crowded`` members meet the others too, and only two wallets or the shape pair the rest."""
    rng = random.Random(21)
    rows = []
    for i in range(60):
        members = sorted({f"w{rng.randrange(14)}" for _ in range(rng.choice([1, 2, 3, 4, 5, 8]))})
        rows.append((f"m{i % 40}", i, "small", rng.choice("xy"), rng.choice("xy"), "high", "low", "h", members))
    df = spark.createDataFrame(rows, "mint string, cluster_id int, size_bucket string, topology string, timing_bucket string, purchase_bucket string, age_bucket string, members_hash string, members array<string>")
    want = {}
    for x, y in itertools.permutations(rows, 2):
        both = len(set(x[8]) & set(y[8]))
        sim = 0.6 * both / min(len(x[8]), len(y[8])) + 0.4 * sum(p == q for p, q in zip(x[2:7], y[2:7])) / 5
        if x[0] != y[0] and both and sim >= 0.6 - 1e-12:
            found = want.setdefault((x[0], x[1]), {})
            found[y[0]] = max(sim, found.get(y[0], 0))
    assert len({len(x[8]) for x in rows}) > 5
    got = {(r.mint, r.cluster_id): (r.matches, round(r.best_similarity, 9)) for r in H.match_recurring(df, df, 0.6, hot_degree=hot, crowded=crowded).collect()}
    assert got == {k: (len(v), round(max(v.values()), 9)) for k, v in want.items()}


def test_components_match_union_find(spark):
    rng = random.Random(6)
    edges = [("m", f"n{rng.randrange(90)}", f"n{rng.randrange(90)}") for _ in range(60)] + [("m", f"p{i}", f"p{i + 1}") for i in range(30)]
    edges = [e for e in edges if e[1] != e[2]]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for _, a, b in edges:
        root[find(a)] = find(b)
    want = {}
    for x in root:
        want.setdefault(find(x), set()).add(x)
    got = {}
    for r in G.connected_components(spark.createDataFrame(edges, "mint string, src string, dst string")).collect():
        got.setdefault(r.component, set()).add(r.wallet)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    assert all(c == min(members) for c, members in got.items())


def test_components_step_over_numbers_and_keep_launches_apart(spark, monkeypatch):
    written = []
    real = G.cut
    monkeypatch.setattr(G, "cut", lambda df, name="step": (written.append((name, [f.dataType.typeName() for f in df.schema])), real(df, name))[1])
    edges = [("m", "b", "Z"), ("m", "é", "b"), ("k", "b", "a"), ("k", "b", "b"), ("k", "hub", "c")] + [("k", f"w{i}", "hub") for i in range(50)]
    got = {(r.mint, r.wallet): r.component for r in G.connected_components(spark.createDataFrame(edges, "mint string, src string, dst string")).collect()}
    want = {("m", x): "Z" for x in ("Z", "b", "é")} | {("k", x): "a" for x in "ab"} | {("k", x): "c" for x in ("c", "hub", *(f"w{i}" for i in range(50)))}
    assert got == want
    assert all(kinds == ["long", "long"] for name, kinds in written if name == "stars")  # no round carries names


def test_bundle_context_without_exits_and_shared_transactions(spark):
    members = spark.createDataFrame([("m", 1, "a"), ("m", 1, "b"), ("m", 2, "c"), ("n", 1, "a")], "mint string, cluster_id long, wallet string")
    facts = spark.createDataFrame([("m", "a", 10.0, True), ("m", "b", 9999.0, False), ("m", "c", 10.0, True)], "mint string, wallet string, age_seconds double, observed boolean")
    infra = spark.createDataFrame([("m", "x", "a"), ("m", "x", "b"), ("m", "x", "c")], "mint string, source string, wallet string")
    trades = spark.createDataFrame([("m", True), ("m", False), ("m", None), ("m", False)], "mint string, mayhem boolean")
    got = {(r.mint, r.cluster_id): r for r in K.bundle_context(members, facts, T.flagged_trades(trades), infra).collect()}
    assert set(got[("m", 1)].asDict()) == {"mint", "cluster_id", "fresh_share", "unobserved_share", "funder_is_infrastructure", "mayhem_share"}
    values = {k: (r.fresh_share, r.unobserved_share, r.funder_is_infrastructure, r.mayhem_share) for k, r in got.items()}
    assert values == {("m", 1): (0.5, 0.5, True, 0.25), ("m", 2): (1.0, 0.0, False, 0.25), ("n", 1): (0.0, 1.0, False, 0.0)}


def test_communities_find_two_cliques(spark):
    clique = lambda names: [("m", a, b, 1.0) for a, b in itertools.combinations(names, 2)]
    edges = spark.createDataFrame(clique("abcd") + clique("efgh") + [("m", "d", "e", 0.1)], "mint string, src string, dst string, weight double")
    labels = G.communities(edges)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.community, set()).add(r.wallet)
    assert sorted(map(sorted, groups.values())) == [list("abcd"), list("efgh")]
    assert G.modularity(edges, labels).first().modularity == pytest.approx(0.4917, abs=1e-3)


def test_communities_of_a_star_are_finished(spark):
    """A star merges one leaf per round; no number of rounds cuts it short."""
    edges = spark.createDataFrame([("m", "a", f"b{i}", 1.0) for i in range(6)], "mint string, src string, dst string, weight double")
    assert {r.community for r in G.communities(edges).collect()} == {"a"}


def test_density_groups(spark):
    rows = [("m", w, i, *p) for i, (w, p) in enumerate({
        "a": (0.0, 0.0, 0.0, 0.0, 0.0), "b": (0.1, 0.0, 0.0, 0.0, 0.0), "c": (0.2, 0.0, 0.0, 0.0, 0.0), "edge": (0.9, 0.0, 0.0, 0.0, 0.0),
        "far": (9.0, 9.0, 0.0, 0.0, 0.0)}.items())]
    df = spark.createDataFrame(rows, "mint string, wallet string, position int, f0 double, f1 double, f2 double, f3 double, f4 double")
    got = {r.wallet: (r.group, r.is_core) for r in G.behaviour_groups(df).collect()}
    assert got == {"a": ("a", True), "b": ("a", True), "c": ("a", True), "edge": ("a", False)}


def test_merge(spark):
    rows = [("m", 0, "graph", list("abcdef")), ("m", 1, "execution", list("abc")), ("m", 3, "community", list("abcdeg")), ("m", 4, "behaviour", list("xyz")), ("m", 2, "execution", list("xw"))]
    df = spark.createDataFrame(rows, "mint string, rank int, method string, members array<string>")
    got = [(r.members, r.methods) for r in K.merge_candidates(df).orderBy("order").collect()]
    assert got == [(list("abcdefg"), ["community", "execution", "graph"]), (list("xyz"), ["behaviour"]), (["x", "w"], ["execution"])]
    assert K.build_clusters(K.merge_candidates(df)).orderBy("cluster_id").first().method == "community+execution+graph"


def scored(spark, **values):
    base = {s: 0.0 for s in K.SIGNALS} | dict(fresh_share=0.0, mayhem_share=0.0, atomic_share=0.0, atomic_size=0, funder_is_infrastructure=False)
    base.update(values)
    df = spark.createDataFrame([("m", 1, *base.values())], ["mint", "cluster_id", *base])
    return R.bundle_score(df).first()


def test_one_signal_is_capped(spark):
    got = scored(spark, common_funder=1.0, common_intermediary=1.0)
    assert got.families == 1 and got.bundle_score <= 35
    assert scored(spark, funding_amount_similarity=1.0, buy_amount_similarity=1.0).bundle_score < 50


def test_atomic_floor(spark):
    got = scored(spark, common_funder=0.7, shared_signer=1.0, buy_timing_similarity=0.8, wallet_age_similarity=0.5, atomic_size=5, atomic_share=1.0)
    assert (got.floor, got.bundle_score) == (78.0, 78)
    assert scored(spark, shared_signer=1.0, atomic_size=5, atomic_share=1.0).floor is None


def test_damping(spark):
    full = scored(spark, common_funder=1.0, shared_signer=1.0, buy_timing_similarity=1.0)
    assert scored(spark, common_funder=1.0, shared_signer=1.0, buy_timing_similarity=1.0, funder_is_infrastructure=True).total_points == pytest.approx(full.total_points - 12.8)
    assert scored(spark, common_funder=1.0, shared_signer=1.0, buy_timing_similarity=1.0, mayhem_share=0.5).total_points == pytest.approx(full.total_points - 4.5)


def test_stored_clusters_are_replaced(spark, tmp_path):
    path = str(tmp_path / "clusters")
    rows = lambda *r: spark.createDataFrame(list(r), "mint string, cluster_id int, wallet string")
    D.save_clusters(spark, path, rows(("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")), buckets=2)
    D.save_clusters(spark, path, rows(("a", 1, "new")), buckets=2)
    assert sorted((r.mint, r.wallet) for r in spark.read.parquet(path).collect()) == [("a", "new"), ("b", "y"), ("c", "z")]


def test_history_leaves_the_launch_out(spark):
    rows = tape(spark, *[trade("w", i, mint=f"m{i % 3}", sig=f"s{i}") for i in range(9)])
    got = {r.mint: (r.launches, r.trades) for r in W.wallet_history(T.first_buys(rows), W.participation(rows)).collect()}
    assert got == {f"m{i}": (2, 6) for i in range(3)}


def test_routes_need_no_amounts_and_no_root_kinds(spark):
    sent = spark.createDataFrame(
        [("r", "f", "SOL", 3.0, "s1", 10, 1), ("f", "w", "SOL", 2.0, "s2", 20, 2), ("g", "v", "SOL", 1.0, "s3", 30, 3)],
        "source string, recipient string, asset string, amount double, signature string, block_time long, slot long",
    )
    first = spark.createDataFrame([("m", "w", 50, 5), ("m", "v", 60, 6), ("m", "x", 70, 7)], "mint string, wallet string, block_time long, slot long")
    known = spark.createDataFrame([], "address string, label string, entity_type string, source string, confidence double, verify boolean")
    found, narrow = (M.asof_funding(first, M.money(sent, columns)) for columns in (M.MONEY, M.ROUTE))
    route = ["mint", "wallet", "direct_funder", "funding_time", "funding_slot", "funding_signature", "found"]
    assert sorted(found.select(*route).collect()) == sorted(narrow.select(*route).collect())
    assert narrow.columns == found.columns and narrow.filter("funding_amount is not null").isEmpty()
    judged = M.assess_sources(M.funder_members(found), known)
    whole = M.funding_paths(found, M.money(sent), judged, max_hops=4)
    bare = M.funding_paths(narrow, M.money(sent, M.ROUTE), judged, max_hops=4, kinds=False)
    assert "root_type" not in bare.columns
    assert {(r.wallet, tuple(r.path), r.hops) for r in bare.collect()} == {("w", ("r", "f", "w"), 2), ("v", ("g", "v"), 1)}
    assert sorted(whole.drop("root_type").collect()) == sorted(bare.collect())


def _drawn(spark):
    rows = [trade("a", 1, sig="t1"), trade("a", 2, sig="t2", buy=False, quote=2.0), trade("b", 3, sig="t3"), trade("c", 4, sig="t4", buy=False)]
    df = tape(spark, *rows)
    buyers = T.buyers_with_positions(df, ("block_time", "slot", "quote_amount"))
    sent = [("f", "a", 9.0, "s1", T0 - 9, 0), ("f", "a", 9.0, "s1", T0 - 8, 0), ("g", "f", 5.0, "s0", T0 - 20, 0), ("a", "b", 1.0, "s2", T0 + 1, 0), (None, "b", 1.0, "s3", T0 - 1, 0)]
    money = spark.createDataFrame(sent, "source string, recipient string, amount double, signature string, block_time long, slot long")
    return df, buyers, G.wallet_inflows(buyers, money)


def test_edges_count_a_transaction_once_and_look_up_steps_into_buyers(spark):
    df, buyers, inflows = _drawn(spark)
    profiles = buyers.select("mint", "wallet")
    creators = spark.createDataFrame([("m", "z", "y", 3.0)], "mint string, creator string, funding_source string, funding_amount double")
    paths = spark.createDataFrame([("m", ["g", "f", "a"]), ("m", ["f", "a", "b"]), ("m", ["q", "b"])], "mint string, path array<string>")
    none = spark.createDataFrame([], "mint string, owner string, amount double")
    common = {
        ("a", "m", "buy:t1", "BOUGHT", 1.0), ("a", "m", "sell:t2", "SOLD", 2.0), ("b", "m", "buy:t3", "BOUGHT", 1.0), ("z", "m", "created", "CREATED", None),
        ("y", "z", "fund:z", "FUNDED", 3.0), ("f", "a", "fund:s1", "FUNDED", 9.0), ("a", "b", "fund:s2", "FUNDED", 1.0), ("g", "f", "fund:f", "FUNDED", None),
    }
    for told, more in ((True, set()), (False, {("q", "b", "fund:b", "FUNDED", None)})):
        out = G.graph_edges(df, profiles, creators, inflows, paths, none, told)
        got = [(r.src, r.dst, r.key, r.relation, r.amount) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == common | more


def test_newest_inflow_starts_the_paths(spark):
    _, _, inflows = _drawn(spark)
    got = {(r.wallet, r.direct_funder, r.funding_amount, r.funding_time) for r in G.newest_funder(inflows).collect()}
    assert got == {("a", "f", 9.0, T0 - 8), ("b", "a", 1.0, T0 + 1)}


def test_simple_view_names_every_relation_and_refuses_others(spark):
    rows = [("m", "a", "m", r, 9.0) for r in ("SOLD", "BOUGHT", "BOUGHT")] + [("m", "m", "a", "HOLDS", None), ("m", "z", "m", None, None)]
    kind = "mint string, src string, dst string, relation string, amount double"
    got = {(r.a, r.b): (r.weight, r.relations) for r in G.graph_simple_view(spark.createDataFrame(rows, kind)).collect()}
    assert got == {("a", "m"): (7.0, ["BOUGHT", "HOLDS", "SOLD"]), ("m", "z"): (1.0, [])}
    with pytest.raises(Exception, match="unknown relation LENT"):
        G.graph_simple_view(spark.createDataFrame([("m", "a", "b", "LENT", 1.0)], kind)).collect()


def test_export_holds_nodes_edges_and_clusters_with_their_attributes(spark):
    """The export once held the nodes alone, without money, first buy and time."""
    from mintweave.sources import exports

    nodes = spark.createDataFrame([("m", "wallet-a", "buyer", 200.0, 7, "wallet", "BUYER", None, 1.5, 60.0)],
                                  "mint string, node string, category string, size double, risk int, role string, entity_type string, label string, sol_balance double, age_seconds double")
    edges = spark.createDataFrame([("m", "m", "wallet-a", 2.00049, ["BOUGHT", "SOLD"])], "mint string, a string, b string, weight double, relations array<string>")
    wallets = spark.createDataFrame([("m", "wallet-a", 2, 4.0, 1.25, 3.0)], "mint string, wallet string, cluster_id int, funding_amount double, quote_amount double, seconds_after_launch double")
    members = spark.createDataFrame([("m", 1, "wallet-a", 50), ("m", 2, "wallet-a", 60)], "mint string, cluster_id int, wallet string, score int")
    got = {(r.part, r.node, r.cluster): r.asDict() for r in exports.export_graph(nodes, edges, wallets, members).collect()}
    assert set(got) == {("node", "wallet-a", 2), ("edge", "m", None), ("cluster", "wallet-a", 1), ("cluster", "wallet-a", 2)}
    node, edge = got["node", "wallet-a", 2], got["edge", "m", None]
    assert (node["sol_balance"], node["age_seconds"], node["funding_amount"], node["first_buy_amount"], node["seconds_after_launch"], node["size"]) == (1.5, 60.0, 4.0, 1.25, 3.0, 5.0)
    assert (edge["other"], edge["weight"], edge["relations"]) == ("wallet-a", 2.0, "BOUGHT,SOLD") and got["cluster", "wallet-a", 2]["score"] == 60


def _random_graph(spark, seed):
    rng = random.Random(seed)
    rows = {}
    for m in range(12):
        for _ in range(rng.randrange(2, 40)):
            a, b = sorted(rng.sample([f"w{i}" for i in range(14)] + ["é", "Z"], 2))
            rows[m, a, b] = rng.choice([0.25, 0.5, 1.0, 1.5])
    return spark.createDataFrame([(*k, w) for k, w in rows.items()], "mint long, src string, dst string, weight double")


@pytest.mark.parametrize("seed", [1, 2])
def test_launches_settled_in_a_task_equal_the_rounds_of_joins(spark, seed):
    """All launches by joins, some, or none: the same components, communities and modularity."""
    edges = _random_graph(spark, seed)
    for make in (G.connected_components, G.communities):
        want = {tuple(r) for r in make(edges, local=0).collect()}
        for local in (20, L.LOCAL):
            got = [tuple(r) for r in make(edges, local=local).collect()]
            assert len(got) == len(want) and set(got) == want
    want = {r.mint: round(r.modularity, 9) for r in G.modularity(edges, G.communities(edges, local=0)).collect()}
    for local in (20, L.LOCAL):
        assert {r.mint: round(r.modularity, 9) for r in G.community_modularity(edges, local=local).collect()} == want


@pytest.mark.parametrize("pairs", [30, 10**6])
def test_density_groups_in_a_task_equal_the_joins(spark, monkeypatch, pairs):
    import pandas as pd

    rng = random.Random(5)
    rows = []
    for m in range(8):
        n = rng.randrange(3, 25)
        rows += [(m, f"w{i:02d}", p + 1, *(rng.choice([0.0, 0.5, 1.0, 4.0]) for _ in range(5))) for p, i in enumerate(rng.sample(range(n), n))]
    df = spark.createDataFrame(rows, "mint long, wallet string, position int, " + ", ".join(f"{f} double" for f in G.FEATURES))
    want = {tuple(r) for r in G.behaviour_groups(df, crowded=0).collect()}
    for crowded in (10, 1000):
        got = [tuple(r) for r in G.behaviour_groups(df, crowded=crowded).collect()]
        assert len(got) == len(want) and set(got) == want
    monkeypatch.setattr(L, "PAIRS", pairs)
    here = L.density_groups(pd.DataFrame(rows, columns=df.columns), G.FEATURES, 0.75, 3)
    assert {tuple(r) for r in here.itertuples(index=False)} == want and {True, False} == set(here.is_core)


def test_no_edges_and_no_buyers_give_no_rows(spark):
    empty = spark.createDataFrame([], "mint long, src string, dst string, weight double")
    assert G.connected_components(empty).count() == G.communities(empty).count() == G.community_modularity(empty).count() == 0
    buyers = spark.createDataFrame([], "mint long, wallet string, position int, " + ", ".join(f"{f} double" for f in G.FEATURES))
    assert G.behaviour_groups(buyers).count() == 0


def test_group_components_equal_those_of_all_links(spark):
    rng = random.Random(9)
    rows = list({(rng.randrange(6), f"s{rng.randrange(9)}", f"w{rng.randrange(20)}") for _ in range(150)})
    members = spark.createDataFrame(rows, "mint long, source string, wallet string")
    pairs = [(m, v, w) for m, s, v in rows for n, t, w in rows if (m, s) == (n, t) and v < w]
    want = {tuple(r) for r in G.connected_components(spark.createDataFrame(pairs, "mint long, src string, dst string"), local=0).collect()}
    for local in (0, 20, L.LOCAL):
        got = [tuple(r) for r in G.group_components(members, local).collect()]
        assert len(got) == len(want) and set(got) == want


def test_members_of_paths_and_funders_need_no_exchange(spark):
    paths = spark.createDataFrame([("m", "w", ["g", "f", "w"]), ("m", "v", ["f", "v"])], "mint string, wallet string, path array<string>")
    funding = spark.createDataFrame([("m", "w", "f"), ("m", "v", None)], "mint string, wallet string, direct_funder string")
    for df, want in ((M.intermediary_members(paths), {("m", "g", "w"), ("m", "f", "w"), ("m", "f", "v")}), (M.funder_members(funding), {("m", "f", "w")})):
        assert {tuple(r) for r in df.collect()} == want and "Exchange" not in df._jdf.queryExecution().toString()
