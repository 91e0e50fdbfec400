"""Ten launches with a known story, analysed together in one scan."""

import random

import pytest
from pyspark.sql import functions as F

from mintweave.plans.scan import Tables, launch_scan
from tests.test_operators import T0, TRADE, TRANSFER

DAY = 86400
INITIAL = 793_100_000_000_000


class World:
    def __init__(self):
        self.trades, self.moves, self.launches, self.seen = [], [], [], set()

    def launch(self, mint, creator=None, mayhem=False, complete=False):
        self.launches.append((mint, creator or f"{mint}-dev", T0, mayhem, complete, INITIAL // 2, INITIAL, None, T0 + 5000 if complete else None))

    def old(self, wallet, seconds):
        """An early outgoing payment: the wallet exists since then."""
        self.moves.append((wallet, f"{wallet}-shop", 0.5, T0 - seconds))

    def fund(self, source, wallet, amount, at):
        self.moves.append((source, wallet, amount, T0 + at))

    def buy(self, mint, wallet, at, amount, sig=None, payer=None, mayhem=False, slot=None, reserves=INITIAL - 10**12):
        self.trades.append((mint, wallet, sig or f"{mint}/{wallet}/{at}", slot or T0 + at, T0 + at, 0, True, float(amount), 100.0 * amount, mayhem, payer or wallet, True, reserves))

    def tables(self, spark):
        moves = [(s, r, "SOL", float(a), f"t{i}", t, t, 0.0, float(a)) for i, (s, r, a, t) in enumerate(self.moves)]
        touched = {(r[1], r[4], r[6]) for r in moves} | {(r[0], r[4], r[6]) for r in moves} | {(r[1], r[2], r[4]) for r in self.trades}
        launches = "mint string, creator string, created_at long, is_mayhem boolean, curve_complete boolean, real_token_reserves long, initial_real_tokens long, pool string, graduated_at long"
        return Tables(
            spark.createDataFrame(self.trades, TRADE),
            spark.createDataFrame(self.launches, launches),
            spark.createDataFrame(moves, TRANSFER),
            spark.createDataFrame([(a, s, t, t, None) for a, s, t in sorted(touched)], "address string, signature string, slot long, block_time long, err string"),
            spark.createDataFrame([("exchange", "Binance", "CEX", "community", 0.8, True)], "address string, label string, entity_type string, source string, confidence double, verify boolean"),
        )


def build():
    rng, w = random.Random(7), World()
    w.launch("independent")
    for i in range(20):
        a = f"ind{i}"
        w.old(a, rng.randrange(20, 400) * DAY)
        w.fund(f"ind-f{i}", a, rng.uniform(0.3, 14), -rng.randrange(1, 112) * 3600)
        w.buy("independent", a, 5 + i * 120 + rng.randrange(60), rng.uniform(0.05, 6))
    w.launch("private", creator="pdev")
    w.fund("boss", "pdev", 12, -900)
    for i in range(8):
        w.fund("boss", f"prv{i}", 5.0 + rng.uniform(-0.02, 0.02), -40 + i)
        w.buy("private", f"prv{i}", 3 + i, 1.0 + rng.uniform(-0.01, 0.01), payer="boss")
    w.launch("atomic")
    for i in range(5):
        w.fund("operator", f"atm{i}", 3, -20 + i)
        w.buy("atomic", f"atm{i}", 2, 1.0, sig="atomic-one", payer="operator")
    w.launch("cex")
    for i in range(12):
        a = f"cex{i}"
        w.old(a, rng.randrange(10, 200) * DAY)
        w.fund("exchange", a, rng.uniform(1, 8), -rng.randrange(600, 90000))
        w.buy("cex", a, 10 + i * 75, rng.uniform(0.2, 3))
    w.launch("automation")
    for i in range(6):
        a = f"aut{i}"
        w.old(a, rng.randrange(30, 300) * DAY)
        w.fund(f"aut-f{i}", a, rng.uniform(1, 20), -rng.randrange(1, 30) * DAY)
        w.buy("automation", a, 1, rng.uniform(0.2, 5), slot=T0 + 1)
    w.launch("mayhem", mayhem=True)
    for i in range(8):
        a = f"may{i}"
        w.old(a, rng.randrange(30, 300) * DAY)
        w.fund(f"may-f{i}", a, 2.0, -rng.randrange(1, 30) * DAY)
        w.buy("mayhem", a, 2 + i, 1.0, mayhem=True)
    w.launch("snipers")
    for i in range(6):
        a = f"snp{i}"
        w.old(a, rng.randrange(100, 300) * DAY)
        w.fund(f"snp-f{i}", a, rng.uniform(2, 30), -rng.randrange(40, 60) * DAY)
        for k in range(30):
            w.buy(f"old-{i}-{k}", a, -(k + 1) * DAY, 0.5, reserves=790_000_000_000_000)
        w.buy("snipers", a, 2 + i, rng.uniform(0.3, 4))
    w.launch("identical")
    for i in range(6):
        a = f"idt{i}"
        w.old(a, rng.randrange(30, 300) * DAY)
        w.fund(f"idt-f{i}", a, 5.0, -rng.randrange(1, 20) * DAY)
        w.buy("identical", a, 60 + i * 580, 1.0)
    w.launch("graduated", complete=True)
    for i in range(6):
        a = f"grd{i}"
        w.old(a, rng.randrange(30, 300) * DAY)
        w.fund(f"grd-f{i}", a, rng.uniform(1, 9), -rng.randrange(1, 20) * DAY)
        w.buy("graduated", a, 30 + i * 300, rng.uniform(0.5, 4))
    w.launch("unsigned")
    for i in range(8):
        w.fund("patron", f"uns{i}", 5.0 + rng.uniform(-0.02, 0.02), -40 + i)
        w.buy("unsigned", f"uns{i}", 3 + i, 1.0 + rng.uniform(-0.01, 0.01))
    # The crew of "unsigned" again, one member exchanged.
    w.launch("again")
    for i, a in enumerate(["uns0", "uns1", "uns2", "uns3", "uns4", "fresh"]):
        w.fund("patron", a, 5.0, 100000 - 40 + i)
        w.buy("again", a, 100000 + i, 1.0)
    return w


@pytest.fixture(scope="module")
def scan(spark):
    tables = build().tables(spark)
    crew = [f"uns{i}" for i in range(8)]
    tables.cluster_memory = spark.createDataFrame(
        [("unsigned", 1, "large", "single_funder", "very_high", "very_high", "very_high", "-", crew)],
        "mint string, cluster_id int, size_bucket string, topology string, timing_bucket string, purchase_bucket string, age_bucket string, members_hash string, members array<string>",
    )
    return launch_scan(tables, "full")


@pytest.fixture(scope="module")
def report(scan):
    return {r.mint: r for r in scan.report.collect()}


@pytest.fixture(scope="module")
def findings(scan):
    out = {}
    for r in scan.evidence.collect():
        out.setdefault(r.mint, {}).setdefault(r.code, []).append(r)
    return out


def test_independent(report):
    r = report["independent"]
    assert r.bundle_score < 45 and r.classification in ("NORMAL EARLY BUYERS", "INSUFFICIENT DATA", "POSSIBLE COORDINATION")


def test_private_bundle(report, findings):
    r = report["private"]
    assert r.bundle_score >= 60 and r.families >= 3 and r["size"] >= 6 and r.floor is None
    assert r.classification in ("BUNDLE-LIKE PATTERN", "POSSIBLE COORDINATION")
    assert {"COMMON_FUNDER", "SHARED_FEE_PAYER", "CREATOR_LINK"} <= set(findings["private"])
    assert all(f.signatures for f in findings["private"]["COMMON_FUNDER"])


def test_atomic_bundle(report, findings):
    r = report["atomic"]
    assert r.classification == "BUNDLE-LIKE PATTERN" and r.bundle_score >= 78
    assert any(len(f.wallets) == 5 for f in findings["atomic"]["ATOMIC_EXECUTION"])


def test_exchange_users(report, findings):
    r = report["cex"]
    assert r.bundle_score < 60 and r.classification != "BUNDLE-LIKE PATTERN"
    assert all(f.strength < 0.3 for f in findings["cex"]["INFRASTRUCTURE_FUNDER"])


def test_automation(report):
    r = report["automation"]
    assert r.same_slot_wallets >= 3 and r.classification == "MEV / AUTOMATED ACTIVITY"


def test_mayhem(report):
    r = report["mayhem"]
    assert r.flagged_trades > 0 and r.mayhem_activity > 0 and r.classification == "MAYHEM ACTIVITY"
    assert any("mayhem" in x for x in r.warnings)


def test_snipers(report, scan):
    assert report["snipers"].classification != "BUNDLE-LIKE PATTERN"
    assert scan.profiles.filter("mint = 'snipers'").agg(F.max("launches")).first()[0] >= 15


def test_identical_amounts(report):
    assert report["identical"].bundle_score < 50 and report["identical"].classification != "BUNDLE-LIKE PATTERN"


def test_graduated(report):
    assert report["graduated"].state in ("GRADUATED", "PUMPSWAP")


def test_same_crew_without_shared_signer(report):
    assert report["unsigned"].bundle_score < report["private"].bundle_score + 1
    assert report["unsigned"].classification in ("POSSIBLE COORDINATION", "BUNDLE-LIKE PATTERN")


def test_crew_comes_back(scan):
    rows = {r.mint: r.repeated_cluster for r in scan.signals.groupBy("mint").agg(F.max("repeated_cluster").alias("repeated_cluster")).collect()}
    assert rows["again"] > 0.6
    assert all(v == 0.0 for m, v in rows.items() if m != "again")
