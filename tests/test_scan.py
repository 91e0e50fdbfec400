"""The scan as a job of stages: what it makes, what it reads, what it keeps."""

import os

import pytest
from pyspark.sql import functions as F

from mintweave.operators.versions import manifest, read_version
from mintweave.plans.scan import Scan, cluster_memory, launch_scan, save_scan
from tests.test_scenarios import DAY, World

GROUP = {"components", "communities", "behaviour", "clusters", "members", "scores", "report"}
SHOWN = {"evidence", "graph_nodes", "graph_edges", "holders", "windows", "timeline"}


def crew(mint, wallets, at):
    w = World()
    w.launch(mint)
    for i, a in enumerate(wallets):
        w.fund("patron", a, 5.0, at - 40 + i)
        w.buy(mint, a, at + i, 1.0)
    return w


@pytest.fixture(scope="module")
def tables(spark):
    w = crew("crew", [f"c{i}" for i in range(8)], 3)
    w.launch("foreign")
    w.buy("foreign", "c0", 50, 1.0)
    w.launch("plain", complete=True)
    for i in range(4):
        w.old(f"p{i}", (20 + i) * DAY)
        w.buy("plain", f"p{i}", 100 + 700 * i, 1.0 + i)
    t = w.tables(spark)
    t.origin = spark.createDataFrame([("crew", "accepted"), ("plain", "unknown"), ("foreign", "rejected")], "mint string, status string")
    t.holders = spark.createDataFrame(
        [("crew", f"c{i}", float(10 * (i + 1)), "helius") for i in range(8)]
        + [("crew", "exchange", 5000.0, "helius"), ("crew", "x", 9.0, "rpc"), ("plain", "p1", 1.0, "rpc"), ("plain", None, 3.0, "rpc"), ("plain", "p2", 0.0, "rpc")],
        "mint string, owner string, amount double, provider string",
    )
    t.requests = spark.createDataFrame(
        [("crew", "a", True, 0.1), ("crew", "a", True, 0.1), ("plain", "a", False, 0.1), ("plain", "a", True, 0.1), ("plain", "b", False, 0.1)],
        "mint string, provider string, ok boolean, latency double",
    )
    t.incomplete = spark.createDataFrame([("plain",)], "mint string")
    return t


@pytest.fixture(scope="module")
def scan(tables):
    with launch_scan(tables, "full") as made:
        yield made


def test_only_what_is_asked_for(scan, tables):
    assert scan.made == set()
    assert scan.wallet_facts.count() == 12
    assert not scan.made & (GROUP | SHOWN)
    report = {r.mint: r for r in scan.report.collect()}
    assert GROUP <= scan.made and not scan.made & SHOWN
    assert Scan.needs("report") >= scan.made
    assert report["crew"]["size"] == 8
    with launch_scan(tables, "quick") as quick:
        assert quick.links.count() == 0 and not quick.made & {"parts", "overlaps", "creator_money"}


def test_rejected_launches_are_history_only(scan):
    assert {r.mint for r in scan.report.select("mint").collect()} == {"crew", "plain"}
    others = {(r.mint, r.wallet): r.launches for r in scan.wallet_facts.select("mint", "wallet", "launches").collect()}
    assert others["crew", "c0"] == 1 and others["crew", "c1"] == 0


def test_quality_of_the_sources(scan):
    levels = {(r.mint, r.dimension): r.level for r in scan.coverage.collect()}
    assert levels["crew", "launch_trades"] == "complete" and levels["plain", "launch_trades"] == "partial"
    assert levels["crew", "holders"] == "complete" and levels["plain", "holders"] == "partial"
    assert len(levels) == 12
    providers = {r.mint: r.providers for r in scan.quality.collect()}
    assert providers == {"crew": 1.0, "plain": 0.25}
    report = {r.mint: r for r in scan.report.collect()}
    assert "a data source failed often" in report["plain"].limitations and "a data source failed often" not in report["crew"].limitations
    assert any("incomplete" in x for x in report["plain"].warnings) and not any("incomplete" in x for x in report["crew"].warnings)


def test_holders_without_protocol_accounts(scan):
    rows = {(r.mint, r.owner): r.position for r in scan.holders.collect()}
    assert rows == {**{("crew", f"c{i}"): 8 - i for i in range(8)}, ("plain", "p1"): 1}
    crew_ = scan.holder_concentration.filter("mint = 'crew'").first()
    assert crew_.total_held == 360 and crew_.holder_count == 8 and crew_.top_1_share == pytest.approx(80 / 360)


def test_early_trading_tables(scan):
    for table in (scan.windows, scan.timeline, scan.slots, scan.distribution, scan.fresh_buckets):
        assert {r.mint for r in table.select("mint").collect()} == {"crew", "plain"}
    after = {r.wallet: r.behaviour for r in scan.post_graduation.collect()}
    assert after == {f"p{i}": "held" for i in range(4)}
    # The scan's time is that of the newest trade.
    assert {r.mint: r.age_seconds for r in scan.lifecycle.collect()} == {"crew": 2200.0, "plain": 2200.0}


def test_display_graph(scan):
    nodes = {(r.mint, r.node): r.role for r in scan.graph_nodes.collect()}
    assert nodes["crew", "crew"] == "token" and nodes["crew", "c3"] == "wallet" and nodes["crew", "patron"] == "actor"
    assert ("crew", "exchange") not in nodes and not any(m == "foreign" for m, _ in nodes)
    edges = {(r.mint, r.src, r.dst, r.relation) for r in scan.graph_edges.collect()}
    assert {("crew", "patron", f"c{i}", "FUNDED") for i in range(8)} <= edges
    assert {("crew", f"c{i}", "crew", "BOUGHT") for i in range(8)} <= edges
    assert all((m, n) in nodes for m, s, d, _ in edges for n in (s, d))


def test_two_scans_in_a_row_know_the_crew(spark, scan, tmp_path):
    folder = str(tmp_path / "kept")
    save_scan(scan, folder, "run-1", 10)
    save_scan(scan, folder, "run-1", 10)
    assert {name: manifest(spark, f"{folder}/{name}")["version"] for name in ("scores", "clusters", "fingerprints")} == dict(scores=1, clusters=1, fingerprints=1)
    save_scan(scan, folder, "run-2", 20)
    scores = read_version(spark, f"{folder}/scores", "mint string")
    assert sorted((r.mint, r.created_at) for r in scores.collect()) == [("crew", 10), ("crew", 20), ("plain", 10), ("plain", 20)]
    assert cluster_memory(spark, folder).count() == scan.clusters.count()

    again = crew("again", [*(f"c{i}" for i in range(6)), "newcomer"], 100_000).tables(spark)
    again.cluster_memory = cluster_memory(spark, folder)
    with launch_scan(again, "full") as later:
        assert later.signals.agg(F.max("repeated_cluster")).first()[0] > 0.6
        place = later.folder
        assert os.listdir(place)
    assert not os.path.exists(place)


def test_nothing_remembered(spark, tmp_path):
    assert cluster_memory(spark, str(tmp_path / "never")).count() == 0


def test_tape_and_payments_are_written_once():
    assert Scan.all_trades.stored and Scan.transfers.stored
    assert "transfers" in Scan.needs("funding") & Scan.needs("paths") & Scan.needs("creator_money")
