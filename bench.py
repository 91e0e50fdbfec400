"""Headline queries at one scale factor; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from mintweave.catalog import QUERIES  # noqa: E402
from mintweave.session import local_session  # noqa: E402

HEADLINE = [
    "first_buyers", "trade_index", "trade_index_hot_launch", "window_counts", "slot_analysis", "describe_distribution", "execution_sponsors",
    "execution_strength", "asof_funding", "funding_paths", "assess_funders", "inflow_events", "wallet_age", "wallet_history", "recurring_groups",
    "wallet_overlap_pairs", "creator_graduations", "holder_concentration", "wallet_exits", "sell_coordination", "connected_components_hubs",
    "bundle_score", "risk_report", "match_recurring", "evidence", "score_delta", "stream_trade_volume",
    "behaviour_groups", "assoc_edges", "graph_edges", "funding_events", "decode_events",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = local_session("bench", cores=cores, partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["first_buys"](spark, sf).write.format("noop").mode("overwrite").save()  # start the engine
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
