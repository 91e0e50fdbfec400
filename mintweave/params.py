"""Thresholds and weights, in one place.

All values in this module are fixed values of the scoring rules.
"""

from __future__ import annotations

# Windows after launch, in seconds.
WINDOWS = {"ultra_early": 10, "early": 60, "launch": 300, "extended": 1800, "full": 3600}
CHECKPOINTS = (0, 1, 5, 10, 30, 60, 300, 600, 1800, 3600)

# Wallet-age buckets: label, exclusive upper bound in seconds.
FRESH_BUCKETS = (
    ("<30s", 30),
    ("<1m", 60),
    ("<5m", 300),
    ("<10m", 600),
    ("<1h", 3600),
    ("<6h", 21600),
    ("<24h", 86400),
)
FRESH_OLDEST = ">24h"

# signal -> (points, family, label)
SIGNALS = {
    "common_funder": (16.0, "funding_topology", "Common funding source"),
    "common_intermediary": (9.0, "funding_topology", "Common intermediary"),
    "shared_signer": (12.0, "execution", "Shared transaction signer"),
    "funding_amount_similarity": (7.0, "funding_pattern", "Funding size similarity"),
    "funding_timing_similarity": (7.0, "funding_pattern", "Funding synchronisation"),
    "buy_amount_similarity": (7.0, "trade_pattern", "Purchase size similarity"),
    "buy_timing_similarity": (9.0, "trade_pattern", "Purchase synchronisation"),
    "wallet_age_similarity": (5.0, "wallet_provenance", "Wallet age similarity"),
    "historical_overlap": (9.0, "history", "Historical overlap"),
    "repeated_cluster": (7.0, "history", "Repeated cluster across launches"),
    "creator_linkage": (7.0, "creator", "Creator linkage"),
}
OTHER_ANOMALIES = ("other_anomalies", 5.0, "Other anomalies")
# Carried with the signals but not weighted as one.
UNWEIGHTED_SIGNALS = ("sell_coordination",)

FAMILY_FIRES_AT = 0.40
MIN_FAMILIES = 3
ONE_FAMILY_CEILING = 35.0
TWO_FAMILY_CEILING = 55.0
ATOMIC_SHARE = 0.50
ATOMIC_FLOOR = 78.0
MIN_CLUSTER_SIZE = 3
LOW_DATA_WALLETS = 5
HIGH_DATA_WALLETS = 20
SMALL_SAMPLE_CEILING = 0.49

CV_IDENTICAL, CV_UNRELATED = 0.02, 0.60
AGE_CV_IDENTICAL, AGE_CV_UNRELATED = 0.05, 1.0
BUY_WINDOW = 60.0
FUNDING_WINDOW = 300.0
EXIT_WINDOW = 120.0

INFRA_FANOUT = 60
INFRA_ACTIVITY = 5000
INFRA_DAMPING = 0.20

MIN_SOL_INFLOW = 0.001
MIN_USDC_INFLOW = 0.5
LOOKBACK = 20
MAX_HOPS = 3

WEIGHT_FUNDER = 1.0
WEIGHT_INTERMEDIARY = 0.6
WEIGHT_TRANSFER = 1.0
WEIGHT_HISTORY = 0.5

MERGE_JACCARD = 0.5
DENSITY_EPS = 0.75
DENSITY_MIN_POINTS = 3
UNKNOWN_AGE = 86400.0

DEPTH_ULTRA, DEPTH_EARLY, DEPTH_MODERATE = 0.005, 0.02, 0.10
INITIAL_REAL_TOKENS = 793_100_000_000_000
NEAR_GRADUATION = 0.80
JUST_CREATED_SECONDS = 60

EXPERIENCED_LAUNCHES = 15
SNIPER_SHARE = 0.6
RECURRING_THRESHOLD = 0.6

LAMPORTS = 1_000_000_000

# depth -> buyers, recent txs, history wallets, history sample, creator sample, holders
DEPTHS = {
    "quick": dict(buyers=25, recent=0, history_wallets=0, history_sample=0, creator_sample=0, holders=20),
    "full": dict(buyers=50, recent=80, history_wallets=25, history_sample=60, creator_sample=250, holders=50),
    "deep": dict(buyers=100, recent=200, history_wallets=40, history_sample=150, creator_sample=500, holders=100),
}

# Watch and discovery.
WATCH_SECONDS = 120
WATCH_SCORE_STEP = 8
WATCH_EXIT_LEVEL = 60
DISCOVERY = dict(max_age=900, min_buyers=8, min_score=60, min_confidence=55)

# Seconds an entry stays valid, by key prefix.
TTL_BY_PREFIX = {
    "rpc:tx": 604800,
    "rpc:account": 15,
    "rpc:sigs": 30,
    "helius:asset": 3600,
    "solscan:account": 3600,
    "wallet:profile": 300,
    "wallet:history": 900,
    "creator:history": 900,
    "token:profile": 30,
    "entity:label": 86400,
}
TTL_DEFAULT = 300
