"""Column expressions shared by the operators.  All run inside codegen; no UDF."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from mintweave import params as P


def known(column: Column) -> Column:
    """Zero counts as missing for times and amounts (rule 1 of the survey's trap list)."""
    return F.nullif(column, F.lit(0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Limit to ``[low, high]``; null stays null (``greatest`` alone would skip it)."""
    return F.when(x.isNotNull(), F.least(F.lit(high), F.greatest(F.lit(low), x)))


def half_even(x: Column) -> Column:
    return F.bround(x).cast("int")


def scale_to_100(x: Column) -> Column:
    return half_even(clamp(x) * 100.0)


def logistic_confidence(n: Column, midpoint: float, steepness: float = 0.35) -> Column:
    return 1.0 / (1.0 + F.exp(-steepness * (n - F.lit(midpoint))))


def _eased(t: Column) -> Column:
    return 0.5 * (1.0 + F.cos(F.lit(math.pi) * t))


def similarity_from_cv(cv: Column, identical: float = P.CV_IDENTICAL, unrelated: float = P.CV_UNRELATED) -> Column:
    return (
        F.when(cv <= identical, 1.0)
        .when(cv >= unrelated, 0.0)
        .otherwise(_eased((cv - identical) / (unrelated - identical)))
    )


def similarity_from_span(span: Column, window: float) -> Column:
    return _eased(F.least(F.lit(1.0), span / F.lit(float(window))))


# --- grouped similarity, to be used inside ``agg`` ---------------------------------


def cv_of(x: Column) -> Column:
    mean = F.avg(x)
    return F.when(mean != 0, F.stddev_pop(x) / F.abs(mean)).otherwise(0.0)


def amount_similarity(x: Column, identical: float = P.CV_IDENTICAL, unrelated: float = P.CV_UNRELATED) -> Column:
    """Aggregate: fewer than two samples carry no information, hence 0."""
    return F.when(F.count(x) < 2, 0.0).otherwise(similarity_from_cv(cv_of(x), identical, unrelated))


def timing_similarity(t: Column, window: float) -> Column:
    return F.when(F.count(t) < 2, 0.0).otherwise(similarity_from_span((F.max(t) - F.min(t)).cast("double"), window))


# --- sets ----------------------------------------------------------------------------


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.size(F.array_union(a, b)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    a, b = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.least(F.size(a), F.size(b)))


def normalized_entropy(values: Column) -> Column:
    """Entropy of an array of weights over ``ln(n)``; fewer than two positive values give 0."""
    kept = F.filter(values, lambda v: v > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)
    h = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc - (v / total) * F.ln(v / total))
    return F.when(F.size(kept) < 2, 0.0).otherwise(h / F.ln(F.size(kept).cast("double")))


def array_mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v) / F.size(values)


# --- text and time ---------------------------------------------------------------------


def shorten(address: Column, head: int = 4, tail: int = 4) -> Column:
    return F.when(F.length(address) <= head + tail + 1, address).otherwise(
        F.concat(F.substring(address, 1, head), F.lit("…"), F.right(address, F.lit(tail)))
    )


def human_duration(seconds: Column) -> Column:
    s = F.abs(seconds.cast("double"))
    whole = F.floor(s).cast("long")
    sign = F.when(seconds < 0, "-").otherwise("")

    def pair(big: Column, big_unit: str, small: Column, small_unit: str) -> Column:
        return F.concat(big.cast("string"), F.lit(big_unit + " "), small.cast("string"), F.lit(small_unit))

    minutes, hours, days = (F.floor(whole / F.lit(n)) for n in (60, 3600, 86400))
    text = (
        F.when(s < 1, F.concat(F.bround(s * 1000).cast("long").cast("string"), F.lit("ms")))
        .when(s < 60, F.concat(F.bround(s).cast("long").cast("string"), F.lit("s")))
        .when(minutes < 60, pair(minutes, "m", whole % 60, "s"))
        .when(hours < 24, pair(hours, "h", minutes % 60, "m"))
        .otherwise(pair(days, "d", hours % 24, "h"))
    )
    return F.when(seconds.isNull(), "unknown").otherwise(F.concat(sign, text))


def human_age(epoch: Column, as_of: Column) -> Column:
    return human_duration((as_of - epoch).cast("double"))


def from_unix(epoch: Column) -> Column:
    """Epoch seconds to timestamp; years outside 1..9999 become null."""
    return F.when(epoch.between(-62135596800, 253402300799), F.timestamp_seconds(epoch))


def launch_age(created_at: Column, as_of: Column) -> Column:
    return F.when(created_at.isNotNull(), F.greatest(F.lit(0.0), (as_of - created_at).cast("double")))


def seconds_after(block_time: Column, created_at: Column) -> Column:
    delta = (block_time - known(created_at)).cast("double")
    return F.when(delta.isNotNull(), F.greatest(F.lit(0.0), delta))


def members_hash(members: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.array_sort(members), "|"), 256), 1, 16)


# --- buckets -----------------------------------------------------------------------------


def _ladder(x: Column, steps: Iterable[tuple[str, float]], last: str, *, inclusive: bool, missing: str | None) -> Column:
    out = F.when(x.isNull(), F.lit(missing))
    for label, bound in steps:
        out = out.when((x <= bound) if inclusive else (x < bound), label)
    return out.otherwise(last)


def fresh_bucket(age: Column) -> Column:
    return _ladder(age, P.FRESH_BUCKETS, P.FRESH_OLDEST, inclusive=False, missing=None)


def size_bucket(n: Column) -> Column:
    return _ladder(n, (("small", 3), ("medium", 7), ("large", 15)), "very_large", inclusive=True, missing=None)


def ratio_bucket(x: Column) -> Column:
    return F.when(x >= 0.85, "very_high").when(x >= 0.6, "high").when(x >= 0.35, "medium").otherwise("low")


def topology(has_funder: Column, has_intermediary: Column) -> Column:
    return (
        F.when(has_funder & has_intermediary, "funder+intermediary")
        .when(has_funder, "single_funder")
        .when(has_intermediary, "intermediary")
        .otherwise("behavioural")
    )


def age_bucket(age: Column) -> Column:
    steps = (("seconds", 60), ("minutes", 3600), ("hours", 86400), ("days", 604800))
    return _ladder(age, steps, "weeks+", inclusive=False, missing="unknown")


def amount_bucket(x: Column) -> Column:
    steps = (("dust", 0.1), ("small", 0.5), ("medium", 2), ("large", 10))
    return F.when(x <= 0, "unknown").otherwise(_ladder(x, steps, "whale", inclusive=False, missing="unknown"))


def entry_bucket(x: Column) -> Column:
    steps = (("instant", 5), ("ultra_early", 30), ("early", 300), ("mid", 1800))
    return _ladder(x, steps, "late", inclusive=True, missing="unknown")


def hold_bucket(x: Column) -> Column:
    return _ladder(x, (("flip", 60), ("short", 900), ("day", 86400)), "long", inclusive=False, missing="holding")


def sell_behavior(fraction: Column, has_sells: Column) -> Column:
    return (
        F.when(~has_sells, "none")
        .when(fraction >= 0.95, "full_exit")
        .when(fraction >= 0.4, "majority_exit")
        .otherwise("partial_exit")
    )


def frequency_bucket(n: Column) -> Column:
    steps = (("first_time", 1), ("occasional", 5), ("regular", 20), ("frequent", 100))
    return _ladder(n, steps, "industrial", inclusive=False, missing="unknown")


def risk_level(score: Column) -> Column:
    return _ladder(score, (("LOW", 24), ("MEDIUM", 49), ("HIGH", 74)), "CRITICAL", inclusive=True, missing=None)


def confidence_level(score: Column) -> Column:
    return F.when(score >= 75, "HIGH").when(score >= 50, "MEDIUM").when(score >= 25, "LOW").otherwise("VERY LOW")


# --- fixed value maps ------------------------------------------------------------------------

INFRASTRUCTURE_TYPES = ("PUMPFUN", "PUMPSWAP", "DEX", "CEX", "BRIDGE", "PROGRAM", "INFRASTRUCTURE", "VAULT", "BURN")

# Ordered: the first group with a keyword inside the label wins.
LABEL_KEYWORDS = (
    ("CEX", ("binance", "coinbase", "kraken", "okx", "bybit", "bitget", "gate.io", "gateio", "mexc", "kucoin",
             "huobi", "htx", "crypto.com", "bitfinex", "upbit", "bithumb", "exchange")),
    ("BRIDGE", ("bridge", "wormhole", "allbridge", "debridge", "portal")),
    ("DEX", ("raydium", "orca", "meteora", "jupiter", "phoenix", "openbook", "serum", "lifinity", "dex", "amm", "swap")),
    ("PUMPFUN", ("pump.fun", "pumpfun")),
    ("PUMPSWAP", ("pumpswap",)),
    ("PROGRAM", ("program", "authority", "sysvar")),
    ("VAULT", ("vault", "treasury")),
    ("BURN", ("burn", "incinerator")),
)

SYSTEM_PROGRAM = "11111111111111111111111111111111"
WRAPPED_SOL = "So11111111111111111111111111111111111111112"
USDC = "EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v"

LIFECYCLE_LABELS = {
    "CREATED": "CREATED",
    "BONDING_CURVE": "BONDING CURVE",
    "NEAR_GRADUATION": "NEAR GRADUATION",
    "GRADUATED": "GRADUATED",
    "PUMPSWAP": "GRADUATED → PUMPSWAP",
}
RISK_EMOJI = {"LOW": "🟢", "MEDIUM": "🟡", "HIGH": "🟠", "CRITICAL": "🔴"}
VERDICTS = {
    "INSUFFICIENT DATA": "Insufficient evidence",
    "NORMAL EARLY BUYERS": "Likely independent",
    "CEX-FUNDED USERS": "Likely independent (shared exchange funding)",
    "PROFESSIONAL SNIPERS": "Likely independent professional snipers",
    "MEV / AUTOMATED ACTIVITY": "Automated, not necessarily coordinated wallets",
    "MAYHEM ACTIVITY": "Protocol-automated activity present",
    "POSSIBLE COORDINATION": "Possible coordination",
    "BUNDLE-LIKE PATTERN": "Strong bundle-like pattern",
}


def text_of(column: Column, table: dict[str, str]) -> Column:
    """Look a value up in a small literal map."""
    pairs = [F.lit(v) for item in table.items() for v in item]
    return F.element_at(F.create_map(*pairs), column)


def is_infrastructure(entity_type: Column) -> Column:
    return F.coalesce(entity_type.isin(*INFRASTRUCTURE_TYPES), F.lit(False))


def label_to_entity(label: Column) -> Column:
    """Keyword reading of a free-form label; null when no keyword matches."""
    low = F.lower(label)
    out = None
    for entity, words in LABEL_KEYWORDS:
        pattern = "|".join(w.replace(".", "\\.") for w in words)
        hit = low.rlike(pattern)
        out = F.when(hit, entity) if out is None else out.when(hit, entity)
    return out


def resolve_pair(quote_mint: Column) -> Column:
    native = quote_mint.isNull() | quote_mint.isin("", SYSTEM_PROGRAM, WRAPPED_SOL)
    return F.when(native, "SOL").when(quote_mint == USDC, "USDC").otherwise("UNKNOWN")


def quote_decimals(quote_mint: Column) -> Column:
    return F.when(quote_mint == USDC, 6).otherwise(9)


def ui_amount(raw: Column, decimals: Column) -> Column:
    return F.coalesce(raw.cast("double") / F.pow(F.lit(10.0), decimals), F.lit(0.0))


def implied_price(quote: Column, token: Column) -> Column:
    return F.when(token > 0, quote / token)


def graduation_progress(complete: Column, remaining: Column, initial: Column) -> Column:
    sold = 1.0 - remaining / known(initial)
    return F.when(complete, 1.0).otherwise(clamp(sold))


def entry_depth(remaining: Column, initial: Column) -> Column:
    return clamp(1.0 - remaining / known(initial))


def lifecycle_state(graduated: Column, has_pool: Column, progress: Column, trades: Column, age: Column) -> Column:
    young = age.isNull() | (age < P.JUST_CREATED_SECONDS)
    return (
        F.when(graduated & has_pool, "PUMPSWAP")
        .when(graduated, "GRADUATED")
        .when(progress >= P.NEAR_GRADUATION, "NEAR_GRADUATION")
        .when((trades == 0) & young, "CREATED")
        .otherwise("BONDING_CURVE")
    )


def state_text(state: Column, progress: Column) -> Column:
    label = text_of(state, LIFECYCLE_LABELS)
    percent = F.bround(progress * 100).cast("long").cast("string")
    return (
        F.when(state == "GRADUATED", "GRADUATED (PumpSwap pool not located yet)")
        .when(state == "PUMPSWAP", label)
        .when(progress.isNotNull(), F.concat(label, F.lit(" · graduation "), percent, F.lit("% complete")))
        .otherwise(label)
    )


def log_features(delay: Column, buy: Column, funding: Column, funding_delay: Column, age: Column) -> list[Column]:
    """Five log-scaled behaviour features; rows without an entry delay have none."""

    def scaled(x: Column) -> Column:
        return F.log10(1.0 + F.greatest(F.lit(0.0), x))

    zero = F.lit(0.0)
    return [
        scaled(delay),
        scaled(buy),
        scaled(F.coalesce(funding, zero)),
        scaled(F.coalesce(funding_delay, zero)),
        scaled(F.coalesce(age, F.lit(P.UNKNOWN_AGE))),
    ]


def node_size(magnitude: Column) -> Column:
    return F.least(F.lit(1400.0), 120.0 + 380.0 * F.log10(1.0 + F.greatest(F.lit(0.0), magnitude)))


def node_category(role: Column, entity_type: Column, risk: Column) -> Column:
    risk = F.coalesce(risk, F.lit(0))
    return (
        F.when(role == "token", "token")
        .when(entity_type == "CREATOR", "creator")
        .when(is_infrastructure(entity_type), "infrastructure")
        .when(role == "actor", "funder")
        .when(role == "holder", "holder")
        .when(risk >= 75, "high_risk")
        .when(risk >= 50, "suspicious")
        .otherwise("buyer")
    )
