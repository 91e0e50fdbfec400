"""The whole analysis of every launch, as tables that are made when they are asked for."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mintweave import params as P
from mintweave.functions import scalars as S
from mintweave.operators import clusters as K
from mintweave.operators import creator as C
from mintweave.operators import evidence as V
from mintweave.operators import execution as X
from mintweave.operators import funding as M
from mintweave.operators import graph as G
from mintweave.operators import history as H
from mintweave.operators import holders as O
from mintweave.operators import scoring as R
from mintweave.operators import sells as Z
from mintweave.operators import store as D
from mintweave.operators import tape as T
from mintweave.operators import versions as N
from mintweave.operators import wallets as W
from mintweave.operators.entities import classify_entities
from mintweave.operators.skew import DAY
from mintweave.plans.stages import Staged, stage

KEYS = ["mint", "cluster_id"]
PAIR = ["mint", "wallet"]
MEMORY = """mint STRING, cluster_id INT, size_bucket STRING, topology STRING, timing_bucket STRING, purchase_bucket STRING, age_bucket STRING,
members_hash STRING, members ARRAY<STRING>"""


@dataclass
class Tables:
    """Canonical inputs; the optional ones switch their part of the analysis off when missing.

    ``origin`` (mint, status): launches that ``origin_gate`` rejected are not scanned, but their trades
    still count as history.  ``requests`` (mint, provider, ok, latency): how the sources answered.
    ``param_updates`` (mint): mayhem parameter updates.  ``transactions``: decoded transactions.
    ``incomplete`` (mint): launches whose oldest trades could not be read.
    """

    trades: DataFrame
    launches: DataFrame
    transfers: DataFrame
    wallet_tx: DataFrame
    entities: DataFrame
    provider_labels: DataFrame | None = None
    sol_deltas: DataFrame | None = None
    holders: DataFrame | None = None
    cluster_memory: DataFrame | None = None
    origin: DataFrame | None = None
    requests: DataFrame | None = None
    param_updates: DataFrame | None = None
    transactions: DataFrame | None = None
    incomplete: DataFrame | None = None


def _deep(scan: Scan) -> bool:
    return scan.depth != "quick"


def _has(table: str):
    return lambda scan: getattr(scan.t, table) is not None


class Scan(Staged):
    """Results of a scan, one table each, keyed by mint.

    A table is made from the stages that its method names, and from no others: ``scan.profiles`` makes no
    cluster, ``scan.report`` no evidence and no display graph.  ``Scan.needs("report")`` lists what a
    table takes.  All tables of a run lie in one folder, which ``close`` (or the end of a ``with`` block) removes.
    """

    def __init__(
        self, t: Tables, depth: str, scope: str, fanout_threshold: int, max_hops: int, width: int, as_of: int | None,
    ):
        super().__init__(t.trades.sparkSession, "scan")
        self.t, self.depth, self.scope, self.max_hops, self.width = t, depth, scope, max_hops, width
        self.thresholds = dict(scope=scope, fanout_threshold=fanout_threshold)
        self.limits = P.DEPTHS[depth]
        self._as_of = as_of

    def _assess(self, sources: DataFrame) -> DataFrame:
        seen = self.t.wallet_tx.join(sources.select(F.col("source").alias("address")).distinct(), "address", "left_semi")
        activity = seen.groupBy("address").agg(F.count(F.lit(1)).alias("activity"))
        return M.assess_sources(sources, self.t.entities, activity, self.t.provider_labels, **self.thresholds)

    # --- launches and first buyers -------------------------------------------------------------------

    @stage
    def rejected(self):
        """Launches that the origin gate keeps out."""
        none = self.t.launches.select("mint").limit(0)
        return none if self.t.origin is None else self.t.origin.filter("status = 'rejected'").select("mint").distinct()

    @stage
    def launches(self, rejected):
        return self.t.launches if self.t.origin is None else self.t.launches.join(rejected, "mint", "left_anti")

    @stage(stored=True)
    def all_trades(self):
        """Trades that went through, on every launch; written once, since making them may join the whole tape."""
        return self.t.trades.filter("tx_success") if "tx_success" in self.t.trades.columns else self.t.trades

    @stage
    def trades(self, all_trades, rejected):
        return all_trades if self.t.origin is None else all_trades.join(rejected, "mint", "left_anti")

    @stage
    def as_of(self, all_trades):
        """The time of the scan: as given, or that of the newest trade (a one-row aggregate)."""
        return self._as_of if self._as_of is not None else (all_trades.agg(F.max("block_time")).first()[0] or 0)

    @stage(stored=True)
    def first(self, trades, launches):
        """The first buyers of each launch."""
        return T.with_seconds(T.first_buyers(trades, self.limits["buyers"]), launches)

    @stage
    def who(self, first):
        return first.select(*PAIR)

    # --- money ---------------------------------------------------------------------------------------

    @stage(stored=True)
    def transfers(self):
        """Payments, written once for all as-of joins."""
        balances = [b for b in ("recipient_before", "recipient_after") if b in self.t.transfers.columns]
        return self.t.transfers.select(*M.MONEY, *balances)

    @stage(stored=True)
    def funding(self, first, transfers):
        """Who paid for each first buy."""
        out = M.asof_funding(first, transfers, self.t.wallet_tx, width=self.width)
        return out if self.t.sol_deltas is None else M.fee_payer_fallback(out, first, self.t.sol_deltas)

    @stage
    def funders(self, funding):
        return M.funder_members(funding)

    @stage(stored=True)
    def direct(self, funders):
        """Direct funders judged, so that paths end at infrastructure."""
        return self._assess(funders)

    @stage(stored=True)
    def paths(self, funding, direct, transfers):
        return M.funding_paths(funding, transfers, direct, scope=self.scope, max_hops=self.max_hops, width=self.width)

    @stage
    def hops(self, paths):
        return M.intermediary_members(paths)

    @stage(stored=True)
    def judged(self, funders, hops):
        return self._assess(funders.unionByName(hops).distinct())

    @stage(stored=True)
    def private(self, funders, judged):
        return M.split_by_assessment(funders, judged, self.scope)[0]

    @stage(stored=True)
    def infra(self, funders, judged):
        return M.split_by_assessment(funders, judged, self.scope)[1]

    @stage(stored=True)
    def private_hops(self, hops, funders, judged):
        between = hops.join(funders.select("mint", "source").distinct(), ["mint", "source"], "left_anti")
        return M.split_by_assessment(between, judged, self.scope)[0]

    # --- wallets -------------------------------------------------------------------------------------

    @stage(stored=True)
    def exits(self, trades, who):
        return Z.wallet_exits(trades.join(who, PAIR, "left_semi"))

    @stage(stored=True, when=_deep)
    def parts(self, all_trades):
        """Every wallet's part in every launch."""
        return W.participation(all_trades)

    @stage
    def past(self, who, parts):
        return who.withColumn("launches", F.lit(None).cast("long")) if parts is None else W.wallet_history(who, parts)

    @stage(stored=True)
    def wallet_facts(self, first, launches, funding, past, exits):
        """The wide row per first buyer."""
        ages = W.wallet_age(first, launches, self.t.wallet_tx)
        labels = classify_entities(
            first.select(F.col("wallet").alias("address")).distinct(), self.t.entities, self.t.provider_labels, "BUYER"
        )
        known = F.when(F.col("entity_type") == "UNKNOWN", "BUYER").otherwise(F.col("entity_type"))
        kind = labels.select(F.col("address").alias("wallet"), known.alias("entity_type"), "label")
        out = (
            first.select(*PAIR, "position", "signature", "block_time", "slot", "quote_amount", "token_amount", "seconds_after_launch")
            .withColumnRenamed("signature", "buy_signature")
            .join(ages, PAIR)
            .join(funding.drop("found"), PAIR, "left")
            .join(past.select(*PAIR, "launches"), PAIR, "left")
            .join(exits.select(*PAIR, "sells", "sold_fraction", "hold_seconds", "exit_kind"), PAIR, "left")
            .join(kind, "wallet", "left")
            .withColumn("fresh_bucket", S.fresh_bucket(F.col("age_seconds")))
            .withColumn("balance_after_purchase", W.balance_after_purchase(F.col("balance_after_funding"), F.col("quote_amount")))
        )
        return W.early_buyer_risk(out)

    @stage
    def profiles(self, wallet_facts, members):
        """The wide row per first buyer, with its cluster."""
        return wallet_facts.join(K.wallet_cluster(members), PAIR, "left")

    # --- creators ------------------------------------------------------------------------------------

    @stage(stored=True, when=_deep)
    def creator_money(self, launches, transfers):
        return C.creator_funding_before(launches, transfers, width=self.width)

    @stage(stored=True)
    def links(self, who, funding, paths, judged, creator_money):
        """Buyers whose money leads to the creator; none at ``quick``."""
        if creator_money is None:
            return who.withColumn("creator", F.lit(None).cast("string")).limit(0)
        return C.creator_links(funding, paths, creator_money, judged, self.scope, self.max_hops)

    @stage
    def creators(self, launches, all_trades, links):
        """Each launch's creator and the risk it brings."""
        if not _deep(self):
            return launches.select("mint", "creator", F.lit(0).alias("creator_risk"))
        linked = links.groupBy("mint").agg(F.count(F.lit(1)).alias("linked"))
        record = C.creator_history(self.t.launches, all_trades).join(C.creator_graduations(self.t.launches).drop("creator"), "mint")
        record = record.join(launches.select("mint"), "mint", "left_semi").join(linked, "mint", "left")
        return C.creator_risk(record.withColumn("linked", F.coalesce("linked", F.lit(0))))

    # --- clusters ------------------------------------------------------------------------------------

    @stage(stored=True)
    def sponsors(self, trades):
        return X.sponsor_members(trades, self.limits["buyers"])

    @stage(stored=True)
    def atomic(self, trades):
        return X.atomic_members(trades, self.limits["buyers"])

    @stage(stored=True, when=_deep)
    def overlaps(self, who, parts):
        return H.wallet_overlap_pairs(who, parts)

    @stage(stored=True)
    def associations(self, private, private_hops, funding, who, overlaps):
        return G.assoc_edges(private, private_hops, funding, who, overlaps)

    @stage
    def components(self, associations):
        return G.connected_components(associations).withColumnRenamed("component", "source")

    @stage
    def communities(self, associations):
        return G.communities(associations).withColumnRenamed("community", "source")

    @stage(stored=True)
    def features(self, wallet_facts):
        return G.behaviour_features(wallet_facts)

    @stage
    def behaviour(self, features):
        return G.behaviour_groups(features).withColumnRenamed("group", "source")

    @stage(stored=True)
    def clusters(self, components, sponsors, atomic, communities, behaviour, wallet_facts):
        proposals = dict(graph=components, sponsor=sponsors, atomic=atomic, community=communities, behaviour=behaviour)
        return K.build_clusters(K.merge_candidates(K.candidates(proposals, wallet_facts)))

    @stage(stored=True)
    def members(self, clusters, who):
        return K.cluster_members(clusters).withColumn("wallet", F.col("wallet").cast(dict(who.dtypes)["wallet"]))

    @stage(stored=True)
    def fingerprints(self, members, private, private_hops, wallet_facts):
        """The shape of each cluster, to be recognised on later launches."""
        funded = K.common_sources(members, private).select(*KEYS).distinct().withColumn("_f", F.lit(True))
        relayed = K.common_sources(members, private_hops).select(*KEYS).distinct().withColumn("_i", F.lit(True))
        shape = K.measured_similarities(members, wallet_facts).join(funded, KEYS, "left").join(relayed, KEYS, "left")
        shape = shape.withColumn("has_funder", F.coalesce("_f", F.lit(False))).withColumn("has_intermediary", F.coalesce("_i", F.lit(False)))
        return H.cluster_fingerprints(shape, members.withColumn("wallet", F.col("wallet").cast("string")))

    @stage
    def repeated(self, fingerprints, clusters):
        """Likeness of each cluster to the remembered ones of other launches."""
        if not _deep(self) or self.t.cluster_memory is None:
            return clusters.select(*KEYS).withColumn("best_similarity", F.lit(None).cast("double"))
        return H.match_recurring(fingerprints, self.t.cluster_memory)

    @stage(stored=True)
    def selling(self, members, exits):
        return Z.sell_coordination(members, exits)

    @stage
    def signals(self, members, wallet_facts, private, private_hops, sponsors, atomic, overlaps, links, repeated, selling):
        if overlaps is None:
            overlaps = wallet_facts.select("mint", F.col("wallet").alias("a"), F.col("wallet").alias("b"), F.lit(0.0).alias("overlap")).limit(0)
        return K.cluster_signals(
            members, facts=wallet_facts, funders=private, hops=private_hops, sponsors=sponsors, atomic=atomic, overlaps=overlaps, links=links,
            repeated=repeated, selling=selling,
        )

    @stage(stored=True)
    def mayhem(self, trades, launches):
        return T.mayhem_separation(trades, launches, self.t.param_updates)

    @stage(stored=True)
    def scores(self, signals, members, wallet_facts, mayhem, infra, selling, atomic, clusters):
        context = K.bundle_context(members, wallet_facts, mayhem, infra, selling, X.atomic_stats(members, atomic))
        return R.bundle_score(signals.join(context.drop("sell_coordination"), KEYS).join(clusters.select(*KEYS, "method"), KEYS))

    # --- evidence ------------------------------------------------------------------------------------

    @stage(stored=True)
    def subjects(self, members, who, clusters):
        """Members of clusters; a launch without one is described over all its buyers, as cluster 0."""
        bare = who.join(clusters.select("mint").distinct(), "mint", "left_anti").withColumn("cluster_id", F.lit(0))
        return members.unionByName(bare.select(*members.columns))

    @stage
    def evidence(self, subjects, trades, who, funding, wallet_facts, private, private_hops, infra, sponsors, atomic, exits, mayhem, parts, links):
        findings = [
            V.evidence_atomic(subjects, atomic),
            V.evidence_fee_payer(subjects, sponsors, X.sponsor_signatures(trades, self.limits["buyers"])),
            V.evidence_common_funder(subjects, private, funding),
            V.evidence_infra_funder(subjects, infra, funding),
            V.evidence_intermediary(subjects, private_hops),
            V.evidence_funding_window(subjects, wallet_facts),
            V.evidence_entry_sync(subjects, wallet_facts),
            V.evidence_buy_size(subjects, wallet_facts),
            V.evidence_fresh(subjects, wallet_facts),
            V.evidence_exit(Z.sync_exit_groups(subjects, exits)),
            V.evidence_mayhem(subjects, mayhem, T.automated_wallets(trades)),
        ]
        if parts is not None:
            findings += [V.evidence_repeat(subjects, H.recurring_groups(who, parts), parts), V.evidence_creator(subjects, links)]
        return V.evidence(findings)

    # --- holders and early trading -------------------------------------------------------------------

    @stage(stored=True, when=_has("holders"))
    def holder_rows(self, launches):
        """Holders from the best source of each launch, labelled.  All of them: concentration needs every one."""
        listed = O.holders_by_priority(self.t.holders, launches, None)
        names = listed.filter("owner is not null").select(F.col("owner").alias("address")).distinct()
        kind = classify_entities(names, self.t.entities, self.t.provider_labels).select(F.col("address").alias("owner"), "entity_type", "label")
        return listed.drop("position").join(kind, "owner", "left").withColumn("entity_type", F.coalesce("entity_type", F.lit("UNKNOWN")))

    @stage(when=_has("holders"))
    def holders(self, holder_rows):
        """The largest holders of each launch, protocol accounts left out."""
        return O.top_holders(holder_rows, self.limits["holders"])

    @stage(when=_has("holders"))
    def holder_concentration(self, holder_rows):
        return O.holder_concentration(holder_rows)

    @stage
    def windows(self, trades, launches):
        """Distinct buyers within each time window after the launch."""
        return T.window_counts(trades, launches)

    @stage
    def timeline(self, trades, launches):
        return T.timeline_counts(trades, launches)

    @stage(stored=True)
    def slots(self, trades):
        return T.slot_analysis(trades)

    @stage
    def distribution(self, trades):
        return T.purchase_distribution(trades)

    @stage
    def fresh_buckets(self, wallet_facts):
        return W.fresh_bucket_counts(wallet_facts)

    @stage
    def post_graduation(self, trades, launches, who):
        return Z.post_graduation(trades.join(who, PAIR, "left_semi"), launches)

    @stage(when=_has("transactions"))
    def order(self, trades):
        return T.transaction_order(trades, self.t.transactions)

    # --- display graph -------------------------------------------------------------------------------

    @stage(stored=True)
    def graph_profiles(self, wallet_facts, trades):
        held = T.token_position(trades.join(wallet_facts, PAIR, "left_semi"))
        out = wallet_facts.join(held, PAIR, "left")
        if self.t.sol_deltas is None:
            return out.withColumn("sol_balance", F.lit(None).cast("double"))
        balance = W.current_balances(self.t.sol_deltas).select(F.col("address").alias("wallet"), F.col("balance").alias("sol_balance"))
        return out.join(balance, "wallet", "left")

    @stage
    def graph_creators(self, creators, creator_money):
        if creator_money is None:
            return creators.select("mint", "creator", "creator_risk", F.lit(None).cast("string").alias("funding_source"), F.lit(None).cast("double").alias("funding_amount"))
        return creators.select("mint", "creator", "creator_risk").join(creator_money.select("mint", "funding_source", "funding_amount"), "mint", "left")

    @stage
    def graph_holders(self, holder_rows, launches):
        """The 25 largest holders are drawn."""
        if holder_rows is None:
            return launches.select("mint", F.lit(None).cast("string").alias("owner"), F.lit(None).cast("double").alias("amount")).limit(0)
        return O.top_holders(holder_rows, 25)

    @stage
    def graph_nodes(self, launches, graph_profiles, graph_creators, graph_holders, funders, hops):
        known = funders.select("mint", F.col("source").alias("address")).unionByName(hops.select("mint", F.col("source").alias("address"))).distinct()
        kind = classify_entities(known.select("address").distinct(), self.t.entities, self.t.provider_labels, "FUNDER")
        actors = known.join(kind.select("address", "entity_type", "label"), "address")
        return G.graph_node_style(G.graph_nodes(launches, graph_profiles, graph_creators.filter("creator is not null"), actors, graph_holders))

    @stage
    def graph_edges(self, trades, first, graph_profiles, graph_creators, paths, graph_holders, transfers):
        inflows = G.wallet_inflows(first, transfers, width=self.width)
        return G.graph_edges(trades, graph_profiles, graph_creators.filter("creator is not null"), inflows, paths, graph_holders)

    # --- report --------------------------------------------------------------------------------------

    @stage
    def coverage(self, launches, wallet_facts, holder_rows):
        """How much of each kind of data was there: (mint, dimension, level)."""
        seen = wallet_facts.groupBy("mint").agg(
            F.avg(F.when(F.col("observed"), 1.0).otherwise(0.0)).alias("funding"),
            F.avg(F.when(F.col("launches").isNotNull(), 1.0).otherwise(0.0)).alias("historical"),
            F.max(F.col("age_seconds").isNotNull()).alias("ages"),
        )
        if self.t.incomplete is not None:
            seen = seen.join(self.t.incomplete.select("mint", F.lit(True).alias("cut")).distinct(), "mint", "left")
        else:
            seen = seen.withColumn("cut", F.lit(None).cast("boolean"))
        if holder_rows is not None:
            seen = seen.join(holder_rows.groupBy("mint").agg(F.first("coverage").alias("listed")), "mint", "left")
        else:
            seen = seen.withColumn("listed", F.lit(None).cast("string"))

        def of(share: Column, some: float) -> Column:
            return F.when(share >= 0.8, "complete").when(share > some, "partial").otherwise("missing")

        levels = {
            "launch_trades": F.when(F.col("cut"), "partial").otherwise("complete"),
            "funding": of(F.col("funding"), 0.2),
            "wallet_age": F.when(F.col("ages"), "complete").otherwise("partial"),
            "holders": F.coalesce("listed", F.lit("missing")),
        }
        if _deep(self):
            levels |= {"historical": of(F.col("historical"), 0.0), "creator_history": F.lit("complete")}
        rows = F.array(*[F.struct(F.lit(name).alias("dimension"), level.alias("level")) for name, level in levels.items()])
        return seen.select("mint", F.inline(rows))

    @stage
    def quality(self, coverage):
        """Coverage and provider scores per launch.  Tables that came without a request log count as read without a failure."""
        out = R.data_quality(coverage, self.t.requests)
        return out if self.t.requests is not None else out.withColumn("providers", F.lit(1.0))

    @stage(stored=True)
    def standing(self, first, scores, wallet_facts, mayhem, infra, atomic, exits):
        """The scores each launch is judged by: those of its largest cluster, or of all its buyers without any signal."""
        top = K.top_cluster(scores, "bundle_score").select(*KEYS)
        best = scores.join(top, KEYS)
        bare = first.select("mint").distinct().join(top, "mint", "left_anti")
        whole = first.select("mint", F.lit(0).alias("cluster_id"), "wallet").join(bare, "mint", "left_semi")
        silent = bare.select(
            "mint", F.lit(0).alias("cluster_id"), F.lit(None).cast("long").alias("size"),
            *[F.lit(0.0).alias(s) for s in K.SIGNALS if s != "sell_coordination"], F.lit("").alias("method"),
        )
        context = K.bundle_context(whole, wallet_facts, mayhem, infra, Z.sell_coordination(whole, exits), X.atomic_stats(whole, atomic))
        return best.unionByName(R.bundle_score(silent.join(context, KEYS)).select(*best.columns))

    @stage
    def lifecycle(self, launches, trades, as_of):
        return T.lifecycle(launches, trades, as_of)

    @stage(stored=True)
    def report(self, standing, wallet_facts, members, creators, slots, mayhem, quality, lifecycle):
        """One row per launch: its largest cluster's score, the confidence in it, and the reading."""
        c = F.col
        per_mint = wallet_facts.groupBy("mint").agg(
            F.count(F.lit(1)).alias("wallets_analyzed"),
            F.count(F.when(c("age_bounded"), 1)).alias("bounded_ages"),
            F.avg(F.when(c("launches").isNotNull(), 1.0).otherwise(0.0)).alias("history_coverage"),
        )
        grouped = standing.filter(c("size").isNotNull()).select(*KEYS)
        inside = wallet_facts.join(grouped, "mint", "left_anti").unionByName(
            wallet_facts.join(members.join(grouped, KEYS, "left_semi"), PAIR, "left_semi")
        )
        worst = R.worst_third_mean(inside, ["mint"])
        experienced = F.avg(F.when(c("launches") >= P.EXPERIENCED_LAUNCHES, 1.0).otherwise(0.0)).alias("experienced_share")
        of_members = inside.groupBy("mint").agg(F.count(F.lit(1)).alias("members"), experienced)
        flagged = mayhem.select("mint", c("enabled").alias("mayhem_enabled"), c("activity").alias("mayhem_activity"), "flagged_trades")
        rows = standing.join(per_mint, "mint")
        for part in (
            of_members, worst, creators.select("mint", c("creator_risk").alias("dev_risk")), slots.select("mint", c("wallets_sharing_a_slot").alias("same_slot_wallets")),
            flagged, quality.select("mint", "coverage", "providers", c("quality").alias("data_quality")),
        ):
            rows = rows.join(part, "mint", "left")
        rows = (
            rows.withColumn("coherence", R.coherence(K.SIGNALS))
            .withColumn("contradictions", R.contradictions())
            .fillna({"early_buyer_risk": 0, "dev_risk": 0, "same_slot_wallets": 0, "members": 0, "experienced_share": 0.0, "providers": 0.0, "coverage": 0.0})
        )
        out = R.risk_report(R.confidence(rows)).join(lifecycle.select("mint", "trades", "progress", "state", "state_text"), "mint", "left")
        if self.t.incomplete is None:
            complete = F.lit(True)
        else:
            out = out.join(self.t.incomplete.select("mint", F.lit(True).alias("_cut")).distinct(), "mint", "left")
            complete = c("_cut").isNull()
        return out.withColumn("warnings", R.scan_warnings(complete, c("mayhem_enabled"), c("state"))).drop("_cut")


def launch_scan(
    t: Tables, depth: str = "full", *, scope: str = "global", fanout_threshold: int = P.INFRA_FANOUT,
    max_hops: int = P.MAX_HOPS, width: int = DAY, as_of: int | None = None,
) -> Scan:
    """Profiles, clusters, scores and evidence for all launches; nothing runs before a table is asked for.

    ``quick`` leaves history, creator and recurrence out.  ``as_of`` is the time of the scan (default: the newest trade).
    """
    return Scan(t, depth, scope, fanout_threshold, max_hops, width, as_of)


def bundle_detail(scan: Scan, clusters: int = 2) -> DataFrame:
    """Score parts and findings of each launch's first clusters."""
    lines = R.score_explanation(scan.scores).filter(F.col("cluster_id") <= clusters)
    found = scan.evidence.filter(F.col("cluster_id") <= clusters).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("rank", "code", "strength"))).alias("findings")
    )
    return lines.join(found, KEYS, "left").join(scan.clusters.select(*KEYS, "size", "method"), KEYS)


def save_scan(scan: Scan, folder: str, run: str, scanned_at: int) -> None:
    """Keep what later scans need: scores are appended, a launch's clusters and fingerprints replaced.

    Each table is committed by itself and knows the run, so a writer that dies half way is run again under
    the same ``run`` and ends in the same state.
    """
    spark = scan.spark
    N.write_version(spark, f"{folder}/scores", D.score_rows(scan.report, F.lit(scanned_at).cast("long")), ["mint"], run)
    N.write_version(spark, f"{folder}/clusters", scan.clusters.select("mint", "cluster_id", "size", "method"), ["mint"], run, D.replace_clusters)
    kept = scan.fingerprints.withColumn("mint", F.col("mint").cast("string")).withColumn("cluster_id", F.col("cluster_id").cast("int"))
    N.write_version(spark, f"{folder}/fingerprints", kept, ["mint"], run, D.replace_clusters)


def cluster_memory(spark: SparkSession, folder: str) -> DataFrame:
    """The fingerprints that earlier scans saved, as ``Tables.cluster_memory``."""
    return N.read_version(spark, f"{folder}/fingerprints", MEMORY)
