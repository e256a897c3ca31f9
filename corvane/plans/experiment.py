"""From flat events to decisions: feature blocks, layers, fusion, policy and the tables that judge them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane import schema
from corvane.functions import scalars
from corvane.operators import baselines, graph, metrics, models, policy, rules, velocity
from corvane.plans.session import checkpointed
from corvane.sources.lenses import micros

DAY = 86_400_000_000


def stream_view(flat: DataFrame) -> DataFrame:
    """Flat events as the columns that the stream operators read; seq, which breaks ties of time, is the id."""
    return flat.select(
        F.col("event_id").alias("seq"), micros(F.col("ts")).alias("t"), F.col("customer_id").alias("customer"), F.col("card_bin").alias("bin"), F.col("device_id").alias("device"), F.col("merchant_id").alias("merchant"),
        F.col("ag_agent_id").alias("agent"), F.col("ag_mandate_hash").alias("mandate"), "ip", "amount", F.rint(F.col("amount") * 100).cast("long").alias("cents"), F.col("auth_response").isin(schema.DECLINES).alias("declined"),
        F.lit(True).alias("known"), (F.col("txn_type") == "refund").alias("refund"), F.rint("settlement_lag_hours").cast("long").alias("lag"), "mcc", "channel", "txn_type", "settled", F.col("is_fraud").alias("fraud"), "attack_id", "attack_campaign", "event_id",
    )


def transaction_block(flat: DataFrame, home: str = "IN") -> DataFrame:
    c = F.col
    columns = {
        "txn_amount": c("amount"), "txn_log_amount": scalars.log_amount(c("amount")), "txn_round_score": scalars.round_score(c("amount")), "txn_cross_border": (c("merchant_country") != home).cast("int"), "txn_agentic": c("ag_agent_id").isNotNull().cast("int"),
        **{f"txn_{k}": v for k, v in scalars.calendar(micros(c("ts"))).items()}, **{f"txn_{k}": v for k, v in scalars.direction(c("txn_type"), c("original_event_id")).items()},
        **{f"txn_{k}": v for k, v in scalars.null_flags("lat", "terminal_id", "device_id", "ip").items()}, "txn_physical_without_geo": (c("channel").isin("card_present", "atm") & c("lat").isNull()).cast("int"),
    }
    return flat.select(F.col("event_id").alias("seq"), *[v.alias(k) for k, v in columns.items()])


def mandate_block(flat: DataFrame, train: DataFrame) -> DataFrame:
    """Scope, age, provenance, presence and deliberation of the agentic block; null off its rail."""
    c = F.col
    fit = baselines.latency_line(train, "ag_deliberation_latency_ms", "amount").first()
    stats = train.where("ag_agent_id is not null").agg(F.avg("ag_tool_call_count").alias("tm"), F.stddev_pop("ag_tool_call_count").alias("ts"), F.avg(F.size("ag_provenance_chain")).alias("cm"), F.stddev_pop(F.size("ag_provenance_chain")).alias("cs")).first()
    chain = scalars.length(c("ag_provenance_chain"))
    columns = {
        "mnd_kya_registered": c("ag_kya_registered").cast("int"), "mnd_kya_token_missing": c("ag_kya_token").isNull().cast("int"), "mnd_consent_valid": c("ag_consent_sig_valid").cast("int"),
        "mnd_amount_vs_ceiling": scalars.guarded(c("amount"), c("ag_scope_max_amount")), "mnd_ceiling_breached": (c("amount") > c("ag_scope_max_amount")).cast("int"),
        "mnd_category_in_scope": scalars.in_scope(c("ag_scope_categories"), c("mcc")), "mnd_merchant_in_scope": scalars.in_scope(c("ag_scope_allowed_merchants"), c("merchant_id")), "mnd_scope_size": scalars.length(c("ag_scope_categories")),
        **{f"mnd_{k}": v for k, v in scalars.mandate_age(c("ts"), c("ag_mandate_issued_ts"), c("ag_mandate_ttl_seconds")).items()}, "mnd_depth": c("ag_delegation_depth"), "mnd_chain": chain, "mnd_content": scalars.length(c("ag_ingested_content_ids")),
        "mnd_chain_z": scalars.z_score(chain, stats["cm"] or 0.0, stats["cs"] or 1.0), "mnd_tools_z": scalars.z_score(c("ag_tool_call_count"), stats["tm"] or 0.0, stats["ts"] or 1.0),
        "mnd_presence_mismatch": scalars.presence_mismatch(c("ag_human_present"), c("ag_cursor_entropy")), "mnd_dwell_per_tool": scalars.guarded(c("ag_dwell_time_ms"), c("ag_tool_call_count")),
        "mnd_deliberation_z": scalars.deliberation_residual(c("ag_deliberation_latency_ms"), c("amount"), fit["intercept"] or 0.0, fit["slope"] or 0.0, fit["sigma"] or 1.0),
    }
    there = c("ag_agent_id").isNotNull()
    return flat.select(F.col("event_id").alias("seq"), *[F.when(there, v).alias(k) for k, v in columns.items()])


def graph_block(events: DataFrame, components: bool = False) -> DataFrame:
    out = graph.capped_degrees(events).join(graph.pair_prior(events), "seq", "left").join(graph.customer_events(events), "seq", "left").join(graph.new_edge_share(events), "seq", "left")
    for key, value, width, name in (("merchant", "customer", DAY, "merchant_customers_24h"), ("bin", "merchant", DAY // 24, "bin_merchants_1h"), ("bin", "merchant", DAY, "bin_merchants_24h"), ("bin", "customer", DAY // 24, "bin_customers_1h")):
        out = out.join(graph.sliding_distinct(events, key, value, width, name), "seq", "left")
    if components:
        out = out.join(graph.component_features(events).drop("root"), "seq", "left")
    return out.select("seq", *[F.col(x).alias(f"gr_{x}") for x in out.columns if x != "seq"])


def feature_matrix(flat: DataFrame, train: DataFrame, keys: dict[str, list[str]] = velocity.KEYS, components: bool = False) -> tuple[DataFrame, list[str]]:
    """seq and all features; windows run over the whole history, fitted parts over ``train`` only."""
    events, fitted = stream_view(flat), stream_view(train)
    entity = baselines.entity_features(events, fitted)
    entity = entity.drop("lag_vs_merchant", "lag_vs_channel").select("seq", *[F.col(x).alias(f"ent_{x}") for x in entity.columns if x not in ("seq", "lag_vs_merchant", "lag_vs_channel")])
    out = velocity.velocity_block(events, keys)
    for block in (graph_block(events, components), transaction_block(flat), entity, mandate_block(flat, train)):
        out = out.join(block, "seq", "left")
    names = [c for c in out.columns if c != "seq"]
    schema.assert_no_leakage(names)
    return out, names


@dataclass
class Result:
    decided: DataFrame
    layers: DataFrame
    curve: DataFrame
    cards: DataFrame
    campaigns: DataFrame
    tallies: DataFrame
    importance: list[tuple[str, float]]


def run(flat: DataFrame, keys: dict[str, list[str]] | None = None, rounds: int = 10, rate: float = 0.01) -> Result:
    """Split by time, fit L1, L2 and fusion on the past, decide and judge the rest; rules override."""
    timed = flat.withColumn("t", micros(F.col("ts")))
    past, _ = models.time_split(timed, 0.7)
    matrix, names = feature_matrix(flat, past.drop("t"), keys or velocity.KEYS)
    facts = rules.apply_rules(flat).select(F.col("event_id").alias("seq"), "l0_reason", "l0_fired")
    facts = stream_view(flat).select("seq", "t", "fraud", "attack_id", F.col("attack_campaign").alias("campaign"), F.col("agent").isNull().alias("can_answer")).join(facts, "seq")
    rows = checkpointed(facts.join(matrix, "seq"))
    train, test = models.time_split(rows, 0.7)
    inner, tail = models.time_split(train, 0.8)

    def layered(fit_on: DataFrame, to: DataFrame) -> tuple[DataFrame, models.Supervised]:
        l1 = models.fit_supervised(fit_on, names, rounds=rounds)
        numeric = [n for n in names if n.startswith(("txn_log", "txn_hour", "ent_", "gr_customer"))]
        forest = models.fit_forest(fit_on.where("not fraud"), numeric, "seq", trees=50)
        scored = l1.score(to).select("seq", "t", "fraud", "attack_id", "campaign", "can_answer", "l0_fired", "l0_reason", "l1")
        return checkpointed(scored.join(forest.score(to, "seq", "l2"), "seq")), l1

    base, _ = layered(inner, tail)  # the stacker sees scores of rows the layers did not
    stacker = policy.fit_fusion(policy.fusion_design(base, base.where("not fraud"), ["l1", "l2"]), ["l1", "l2"])
    scored, l1 = layered(train, test)
    reference = scored.where("not fraud")
    fused = checkpointed(stacker.score(policy.fusion_design(scored, reference, ["l1", "l2"])).withColumn("score", F.col("fused")))
    thresholds = policy.policy_thresholds(fused.where("not fraud"))
    decided = fused.withColumn("decision", policy.decide(F.col("score"), thresholds, F.col("l0_fired"), F.col("can_answer")))
    layers = None
    for name in ("l1", "l2", "fused"):
        one = metrics.areas(fused.withColumn("score", F.col(name))).withColumn("layer", F.lit(name))
        layers = one if layers is None else layers.unionByName(one)
    at = metrics.threshold_at_fpr(fused, rate)
    return Result(decided, layers, metrics.recall_curve(fused), metrics.recall_at(fused.where("fraud"), at, ["attack_id"]), metrics.campaign_summary(metrics.campaigns(fused, at)), policy.tallies(decided), l1.importance())
