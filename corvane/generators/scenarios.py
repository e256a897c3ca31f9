"""Labelled scenarios: rows of the background, cloned and rewritten.

A scenario picks background events by a seeded hash, gives each clone a campaign
and a place in it, and rewrites columns.  Clones reuse existing entities only, so
a scenario's rows pass the checks of ``schema.check_attack``.  The number of
clones is bounded by the scenario's size times the intensity.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane import schema
from corvane.functions.scalars import content_id, uniform
from corvane.plans.session import checkpointed

Rewrite = Callable[[DataFrame, "Context"], DataFrame]

# How often, or how far, the scenarios do what marks them.
NEAR_CAP = (0.88, 0.995)
CLASSIC_RAIL = 0.32
DRIFT = 0.55
OVER_HALFWAY = 0.58
INSTANT = 0.74
SHARED_HASH = 0.46
LAZY_CURSOR = 0.40
CONSENT_INVALID = 0.52
KYA_UNREGISTERED = 0.34
LATE = 0.66
PROBE_DECLINED = 0.56
OVER_RARELY = 0.14


@dataclass(frozen=True)
class Context:
    """What a rewrite may use: the background, and draws tied to the scenario's seed."""

    background: DataFrame
    seed: str

    def u(self, stream: str, *parts: str) -> Column:
        return uniform(f"{self.seed}/{stream}", *[F.col(p) for p in (parts or ("event_id",))])


@dataclass(frozen=True)
class Scenario:
    card: str
    source: str
    campaigns: int
    per_campaign: int
    rewrite: Rewrite
    clean: bool = False


SCENARIOS: dict[str, Scenario] = {}
#: What the scenarios' sources and rewrites read of the whole background.
READ = ["event_id", "customer_id", "merchant_id", "merchant_country", "mcc", "amount", "txn_type", "auth_response", "device_id", "ag_agent_id", "is_fraud"]


def scenario(card: str, source: str, campaigns: int, per_campaign: int, clean: bool = False) -> Callable[[Rewrite], Rewrite]:
    def add(f: Rewrite) -> Rewrite:
        SCENARIOS[card] = Scenario(card, source, campaigns, per_campaign, f, clean)
        return f

    return add


def scaled(s: Scenario, intensity: float) -> tuple[int, int]:
    """Campaigns grow with the root of the intensity, events in proportion to it."""
    campaigns = max(1, round(s.campaigns * math.sqrt(intensity)))
    return campaigns, max(campaigns, round(s.campaigns * s.per_campaign * intensity))


def picks(background: DataFrame, s: Scenario, intensity: float, seed: int) -> DataFrame:
    """The background events that a scenario clones: the first of its source by a seeded hash."""
    key = uniform(f"{seed}/{s.card}/pick", F.col("event_id"))
    return background.where(F.expr(s.source) & ~F.col("is_fraud")).withColumn("pick", key).orderBy("pick", "event_id").limit(scaled(s, intensity)[1])


def clones(background: DataFrame, s: Scenario, intensity: float, seed: int) -> DataFrame:
    """Cloned rows with owner (campaign number), place in it, and size of it; campaigns are of uneven size."""
    campaigns, _ = scaled(s, intensity)
    picked = picks(background, s, intensity, seed)
    w = uniform(f"{seed}/{s.card}/campaign", F.col("event_id"))
    rows = picked.withColumn("owner", F.floor(F.pow(w, 1.3) * campaigns).cast("int"))
    inside = Window.partitionBy("owner").orderBy("ts", "event_id")
    rows = rows.withColumn("place", F.row_number().over(inside)).withColumn("size", F.count("*").over(Window.partitionBy("owner")))
    campaign = F.format_string(f"{s.card}-s{seed}-%04d", F.col("owner"))
    rows = rows.withColumn("event_id", F.concat(F.lit(f"X{seed}-{s.card}-"), F.col("event_id")))
    reset = {"dispute_outcome": F.lit(None).cast("string"), "dispute_raised_ts": F.lit(None).cast("timestamp"), "original_event_id": F.lit(None).cast("string"), "is_fraud": F.lit(True), "attack_id": F.lit(s.card), "attack_campaign": campaign}
    return rows.withColumns(reset)


def inject(background: DataFrame, card: str, intensity: float = 1.0, seed: int = 1337, sources: DataFrame | None = None) -> DataFrame:
    """Events of one scenario in the flat contract; ``sources`` are background events with all that the scenario picks."""
    s = SCENARIOS[card]
    rows = s.rewrite(clones(background if sources is None else sources, s, intensity, seed), Context(background, f"{seed}/{card}"))
    return finalise(rows)


def finalise(rows: DataFrame) -> DataFrame:
    """Keep declines, settlement, mandates and content ids coherent, then take the contract's columns."""
    declined = F.col("auth_response").isin(schema.DECLINES)
    rows = rows.withColumn("settled", F.col("settled") & ~declined)
    rows = rows.withColumn("settlement_lag_hours", F.when(F.col("settled"), F.coalesce("settlement_lag_hours", F.lit(24.0)))).withColumn("amount", F.round(F.greatest(F.lit(1.0), F.col("amount")), 2))
    rows = rows.withColumn("ag_ingested_content_ids", F.transform("ag_provenance_chain", content_id))
    return rows.select(*schema.ALL_COLUMNS)


def inject_all(background: DataFrame, intensity: float = 1.0, seed: int = 1337, cards: list[str] | None = None) -> DataFrame:
    """All scenarios side by side.

    They pick from the few columns that sources and rewrites read; whole rows are
    taken from the background once, for all picks, as many as the scenarios' sizes.
    """
    chosen = cards or list(SCENARIOS)
    light = checkpointed(background.select(*READ))
    picked = None
    for card in chosen:
        one = picks(light, SCENARIOS[card], intensity, seed).select("event_id")
        picked = one if picked is None else picked.unionByName(one)
    sources = checkpointed(background.join(F.broadcast(checkpointed(picked.distinct())), "event_id", "left_semi"))
    out = None
    for card in chosen:
        one = checkpointed(inject(light, card, intensity, seed, sources))  # its plan holds the background's
        out = one if out is None else out.unionByName(one)
    return out


def summary(attacks: DataFrame) -> DataFrame:
    """Per card: events, campaigns, customers, merchants, median amount, agentic share."""
    return attacks.groupBy("attack_id").agg(
        F.count("*").alias("events"), F.count_distinct("attack_campaign").alias("campaigns"), F.count_distinct("customer_id").alias("customers"), F.count_distinct("merchant_id").alias("merchants"),
        F.percentile("amount", 0.5).alias("median_amount"), (F.count("ag_agent_id").cast("double") / F.count("*")).alias("agentic_share"),
    )


# --- toolkit ----------------------------------------------------------------


def after(ts: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(ts) + seconds.cast("long"))


def one_of(rows: DataFrame, column: str, by: str) -> DataFrame:
    """Every row of an owner takes the value of the owner's first few rows (``by`` says which)."""
    first = rows.groupBy("owner").agg(F.sort_array(F.collect_set(column)).alias("options"))  # an owner is one bounded campaign
    return rows.join(first, "owner").withColumn(column, F.coalesce(F.get("options", F.least(F.expr(by).cast("int"), F.size("options") - 1)), column)).drop("options")


def campaign_time(rows: DataFrame, c: Context, hours: float) -> DataFrame:
    """Events of a campaign follow one another within so many hours of its first one."""
    start = F.min("ts").over(Window.partitionBy("owner"))
    step = hours * 3600 * (F.col("place") - 1 + 0.8 * c.u("step")) / F.col("size")
    return rows.withColumn("ts", after(start, step)).withColumn("ag_mandate_issued_ts", F.when(F.col("ag_agent_id").isNotNull(), after(F.col("ts"), -(60 + 900 * c.u("issued")))))


def other_merchant(rows: DataFrame, c: Context, rank: str) -> DataFrame:
    """Retarget to existing merchants: ``rank`` is a number from 0 into a sample of the background's merchants."""
    pool = c.background.select("merchant_id", "mcc", "merchant_country").where("mcc is not null").groupBy("merchant_id").agg(F.min("mcc").alias("mcc"), F.min("merchant_country").alias("merchant_country"))
    pool = pool.orderBy(F.md5("merchant_id")).limit(200).withColumn("r", F.row_number().over(Window.orderBy(F.md5("merchant_id"))) - 1)  # 200 rows
    pool = pool.select("r", F.col("merchant_id").alias("n_m"), F.col("mcc").alias("n_c"), F.col("merchant_country").alias("n_k"))
    joined = rows.withColumn("r", F.pmod(F.expr(rank).cast("int"), F.lit(200))).join(F.broadcast(pool), "r", "left")
    return joined.withColumn("merchant_id", F.coalesce("n_m", "merchant_id")).withColumn("mcc", F.coalesce("n_c", "mcc")).withColumn("merchant_country", F.coalesce("n_k", "merchant_country")).drop("r", "n_m", "n_c", "n_k")


def shop_chain() -> Column:
    return F.array(F.get("ag_provenance_chain", F.lit(0)), F.concat(F.lit("https://shop."), F.lower("merchant_id"), F.lit(".test/deal")))


AGENTIC = "ag_agent_id is not null and auth_response = 'approved'"
CARDS = "ag_agent_id is null and txn_type = 'purchase' and auth_response = 'approved'"

# --- the scenarios ------------------------------------------------------------


@scenario("F1-01", AGENTIC, 12, 12, clean=True)
def cart_tampering(rows: DataFrame, c: Context) -> DataFrame:
    """Another shop's cart just under the ceiling, after pages that tell the agent to hurry; no rule breaks."""
    rows = other_merchant(rows, c, "100 + owner * 3 + place % 2")
    rows = rows.withColumn("ag_scope_categories", F.array_union("ag_scope_categories", F.array("mcc"))).withColumn("amount", F.col("ag_scope_max_amount") * (NEAR_CAP[0] + (NEAR_CAP[1] - NEAR_CAP[0]) * c.u("near")))
    classic = c.u("rail") < CLASSIC_RAIL
    rows = rows.withColumn("ag_provenance_chain", shop_chain()).withColumn("ag_deliberation_latency_ms", F.col("ag_deliberation_latency_ms") * 0.08)
    return rows.withColumn("channel", F.when(classic, "ecom").otherwise(F.col("channel"))).withColumn("ag_kya_registered", F.lit(True)).withColumn("ag_consent_sig_valid", F.lit(True))


@scenario("F1-02", AGENTIC, 10, 14)
def scope_inflation(rows: DataFrame, c: Context) -> DataFrame:
    """Intent mandates that drift to other categories and, more and more, over the ceiling."""
    drift = c.u("drift") < DRIFT
    rows = rows.withColumn("ag_mandate_type", F.lit("intent")).withColumn("mcc", F.when(drift, F.lit("6540")).otherwise(F.col("mcc")))
    over = c.u("over") < OVER_HALFWAY * (0.5 + F.col("place") / F.col("size"))
    return rows.withColumn("amount", F.when(over, F.col("ag_scope_max_amount") * (1.05 + 1.2 * F.col("place") / F.col("size"))).otherwise(F.col("amount")))


@scenario("F1-03", CARDS, 14, 10, clean=True)
def refund_hijack(rows: DataFrame, c: Context) -> DataFrame:
    """Partial refunds of real purchases, most of them at once."""
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(1), (2 + F.floor(3 * c.u("parts"))).cast("int"))))
    source = F.regexp_replace("event_id", "^X[0-9]+-F1-03-", "")
    parts = parts.withColumn("original_event_id", source).withColumn("amount", F.col("amount") * (0.15 + 0.15 * c.u("share", "event_id", "part"))).withColumn("txn_type", F.lit("refund"))
    wait = F.when(c.u("instant", "event_id", "part") < INSTANT, 120 * F.col("part")).otherwise(86_400 * F.col("part"))
    return parts.withColumn("ts", after(F.col("ts"), wait)).withColumn("settlement_lag_hours", F.when(F.col("settled"), F.lit(0.5))).withColumn("event_id", F.concat("event_id", F.lit("-"), F.col("part").cast("string")))


@scenario("F1-04", AGENTIC, 10, 8)
def category_drift(rows: DataFrame, c: Context) -> DataFrame:
    """One purchase in a category that the customer never used, under the ceiling."""
    used = c.background.groupBy("customer_id").agg(F.collect_set("mcc").alias("used"))  # at most the number of categories
    rows = rows.join(used, "customer_id", "left")
    every = F.array(*[F.lit(x) for x in ("6540", "4511", "7011", "8398", "5732", "6011")])
    fresh = F.array_except(every, F.coalesce("used", F.array().cast("array<string>")))
    rows = rows.withColumn("mcc", F.coalesce(F.get(fresh, F.lit(0)), "mcc")).drop("used")
    return rows.withColumn("amount", F.least(F.col("amount") * 1.6, F.col("ag_scope_max_amount") * 0.97))


@scenario("F1-05", AGENTIC, 10, 12)
def delegation_laundering(rows: DataFrame, c: Context) -> DataFrame:
    """A few shared sub-agents, deep delegation, a shared mandate."""
    rows = one_of(rows, "ag_agent_id", "place % 2")
    shared = F.first("ag_mandate_hash").over(Window.partitionBy("owner").orderBy("place"))
    rows = rows.withColumn("ag_mandate_hash", F.when(c.u("hash") < SHARED_HASH, shared).otherwise(F.col("ag_mandate_hash")))
    return campaign_time(rows.withColumn("ag_delegation_depth", (2 + F.floor(5 * c.u("depth"))).cast("int")), c, 30)


@scenario("F1-09", AGENTIC, 8, 14)
def presence_spoof(rows: DataFrame, c: Context) -> DataFrame:
    """A human is claimed to be present; the telemetry is lazy or forged."""
    lazy = c.u("lazy") < LAZY_CURSOR
    rows = rows.withColumn("ag_human_present", F.lit(True)).withColumn("ag_cursor_entropy", F.when(lazy, 0.05 * c.u("c1")).otherwise(0.55 + 0.1 * c.u("c2")))
    return rows.withColumn("ag_consent_sig_valid", c.u("consent") >= CONSENT_INVALID).withColumn("ag_kya_registered", c.u("kya") >= KYA_UNREGISTERED)


@scenario("F1-10", AGENTIC, 14, 6)
def mandate_replay(rows: DataFrame, c: Context) -> DataFrame:
    """One mandate shown again and again, often past its end."""
    first = Window.partitionBy("owner").orderBy("place")
    rows = campaign_time(rows, c, 10)
    for col in ("ag_mandate_hash", "ag_mandate_id", "ag_agent_id", "customer_id"):
        rows = rows.withColumn(col, F.first(col).over(first))
    late = c.u("late") < LATE
    return rows.withColumn("ag_mandate_issued_ts", F.when(late, after(F.col("ts"), F.lit(-7200.0) - 3600 * F.col("place"))).otherwise(F.col("ag_mandate_issued_ts")))


@scenario("F2-13", CARDS + " and device_id is not null", 10, 14)
def synthetic_identity(rows: DataFrame, c: Context) -> DataFrame:
    """Thin-file cohorts on shared devices and addresses; spend ramps up."""
    rows = one_of(one_of(rows, "device_id", "0"), "ip", "0")
    return campaign_time(rows.withColumn("amount", F.col("amount") * (0.4 + 2.5 * F.col("place") / F.col("size"))), c, 200)


@scenario("F2-16", CARDS, 10, 16)
def bust_out(rows: DataFrame, c: Context) -> DataFrame:
    """Even, small purchases for weeks, then all that can be drawn at once."""
    first = Window.partitionBy("owner").orderBy("place")
    rows = rows.withColumn("customer_id", F.first("customer_id").over(first)).withColumn("card_bin", F.first("card_bin").over(first))
    drawdown = F.col("place") > 0.7 * F.col("size")
    start = F.min("ts").over(Window.partitionBy("owner"))
    rows = rows.withColumn("ts", after(start, F.when(drawdown, 700_000 + 900 * F.col("place")).otherwise(40_000 * F.col("place"))))
    return rows.withColumn("amount", F.when(drawdown, 9_000 + 6_000 * c.u("draw")).otherwise(300 + 100 * c.u("calm")))


@scenario("F3-19", CARDS, 10, 8)
def coerced_transfers(rows: DataFrame, c: Context) -> DataFrame:
    """A frightened customer sends more and more, in round sums."""
    first = Window.partitionBy("owner").orderBy("place")
    rows = campaign_time(rows.withColumn("customer_id", F.first("customer_id").over(first)), c, 6)
    usual = c.background.groupBy("customer_id").agg(F.percentile("amount", 0.99).alias("p99"))
    rows = rows.join(usual, "customer_id", "left")
    amount = F.rint(F.coalesce("p99", "amount") * (0.9 + 0.35 * F.col("place")) / 500) * 500
    return rows.withColumn("amount", F.greatest(F.lit(500.0), amount)).withColumn("channel", F.lit("transfer")).withColumn("entry_mode", F.lit("vpa")).drop("p99")


@scenario("F4-27", CARDS, 12, 18)
def adaptive_bin(rows: DataFrame, c: Context) -> DataFrame:
    """Small probes over two or three card ranges, many declined, then larger amounts where they passed."""
    rows = campaign_time(one_of(rows, "card_bin", "place % 3"), c, 3)
    probe = F.col("place") <= 0.7 * F.col("size")
    rows = rows.withColumn("amount", F.when(probe, 5 + 40 * c.u("probe")).otherwise(1500 + 4000 * c.u("take")))
    return rows.withColumn("auth_response", F.when(probe & (c.u("no") < PROBE_DECLINED), "declined_risk").otherwise("approved"))


@scenario("F4-28", CARDS, 10, 14)
def threshold_probe(rows: DataFrame, c: Context) -> DataFrame:
    """Amounts just under round limits, with a few that overshoot."""
    limit = F.element_at(F.array(F.lit(2000.0), F.lit(5000.0), F.lit(10000.0)), (1 + F.pmod("owner", F.lit(3))).cast("int"))
    over = c.u("over") < OVER_RARELY
    return campaign_time(rows.withColumn("amount", limit * F.when(over, 1.01 + 0.05 * c.u("o")).otherwise(0.97 + 0.029 * c.u("under"))), c, 48)


@scenario("F6-38", CARDS, 8, 24)
def mule_fan_out(rows: DataFrame, c: Context) -> DataFrame:
    """Many customers pay two or three collectors; then a few accounts pay out."""
    gather = F.col("place") <= 0.75 * F.col("size")
    rows = campaign_time(other_merchant(rows, c, "owner * 5 + place % 3"), c, 20)
    first = F.first("customer_id").over(Window.partitionBy("owner").orderBy("place"))
    return rows.withColumn("customer_id", F.when(gather, F.col("customer_id")).otherwise(first)).withColumn("amount", F.when(gather, 400 + 900 * c.u("in")).otherwise(6000 + 4000 * c.u("out")))


@scenario("F6-39", CARDS, 8, 18)
def shell_merchant(rows: DataFrame, c: Context) -> DataFrame:
    """Large tickets at little-used merchants of a small-ticket category."""
    rows = other_merchant(rows, c, "150 + owner")
    return rows.withColumn("mcc", F.lit("5812")).withColumn("amount", 7000 + 9000 * c.u("ticket"))


@scenario("F6-40", CARDS, 8, 18)
def stored_value(rows: DataFrame, c: Context) -> DataFrame:
    """Bursts of fixed denominations at a few redeemers."""
    rows = campaign_time(other_merchant(rows, c, "60 + owner * 2 + place % 2"), c, 1.5)
    worth = F.element_at(F.array(F.lit(500.0), F.lit(1000.0), F.lit(2000.0)), (1 + F.pmod("place", F.lit(3))).cast("int"))
    return rows.withColumn("mcc", F.lit("6540")).withColumn("amount", worth)
