"""A seeded population: entities and events as functions of (seed, number).

No draw depends on the partitioning or on another row: every attribute comes from
a hash of the seed, a stream name and the entity's number, so an event can work
out its customer's home or its merchant's category without a join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schema
from corvane.functions.scalars import content_id, draw, normal, uniform
from corvane.operators.lookups import bind_source
from corvane.plans.session import checkpointed
from corvane.sources.lenses import micros
from corvane.sources.readers import Calibration

#: Category -> weight, mean of log amount, its spread, step that amounts snap to.  Invented figures.
CATEGORIES: dict[str, tuple[float, float, float, int]] = {
    "5411": (22.0, 6.2, 0.8, 0), "5812": (16.0, 6.0, 0.7, 0), "5541": (12.0, 6.9, 0.5, 100), "5732": (6.0, 8.9, 1.0, 0), "5651": (9.0, 7.4, 0.7, 0), "4121": (11.0, 5.2, 0.6, 0),
    "4511": (3.0, 8.9, 0.7, 0), "7011": (4.0, 8.4, 0.7, 0), "5912": (8.0, 6.0, 0.8, 0), "6011": (4.0, 8.0, 0.6, 500), "6540": (2.0, 6.9, 0.6, 500), "8398": (3.0, 6.4, 0.9, 100),
}
CITIES = {"delhi": (28.61, 77.21, 5.0), "mumbai": (19.08, 72.88, 5.0), "bengaluru": (12.97, 77.59, 4.0), "chennai": (13.08, 80.27, 3.0), "kolkata": (22.57, 88.36, 3.0)}
BINS = ["401200", "401288", "431940", "455701", "510510", "524167", "535522", "652150"]
HOURS = [1, 1, 1, 1, 1, 2, 4, 7, 9, 10, 11, 12, 13, 12, 11, 11, 12, 14, 16, 17, 15, 11, 6, 3]
DAYS = [10, 10, 10, 11, 13, 14, 12]
CHANNEL_MIX = {"card_present": 0.38, "ecom": 0.24, "upi": 0.28, "wallet": 0.06, "atm": 0.04}
ENTRY = {"card_present": "contactless", "ecom": "cof", "upi": "vpa", "wallet": "qr", "atm": "chip", "transfer": "vpa", "agentic": "agent_token"}
#: What a refund takes over from its purchase, besides the agentic block; its lag (hours, median), band (microseconds) and the share of full refunds.
INHERITED = {"customer_id", "mcc", "channel", "entry_mode", "card_bin", "merchant_id", "merchant_country", "terminal_id", "device_id", "ip", "lat", "lon", "threeds_result"}
REFUND_LAG_HOURS, REFUND_BAND, REFUND_FULL = 72.0, 86_400_000_000, 0.8
START = "2025-01-06 00:00:00"


@dataclass(frozen=True)
class Config:
    events: int
    customers: int
    merchants: int
    days: int = 60
    seed: int = 7


def _u(c: Config, stream: str, *parts: Column) -> Column:
    return uniform(f"{c.seed}/{stream}", *parts)


class Draws:
    """Draws that become columns of their own: an expression that names one often (a ladder of cases does) has it hashed once a row.

    Calls return references; ``drawn`` adds what was asked for since to a table.
    """

    def __init__(self, c: Config) -> None:
        self.c, self.asked = c, {}

    def __call__(self, c: Config, stream: str, *parts: Column) -> Column:
        self.asked[f"u_{stream}"] = _u(self.c, stream, *parts)
        return F.col(f"u_{stream}")

    def normal(self, stream: str, *parts: Column) -> Column:
        self.asked[f"z_{stream}"] = normal(f"{self.c.seed}/{stream}", *parts)
        return F.col(f"z_{stream}")

    def drawn(self, rows: DataFrame) -> DataFrame:
        found, self.asked = rows.withColumns(self.asked), {}
        return found


def customer_columns(c: Config, n: Column, draws: Draws | None = None) -> dict[str, Column]:
    """The customer's attributes; ``draws`` holds their draws for the caller to add to its table."""
    _u = draws or globals()["_u"]
    city = draw(_u(c, "city", n), {k: v[2] for k, v in CITIES.items()})
    def place(i: int, stream: str) -> Column:
        base = F.lit(0.0)
        for k, v in CITIES.items():
            base = F.when(city == k, F.lit(v[i])).otherwise(base)
        return base + 0.08 * (draws.normal(stream, n) if draws else normal(f"{c.seed}/{stream}", n))
    return {
        "customer_id": F.format_string("C%08d", n), "home_city": city, "home_lat": place(0, "lat"), "home_lon": place(1, "lon"), "tenure_days": (30 + 2500 * _u(c, "tenure", n)).cast("int"),
        "cards": (1 + F.floor(3 * F.pow(_u(c, "cards", n), 2))).cast("int"), "devices": (1 + F.floor(3 * F.pow(_u(c, "devices", n), 2))).cast("int"),
        "agent_propensity": F.pow(_u(c, "propensity", n), 3), "platform": draw(_u(c, "platform", n), {"atlas": 5.0, "beacon": 3.0, "cove": 2.0}), "prefix": F.format_string("10.%d.%d", F.floor(256 * _u(c, "ip1", n)), F.floor(256 * _u(c, "ip2", n))),
    }


def merchant_columns(c: Config, m: Column, draws: Draws | None = None) -> dict[str, Column]:
    _u = draws or globals()["_u"]
    mcc = draw(_u(c, "mcc", m), {k: v[0] for k, v in CATEGORIES.items()})
    return {"merchant_id": F.format_string("M%07d", m), "mcc": mcc, "merchant_country": F.when(_u(c, "abroad", m) < 0.05, F.lit("SG")).otherwise(F.lit("IN")), "weight": 1 / (m + 1.0)}


def customers(spark: SparkSession, c: Config) -> DataFrame:
    return spark.range(c.customers).select(*[v.alias(k) for k, v in customer_columns(c, F.col("id")).items()])


def merchants(spark: SparkSession, c: Config) -> DataFrame:
    return spark.range(c.merchants).select(*[v.alias(k) for k, v in merchant_columns(c, F.col("id")).items()])


def _log_uniform(u: Column, n: int) -> Column:
    """0 .. n - 1 with a chance falling as 1 / rank."""
    return F.least(F.floor(F.exp(u * F.log(F.lit(n + 1.0)))) - 1, F.lit(n - 1)).cast("long")


def _by_category(mcc: Column, i: int) -> Column:
    out = F.lit(0.0)
    for k, v in CATEGORIES.items():
        out = F.when(mcc == k, F.lit(float(v[i]))).otherwise(out)
    return out


def simulate(spark: SparkSession, c: Config, calibration: Calibration | None = None) -> DataFrame:
    """``c.events`` legitimate events in the flat contract.

    Every refund is bound to an earlier purchase (``bind_returns``).
    """
    k = calibration or Calibration()
    return bind_returns(spark.range(c.events), c, k)


def drawn_events(ids: DataFrame, c: Config, k: Calibration) -> DataFrame:
    """The events of the numbers ``id`` in the flat contract, refunds not yet bound; other columns of ``ids`` stay."""
    i, u = F.col("id"), Draws(c)
    z, _u = u.normal, u
    base = ids.withColumns({"n": F.floor(F.lit(c.customers) * F.pow(uniform(f"{c.seed}/who", i), 1.4)).cast("long"), "slot": F.floor(5 * uniform(f"{c.seed}/slot", i))})
    n, slot = F.col("n"), F.col("slot")
    loyal = _log_uniform(_u(c, "loyal", n, slot), c.merchants)
    m = F.when(_u(c, "mode", i) < 0.55, loyal).otherwise(_log_uniform(_u(c, "merchant", i), c.merchants))
    base = u.drawn(base).withColumn("m", m)
    held = {f"c_{x}": v for x, v in customer_columns(c, n, u).items()} | {f"m_{x}": v for x, v in merchant_columns(c, F.col("m"), u).items()}
    base = u.drawn(base).withColumns(held)
    agentic = _u(c, "agentic", i) < F.lit(4 * k.agentic_share) * F.col("c_agent_propensity")
    hour = F.when(agentic, F.floor(24 * _u(c, "ahour", i)).cast("string")).otherwise(draw(_u(c, "hour", i), {str(h): float(w) for h, w in enumerate(HOURS)})).cast("int")
    day = F.floor(F.lit(c.days / 7) * _u(c, "week", i)) * 7 + draw(_u(c, "dow", i), {str(d): float(w) for d, w in enumerate(DAYS)}).cast("int")
    second = (day * 86_400 + hour * 3600 + F.floor(3600 * _u(c, "second", i))).cast("long")
    mcc = F.col("m_mcc")
    raw = F.exp(_by_category(mcc, 1) + _by_category(mcc, 2) * z("amount", i))
    step = _by_category(mcc, 3)
    amount = F.when(step > 0, F.greatest(step, F.rint(raw / step) * step)).otherwise(F.round(raw, 2))
    base = u.drawn(base).withColumn("agentic", agentic).withColumn("ts", F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + second)).withColumn("amount", amount)
    channel = F.when(F.col("agentic"), F.lit("agentic")).otherwise(draw(_u(c, "channel", i), CHANNEL_MIX))
    txn_type = F.when(_u(c, "type", i) < k.refund_share, F.lit("refund")).when(_u(c, "type", i) > 0.985, F.lit("preauth")).otherwise(F.lit("purchase"))
    base = u.drawn(base).withColumn("channel", channel).withColumn("txn_type", txn_type)
    declined = _u(c, "decline", i) < k.decline_share * F.when(F.log(F.col("amount")) > 8.5, 2.0).otherwise(0.9)
    settled = ~F.col("declined") & (_u(c, "settle", i) < 0.97)
    base = u.drawn(base).withColumn("declined", declined).withColumn("settled", settled)
    disputed = F.col("settled") & (_u(c, "dispute", i) < k.dispute_share)
    entry = F.lit("chip")
    for a, b in ENTRY.items():
        entry = F.when(F.col("channel") == a, F.lit(b)).otherwise(entry)
    physical = F.col("channel").isin("card_present", "atm")
    ag = F.col("agentic")
    cap = F.round(F.col("amount") * (1.05 + 1.5 * _u(c, "cap", i)), 2)
    url = F.concat(F.lit("https://shop."), F.lower(F.col("m_merchant_id")), F.lit(".test/item/"), F.floor(500 * _u(c, "item", i)).cast("string"))
    search = F.concat(F.lit("https://site"), F.floor(60 * _u(c, "site", n, slot)).cast("string"), F.lit(".example/page/"), F.floor(90 * _u(c, "page", i)).cast("string"))
    chain = F.array(search, url)
    human = _u(c, "human", i) < 0.35
    def on(x: Column) -> Column:
        return F.when(ag, x)
    columns: dict[str, Column] = {
        "event_id": F.format_string("E%d-%012d", F.lit(c.seed), i), "ts": F.col("ts"), "amount": F.col("amount"), "currency": F.lit("INR"), "mcc": mcc, "channel": F.col("channel"), "entry_mode": entry, "customer_id": F.col("c_customer_id"),
        "card_bin": F.element_at(F.array(*map(F.lit, BINS)), (1 + F.floor(len(BINS) * _u(c, "bin", n, F.floor(F.col("c_cards") * uniform(f"{c.seed}/card", i))))).cast("int")), "merchant_id": F.col("m_merchant_id"), "merchant_country": F.col("m_merchant_country"),
        "terminal_id": F.when(physical, F.format_string("T%s-%d", F.col("m_merchant_id"), F.floor(3 * _u(c, "terminal", i)))), "device_id": F.when(~physical, F.format_string("D%08d-%d", n, F.floor(F.col("c_devices") * _u(c, "device", i)))),
        "ip": F.when(~physical, F.concat(F.col("c_prefix"), F.lit("."), (1 + F.floor(4 * _u(c, "ip", i))).cast("string"), F.lit(".7"))), "lat": F.when(physical, F.round(F.col("c_home_lat") + 0.03 * z("dlat", i), 5)), "lon": F.when(physical, F.round(F.col("c_home_lon") + 0.03 * z("dlon", i), 5)),
        "threeds_result": F.when(F.col("channel") == "ecom", draw(_u(c, "3ds", i), {"authenticated": 0.7, "frictionless": 0.2, "failed": 0.1})), "txn_type": F.col("txn_type"), "auth_response": F.when(F.col("declined"), draw(_u(c, "why", i), {"declined_funds": 0.5, "declined_risk": 0.2, "declined_invalid": 0.2, "declined_limit": 0.1})).otherwise(F.lit("approved")),
        "original_event_id": F.lit(None).cast("string"), "dispute_outcome": F.when(disputed, draw(_u(c, "outcome", i), {"won": 0.3, "lost": 0.5, "withdrawn": 0.2})), "dispute_raised_ts": F.when(disputed, F.timestamp_seconds(F.unix_timestamp("ts") + F.floor(86_400 * (2 + 40 * _u(c, "raised", i))))),
        "settled": F.col("settled"), "settlement_lag_hours": F.when(F.col("settled"), F.round(20 + 18 * _u(c, "lag", i), 3)),
        "ag_agent_id": on(F.format_string("A%08d", n)), "ag_agent_platform": on(F.col("c_platform")), "ag_kya_token": on(F.concat(F.lit("kya-"), F.substring(F.sha2(F.col("c_customer_id"), 256), 1, 12))), "ag_kya_registered": on(_u(c, "kya", i) < 0.985),
        "ag_mandate_type": on(draw(_u(c, "mandate", i), {"intent": 0.5, "cart": 0.35, "payment": 0.15})), "ag_mandate_id": on(F.format_string("MD%012d", i)), "ag_mandate_hash": on(F.substring(F.sha2(F.format_string("%d:%d", F.lit(c.seed), i), 256), 1, 24)),
        "ag_mandate_issued_ts": on(F.timestamp_seconds(F.unix_timestamp("ts") - F.floor(3000 * _u(c, "age", i)))), "ag_mandate_ttl_seconds": on(F.lit(3600)), "ag_scope_categories": on(F.array(mcc, F.lit("5411"))), "ag_scope_max_amount": on(cap), "ag_scope_max_items": on(F.lit(5)),
        "ag_scope_allowed_merchants": on(F.array().cast("array<string>")), "ag_scope_ttl_seconds": on(F.lit(3600)), "ag_human_present": on(human), "ag_consent_sig_valid": on(_u(c, "consent", i) < 0.99), "ag_delegation_depth": on((1 + F.floor(2 * F.pow(_u(c, "depth", i), 3))).cast("int")),
        "ag_provenance_chain": on(chain), "ag_ingested_content_ids": on(F.transform(chain, content_id)), "ag_tool_call_count": on((2 + F.floor(9 * _u(c, "tools", i))).cast("int")),
        "ag_deliberation_latency_ms": on(F.round(F.exp(6.0 + 0.25 * F.log1p(F.col("amount")) + 0.4 * z("think", i)), 1)), "ag_cursor_entropy": on(F.when(human, 0.6 + 0.4 * _u(c, "cursor", i)).otherwise(0.1 * _u(c, "cursor", i))), "ag_dwell_time_ms": on(F.round(F.exp(7 + 0.5 * z("dwell", i)), 1)),
        "is_fraud": F.lit(False), "attack_id": F.lit(None).cast("string"), "attack_campaign": F.lit(None).cast("string"),
    }
    return u.drawn(base).select(*ids.columns, *[columns[x].alias(x) for x in schema.ALL_COLUMNS])


def bind_returns(ids: DataFrame, c: Config, k: Calibration) -> DataFrame:
    """The events of the numbers ``id``, every refund bound to an earlier purchase, whose parties, rail and credential it takes over.

    A refund looks for purchases around a lag of some days before it, else takes
    any earlier one; one that finds none stays a purchase.  A refund gives back
    all or a part of the amount and is not declined.  Only numbers and times are
    shuffled: a purchase's columns follow from its number.
    """
    number = lambda event: F.substring_index(event, "-", -1).cast("long")
    own = F.col("event_id")
    light = checkpointed(drawn_events(ids, c, k).select(own, "txn_type", micros(F.col("ts")).alias("t")))
    lag = F.exp(F.log(F.lit(REFUND_LAG_HOURS * 3600.0)) + 0.7 * normal(f"{c.seed}/refund_lag", own))
    returns = light.where("txn_type = 'refund'").select(own.alias("seq"), (F.col("t") - (lag * 1e6).cast("long")).alias("target"))
    bound = checkpointed(bind_source(returns, light.where("txn_type = 'purchase'").select(own.alias("seq"), "t"), REFUND_BAND))
    refunds = drawn_events(bound.select(number(F.col("seq")).alias("id"), "source"), c, k)
    sources = drawn_events(refunds.select(F.struct(*schema.ALL_COLUMNS).alias("own"), "source", number(F.col("source")).alias("id")), c, k)
    taken = [x for x in schema.ALL_COLUMNS if x in INHERITED or x.startswith("ag_")]
    rows = sources.select("source", F.col("amount").alias("s_amount"), *[F.col(x).alias(f"s_{x}") for x in taken], "own.*")
    there = F.col("source").isNotNull()
    part = F.when(_u(c, "full", own) < REFUND_FULL, 1.0).otherwise(0.2 + 0.7 * _u(c, "part", own))
    issued = F.timestamp_seconds(F.unix_timestamp("ts") - F.floor(3000 * _u(c, "refund_age", own)))
    changed: dict[str, Column] = {x: F.when(there, F.col(f"s_{x}")).otherwise(F.col(x)) for x in taken}
    changed |= {
        "original_event_id": F.col("source"), "txn_type": F.when((F.col("txn_type") == "refund") & ~there, F.lit("purchase")).otherwise(F.col("txn_type")), "auth_response": F.when(there, F.lit("approved")).otherwise(F.col("auth_response")),
        "amount": F.when(there, F.greatest(F.lit(1.0), F.round(F.col("s_amount") * part, 2))).otherwise(F.col("amount")),
        "ag_mandate_issued_ts": F.when(there & F.col("s_ag_agent_id").isNotNull(), issued).when(there, F.lit(None)).otherwise(F.col("ag_mandate_issued_ts")),
    }
    others = drawn_events(ids, c, k).where("txn_type <> 'refund'").select(*schema.ALL_COLUMNS)
    return others.unionByName(rows.select(*[changed.get(x, F.col(x)).alias(x) for x in schema.ALL_COLUMNS]))
