"""The event contract: types, constraints as predicates, and the flat form.

``EVENT`` is the nested form (the agentic block is a struct); the flat form has
the same columns for every event, the block's columns null off its rail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = "1.1.0"

# Fixed values of the contract.
CHANNELS = ["card_present", "ecom", "upi", "wallet", "atm", "transfer", "agentic"]
ENTRY_MODES = ["chip", "contactless", "swipe", "manual", "cof", "qr", "vpa", "agent_token"]
TXN_TYPES = ["purchase", "refund", "reversal", "preauth", "credit"]
RETURN_TYPES = ["refund", "reversal", "credit"]
AUTH_RESPONSES = ["approved", "declined_funds", "declined_risk", "declined_invalid", "declined_limit", "timeout"]
DECLINES = ["declined_funds", "declined_risk", "declined_invalid", "declined_limit"]
MANDATE_TYPES = ["intent", "cart", "payment", "none"]

_s, _d, _b, _i, _t = T.StringType(), T.DoubleType(), T.BooleanType(), T.IntegerType(), T.TimestampType()
_texts = T.ArrayType(_s)

SCOPE = T.StructType([T.StructField(n, t) for n, t in [("categories", _texts), ("max_amount", _d), ("max_items", _i), ("allowed_merchants", _texts), ("ttl_seconds", _i)]])
AGENTIC_FIELDS: list[tuple[str, T.DataType]] = [
    ("agent_id", _s), ("agent_platform", _s), ("kya_token", _s), ("kya_registered", _b), ("mandate_type", _s), ("mandate_id", _s), ("mandate_hash", _s), ("mandate_issued_ts", _t),
    ("mandate_ttl_seconds", _i), ("mandate_scope", SCOPE), ("human_present", _b), ("consent_sig_valid", _b), ("delegation_depth", _i), ("provenance_chain", _texts),
    ("ingested_content_ids", _texts), ("tool_call_count", _i), ("deliberation_latency_ms", _d), ("cursor_entropy", _d), ("dwell_time_ms", _d),
]
CORE_FIELDS: list[tuple[str, T.DataType]] = [
    ("event_id", _s), ("ts", _t), ("amount", _d), ("currency", _s), ("mcc", _s), ("channel", _s), ("entry_mode", _s), ("customer_id", _s), ("card_bin", _s), ("merchant_id", _s),
    ("merchant_country", _s), ("terminal_id", _s), ("device_id", _s), ("ip", _s), ("lat", _d), ("lon", _d), ("threeds_result", _s), ("txn_type", _s), ("auth_response", _s),
    ("original_event_id", _s), ("dispute_outcome", _s), ("dispute_raised_ts", _t), ("settled", _b), ("settlement_lag_hours", _d),
]
LABEL_FIELDS: list[tuple[str, T.DataType]] = [("is_fraud", _b), ("attack_id", _s), ("attack_campaign", _s)]
AGENTIC = T.StructType([T.StructField(n, t) for n, t in AGENTIC_FIELDS])
EVENT = T.StructType([T.StructField(n, t) for n, t in CORE_FIELDS] + [T.StructField("agentic", AGENTIC)] + [T.StructField(n, t) for n, t in LABEL_FIELDS])

LABEL_COLUMNS = [n for n, _ in LABEL_FIELDS]
POST_HOC_COLUMNS = ["dispute_outcome", "dispute_raised_ts"]
OWN_OUTCOME_COLUMNS = ["auth_response", "settled", "settlement_lag_hours"]
SCOPE_NAMES = {"categories": "ag_scope_categories", "max_amount": "ag_scope_max_amount", "max_items": "ag_scope_max_items", "allowed_merchants": "ag_scope_allowed_merchants", "ttl_seconds": "ag_scope_ttl_seconds"}


def _flat_agentic() -> list[tuple[str, str]]:
    """(path in the struct, flat name) in order."""
    out = []
    for name, _ in AGENTIC_FIELDS:
        if name == "mandate_scope":
            out += [(f"mandate_scope.{k}", v) for k, v in SCOPE_NAMES.items()]
        else:
            out.append((name, f"ag_{name}"))
    return out


ALL_COLUMNS = [n for n, _ in CORE_FIELDS] + [f for _, f in _flat_agentic()] + LABEL_COLUMNS


def flatten(events: DataFrame) -> DataFrame:
    """Nested events as the flat columns, in contract order."""
    return events.select(*[n for n, _ in CORE_FIELDS], *[F.col(f"agentic.{p}").alias(f) for p, f in _flat_agentic()], *LABEL_COLUMNS)


def nest(flat: DataFrame) -> DataFrame:
    """The inverse of ``flatten``: no block where the agent is null."""
    scope = F.struct(*[F.col(f).alias(k) for k, f in SCOPE_NAMES.items()])
    block = F.struct(*[scope.alias(n) if n == "mandate_scope" else F.col(f"ag_{n}").alias(n) for n, _ in AGENTIC_FIELDS])
    return flat.select(*[n for n, _ in CORE_FIELDS], F.when(F.col("ag_agent_id").isNotNull(), block).alias("agentic"), *LABEL_COLUMNS)


def constraints() -> dict[str, Column]:
    """Name -> predicate over the flat form that holds for a valid event (unknown counts as broken)."""
    c = F.col
    declined = c("auth_response").isin(DECLINES)

    def implies(a: Column, b: Column) -> Column:
        return ~F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False))

    def in_range(name: str, low: float, high: float | None = None) -> Column:
        return c(name).isNull() | ((c(name) >= low) & (F.lit(True) if high is None else c(name) <= high))

    return {
        "currency": c("currency").rlike("^[A-Z]{3}$"),
        "mcc": c("mcc").rlike("^[0-9]{4}$"),
        "card_bin": c("card_bin").rlike("^[0-9]{6,8}$"),
        "country": c("merchant_country").rlike("^[A-Z]{2}$"),
        "channel": c("channel").isin(CHANNELS) & c("entry_mode").isin(ENTRY_MODES) & c("txn_type").isin(TXN_TYPES) & c("auth_response").isin(AUTH_RESPONSES),
        "agentic_block": implies(c("channel") == "agentic", c("ag_agent_id").isNotNull()) & implies(c("ag_agent_id").isNotNull() & (c("channel") != "agentic"), c("entry_mode") == "agent_token"),
        "settlement": implies(declined, ~c("settled") & c("settlement_lag_hours").isNull()) & implies(~c("settled"), c("settlement_lag_hours").isNull()),
        "original": implies(c("original_event_id").isNotNull(), c("txn_type").isin(RETURN_TYPES) & (c("original_event_id") != c("event_id"))),
        "dispute": (c("dispute_outcome").isNull() == c("dispute_raised_ts").isNull()) & implies(c("dispute_raised_ts").isNotNull(), c("dispute_raised_ts") >= c("ts")),
        "label": c("is_fraud").isNotNull() & (c("is_fraud") == c("attack_id").isNotNull()),
        "ranges": c("amount").isNotNull() & in_range("amount", 0) & in_range("settlement_lag_hours", 0) & in_range("lat", -90, 90) & in_range("lon", -180, 180) & in_range("ag_delegation_depth", 0) & in_range("ag_tool_call_count", 0) & in_range("ag_mandate_ttl_seconds", 0),
    }


def violations(flat: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """(constraint, n): events that break each constraint, in one pass."""
    rules = constraints() if rules is None else rules
    counts = flat.agg(*[F.count_if(~F.coalesce(p, F.lit(False))).alias(n) for n, p in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(n).alias("n")) for n in rules])).alias("x")).select("x.*")


def check_attack(attack: DataFrame, background: DataFrame) -> DataFrame:
    """(problem, n) for a frame of injected events beside its background (V11)."""
    ids, known = background.select("event_id"), background.select("event_id").unionByName(attack.select("event_id"))
    problems = {
        "columns": attack.limit(0 if attack.columns == ALL_COLUMNS else 1).select(F.lit(1).alias("x")),
        "unlabelled": attack.where(~F.coalesce("is_fraud", F.lit(False)) | F.col("attack_id").isNull() | F.col("attack_campaign").isNull()),
        "repeated_id": attack.groupBy("event_id").count().where("count > 1"),
        "collision": attack.join(ids, "event_id", "left_semi"),
        "dangling": attack.where(F.col("original_event_id").isNotNull()).join(known.select(F.col("event_id").alias("original_event_id")), "original_event_id", "left_anti"),
        "new_customer": attack.select("customer_id").distinct().join(background.select("customer_id"), "customer_id", "left_anti"),
    }
    out = None
    for name, rows in problems.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.unionByName(one)
    return out


class LeakageError(ValueError):
    """A feature matrix holds a column that a feature must not be."""


def assert_no_leakage(columns: list[str]) -> None:
    """Raise if a feature is, or is named after, a label, post-hoc or own-outcome column."""
    forbidden = LABEL_COLUMNS + POST_HOC_COLUMNS + OWN_OUTCOME_COLUMNS
    bad = [c for c in columns for f in forbidden if c == f or (f in LABEL_COLUMNS + POST_HOC_COLUMNS and f in c)]
    if bad:
        raise LeakageError(f"forbidden columns among the features: {sorted(set(bad))}")
