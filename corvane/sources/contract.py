"""A lens that views the event log as flat events of the contract, agentic block included.

Clicks are the agentic rail.  A few rows break the contract on purpose, so that
its checks have something to find.  ``FLAT`` pairs each contract column with its
Spark expression; ``FLAT_SQL`` says the same for DuckDB (where the two dialects
differ, the second text of the pair).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.schema import ALL_COLUMNS

_ON = "event_type = 'click'"


def _if_agent(x: str) -> str:
    return f"CASE WHEN {_ON} THEN {x} END"


#: Column -> expression, or (Spark, DuckDB) where they differ; i, u, k and v are the event, user, place and value.
FLAT: dict[str, str | tuple[str, str]] = {
    "event_id": "concat('e', i)",
    "ts": "ts",
    "amount": "v",
    "currency": "CASE WHEN i % 97 = 0 THEN 'usd' ELSE 'USD' END",
    "mcc": "CASE WHEN i % 89 = 0 THEN '58x' ELSE concat('', 5000 + k) END",
    "channel": "CASE event_type WHEN 'click' THEN 'agentic' WHEN 'purchase' THEN 'ecom' WHEN 'view' THEN 'card_present' WHEN 'error' THEN 'upi' ELSE 'transfer' END",
    "entry_mode": "CASE WHEN event_type = 'click' AND i % 83 <> 0 THEN 'agent_token' WHEN event_type = 'view' THEN 'chip' ELSE 'vpa' END",
    "customer_id": "concat('c', u)",
    "card_bin": "concat('', 400000 + u % 16)",
    "merchant_id": "concat('M-S', k)",
    "merchant_country": "CASE k % 4 WHEN 0 THEN 'US' WHEN 1 THEN 'SG' ELSE 'IN' END",
    "terminal_id": "CASE WHEN event_type = 'view' AND k % 6 <> 0 THEN concat('t', k % 20) END",
    "device_id": "CASE WHEN k % 5 <> 0 THEN concat('d', k % 20) END",
    "ip": "CASE WHEN k % 10 <> 0 THEN concat('10.0.0.', u % 50) END",
    "lat": "CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN CAST(12 + u % 100 AS DOUBLE) END",
    "lon": "CASE WHEN event_type = 'view' AND k % 3 <> 0 THEN CAST(77 + u % 150 AS DOUBLE) END",
    "threeds_result": "CASE WHEN event_type = 'purchase' THEN 'passed' END",
    "txn_type": "CASE WHEN event_type = 'view' THEN 'refund' WHEN event_type = 'signup' THEN 'preauth' WHEN event_type = 'error' AND k % 2 = 0 THEN 'credit' ELSE 'purchase' END",
    "auth_response": "CASE WHEN event_type = 'error' THEN 'declined_funds' ELSE 'approved' END",
    "original_event_id": "CASE WHEN event_type = 'view' AND i % 3 <> 0 THEN concat('e', i - 1) WHEN i % 211 = 0 THEN concat('e', i) END",
    "dispute_outcome": "CASE WHEN i % 50 = 0 THEN 'won' END",
    "dispute_raised_ts": ("CASE WHEN i % 50 = 0 AND i % 150 <> 0 THEN ts + make_dt_interval(1) END", "CASE WHEN i % 50 = 0 AND i % 150 <> 0 THEN ts + to_days(1) END"),
    "settled": "event_type <> 'error' OR i % 101 = 0",
    "settlement_lag_hours": "CASE WHEN event_type <> 'error' OR i % 101 = 0 THEN CAST(k % 48 AS DOUBLE) END",
    "ag_agent_id": _if_agent("concat('a', u % 7)"),
    "ag_agent_platform": _if_agent("concat('platform-', u % 3)"),
    "ag_kya_token": _if_agent("CASE WHEN k % 4 <> 0 THEN concat('kya-', u) END"),
    "ag_kya_registered": _if_agent("CASE WHEN k % 6 = 1 THEN false WHEN k % 6 <> 0 THEN true END"),
    "ag_mandate_type": _if_agent("CASE k % 8 WHEN 0 THEN 'none' WHEN 1 THEN NULL WHEN 2 THEN 'intent' WHEN 3 THEN 'cart' ELSE 'payment' END"),
    "ag_mandate_id": _if_agent("concat('mandate-', u % 7 * 10 + k % 3)"),
    "ag_mandate_hash": _if_agent("md5(concat('mandate-', u % 7 * 10 + k % 3))"),
    "ag_mandate_issued_ts": (_if_agent("ts - make_dt_interval(0, 0, 0, k * 100)"), _if_agent("ts - to_seconds(k * 100)")),
    "ag_mandate_ttl_seconds": _if_agent("CAST(u % 5 * 1000 AS INT)"),
    "ag_scope_categories": (
        _if_agent("CASE WHEN k % 7 = 1 THEN cast(array() AS array<string>) WHEN k % 7 <> 0 THEN array('5001', concat('', 5000 + u % 9 + k % 90)) END"),
        _if_agent("CASE WHEN k % 7 = 1 THEN []::VARCHAR[] WHEN k % 7 <> 0 THEN ['5001', concat('', 5000 + u % 9 + k % 90)] END"),
    ),
    "ag_scope_max_amount": _if_agent("CAST(u % 4 * 20 AS DOUBLE)"),
    "ag_scope_max_items": _if_agent("CAST(u % 5 AS INT)"),
    "ag_scope_allowed_merchants": (
        _if_agent("CASE WHEN k % 5 = 1 THEN cast(array() AS array<string>) WHEN k % 5 <> 0 THEN array(concat('M-S', k - k % 2), concat('M-S', k + u % 3)) END"),
        _if_agent("CASE WHEN k % 5 = 1 THEN []::VARCHAR[] WHEN k % 5 <> 0 THEN [concat('M-S', k - k % 2), concat('M-S', k + u % 3)] END"),
    ),
    "ag_scope_ttl_seconds": _if_agent("CAST(u % 5 * 1000 AS INT)"),
    "ag_human_present": _if_agent("k % 2 = 0"),
    "ag_consent_sig_valid": _if_agent("CASE WHEN k % 9 = 1 THEN false WHEN k % 9 <> 0 THEN true END"),
    "ag_delegation_depth": _if_agent("CAST(k % 8 AS INT)"),
    "ag_provenance_chain": (
        _if_agent("CASE WHEN k % 11 = 1 THEN cast(array() AS array<string>) WHEN k % 11 <> 0 THEN array(concat('https://www', u % 13, '.search.test/q?x=', i), CASE WHEN k % 3 = 0 THEN 'not a link' ELSE concat('https://shop.s', k + u % 2, '.test/item/', i) END) END"),
        _if_agent("CASE WHEN k % 11 = 1 THEN []::VARCHAR[] WHEN k % 11 <> 0 THEN [concat('https://www', u % 13, '.search.test/q?x=', i), CASE WHEN k % 3 = 0 THEN 'not a link' ELSE concat('https://shop.s', k + u % 2, '.test/item/', i) END] END"),
    ),
    "ag_ingested_content_ids": (_if_agent("array(concat('sha256:', i))"), _if_agent("[concat('sha256:', i)]")),
    "ag_tool_call_count": _if_agent("CAST(k % 15 AS INT)"),
    "ag_deliberation_latency_ms": _if_agent("CAST(200 + 37 * (k % 40) + i % 17 AS DOUBLE)"),
    "ag_cursor_entropy": _if_agent("CASE WHEN k % 13 <> 0 THEN CAST(k % 10 AS DOUBLE) / 8 END"),
    "ag_dwell_time_ms": _if_agent("CAST(100 * k AS DOUBLE)"),
    "is_fraud": "u % 10 = 0",
    "attack_id": "CASE WHEN u % 10 = 0 AND i % 131 <> 0 THEN concat('F', 1 + k % 3, '-0', 1 + k % 5) END",
    "attack_campaign": "CASE WHEN u % 10 = 0 THEN concat('camp-', u) END",
}

FLAT_SQL = (
    "flat AS (SELECT "
    + ", ".join(f"{x if isinstance(x, str) else x[1]} AS {c}" for c, x in FLAT.items())
    + " FROM (SELECT event_id AS i, user_id AS u, event_type, value AS v, ts, (props::JSON->>'k')::BIGINT AS k FROM events))"
)


def flat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("i"), F.col("user_id").alias("u"), "event_type", F.col("value").alias("v"), "ts", F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    return base.select(*[F.expr(x if isinstance(x, str) else x[0]).alias(c) for c, x in FLAT.items()]).select(*ALL_COLUMNS)
