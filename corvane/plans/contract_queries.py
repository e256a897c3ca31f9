"""Registered queries over flat contract events: constraints, protocol clauses, feature blocks; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schema
from corvane.operators import rules
from corvane.plans import experiment
from corvane.plans.queries import QUERIES, SQL, query
from corvane.sources.contract import FLAT_SQL, flat_events

FL = f"WITH {FLAT_SQL}"

#: The clauses in SQL, in the order in which they name a reason.
CLAUSES_SQL = {
    "scope_mcc": "len(ag_scope_categories) > 0 AND NOT list_contains(ag_scope_categories, mcc)",
    "scope_merchant": "len(ag_scope_allowed_merchants) > 0 AND NOT list_contains(ag_scope_allowed_merchants, merchant_id)",
    "amount_over_cap": "ag_scope_max_amount > 0 AND amount > ag_scope_max_amount",
    "mandate_expired": "ag_mandate_ttl_seconds > 0 AND epoch_us(ts) // 1000000 - epoch_us(ag_mandate_issued_ts) // 1000000 > ag_mandate_ttl_seconds",
    "delegation_depth": "ag_delegation_depth > 5",
    "consent_invalid": "ag_consent_sig_valid = false",
    "kya_unregistered": "ag_kya_registered IS DISTINCT FROM true",
    "mandate_missing": "ag_mandate_type IS NULL OR ag_mandate_type = 'none'",
    "provenance_mismatch": r"""regexp_matches(ag_provenance_chain[-1], '^[a-z]+://shop\.[a-z0-9-]+\.test(/|$)') AND NOT ends_with(lower(merchant_id), regexp_extract(ag_provenance_chain[-1], '^[a-z]+://shop\.([a-z0-9-]+)\.test', 1))""",
}
FIRED_SQL = f"""{FL}, fired AS (SELECT event_id, is_fraud, attack_id, ag_agent_id, {", ".join(f"coalesce(ag_agent_id IS NOT NULL AND ({x}), false) AS {n}" for n, x in CLAUSES_SQL.items())} FROM flat)"""
ANY_SQL = " OR ".join(CLAUSES_SQL)
UNPIVOT_SQL = " UNION ALL ".join(f"SELECT event_id, is_fraud, attack_id, ag_agent_id, '{n}' AS clause, {n} AS hit FROM fired" for n in CLAUSES_SQL)


@query(
    "l0_clauses",
    f"""{FIRED_SQL} SELECT event_id, {", ".join(f"{n} AS l0_{n}" for n in CLAUSES_SQL)}, CASE {" ".join(f"WHEN {n} THEN '{n}'" for n in CLAUSES_SQL)} END AS l0_reason, ({ANY_SQL}) AS l0_fired FROM fired""",
)
def l0_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rules.apply_rules(flat_events(spark, sf_dir))
    return out.select("event_id", *[f"l0_{n}" for n in rules.clauses()], "l0_reason", "l0_fired")


@query(
    "l0_clause_report",
    f"""{FIRED_SQL}, l AS ({UNPIVOT_SQL} UNION ALL SELECT event_id, is_fraud, attack_id, ag_agent_id, 'ANY', {ANY_SQL} FROM fired)
    SELECT clause, count(*) FILTER (hit) AS fires, (count(*) FILTER (hit AND is_fraud))::DOUBLE / nullif(count(*) FILTER (hit), 0) AS precision,
      (count(*) FILTER (hit AND NOT is_fraud))::DOUBLE / nullif(count(*) FILTER (NOT is_fraud), 0) AS fpr,
      (count(*) FILTER (hit AND NOT is_fraud AND ag_agent_id IS NOT NULL))::DOUBLE / nullif(count(*) FILTER (NOT is_fraud AND ag_agent_id IS NOT NULL), 0) AS agentic_fpr FROM l GROUP BY clause""",
)
def l0_clause_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.clause_table(rules.apply_rules(flat_events(spark, sf_dir)), list(rules.clauses()), F.col("ag_agent_id").isNotNull())


@query(
    "l0_clause_buckets",
    f"""{FIRED_SQL}, l AS ({UNPIVOT_SQL}), p AS (SELECT attack_id, clause, count(*) AS n, count(*) FILTER (hit) AS hits FROM l WHERE attack_id IS NOT NULL GROUP BY ALL),
    b AS (SELECT attack_id, arg_min(clause, (-hits, clause)) AS clause, max(hits)::DOUBLE / max(n) AS share FROM p GROUP BY attack_id),
    r AS (SELECT attack_id, count(*) AS events, (count(*) FILTER ({ANY_SQL}))::DOUBLE / count(*) AS recall FROM fired WHERE attack_id IS NOT NULL GROUP BY attack_id)
    SELECT attack_id, events, recall, clause, share, CASE WHEN recall = 0 THEN 'CLEAN' WHEN share >= 0.3 THEN 'HARD' ELSE 'SOFT' END AS bucket FROM r JOIN b USING (attack_id)""",
)
def l0_clause_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    fired = rules.apply_rules(flat_events(spark, sf_dir))
    return rules.bucket_verdict(rules.strongest_clause(fired, "attack_id", list(rules.clauses())))


@query(
    "l0_untrusted_domain",
    rf"""{FL}, u AS (SELECT event_id, is_fraud, unnest(ag_provenance_chain) AS url FROM flat), h AS (SELECT event_id, is_fraud, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM u WHERE regexp_matches(url, '^[a-z]+://')),
    ok AS (SELECT host FROM h WHERE NOT is_fraud GROUP BY host HAVING count(*) >= 20), bad AS (SELECT DISTINCT event_id FROM h WHERE NOT regexp_matches(host, '^shop\.[a-z0-9-]+\.test$') AND host NOT IN (SELECT host FROM ok))
    SELECT event_id, event_id IN (SELECT event_id FROM bad) AS untrusted FROM flat""",
)
def l0_untrusted_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flat_events(spark, sf_dir)
    return rules.untrusted_domain(flat, rules.host_allow_list(flat.where("not is_fraud")))


_DECLINED_SQL = "auth_response IN ('declined_funds', 'declined_risk', 'declined_invalid', 'declined_limit')"
#: Rows that break each constraint.
BROKEN_SQL = {
    "currency": "NOT regexp_full_match(currency, '[A-Z]{3}')",
    "mcc": "NOT regexp_full_match(mcc, '[0-9]{4}')",
    "card_bin": "NOT regexp_full_match(card_bin, '[0-9]{6,8}')",
    "country": "NOT regexp_full_match(merchant_country, '[A-Z]{2}')",
    "channel": "channel NOT IN ('card_present', 'ecom', 'upi', 'wallet', 'atm', 'transfer', 'agentic') OR entry_mode NOT IN ('chip', 'contactless', 'swipe', 'manual', 'cof', 'qr', 'vpa', 'agent_token')",
    "agentic_block": "(channel = 'agentic') AND ag_agent_id IS NULL OR ag_agent_id IS NOT NULL AND channel <> 'agentic' AND entry_mode <> 'agent_token'",
    "settlement": f"{_DECLINED_SQL} AND (settled OR settlement_lag_hours IS NOT NULL) OR NOT settled AND settlement_lag_hours IS NOT NULL",
    "original": "original_event_id IS NOT NULL AND (txn_type NOT IN ('refund', 'reversal', 'credit') OR original_event_id = event_id)",
    "dispute": "(dispute_outcome IS NULL) <> (dispute_raised_ts IS NULL) OR dispute_raised_ts < ts",
    "label": "is_fraud <> (attack_id IS NOT NULL)",
    "ranges": "amount IS NULL OR amount < 0 OR settlement_lag_hours < 0 OR abs(lat) > 90 OR abs(lon) > 180 OR ag_delegation_depth < 0 OR ag_tool_call_count < 0 OR ag_mandate_ttl_seconds < 0",
}


@query("contract_violations", f"""{FL} {" UNION ALL ".join(f"SELECT '{n}' AS 'constraint', count(*) FILTER ({x}) AS n FROM flat" for n, x in BROKEN_SQL.items())}""")
def contract_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema.violations(flat_events(spark, sf_dir))


@query("contract_round_trip", f"""{FL} SELECT event_id, ag_agent_id, ag_scope_categories[1] AS first_category, ag_scope_max_amount, len(ag_provenance_chain) AS hops, is_fraud FROM flat""")
def contract_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat to nested and back."""
    again = schema.flatten(schema.nest(flat_events(spark, sf_dir)))
    hops = F.when(F.col("ag_provenance_chain").isNotNull(), F.size("ag_provenance_chain")).cast("long")
    return again.select("event_id", "ag_agent_id", F.get("ag_scope_categories", F.lit(0)).alias("first_category"), "ag_scope_max_amount", hops.alias("hops"), "is_fraud")


def _int(x: str) -> str:
    return f"({x})::INTEGER"


TXN_SQL = {
    "txn_amount": "amount", "txn_log_amount": "round(ln(1 + amount), 9)", "txn_round_score": "(c % 100 = 0)::INTEGER + (c % 10000 = 0)::INTEGER + (c % 100000 = 0)::INTEGER",
    "txn_cross_border": _int("merchant_country <> 'IN'"), "txn_agentic": _int("ag_agent_id IS NOT NULL"),
    "txn_hour": "hour(ts)::INTEGER", "txn_dow": "(isodow(ts) - 1)::INTEGER", "txn_is_weekend": _int("isodow(ts) >= 6"), "txn_is_night": _int("hour(ts) BETWEEN 1 AND 5"),
    "txn_is_outbound": _int("txn_type IN ('refund', 'reversal', 'credit')"), "txn_is_orphan_outbound": _int("txn_type IN ('refund', 'reversal', 'credit') AND original_event_id IS NULL"),
    "txn_is_refund": _int("txn_type = 'refund'"), "txn_is_credit": _int("txn_type = 'credit'"), "txn_is_preauth": _int("txn_type = 'preauth'"),
    "txn_lat_missing": _int("lat IS NULL"), "txn_terminal_id_missing": _int("terminal_id IS NULL"), "txn_device_id_missing": _int("device_id IS NULL"), "txn_ip_missing": _int("ip IS NULL"),
    "txn_physical_without_geo": _int("channel IN ('card_present', 'atm') AND lat IS NULL"),
}


@query("transaction_block", f"""{FL} SELECT event_id AS seq, {", ".join(f"{x} AS {n}" for n, x in TXN_SQL.items())} FROM (SELECT *, round(amount * 100)::BIGINT AS c FROM flat)""")
def transaction_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = experiment.transaction_block(flat_events(spark, sf_dir))
    return block.select("seq", *[F.round(c, 9).alias(c) if c == "txn_log_amount" else F.col(c) for c in TXN_SQL])


def _in_scope(items: str, value: str) -> str:
    return f"CASE WHEN {items} IS NULL THEN NULL WHEN len({items}) = 0 THEN 1 ELSE list_contains({items}, {value})::INTEGER END"


MND_SQL = {
    "mnd_kya_registered": _int("ag_kya_registered"), "mnd_kya_token_missing": _int("ag_kya_token IS NULL"), "mnd_consent_valid": _int("ag_consent_sig_valid"),
    "mnd_amount_vs_ceiling": "CASE WHEN ag_scope_max_amount > 0 THEN round(amount / ag_scope_max_amount, 9) END", "mnd_ceiling_breached": _int("amount > ag_scope_max_amount"),
    "mnd_category_in_scope": _in_scope("ag_scope_categories", "mcc"), "mnd_merchant_in_scope": _in_scope("ag_scope_allowed_merchants", "merchant_id"), "mnd_scope_size": "len(ag_scope_categories)::INTEGER",
    "mnd_mandate_age": "age", "mnd_mandate_age_share": "CASE WHEN ag_mandate_ttl_seconds > 0 THEN round(age::DOUBLE / ag_mandate_ttl_seconds, 9) END",
    "mnd_mandate_expired": _int("ag_mandate_ttl_seconds > 0 AND age > ag_mandate_ttl_seconds"), "mnd_mandate_ttl": "ag_mandate_ttl_seconds", "mnd_depth": "ag_delegation_depth",
    "mnd_chain": "len(ag_provenance_chain)::INTEGER", "mnd_content": "len(ag_ingested_content_ids)::INTEGER",
    "mnd_chain_z": "round((len(ag_provenance_chain) - cm) / cs, 6)", "mnd_tools_z": "round((ag_tool_call_count - tm) / tsd, 6)",
    "mnd_presence_mismatch": "CASE WHEN ag_human_present THEN round(greatest(0.0, 1 - coalesce(ag_cursor_entropy, 0)), 9) END::DOUBLE",
    "mnd_dwell_per_tool": "CASE WHEN ag_tool_call_count > 0 THEN round(ag_dwell_time_ms / ag_tool_call_count, 9) END",
    "mnd_deliberation_z": "round((ln(ag_deliberation_latency_ms) - (intercept + slope * ln(1 + amount))) / sigma, 6)",
}


@query(
    "mandate_block",
    f"""{FL}, a AS (SELECT avg(ag_tool_call_count) AS tm, stddev_pop(ag_tool_call_count) AS tsd, avg(len(ag_provenance_chain)) AS cm, stddev_pop(len(ag_provenance_chain)) AS cs FROM flat WHERE ag_agent_id IS NOT NULL),
    f AS (SELECT regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM (SELECT ln(ag_deliberation_latency_ms) AS y, ln(1 + amount) AS x FROM flat WHERE ag_deliberation_latency_ms > 0)),
    s AS (SELECT slope, intercept, stddev_pop(ln(ag_deliberation_latency_ms) - (intercept + slope * ln(1 + amount))) AS sigma FROM flat, f WHERE ag_deliberation_latency_ms > 0 GROUP BY ALL),
    g AS (SELECT *, epoch_us(ts) // 1000000 - epoch_us(ag_mandate_issued_ts) // 1000000 AS age FROM flat, a, s)
    SELECT event_id AS seq, {", ".join(f"CASE WHEN ag_agent_id IS NOT NULL THEN {x} END AS {n}" for n, x in MND_SQL.items())} FROM g""",
)
def mandate_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flat_events(spark, sf_dir)
    block = experiment.mandate_block(flat, flat)
    places = {"mnd_chain_z": 6, "mnd_tools_z": 6, "mnd_deliberation_z": 6, "mnd_amount_vs_ceiling": 9, "mnd_mandate_age_share": 9, "mnd_presence_mismatch": 9, "mnd_dwell_per_tool": 9}
    return block.select("seq", *[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in MND_SQL])
