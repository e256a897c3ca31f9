"""Registered queries of the population index and the probes, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import index, probe
from corvane.plans.contract_queries import FL
from corvane.plans.queries import EV, query
from corvane.plans.session import read
from corvane.sources.contract import flat_events
from corvane.sources.lenses import auth_events


@query(
    "customer_index",
    f"""{FL} SELECT customer_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n, round(quantile_cont(amount, 0.5), 6) AS p50, round(quantile_cont(amount, 0.99), 6) AS p99, max(amount) AS most,
    round(avg((ag_agent_id IS NOT NULL)::INTEGER), 9) AS agentic_share FROM flat GROUP BY customer_id""",
)
def customer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.customer_index(flat_events(spark, sf_dir)).withColumns({"p50": F.round("p50", 6), "p99": F.round("p99", 6), "agentic_share": F.round("agentic_share", 9)})


@query(
    "merchant_index",
    f"""{FL} SELECT merchant_id, arg_min(mcc, (ts, event_id)) AS mcc, arg_min(merchant_country, (ts, event_id)) AS country, count(*) AS n, quantile_cont(lat, 0.5) AS lat, quantile_cont(lon, 0.5) AS lon,
    round(quantile_cont(amount, 0.5), 6) AS amount FROM flat GROUP BY merchant_id""",
)
def merchant_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.merchant_index(flat_events(spark, sf_dir)).withColumn("amount", F.round("amount", 6))


@query("hour_shares", f"{FL} SELECT hour(ts)::INTEGER AS hour, count(*)::DOUBLE / (SELECT count(*) FROM flat) AS share FROM flat GROUP BY 1")
def hour_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.hour_shares(flat_events(spark, sf_dir))


@query("channel_lags", f"{FL} SELECT channel, quantile_cont(settlement_lag_hours, 0.5) AS lag FROM flat GROUP BY channel")
def channel_lags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.channel_lags(flat_events(spark, sf_dir))


@query("amount_bands", f"""{FL} SELECT mcc, band::DOUBLE AS band, round(quantile_cont(amount, [0.05, 0.25, 0.5, 0.75, 0.95])[i], 6) AS amount FROM flat, (VALUES (1, 0.05), (2, 0.25), (3, 0.5), (4, 0.75), (5, 0.95)) b(i, band) GROUP BY mcc, i, band""")
def amount_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.amount_bands(flat_events(spark, sf_dir)).withColumn("amount", F.round("amount", 6))


@query("within_amount_band", f"""{FL}, q AS (SELECT mcc, quantile_cont(amount, 0.25) AS low, quantile_cont(amount, 0.75) AS high FROM flat GROUP BY mcc) SELECT event_id, mcc, amount FROM flat JOIN q USING (mcc) WHERE amount BETWEEN low AND high""")
def within_amount_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.within_band(flat_events(spark, sf_dir), 0.25, 0.75).select("event_id", "mcc", "amount")


@query(
    "calibration_report",
    f"""{FL} SELECT metric, round(value, 6) AS value FROM (
      SELECT unnest(['amount_p01', 'amount_p25', 'amount_p50', 'amount_p75', 'amount_p99']) AS metric, unnest(quantile_cont(amount, [0.01, 0.25, 0.5, 0.75, 0.99])) AS value FROM flat
      UNION ALL SELECT 'share_' || channel, count(*)::DOUBLE / (SELECT count(*) FROM flat) FROM flat GROUP BY channel
      UNION ALL SELECT unnest(['distinct_customer_id', 'distinct_merchant_id', 'distinct_device_id', 'distinct_card_bin']), unnest([count(DISTINCT customer_id), count(DISTINCT merchant_id), count(DISTINCT device_id), count(DISTINCT card_bin)])::DOUBLE FROM flat
      UNION ALL SELECT unnest(['missing_device_id', 'missing_ip', 'missing_lat', 'missing_terminal_id']), unnest([avg((device_id IS NULL)::INTEGER), avg((ip IS NULL)::INTEGER), avg((lat IS NULL)::INTEGER), avg((terminal_id IS NULL)::INTEGER)]) FROM flat)""",
)
def calibration_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.calibration(flat_events(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "fitted_amounts",
    f"""{FL} SELECT mcc, count(*) AS n, round(avg(ln(amount)), 6) AS log_mean, round(stddev_pop(ln(amount)), 6) AS log_std, round(avg(amount) * avg(amount) / var_pop(amount), 6) AS gamma_shape
    FROM flat WHERE amount > 0 GROUP BY mcc HAVING count(*) >= 10""",
)
def fitted_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.fit_amounts(flat_events(spark, sf_dir), 10).withColumns({c: F.round(c, 6) for c in ("log_mean", "log_std", "gamma_shape")})


@query(
    "burst_share",
    f"""{FL}, g AS (SELECT epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS gap FROM flat) SELECT count(gap) AS gaps, (count(*) FILTER (gap <= 86400000000))::DOUBLE / count(gap) AS burst_share FROM g""",
)
def burst_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.burst_share(flat_events(spark, sf_dir), 86_400_000_000)


@query(
    "entity_caps",
    f"""{FL} {" UNION ALL ".join(f"SELECT '{v} per {k}' AS measure, max(n) AS most FROM (SELECT count(DISTINCT {v}) AS n FROM flat WHERE {k} IS NOT NULL GROUP BY {k})" for k, v in (("customer_id", "card_bin"), ("customer_id", "device_id"), ("customer_id", "merchant_id"), ("ag_agent_id", "customer_id")))}""",
)
def entity_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.entity_caps(flat_events(spark, sf_dir))


@query("class_balance", f"{FL} SELECT card_bin AS seed, count(*) AS n, count(*) FILTER (is_fraud) AS attacks, round(avg(is_fraud::INTEGER), 9) AS share FROM flat GROUP BY card_bin")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.class_balance(flat_events(spark, sf_dir).withColumn("seed", F.col("card_bin"))).withColumn("share", F.round("share", 9))


@query(
    "home_distance",
    f"""{FL}, h AS (SELECT customer_id, quantile_cont(lat, 0.5) AS lat0, quantile_cont(lon, 0.5) AS lon0 FROM flat WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY customer_id)
    SELECT event_id, round(6371 * sqrt((radians(lon - lon0) * cos(radians((lat + lat0) / 2))) ** 2 + radians(lat - lat0) ** 2), 6) AS km FROM flat JOIN h USING (customer_id) WHERE lat IS NOT NULL AND lon IS NOT NULL""",
)
def home_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.home_distance(flat_events(spark, sf_dir)).withColumn("km", F.round("km", 6))


@query("entity_weights", f"{FL} SELECT device_id, count(*) AS n FROM flat WHERE device_id IS NOT NULL GROUP BY device_id")
def entity_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.entity_weights(flat_events(spark, sf_dir), "device_id")


@query("least_active", f"{FL} SELECT customer_id, count(*) AS n FROM flat GROUP BY customer_id ORDER BY n, customer_id LIMIT 25")
def least_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.least_active(flat_events(spark, sf_dir), 25)


@query(
    "popularity_slice",
    f"""{FL}, r AS (SELECT merchant_id, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, merchant_id) - 1 AS place, count(*) OVER () AS total FROM flat GROUP BY merchant_id)
    SELECT merchant_id, n, place FROM r WHERE place::DOUBLE / total >= 0.05 AND place::DOUBLE / total < 0.95""",
)
def popularity_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.popularity_slice(flat_events(spark, sf_dir), 0.05, 0.95)


@query(
    "planted_artifacts",
    f"""{FL}, a AS (SELECT 'sha256:' || event_id AS content_id, event_type AS kind FROM events WHERE value > 20), u AS (SELECT is_fraud, unnest(ag_ingested_content_ids) AS content_id FROM flat)
    SELECT kind, count(*) FILTER (is_fraud) AS in_attacks, count(*) FILTER (NOT is_fraud) AS elsewhere, count(DISTINCT content_id) AS artifacts FROM u JOIN a USING (content_id) GROUP BY kind""",
)
def planted_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    artifacts = read(spark, sf_dir, "events").where("value > 20").select(F.concat(F.lit("sha256:"), F.col("event_id")).alias("content_id"), F.col("event_type").alias("kind"))
    return index.planted(flat_events(spark, sf_dir), artifacts)


@query("wire_truth", f"{FL} SELECT event_id, is_fraud, attack_id, attack_campaign FROM flat")
def wire_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.on_the_wire(flat_events(spark, sf_dir), ["is_fraud", "attack_id", "attack_campaign"])[1]


@query(
    "hex_ids",
    """WITH s AS (SELECT ('0x' || substr(sha256('d/start'), 1, 8))::BIGINT AS a, ('0x' || substr(sha256('d/stride'), 1, 8))::BIGINT AS b)
    SELECT event_id, lpad(lower(to_hex((a + (CASE WHEN b % 2 = 0 THEN b + 1 ELSE b END % 16777216) * (event_id % 16777216)) % 16777216)), 6, '0') AS hex_id FROM events, s""",
)
def hex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.hex_ids(read(spark, sf_dir, "events").select("event_id"), "event_id", 6, "d")


@query(
    "weighted_sample",
    f"""{EV} SELECT seq, cents FROM ev WHERE cents > 0 ORDER BY -ln((('0x' || substr(sha256('w:' || seq), 1, 8))::BIGINT + 0.5) / 4294967296.0) / cents, seq LIMIT 200""",
)
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.weighted_sample(auth_events(spark, sf_dir).select("seq", "cents"), 200, "cents", "seq", "w")


@query(
    "corpus_plan",
    """SELECT subject, kind, v::INTEGER AS variant, subject || ' (' || kind || ' v' || v || ')' AS title FROM (VALUES ('bank'), ('post'), ('shop')) s(subject), (VALUES ('page', 3), ('note', 2)) k(kind, n), range(1, 4) r(v) WHERE v <= n""",
)
def corpus_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.corpus_plan(spark.range(1), ["bank", "post", "shop"], {"page": 3, "note": 2})


@query(
    "late_rows",
    f"""{EV}, a AS (SELECT seq, t + (merchant - 50) * 60000000 AS t FROM ev), m AS (SELECT seq, t, max(t) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM a) SELECT seq, t, top - t AS late_by FROM m WHERE top > t""",
)
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = auth_events(spark, sf_dir).select("seq", (F.col("t") + (F.col("merchant") - 50) * 60_000_000).alias("t"))
    return index.late_rows(events, "seq", "t", 500)


# --- probes -----------------------------------------------------------------

NUMBERS, FLAGS, CATEGORIES = ["amount", "settlement_lag_hours", "ag_tool_call_count"], ["settled", "ag_consent_sig_valid"], ["channel", "merchant_country"]
PROBED = ["amount", "settlement_lag_hours", "settlement_lag_hours_null", "ag_tool_call_count", "settled", "ag_consent_sig_valid", "channel=agentic", "merchant_country=IN"]


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.probe_matrix(flat_events(spark, sf_dir), "event_id", F.col("is_fraud"), NUMBERS, FLAGS, CATEGORIES)


MATRIX_SQL = f"""{FL}, m AS (SELECT event_id, is_fraud AS y, coalesce(amount, -1) AS amount, (amount IS NULL)::INTEGER::DOUBLE AS amount_null, coalesce(settlement_lag_hours, -1) AS settlement_lag_hours, (settlement_lag_hours IS NULL)::INTEGER::DOUBLE AS settlement_lag_hours_null,
  coalesce(ag_tool_call_count, -1)::DOUBLE AS ag_tool_call_count, (ag_tool_call_count IS NULL)::INTEGER::DOUBLE AS ag_tool_call_count_null, coalesce(settled::INTEGER, -1)::DOUBLE AS settled, coalesce(ag_consent_sig_valid::INTEGER, -1)::DOUBLE AS ag_consent_sig_valid,
  {", ".join(f"(channel = '{v}')::INTEGER::DOUBLE AS 'channel={v}'" for v in ("agentic", "card_present", "ecom", "transfer", "upi"))}, {", ".join(f"(merchant_country = '{v}')::INTEGER::DOUBLE AS 'merchant_country={v}'" for v in ("IN", "SG", "US"))} FROM flat)"""


@query("probe_matrix", f"{MATRIX_SQL} SELECT * FROM m")
def probe_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir)


def _auc_sql(columns: list[str], source: str = "m", y: str = "y") -> str:
    """Ranks and running shares of long rows: (col, auc, gap)."""
    long = " UNION ALL ".join(f"""SELECT '{c}' AS col, "{c}"::DOUBLE AS v, {y} AS y FROM {source} WHERE "{c}" IS NOT NULL""" for c in columns)
    return f"""l AS ({long}), g AS (SELECT col, v, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM l GROUP BY col, v),
    w AS (SELECT col, pos, neg, sum(pos) OVER o AS tp, sum(neg) OVER o AS fp, sum(pos) OVER (PARTITION BY col) AS p, sum(neg) OVER (PARTITION BY col) AS n FROM g WINDOW o AS (PARTITION BY col ORDER BY v)),
    s AS (SELECT col, sum(pos * (2 * (fp - neg) + neg))::DOUBLE / 2 / (max(p) * max(n)) AS auc, max(abs(tp::DOUBLE / p - fp::DOUBLE / n)) AS gap FROM w GROUP BY col)"""


@query(
    "separability_gate",
    f"""{MATRIX_SQL}, {_auc_sql(PROBED)} SELECT col AS 'column', greatest(round(greatest(auc, 1 - auc), 9), round(0.5 + gap / 2, 9)) AS score, CASE WHEN auc >= 0.5 THEN 'up' ELSE 'down' END AS direction, greatest(auc, 1 - auc, 0.5 + gap / 2) < 0.52 AS passed FROM s""",
)
def separability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.gate(_matrix(spark, sf_dir), PROBED, 0.52)


SLICES = {"agentic": "channel=agentic", "home": "merchant_country=IN", "abroad": "merchant_country=SG"}


def _slice_sql(name: str, column: str) -> str:
    return f"""SELECT '{name}' AS slice, (SELECT count(*) FROM m WHERE "{column}" = 1) AS n, * FROM (WITH x AS (SELECT * FROM m WHERE "{column}" = 1), {_auc_sql(["amount", "settlement_lag_hours"], "x")} SELECT col, greatest(round(greatest(auc, 1 - auc), 9), round(0.5 + gap / 2, 9)) AS score FROM s)"""


@query("gate_slices", f"""{MATRIX_SQL} SELECT slice, n, n < 500 AS thin, col AS 'column', score, CASE WHEN n >= 500 THEN score < 0.95 END AS passed FROM ({" UNION ALL ".join(_slice_sql(k, v) for k, v in SLICES.items())})""")
def gate_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.gate_slices(_matrix(spark, sf_dir), ["amount", "settlement_lag_hours"], {k: F.col(f"`{v}`") == 1 for k, v in SLICES.items()}, 500)


LEAKS = ["ag_agent_id", "device_id", "ip", "lat", "original_event_id", "attack_campaign"]


@query(
    "null_leaks",
    f"""{FL} {" UNION ALL ".join(f"SELECT '{c}' AS 'column', round(0.5 + abs((count(*) FILTER (is_fraud AND {c} IS NULL))::DOUBLE / count(*) FILTER (is_fraud) - (count(*) FILTER (NOT is_fraud AND {c} IS NULL))::DOUBLE / count(*) FILTER (NOT is_fraud)) / 2, 9) AS auc FROM flat" for c in LEAKS)}""",
)
def null_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.null_leaks(flat_events(spark, sf_dir), F.col("is_fraud"), LEAKS).withColumn("auc", F.round("auc", 9))


@query(
    "length_leaks",
    f"""{FL}, m AS (SELECT is_fraud AS y, len(ag_provenance_chain) AS chain, len(ag_scope_categories) AS scope FROM flat), {_auc_sql(["chain", "scope"])} SELECT col AS 'column', round(greatest(auc, 1 - auc), 9) AS rank_auc FROM s""",
)
def length_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def length(c: str) -> F.Column:
        return F.when(F.col(c).isNotNull(), F.size(c))

    rows = flat_events(spark, sf_dir).select(F.col("is_fraud").alias("y"), length("ag_provenance_chain").alias("chain"), length("ag_scope_categories").alias("scope"))
    return probe.separability(rows, ["chain", "scope"]).select("column", "rank_auc")


@query(
    "target_leaks",
    f"""{FL}, b AS (SELECT card_bin, channel, is_fraud AS y, ('0x' || substr(md5(event_id), 1, 8))::BIGINT % 2 AS half FROM flat), o AS (SELECT 1 - half AS half, avg(y::INTEGER) AS whole FROM b GROUP BY half),
    r1 AS (SELECT 1 - half AS half, card_bin, avg(y::INTEGER) AS rate FROM b GROUP BY ALL), r2 AS (SELECT 1 - half AS half, channel, avg(y::INTEGER) AS rate FROM b GROUP BY ALL),
    m AS (SELECT y, coalesce(r1.rate, whole) AS card_bin, coalesce(r2.rate, whole) AS channel FROM b JOIN o USING (half) LEFT JOIN r1 ON r1.half = b.half AND r1.card_bin = b.card_bin LEFT JOIN r2 ON r2.half = b.half AND r2.channel = b.channel),
    {_auc_sql(["card_bin", "channel"])} SELECT col AS 'column', round(greatest(auc, 1 - auc), 9) AS auc FROM s""",
)
def target_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.target_leaks(flat_events(spark, sf_dir), "event_id", F.col("is_fraud"), ["card_bin", "channel"])


POWER = [("amount", "F1-01"), ("settlement_lag_hours", "F2-02")]


def _power_sql(feature: str, attack: str) -> str:
    return f"""SELECT '{feature}' AS feature, '{attack}' AS attack, max(a) FILTER (k = 1) AS against_all, max(a) FILTER (k = 2) AS against_target FROM (
      SELECT k, round(greatest(auc, 1 - auc), 9) AS a FROM (WITH q AS (SELECT is_fraud AS y, attack_id, coalesce({feature}, (SELECT quantile_cont({feature}, 0.5) FROM flat)) AS x FROM flat), z AS (SELECT 1 AS k, y, x FROM q UNION ALL SELECT 2, y, x FROM q WHERE NOT y OR attack_id = '{attack}'),
      g AS (SELECT k, x, count(*) FILTER (y) AS pos, count(*) FILTER (NOT y) AS neg FROM z GROUP BY k, x), w AS (SELECT k, pos, neg, sum(neg) OVER (PARTITION BY k ORDER BY x) AS fp FROM g) SELECT k, sum(pos * (2 * (fp - neg) + neg))::DOUBLE / 2 / (sum(pos) * sum(neg)) AS auc FROM w GROUP BY k))"""


@query("power_table", f"{FL} {' UNION ALL '.join(_power_sql(*p) for p in POWER)}")
def power_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = flat_events(spark, sf_dir).withColumn("y", F.col("is_fraud"))
    return probe.power(flat, "attack_id", POWER)
