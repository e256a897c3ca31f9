"""The registered queries of the event operators, each with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane import schema
from corvane.functions import scalars
from corvane.generators import population, scenarios
from corvane.operators import baselines, distances, graph, lookups, metrics, models, policy, rules, sequences, text, velocity
from corvane.operators.ordered import average_rank, numbered, quantiles
from corvane.plans.session import checkpointed, read
from corvane.sources.lenses import DAY, EVENTS_SQL, HOUR, ITEMS_SQL, SESSIONS_SQL, auth_events, auth_items, auth_sessions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
EV, IT = f"WITH {EVENTS_SQL}", f"WITH {ITEMS_SQL}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# --- velocity -------------------------------------------------------------


def _velocity(key: str) -> None:
    QUERIES[f"velocity_{key}"] = lambda s, d: velocity.velocity(auth_events(s, d), velocity.KEYS[key])
    SQL[f"velocity_{key}"] = velocity.velocity_sql(EVENTS_SQL, "ev", velocity.KEYS[key])


for _key in velocity.KEYS:
    _velocity(_key)


def _block_sql() -> str:
    one = {n: velocity.velocity_sql("x AS (SELECT 1)", "ev", k).split("SELECT 1)", 1)[1] for n, k in velocity.KEYS.items()}
    parts = ", ".join(f"v_{n} AS ({sql})" for n, sql in one.items())
    columns = ", ".join(f"v_{n}.{f} AS vel_{n}_{f}" for n in one for f in velocity.feature_names())
    return f"{EV}, {parts} SELECT ev.seq, {columns} FROM ev {' '.join(f'JOIN v_{n} USING (seq)' for n in one)}"


@query("velocity_block", _block_sql())
def velocity_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return velocity.velocity_block(auth_events(spark, sf_dir))


@query(
    "l0_amount_decisions",
    f"""{EV}, v AS (SELECT e.seq, e.cents, count(p.seq) FILTER (p.t >= e.t - {HOUR}) AS c1, count(p.seq) AS life FROM ev e LEFT JOIN ev p ON p.customer = e.customer AND (p.t < e.t OR p.t = e.t AND p.seq < e.seq) GROUP BY e.seq, e.cents)
    SELECT CASE WHEN cents > 10000 THEN 'amount_over_cap' WHEN c1 >= 2 THEN 'velocity' ELSE 'pass' END AS reason, count(*) AS n, sum(cents)::BIGINT AS cents, count(*) FILTER (life = 0) AS first_seen FROM v GROUP BY 1""",
)
def l0_amount_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = auth_events(spark, sf_dir)
    v = velocity.velocity(events, ["customer"]).join(events.select("seq", "cents"), "seq")
    reason = F.when(F.col("cents") > 10_000, "amount_over_cap").when(F.col("count_1h") >= 2, "velocity").otherwise("pass")
    return v.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.count_if(F.col("lifetime_count").isNull()).alias("first_seen"))


# --- scalar expressions ---------------------------------------------------


@query(
    "txn_calendar",
    f"""{EV} SELECT seq, hour(ts)::INTEGER AS hour, ((dayofweek(ts) + 6) % 7)::INTEGER AS dow, (dayofweek(ts) IN (0, 6))::INTEGER AS is_weekend, (hour(ts) BETWEEN 1 AND 5)::INTEGER AS is_night FROM (SELECT seq, make_timestamp(t) AS ts FROM ev)""",
)
def txn_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_events(spark, sf_dir).select("seq", *[v.alias(k) for k, v in scalars.calendar(F.col("t")).items()])


@query(
    "txn_round_score",
    f"""{IT} SELECT seq, ((cents % 100 = 0)::INTEGER + (cents % 10000 = 0)::INTEGER + (cents % 100000 = 0)::INTEGER) AS round_score, round(ln(1 + amount), 9) AS log_amount FROM it""",
)
def txn_round_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return auth_items(spark, sf_dir).select("seq", scalars.round_score(F.col("amount")).alias("round_score"), F.round(scalars.log_amount(F.col("amount")), 9).alias("log_amount"))


@query("null_pattern", f"{IT} SELECT customer IS NULL AS no_customer, bin IS NULL AS no_bin, lag IS NULL AS no_lag, txn_type, count(*) AS n FROM it GROUP BY 1, 2, 3, 4")
def null_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return auth_items(spark, sf_dir).groupBy(c("customer").isNull().alias("no_customer"), c("bin").isNull().alias("no_bin"), c("lag").isNull().alias("no_lag"), "txn_type").agg(F.count("*").alias("n"))


@query(
    "array_scope_membership",
    f"""{IT}, s AS (SELECT customer, list(DISTINCT mcc) AS scope FROM it WHERE customer % 3 <> 0 AND seq % 5 = 0 GROUP BY customer)
    SELECT seq, CASE WHEN scope IS NULL THEN NULL WHEN customer % 7 = 0 THEN 1 WHEN list_contains(scope, mcc) THEN 1 ELSE 0 END::INTEGER AS in_scope, CASE WHEN scope IS NULL THEN NULL WHEN customer % 7 = 0 THEN 0 ELSE len(scope) END::INTEGER AS scope_size
    FROM it LEFT JOIN s USING (customer)""",
)
def array_scope_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = auth_items(spark, sf_dir)
    scopes = items.where("customer % 3 <> 0 and seq % 5 = 0").groupBy("customer").agg(F.collect_set("mcc").alias("scope"))  # at most the number of categories
    scope = F.when(F.col("scope").isNotNull() & (F.col("customer") % 7 == 0), F.array().cast("array<string>")).otherwise(F.col("scope"))
    return items.join(scopes, "customer", "left").select("seq", scalars.in_scope(scope, F.col("mcc")).alias("in_scope"), scalars.length(scope).alias("scope_size"))


@query(
    "content_ids",
    """SELECT page_id, 'sha256:' || substr(sha256(url), 1, 12) AS content_id, ('0x' || substr(sha256(url), 1, 8))::BIGINT AS seed, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages""",
)
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return read(spark, sf_dir, "pages").select("page_id", scalars.content_id(url).alias("content_id"), scalars.seed32(url).alias("seed"), F.regexp_extract(url, "^[a-z]+://([^/?#:]+)", 1).alias("host"))


@query(
    "risk_dial",
    f"""{IT} SELECT seq, round(CASE WHEN amount <= 1000 THEN 0 WHEN amount <= 20000 THEN (amount - 1000) * (30.0 / 19000) WHEN amount <= 50000 THEN 30 + (amount - 20000) * (40.0 / 30000) WHEN amount <= 90000 THEN 70 + (amount - 50000) * (30.0 / 40000) ELSE 100 END, 8) AS risk FROM it""",
)
def risk_dial(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = [(1000.0, 0.0), (20_000.0, 30.0), (50_000.0, 70.0), (90_000.0, 100.0)]
    return auth_items(spark, sf_dir).select("seq", F.round(scalars.piecewise(F.col("amount"), points), 8).alias("risk"))


# --- baselines ------------------------------------------------------------


@query(
    "entity_profile_customer",
    f"""{IT} SELECT customer, n, CASE WHEN n >= 5 THEN round(mean, 9) END AS mean, CASE WHEN n >= 5 THEN round(std, 6) END AS std, CASE WHEN n >= 5 THEN round(p99, 6) END AS p99, CASE WHEN n >= 5 THEN ob END AS outbound_share
    FROM (SELECT customer, count(*) AS n, avg(ln(1 + amount)) AS mean, stddev_samp(ln(1 + amount)) AS std, quantile_cont(amount, 0.99) AS p99, (count(*) FILTER (txn_type = 'refund'))::DOUBLE / count(*) AS ob FROM it WHERE customer IS NOT NULL GROUP BY customer)""",
)
def entity_profile_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = baselines.customer_profile(auth_items(spark, sf_dir))
    return p.select("customer", "n", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), F.round("p99", 6).alias("p99"), "outbound_share")


@query(
    "entity_profile_merchant",
    f"""{IT} SELECT merchant, count(*) AS n, round(avg(ln(1 + amount)), 9) AS mean, round(stddev_samp(ln(1 + amount)), 6) AS std, (count(*) FILTER (txn_type = 'refund'))::DOUBLE / count(*) AS outbound_share,
      (count(*) FILTER (declined))::DOUBLE / count(*) AS decline_share, count(DISTINCT customer) AS customers, sum(lag) FILTER (settled)::DOUBLE / count(lag) FILTER (settled) AS mean_lag FROM it WHERE merchant IS NOT NULL GROUP BY merchant HAVING count(*) >= 5""",
)
def entity_profile_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = baselines.merchant_profile(auth_items(spark, sf_dir)).where("n >= 5")
    return p.select("merchant", "n", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), "outbound_share", "decline_share", "customers", "mean_lag")


@query(
    "entity_profile_small",
    f"""{IT} SELECT 'bin' AS kind, bin::VARCHAR AS entity, (count(*) FILTER (declined))::DOUBLE / count(*) AS value FROM it WHERE bin IS NOT NULL GROUP BY bin
    UNION ALL SELECT 'mcc', mcc, round(avg(ln(1 + amount)), 9) FROM it WHERE mcc IS NOT NULL GROUP BY mcc UNION ALL SELECT 'channel', channel, quantile_cont(lag, 0.5)::DOUBLE FROM it WHERE channel IS NOT NULL GROUP BY channel""",
)
def entity_profile_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each profile by the tables that it needs.
    by_bin, by_mcc, by_channel = (auth_items(spark, sf_dir, c) for c in (["bin", "declined"], ["mcc", "amount"], ["channel", "lag"]))
    a = baselines.bin_profile(by_bin).select(F.lit("bin").alias("kind"), F.col("bin").cast("string").alias("entity"), F.col("decline_share").alias("value"))
    b = baselines.mcc_profile(by_mcc).select(F.lit("mcc").alias("kind"), F.col("mcc").alias("entity"), F.round("mean", 9).alias("value"))
    return a.unionByName(b).unionByName(baselines.channel_profile(by_channel).select(F.lit("channel").alias("kind"), F.col("channel").alias("entity"), F.col("median_lag").alias("value")))


@query(
    "entity_z_scores",
    f"""{IT}, tr AS (SELECT * FROM it WHERE seq % 10 < 7), c AS (SELECT customer, count(*) AS n, avg(ln(1 + amount)) AS m, stddev_samp(ln(1 + amount)) AS s FROM tr WHERE customer IS NOT NULL GROUP BY customer),
    k AS (SELECT merchant, count(*) AS n, avg(ln(1 + amount)) AS m, stddev_samp(ln(1 + amount)) AS s FROM tr WHERE merchant IS NOT NULL GROUP BY merchant)
    SELECT seq, round(CASE WHEN c.n >= 5 AND c.s > 0 THEN (ln(1 + amount) - c.m) / c.s END, 6) AS customer_z, round(CASE WHEN k.n >= 5 AND k.s > 0 THEN (ln(1 + amount) - k.m) / k.s END, 6) AS merchant_z,
      (c.n IS NULL)::INTEGER AS customer_unseen, (k.n IS NULL)::INTEGER AS merchant_unseen FROM it LEFT JOIN c USING (customer) LEFT JOIN k USING (merchant)""",
)
def entity_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = auth_items(spark, sf_dir, ["seq", "customer", "merchant", "amount"])
    f = baselines.entity_features(items, items.where("seq % 10 < 7"), ["customer_z", "merchant_z", "customer_unseen", "merchant_unseen"])
    return f.select("seq", F.round("customer_z", 6).alias("customer_z"), F.round("merchant_z", 6).alias("merchant_z"), "customer_unseen", "merchant_unseen")


@query(
    "ols_residual_z",
    f"""{IT}, f AS (SELECT count(*) AS n, regr_slope(ln(lag), ln(1 + amount)) AS b, regr_intercept(ln(lag), ln(1 + amount)) AS a FROM it WHERE lag > 0),
    s AS (SELECT stddev_pop(ln(lag) - a - b * ln(1 + amount)) AS sg FROM it, f WHERE lag > 0)
    SELECT seq, round((ln(lag) - a - b * ln(1 + amount)) / sg, 5) AS residual_z FROM it, f, s WHERE lag > 0""",
)
def ols_residual_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = auth_items(spark, sf_dir, ["seq", "lag", "amount"])
    fit = baselines.latency_line(items, "lag", "amount").first()
    z = scalars.deliberation_residual(F.col("lag"), F.col("amount"), fit["intercept"], fit["slope"], fit["sigma"])
    return items.where("lag > 0").select("seq", F.round(z, 5).alias("residual_z"))


@query(
    "entity_vectors",
    f"""{EV}, h AS (SELECT customer, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS hour_entropy FROM (SELECT customer, t // {HOUR} % 24, count(*) AS n FROM ev GROUP BY 1, 2) GROUP BY customer),
    p AS (SELECT customer, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS partner_entropy FROM (SELECT customer, merchant, count(*) AS n FROM ev WHERE merchant IS NOT NULL GROUP BY 1, 2) GROUP BY customer)
    SELECT customer, count(*) AS n, round(avg(amount), 9) AS mean, max(amount) AS max, sum(cents) / 100 AS sum, count(*) FILTER (declined) / count(*) AS decline_share, count(agent) / count(*) AS agentic_share, count(DISTINCT merchant) AS partners, count(DISTINCT device) AS devices,
      round((max(t) - min(t)) / 3.6e9::DOUBLE, 6) AS span_hours, round(any_value(hour_entropy), 6) AS hour_entropy, round(any_value(partner_entropy), 6) AS partner_entropy FROM ev JOIN h USING (customer) JOIN p USING (customer) GROUP BY customer""",
)
def entity_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = baselines.entity_vectors(auth_events(spark, sf_dir), "customer", "merchant")
    return v.select("customer", "n", F.round("mean", 9).alias("mean"), "max", "sum", "decline_share", "agentic_share", "partners", "devices", F.round("span_hours", 6).alias("span_hours"), F.round("hour_entropy", 6).alias("hour_entropy"), F.round("partner_entropy", 6).alias("partner_entropy"))


@query(
    "zipf_ols",
    f"""{EV}, n AS (SELECT merchant, count(*) AS n FROM ev GROUP BY merchant HAVING count(*) >= 5 ORDER BY n DESC, merchant LIMIT 2000), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, merchant) AS r FROM n)
    SELECT count(*) AS points, round(-regr_slope(ln(n), ln(r)), 9) AS exponent FROM r""",
)
def zipf_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.zipf_exponent(auth_events(spark, sf_dir), "merchant")


@query(
    "rollup_totals",
    f"""{IT} SELECT channel, grouping(channel)::INTEGER AS is_total, count(*) AS volume, sum(declined::INTEGER)::BIGINT AS marked, avg(declined::INTEGER) AS prevalence,
      round(avg(declined::INTEGER) / (SELECT avg(declined::INTEGER) FROM it), 9) AS lift FROM it GROUP BY ROLLUP (channel)""",
)
def rollup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = baselines.summary_with_total(auth_items(spark, sf_dir), "channel", F.col("declined"))
    return s.withColumn("is_total", F.col("is_total").cast("int"))


# --- graph ----------------------------------------------------------------


@query("graph_degree_capped")
def graph_degree_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.capped_degrees(auth_events(spark, sf_dir))


SQL["graph_degree_capped"] = (
    f"{EV}, "
    + ", ".join(f"f{i} AS (SELECT seq, row_number() OVER (PARTITION BY {k}, {v} ORDER BY t, seq) = 1 AND {k} IS NOT NULL AND {v} IS NOT NULL AS f FROM ev)" for i, (k, v) in enumerate(graph.DEGREES.values()))
    + " SELECT seq, "
    + ", ".join(f"CASE WHEN {k} IS NOT NULL THEN least(256, coalesce(sum(f{i}.f::INTEGER) OVER (PARTITION BY {k} ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) END::BIGINT AS {n}" for i, (n, (k, _)) in enumerate(graph.DEGREES.items()))
    + " FROM ev "
    + " ".join(f"JOIN f{i} USING (seq)" for i in range(len(graph.DEGREES)))
)


def _sliding_sql(key: str, value: str, width: int, name: str) -> str:
    return f"""{EV} SELECT e.seq, count(DISTINCT p.{value})::BIGINT AS {name} FROM ev e LEFT JOIN ev p ON p.{key} = e.{key} AND (p.t < e.t OR p.t = e.t AND p.seq < e.seq) AND p.t >= e.t - {width} WHERE e.{key} IS NOT NULL GROUP BY e.seq"""


def _sliding(query_name: str, key: str, value: str, width: int, name: str) -> None:
    QUERIES[query_name] = lambda s, d: graph.sliding_distinct(auth_events(s, d), key, value, width, name)
    SQL[query_name] = _sliding_sql(key, value, width, name)


_sliding("graph_fanin_24h", "merchant", "customer", DAY, "customers_24h")
_sliding("graph_fanin_7d", "merchant", "customer", 7 * DAY, "customers_7d")
_sliding("graph_bin_merchants_1h", "bin", "merchant", HOUR, "merchants_1h")
_sliding("graph_bin_merchants_24h", "bin", "merchant", DAY, "merchants_24h")
_sliding("graph_bin_burst", "bin", "customer", HOUR, "customers_1h")


@query(
    "graph_pair_prior",
    f"""{EV} SELECT e.seq, count(p.seq) AS pair_prior, (SELECT count(*) FROM ev q WHERE q.customer = e.customer AND (q.t < e.t OR q.t = e.t AND q.seq < e.seq)) AS customer_events FROM ev e LEFT JOIN ev p ON p.customer = e.customer AND p.merchant = e.merchant AND (p.t < e.t OR p.t = e.t AND p.seq < e.seq) GROUP BY e.seq, e.customer, e.t""",
)
def graph_pair_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = auth_events(spark, sf_dir)
    return graph.pair_prior(events).join(graph.customer_events(events), "seq")


@query(
    "graph_new_edge_share",
    f"""{EV}, x AS (SELECT seq, CASE WHEN customer IS NOT NULL AND device IS NOT NULL THEN (row_number() OVER (PARTITION BY customer, device ORDER BY t, seq) = 1)::INTEGER END AS a,
      CASE WHEN agent IS NOT NULL THEN (row_number() OVER (PARTITION BY customer, agent ORDER BY t, seq) = 1)::INTEGER END AS b, CASE WHEN device IS NOT NULL AND agent IS NOT NULL THEN (row_number() OVER (PARTITION BY device, agent ORDER BY t, seq) = 1)::INTEGER END AS c FROM ev)
    SELECT seq, (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))::DOUBLE / nullif((a IS NOT NULL)::INTEGER + (b IS NOT NULL)::INTEGER + (c IS NOT NULL)::INTEGER, 0) AS new_edge_share FROM x""",
)
def graph_new_edge_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.new_edge_share(auth_events(spark, sf_dir))


IDENTITY_SQL = """e AS (SELECT DISTINCT 'c:' || customer AS a, 'd:' || device AS b FROM ev WHERE device IS NOT NULL UNION SELECT DISTINCT 'c:' || customer, 'a:' || agent FROM ev WHERE agent IS NOT NULL
    UNION SELECT DISTINCT 'd:' || device, 'a:' || agent FROM ev WHERE device IS NOT NULL AND agent IS NOT NULL), g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    r AS (SELECT a AS node, a AS reach FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.reach = g.a)"""


@query("graph_components_final", f"WITH RECURSIVE {EVENTS_SQL}, {IDENTITY_SQL} SELECT node, min(reach) AS component FROM r GROUP BY node")
def graph_components_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.connected_components(graph.identity_edges(auth_events(spark, sf_dir)))


@query("graph_component_sizes", f"WITH RECURSIVE {EVENTS_SQL}, {IDENTITY_SQL} SELECT component, count(*) AS nodes FROM (SELECT node, min(reach) AS component FROM r GROUP BY node) GROUP BY component")
def graph_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_sizes(auth_events(spark, sf_dir))


def _states_sql(lens: str) -> str:
    """Union by rank edge by edge: ``reached(step, i, root)`` has every node's root after each first edge, ``x`` events with the steps before and after them."""
    edge = "SELECT {0} AS a, {1} AS b, min({{'t': t, 'seq': seq}}) AS f, {2} AS k FROM ev WHERE {0} IS NOT NULL AND {1} IS NOT NULL GROUP BY 1, 2".format
    c, d, g = "'c:' || customer", "'d:' || device", "'a:' || agent"
    return f"""WITH RECURSIVE {lens}, firsts AS ({edge(c, d, 0)} UNION ALL {edge(c, g, 1)} UNION ALL {edge(d, g, 2)}
    ), born AS (
      SELECT node, min(f) AS f FROM (SELECT unnest([{c}, {d}, {g}]) AS node, {{'t': t, 'seq': seq}} AS f FROM ev) WHERE node IS NOT NULL GROUP BY node
    ), nodes AS (
      SELECT node, f, row_number() OVER (ORDER BY node) AS i FROM born
    ), steps AS (
      SELECT row_number() OVER (ORDER BY firsts.f, k) AS step, x.i AS x, y.i AS y, firsts.f FROM firsts JOIN nodes x ON a = x.node JOIN nodes y ON b = y.node
    ), rec AS (
      SELECT 0::BIGINT AS step, list(i ORDER BY i) AS roots, list(0 ORDER BY i) AS ranks FROM nodes
      UNION ALL
      SELECT step, list_transform(roots, lambda v: CASE WHEN v = lost THEN kept ELSE v END), list_transform(ranks, lambda v, i: CASE WHEN i = kept AND even THEN v + 1 ELSE v END)
      FROM (SELECT s.step, roots, ranks, CASE WHEN ranks[roots[x]] < ranks[roots[y]] THEN roots[y] ELSE roots[x] END AS kept, CASE WHEN ranks[roots[x]] < ranks[roots[y]] THEN roots[x] ELSE roots[y] END AS lost,
              roots[x] <> roots[y] AND ranks[roots[x]] = ranks[roots[y]] AS even FROM rec r JOIN steps s ON s.step = r.step + 1)
    ), reached AS (
      SELECT step, unnest(roots) AS root, unnest(range(1, len(roots) + 1)) AS i FROM rec
    ), x AS (
      SELECT ev.*, nodes.i, nodes.f AS born, coalesce(sum(n) OVER (ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(sum(n) OVER (ORDER BY t, seq ROWS UNBOUNDED PRECEDING), 0) AS after
      FROM ev JOIN nodes ON nodes.node = {c} LEFT JOIN (SELECT f.seq AS edge_seq, count(*) AS n FROM steps GROUP BY 1) ON edge_seq = seq
    ), rooted AS (
      SELECT x.*, named.node AS root FROM x JOIN reached r ON r.step = x.after AND r.i = x.i JOIN nodes named ON named.i = r.root
    )"""


def _component_sql(lens: str) -> str:
    return f"""{_states_sql(lens)}, known AS (
      SELECT x.seq, x.t, o.i, n.node, n.f FROM x JOIN reached r ON r.step = x.before AND r.i = x.i JOIN reached o ON o.step = x.before AND o.root = r.root JOIN nodes n ON n.i = o.i
      WHERE x.born < {{'t': x.t, 'seq': x.seq}} AND n.f < {{'t': x.t, 'seq': x.seq}}
    ), sums AS (
      SELECT i, t, seq, count(*) OVER w AS n, sum(cents) OVER w AS cents, sum(declined::INTEGER) OVER w AS declined, sum((agent IS NOT NULL)::INTEGER) OVER w AS agentic FROM x WINDOW w AS (PARTITION BY i ORDER BY t, seq ROWS UNBOUNDED PRECEDING)
    ), placed AS (
      SELECT i, n, cents, declined, agentic, {{'t': t, 'seq': seq}} AS place FROM sums
    ), state AS (
      SELECT k.seq, count(*) AS nodes, count(*) FILTER (node LIKE 'c:%') AS customers, count(*) FILTER (node LIKE 'd:%') AS devices, sum(p.n) AS events, sum(p.cents) AS cents, sum(p.declined) AS declined, sum(p.agentic) AS agentic
      FROM (SELECT *, {{'t': t, 'seq': seq - 1}} AS latest FROM known) k ASOF LEFT JOIN placed p ON p.i = k.i AND p.place <= k.latest GROUP BY k.seq
    )
    SELECT seq, root, coalesce(nodes, 1)::BIGINT AS component_nodes, coalesce(customers, 1)::BIGINT AS component_customers, coalesce(devices, 0)::BIGINT AS component_devices, coalesce(events, 0)::BIGINT AS component_events,
      s.cents::DOUBLE / nullif(events, 0) / 100 AS component_amount_mean, s.declined::DOUBLE / nullif(events, 0) AS component_decline_ratio, agentic::DOUBLE / nullif(events, 0) AS component_agentic_share,
      nullif(events, 0)::DOUBLE / customers AS component_events_per_customer
    FROM rooted LEFT JOIN state s USING (seq)"""


def _fan_in_sql(lens: str) -> str:
    return f"""{_states_sql(lens)}, w AS (
      SELECT e.seq, count(DISTINCT p.customer) FILTER (p.t >= e.t - {DAY})::BIGINT AS customers_24h, count(DISTINCT p.customer)::BIGINT AS customers_7d, count(DISTINCT p.root)::BIGINT AS components_7d
      FROM rooted e LEFT JOIN rooted p ON p.merchant = e.merchant AND (p.t < e.t OR p.t = e.t AND p.seq < e.seq) AND p.t >= e.t - {7 * DAY} WHERE e.merchant IS NOT NULL GROUP BY e.seq
    )
    SELECT *, customers_7d::DOUBLE / nullif(components_7d, 0) AS fanin_per_component, customers_24h / nullif(customers_7d / 7.0::DOUBLE, 0) AS fanin_burst FROM w"""


def _components(prefix: str, lens, sql: str) -> None:
    QUERIES[f"{prefix}_component_state"] = lambda s, d: graph.component_features(lens(s, d))
    SQL[f"{prefix}_component_state"] = _component_sql(sql)

    def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = lens(spark, sf_dir)
        return graph.fan_in(events, graph.component_roots(events), DAY, 7 * DAY)

    QUERIES[f"{prefix}_fan_in"] = fan_in
    SQL[f"{prefix}_fan_in"] = _fan_in_sql(sql)


_components("graph", auth_events, EVENTS_SQL)
_components("session", auth_sessions, SESSIONS_SQL)


@query("session_component_sizes", f"WITH RECURSIVE {SESSIONS_SQL}, {IDENTITY_SQL} SELECT component, count(*) AS nodes FROM (SELECT node, min(reach) AS component FROM r GROUP BY node) GROUP BY component")
def session_component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.component_sizes(auth_sessions(spark, sf_dir))


# --- metrics --------------------------------------------------------------


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their amount as score, errors as frauds and campaigns of frauds by customer."""
    e = auth_events(spark, sf_dir)
    return e.select("seq", "t", F.col("amount").alias("score"), F.col("declined").alias("fraud"), F.when(F.col("declined"), F.concat(F.lit("C"), (F.col("customer") % 10).cast("string"))).alias("campaign"), "agent", "bin")


SC = f"{EV}, sc AS (SELECT seq, t, amount AS score, declined AS fraud, CASE WHEN declined THEN 'C' || (customer % 10) END AS campaign, agent, bin FROM ev)"


@query(
    "auc_roc_pr",
    f"""{SC}, d AS (SELECT score, count(*) FILTER (fraud) AS pos, count(*) FILTER (NOT fraud) AS neg FROM sc GROUP BY score), w AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d)
    SELECT max(p)::BIGINT AS positives, max(n)::BIGINT AS negatives, round(sum(neg * (tp - pos / 2.0::DOUBLE)) / (max(p) * max(n)), 9) AS roc_auc, round(sum(pos::DOUBLE / p * tp / (tp + fp)), 9) AS auc_pr FROM w""",
)
def auc_roc_pr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.areas(scored(spark, sf_dir))


@query(
    "recall_curve",
    f"""{SC}, r(rate) AS (VALUES (0.001::DOUBLE), (0.005::DOUBLE), (0.01::DOUBLE)), th AS (SELECT 0.001::DOUBLE AS rate, CASE WHEN count(*) < 1000 THEN 'inf'::DOUBLE ELSE quantile_cont(score, 0.999) END AS threshold FROM sc WHERE NOT fraud UNION ALL SELECT 0.005, CASE WHEN count(*) < 200 THEN 'inf'::DOUBLE ELSE quantile_cont(score, 0.995) END FROM sc WHERE NOT fraud UNION ALL SELECT 0.01, CASE WHEN count(*) < 100 THEN 'inf'::DOUBLE ELSE quantile_cont(score, 0.99) END FROM sc WHERE NOT fraud)
    SELECT rate, round(threshold, 6) AS threshold, (count(*) FILTER (fraud AND score >= threshold))::DOUBLE / count(*) FILTER (fraud) AS recall, (count(*) FILTER (NOT fraud AND score >= threshold))::DOUBLE / count(*) FILTER (NOT fraud) AS realised_fpr FROM sc, th GROUP BY rate, threshold""",
)
def recall_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_curve(scored(spark, sf_dir)).withColumn("threshold", F.round("threshold", 6))


@query(
    "recall_by_rail",
    f"""{SC} SELECT agent IS NOT NULL AS agentic, count(*) FILTER (fraud) AS frauds, (count(*) FILTER (fraud AND score >= 50))::DOUBLE / nullif(count(*) FILTER (fraud), 0) AS recall, (count(*) FILTER (NOT fraud AND score >= 50))::DOUBLE / nullif(count(*) FILTER (NOT fraud), 0) AS realised_fpr FROM sc GROUP BY 1""",
)
def recall_by_rail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recall_at(scored(spark, sf_dir).withColumn("agentic", F.col("agent").isNotNull()), 50.0, ["agentic"])


@query(
    "campaign_first_alert",
    f"""{SC}, x AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY t, seq) AS place, score >= 150 AS hit FROM sc WHERE fraud)
    SELECT campaign, count(*) AS size, bool_or(hit) AS caught, min(place) FILTER (hit) AS first_alert, CASE WHEN max(t) > min(t) THEN (min(t) FILTER (hit) - min(t))::DOUBLE / (max(t) - min(t)) WHEN bool_or(hit) THEN 0 END AS elapsed_share FROM x GROUP BY campaign""",
)
def campaign_first_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.campaigns(scored(spark, sf_dir), 150.0)


@query(
    "campaign_report",
    f"""{SC}, x AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY t, seq) AS place, score >= 150 AS hit FROM sc WHERE fraud),
    c AS (SELECT campaign, count(*) AS size, bool_or(hit) AS caught, min(place) FILTER (hit) AS fa, (min(t) FILTER (hit) - min(t))::DOUBLE / (max(t) - min(t)) AS el FROM x GROUP BY campaign)
    SELECT count(*) AS campaigns, count(*) FILTER (caught) AS caught, quantile_cont(fa, 0.5) AS median_first_alert, avg(fa) AS mean_first_alert, quantile_cont(size, 0.5) AS median_size, quantile_cont(el, 0.5) AS median_elapsed_share FROM c""",
)
def campaign_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.campaign_summary(metrics.campaigns(scored(spark, sf_dir), 150.0))


@query("legit_percentile", f"""{SC} SELECT e.seq, (SELECT count(*) FROM sc l WHERE NOT l.fraud AND l.score < e.score)::DOUBLE / (SELECT count(*) FROM sc WHERE NOT fraud) AS percentile FROM sc e""")
def legit_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return policy.legit_percentile(s, s.where(~F.col("fraud")), "score")


@query(
    "decision_policy",
    f"""{SC}, q AS (SELECT quantile_cont(score, 0.99) AS c, quantile_cont(score, 0.995) AS r, quantile_cont(score, 0.999) AS d FROM sc WHERE NOT fraud)
    SELECT CASE WHEN bin = 3 AND score > 100 OR score >= d THEN 'decline' WHEN score >= r THEN 'review' WHEN score >= c THEN CASE WHEN agent IS NULL THEN 'challenge' ELSE 'review' END ELSE 'approve' END AS decision, count(*) AS n FROM sc, q GROUP BY 1""",
)
def decision_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    t = policy.policy_thresholds(s.where(~F.col("fraud")))
    violation = (F.col("bin") == 3) & (F.col("score") > 100)
    return policy.tallies(s.withColumn("decision", policy.decide(F.col("score"), t, violation, F.col("agent").isNull())))


@query("time_split", f"""{EV}, q AS (SELECT quantile_cont(t, 0.7) AS c FROM ev) SELECT t <= c AS train, count(*) AS n, sum(cents)::BIGINT AS cents FROM ev, q GROUP BY 1""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    cut = quantiles(e, "t", [0.7])[0]
    return e.groupBy((F.col("t") <= cut).alias("train")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


# --- distances ------------------------------------------------------------


@query(
    "jsd",
    f"""{IT}, p AS (SELECT mcc AS l, count(*)::DOUBLE / (SELECT count(mcc) FROM it WHERE txn_type = 'refund') AS p FROM it WHERE txn_type = 'refund' AND mcc IS NOT NULL GROUP BY mcc), q AS (SELECT mcc AS l, count(*)::DOUBLE / (SELECT count(mcc) FROM it WHERE txn_type <> 'refund') AS q FROM it WHERE txn_type <> 'refund' AND mcc IS NOT NULL GROUP BY mcc),
    b AS (SELECT coalesce(p, 0) AS p, coalesce(q, 0) AS q, (coalesce(p, 0) + coalesce(q, 0)) / 2 AS m FROM p FULL JOIN q USING (l))
    SELECT round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 9) AS jsd, round(sum(abs(p - q)) / 2, 9) AS total_variation, round(max(abs(p - q)), 9) AS largest_gap FROM b""",
)
def jsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = auth_items(spark, sf_dir)
    return distances.jsd(i.where("txn_type = 'refund'"), i.where("txn_type <> 'refund'"), "mcc")


@query(
    "ks_two_sample",
    f"""{EV}, d AS (SELECT amount, count(*) FILTER (declined) AS x, count(*) FILTER (NOT declined) AS y FROM ev GROUP BY amount), w AS (SELECT sum(x) OVER (ORDER BY amount) AS cx, sum(y) OVER (ORDER BY amount) AS cy, sum(x) OVER () AS n, sum(y) OVER () AS m FROM d)
    SELECT max(n)::BIGINT AS n, max(m)::BIGINT AS m, round(max(abs(cx::DOUBLE / n - cy::DOUBLE / m)), 9) AS ks, round(1.63 * sqrt((max(n) + max(m))::DOUBLE / (max(n) * max(m))), 9) AS band FROM w""",
)
def ks_two_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    return distances.ks_two_sample(e.where("declined"), e.where("not declined"), "amount")


@query(
    "spearman_matrix",
    f"""{EV}, r AS (SELECT rank() OVER (ORDER BY amount) + (count(*) OVER (PARTITION BY amount) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY merchant) + (count(*) OVER (PARTITION BY merchant) - 1) / 2.0::DOUBLE AS m, rank() OVER (ORDER BY customer) + (count(*) OVER (PARTITION BY customer) - 1) / 2.0::DOUBLE AS c FROM ev)
    SELECT 'amount' AS a, 'merchant' AS b, round(corr(a, m), 9) AS rho FROM r UNION ALL SELECT 'amount', 'customer', round(corr(a, c), 9) FROM r UNION ALL SELECT 'merchant', 'customer', round(corr(m, c), 9) FROM r""",
)
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.spearman(auth_events(spark, sf_dir), ["amount", "merchant", "customer"])


@query(
    "separability",
    "\nUNION ALL\n".join(
        f"""SELECT * FROM ({EV}, d AS (SELECT {c} AS v, count(*) FILTER (declined) AS pos, count(*) FILTER (NOT declined) AS neg FROM ev GROUP BY 1), w AS (SELECT *, sum(pos) OVER (ORDER BY v) AS cp, sum(neg) OVER (ORDER BY v) AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d),
        s AS (SELECT sum(pos * (cn - neg / 2.0::DOUBLE)) / (max(p) * max(n)) AS auc, max(abs(cp::DOUBLE / p - cn::DOUBLE / n)) AS gap FROM w)
        SELECT '{c}' AS "column", round(greatest(auc, 1 - auc), 9) AS rank_auc, CASE WHEN auc >= 0.5 THEN 'up' ELSE 'down' END AS direction, round(0.5 + gap / 2, 9) AS stump_auc FROM s)"""
        for c in ("amount", "merchant")
    ),
)
def separability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir).withColumn("y", F.col("declined"))
    return distances.separability(e, ["amount", "merchant"])


@query(
    "functional_dependency_audit",
    f"{IT}, g AS (SELECT merchant, count(*) FILTER (country > 12) AS y, count(*) AS n FROM it GROUP BY merchant) SELECT count(*) AS groups, count(*) FILTER (y > 0 AND y < n) AS mixed FROM g",
)
def functional_dependency_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.functional_dependency(auth_items(spark, sf_dir), ["merchant"], F.col("country") > 12)


@query(
    "top_share",
    f"""{EV}, n AS (SELECT customer, count(*) AS n FROM ev GROUP BY customer), r AS (SELECT n, row_number() OVER (ORDER BY n DESC) AS r, count(*) OVER () AS k FROM n)
    SELECT round((sum(n) FILTER (r <= greatest(1, floor(k * 0.1::DOUBLE))))::DOUBLE / sum(n), 9) AS top_share, max(n)::DOUBLE / min(n) AS peak_ratio FROM r""",
)
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.top_share(auth_events(spark, sf_dir), "customer", 0.1)


# --- sequences and lookups ------------------------------------------------


@query(
    "gap_ratio",
    f"""{EV}, g AS (SELECT seq, customer, (t - lag(t) OVER (PARTITION BY customer ORDER BY t, seq)) / 1e6::DOUBLE AS gap FROM ev), m AS (SELECT customer, quantile_cont(gap, 0.5) AS med FROM g GROUP BY customer)
    SELECT seq, gap, CASE WHEN gap > 0 AND med > 0 THEN round(ln(gap / med), 9) END AS gap_ratio, (gap <= 3600)::INTEGER AS burst_1h FROM g JOIN m USING (customer)""",
)
def gap_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.gaps(auth_events(spark, sf_dir))


@query("category_shift", f"{EV} SELECT seq, (kind <> lag(kind) OVER (PARTITION BY customer ORDER BY t, seq))::INTEGER AS category_shift FROM ev")
def category_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.category_shift(auth_events(spark, sf_dir))


@query(
    "robust_z",
    f"""{EV}, q AS (SELECT kind, quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.5) AS b, quantile_cont(amount, 0.75) AS c FROM ev GROUP BY kind) SELECT seq, CASE WHEN c - a > 0 THEN round((amount - b) / (c - a), 9) ELSE 0 END AS robust_z FROM ev JOIN q USING (kind)""",
)
def robust_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.robust_z(auth_events(spark, sf_dir), "kind", "amount")


@query(
    "merchant_rank_pct",
    f"""{EV}, n AS (SELECT merchant, count(*) AS n FROM ev WHERE merchant IS NOT NULL GROUP BY merchant) SELECT merchant, n, (rank() OVER (ORDER BY n DESC) + (count(*) OVER (PARTITION BY n) - 1) / 2.0::DOUBLE) / count(*) OVER () AS rank_pct FROM n""",
)
def merchant_rank_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.popularity_rank(auth_events(spark, sf_dir))


@query(
    "campaign_blocks",
    f"""{SC} SELECT seq, campaign, (ntile(3) OVER (PARTITION BY campaign ORDER BY t, seq) - 1)::INTEGER AS block, row_number() OVER (PARTITION BY campaign ORDER BY t, seq)::DOUBLE / count(*) OVER (PARTITION BY campaign) AS progress FROM sc WHERE campaign IS NOT NULL""",
)
def campaign_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    return sequences.split_blocks(s, "campaign", 3).join(sequences.ramp(s, "campaign"), "seq")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat_ws("-", F.lit("a"), (F.length("text") % 50).cast("string")).alias("a")))).alias("x"))
    return turns.select(F.col("conv_id").alias("seq"), F.transform("x", lambda x: x["a"]).alias("chain"))


@query(
    "chain_max_runner_up",
    """WITH c AS (SELECT conv_id, turn, 'a-' || (length(text) % 50) AS item FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, item) AS r FROM c), s AS (SELECT item, length(text) % 97 / 97.0::DOUBLE AS score FROM (SELECT 'a-' || item_id AS item, text FROM benchmark)),
    t AS (SELECT conv_id, list(score ORDER BY score DESC) FILTER (score IS NOT NULL) AS s FROM f LEFT JOIN s USING (item) WHERE r <= 12 GROUP BY conv_id)
    SELECT conv_id AS seq, round(s[1] + 0.02::DOUBLE * coalesce(s[2], 0), 9) AS score FROM t""",
)
def chain_max_runner_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("a-"), F.col("item_id").cast("string")).alias("item"), ((F.length("text") % 97) / F.lit(97.0)).alias("score"))
    return lookups.chain_score(_turns(spark, sf_dir), scores).withColumn("score", F.round("score", 9))


@query("host_allow_list", """SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages) WHERE host <> '' GROUP BY host HAVING count(*) >= 2""")
def host_allow_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.host_allow_list(read(spark, sf_dir, "pages").select(F.array("url").alias("chain")), "chain", 2)


@query(
    "content_resolution",
    """WITH ids AS (SELECT 'sha256:' || substr(sha256(url), 1, 12) AS content_id, page_id FROM pages), b AS (SELECT content_id, 'bound-' || min(page_id) AS artifact FROM ids WHERE page_id % 4 = 0 GROUP BY content_id), n AS (SELECT count(*) AS n FROM benchmark)
    SELECT DISTINCT ids.content_id, coalesce(b.artifact, 'item-' || (('0x' || substr(ids.content_id, 8, 8))::BIGINT % n)) AS artifact FROM ids LEFT JOIN b USING (content_id), n""",
)
def content_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "pages").select(scalars.content_id(F.col("url")).alias("content_id"), "page_id")
    bindings = ids.where("page_id % 4 = 0").groupBy("content_id").agg(F.concat(F.lit("bound-"), F.min("page_id").cast("string")).alias("artifact"))
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("ordinal"), F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("artifact"))
    return lookups.resolve(ids.select("content_id").distinct(), bindings, items)


@query(
    "anti_join_novel_merchant",
    f"""{EV}, u AS (SELECT DISTINCT customer, merchant FROM ev), m AS (SELECT DISTINCT merchant FROM ev), c AS (SELECT DISTINCT customer FROM ev),
    f AS (SELECT customer, list(m.merchant ORDER BY m.merchant) AS free FROM c, m WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.customer = c.customer AND u.merchant = m.merchant) GROUP BY customer),
    w AS (SELECT list(merchant ORDER BY merchant) AS whole FROM m)
    SELECT c.customer, coalesce(free, whole)[('0x' || substr(md5(c.customer::VARCHAR), 1, 8))::BIGINT % len(coalesce(free, whole)) + 1] AS merchant FROM c LEFT JOIN f USING (customer), w""",
)
def anti_join_novel_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    candidates = numbered(e.select("merchant").distinct(), "merchant", "merchant")
    return lookups.never_used(e.select("customer", "merchant"), candidates, "customer", "merchant")


#: A return's target lies some hours before it.
BIND_SQL = f"""{EV}, p AS (SELECT seq AS source, t AS pt, row_number() OVER (ORDER BY t, seq) - 1 AS ordinal FROM ev WHERE kind = 'purchase'), r AS (SELECT seq, t - merchant * {HOUR} AS target FROM ev WHERE refund),
    n AS (SELECT seq, count(source) FILTER (pt <= target) AS high, count(source) FILTER (pt < target - {DAY}) AS low FROM r LEFT JOIN p ON true GROUP BY seq),
    o AS (SELECT seq, high, CASE WHEN low < high THEN low ELSE 0 END AS low FROM n),
    b AS (SELECT seq, source FROM o LEFT JOIN p ON high > 0 AND ordinal = low + ('0x' || substr(md5(seq::VARCHAR), 1, 8))::BIGINT % nullif(high - low, 0))"""


def _bound(events: DataFrame) -> DataFrame:
    returns = events.where("refund").select("seq", (F.col("t") - F.col("merchant") * HOUR).alias("target"))
    return lookups.bind_source(returns, events.where("kind = 'purchase'"), DAY)


@query("interval_source_binding", f"{BIND_SQL} SELECT seq, source FROM b")
def interval_source_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bound(auth_events(spark, sf_dir))


@query(
    "opaque_keys",
    f"""{EV}, f AS (SELECT customer, min((t, seq)) AS k FROM ev GROUP BY customer) SELECT customer, printf('cus-%06d', row_number() OVER (ORDER BY k) - 1) AS opaque FROM f""",
)
def opaque_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.opaque(auth_events(spark, sf_dir), "customer", "cus")


@query("time_window_sample", f"""{EV} SELECT seq, customer, cents FROM ev WHERE t >= 1704067200000000 + {5 * DAY} AND t < 1704067200000000 + {12 * DAY}""")
def time_window_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.time_window(auth_events(spark, sf_dir), 1_704_067_200_000_000 + 5 * DAY, 7 * DAY).select("seq", "customer", "cents")


@query("sample_exact", f"""{EV} SELECT seq, customer FROM ev ORDER BY md5('s1:' || seq), seq LIMIT 500""")
def sample_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.sample_exact(auth_events(spark, sf_dir).select("seq", "customer"), 500, "s1")


@query(
    "average_rank",
    f"""{EV}, n AS (SELECT amount, count(*) AS n FROM ev GROUP BY amount) SELECT amount, (coalesce(sum(n) OVER (ORDER BY amount ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0::DOUBLE)::DOUBLE AS rank FROM n""",
)
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return average_rank(auth_events(spark, sf_dir), "amount").withColumn("rank", F.col("rank").cast("double"))


@query(
    "clause_table",
    f"""{EV}, r AS (SELECT declined, agent IS NOT NULL AS agentic, cents > 8000 AS big, device = 3 AS dev FROM ev), l AS (SELECT declined, agentic, 'big' AS clause, big AS fired FROM r UNION ALL SELECT declined, agentic, 'dev', dev FROM r UNION ALL SELECT declined, agentic, 'ANY', big OR dev FROM r)
    SELECT clause, count(*) FILTER (fired) AS fires, (count(*) FILTER (fired AND declined))::DOUBLE / nullif(count(*) FILTER (fired), 0) AS precision, (count(*) FILTER (fired AND NOT declined))::DOUBLE / count(*) FILTER (NOT declined) AS fpr,
      (count(*) FILTER (fired AND NOT declined AND agentic))::DOUBLE / count(*) FILTER (NOT declined AND agentic) AS agentic_fpr FROM l GROUP BY clause""",
)
def clause_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir).select(F.col("declined").alias("is_fraud"), "agent", (F.col("cents") > 8000).alias("l0_big"), (F.col("device") == 3).alias("l0_dev"))
    return rules.clause_table(e, ["big", "dev"], F.col("agent").isNotNull())


@query(
    "strongest_clause",
    f"""{EV}, r AS (SELECT kind, (cents > 8000)::INTEGER AS big, (device = 3)::INTEGER AS dev FROM ev) SELECT kind, count(*) AS events, sum(greatest(big, dev))::DOUBLE / count(*) AS recall, CASE WHEN sum(big) >= sum(dev) THEN 'big' ELSE 'dev' END AS clause, greatest(sum(big), sum(dev))::DOUBLE / count(*) AS share,
      CASE WHEN sum(greatest(big, dev)) = 0 THEN 'CLEAN' WHEN greatest(sum(big), sum(dev))::DOUBLE / count(*) >= 0.3 THEN 'HARD' ELSE 'SOFT' END AS bucket FROM r GROUP BY kind""",
)
def strongest_clause(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir).select("kind", (F.col("cents") > 8000).alias("l0_big"), (F.col("device") == 3).alias("l0_dev"))
    return rules.bucket_verdict(rules.strongest_clause(e, "kind", ["big", "dev"]))


@query(
    "tfidf_terms",
    r"""WITH d AS (SELECT item_id, regexp_extract_all(translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS w FROM benchmark),
    t AS (SELECT item_id, unnest(w) AS term FROM d UNION ALL SELECT item_id, w[i] || ' ' || w[i + 1] FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM d)), c AS (SELECT item_id, term, count(*) AS tf FROM t GROUP BY 1, 2), f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
    r AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term))
    SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 8) AS weight FROM r""",
)
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = read(spark, sf_dir, "benchmark").select("item_id", F.col("text"))
    return text.tfidf(plain, "item_id", "text").withColumn("weight", F.round("weight", 8))


# --- more of the inventory ------------------------------------------------


@query(
    "schema_violations",
    f"""{IT} SELECT 'customer' AS "constraint", count(*) FILTER (customer IS NULL) AS n FROM it UNION ALL SELECT 'lag', count(*) FILTER (lag < 0 OR lag IS NULL) FROM it
    UNION ALL SELECT 'settlement', count(*) FILTER (declined AND settled) FROM it UNION ALL SELECT 'mcc', count(*) FILTER (NOT regexp_matches(mcc, '^[A-Z]+$') OR mcc IS NULL) FROM it""",
)
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rules_ = {"customer": c("customer").isNotNull(), "lag": c("lag") >= 0, "settlement": ~(c("declined") & c("settled")), "mcc": c("mcc").rlike("^[A-Z]+$")}
    return schema.violations(auth_items(spark, sf_dir), rules_)


@query("deviation_from_mean", f"{EV}, m AS (SELECT customer, sum(cents)::DOUBLE / count(*) AS m FROM ev GROUP BY customer) SELECT seq, cents - m AS deviation FROM ev JOIN m USING (customer)")
def deviation_from_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.deviation(auth_events(spark, sf_dir))


@query(
    "threshold_prices",
    f"""{EV} SELECT th AS threshold, (count(*) FILTER (amount > th AND declined))::DOUBLE / count(*) FILTER (declined) AS recall, (count(*) FILTER (amount > th AND NOT declined))::DOUBLE / count(*) FILTER (NOT declined) AS fpr FROM ev, (SELECT unnest([20.0, 50.0, 100.0, 200.0])::DOUBLE AS th) GROUP BY th""",
)
def threshold_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.price_thresholds(auth_events(spark, sf_dir).withColumn("is_fraud", F.col("declined")), "amount", [20.0, 50.0, 100.0, 200.0])


@query("active_customers", f"{EV} SELECT seq, customer, cents FROM ev WHERE customer IN (SELECT customer FROM ev GROUP BY customer HAVING count(*) >= 70)")
def active_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.active(auth_events(spark, sf_dir), "customer", 70).select("seq", "customer", "cents")


INHERITED = ["customer", "merchant", "device", "agent", "mandate", "ip", "bin", "cents", "amount"]


@query(
    "inherited_source",
    f"""{BIND_SQL} SELECT e.seq, b.source, {", ".join(f"CASE WHEN b.source IS NULL THEN e.{c} ELSE s.{c} END AS {c}" for c in INHERITED)} FROM ev e JOIN b USING (seq) LEFT JOIN ev s ON s.seq = b.source""",
)
def inherited_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    return lookups.inherit(e.where("refund"), e.where("kind = 'purchase'"), _bound(e), INHERITED).select("seq", "source", *INHERITED)


@query(
    "registry_consistency",
    """SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NOT NULL THEN 'a' ELSE 'b' END AS side FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) a FULL JOIN (SELECT DISTINCT o_orderkey AS k FROM orders) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""",
)
def registry_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.consistency(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), "k")


@query("simulated_population")
def simulated_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "events").count()
    return population.simulate(spark, population.Config(events=n, customers=max(50, n // 25), merchants=max(50, n // 20)))


@query("injected_attacks")
def injected_attacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scenarios.inject_all(simulated_population(spark, sf_dir))


@query("iforest_scores")
def iforest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = baselines.entity_vectors(auth_events(spark, sf_dir), "customer", "merchant")
    return models.entity_novelty(v, ["n", "mean", "std", "max", "decline_share", "partners", "rate", "hour_entropy", "partner_entropy"], "customer", trees=50)


@query("gbt_scores")
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    rows = checkpointed(velocity.velocity(e, ["customer"]).join(e.select("seq", "t", "amount", F.col("declined").alias("fraud")), "seq"))
    train, test = models.time_split(rows, 0.7)
    return models.fit_supervised(train, ["amount", "count_24h", "amount_cents_7d", "decline_ratio_7d", "seconds_since_prior", "amount_vs_mean"], rounds=5).score(test).select("seq", "fraud", "l1")


@query("text_scores")
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where("doc_id % 4 <> 2")
    return text.learn_and_score(read(spark, sf_dir, "documents"), labels, "doc_id", "text", "toxic")
