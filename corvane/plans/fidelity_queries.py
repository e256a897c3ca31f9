"""Registered queries of distances and fidelity over many columns at a time: declined events or lines against the others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import distances, fidelity, ordered
from corvane.plans.queries import EV, IT, query
from corvane.sources.lenses import auth_events, auth_items

NUMBERS = ["amount", "lag", "merchant", "cents"]
LEVELS = ["channel", "brand", "status"]
#: Weight, mean and deviation of the logarithm.
MIXTURE = [(0.5, 3.5, 1.0), (0.3, 4.5, 0.8), (0.2, 2.0, 1.5)]

_PHI = "1 - (((((1.061405429 * k - 1.453152027) * k) + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k * exp(-z * z)"
_CDF = " + ".join(
    f"{w}::DOUBLE * (SELECT CASE WHEN x >= 0 THEN (1 + e) / 2 ELSE (1 - e) / 2 END FROM (SELECT x, {_PHI} AS e FROM (SELECT x, z, 1 / (1 + 0.3275911::DOUBLE * z) AS k FROM (SELECT x, abs(x) / sqrt(2::DOUBLE) AS z FROM (SELECT (ln(v) - {m}::DOUBLE) / {s}::DOUBLE AS x)))))"
    for w, m, s in MIXTURE
)


@query(
    "ks_mixture",
    f"""{EV}, d AS (SELECT amount AS v, count(*) AS n FROM ev GROUP BY amount), c AS (SELECT v, sum(n) OVER (ORDER BY v)::DOUBLE AS upto, n, sum(n) OVER () AS total FROM d),
    g AS (SELECT *, CASE WHEN v > 0 THEN {_CDF} ELSE 0 END AS f FROM c)
    SELECT max(total)::BIGINT AS n, round(max(greatest(abs(upto / total - f), abs((upto - n) / total - f))), 9) AS ks, round(1.63 / sqrt(max(total)::DOUBLE), 9) AS band, 1.5e-7::DOUBLE AS error_bound FROM g""",
)
def ks_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distances.ks_mixture(auth_events(spark, sf_dir), "amount", MIXTURE)


def _long_sql(columns: list[str], table: str, y: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS name, {c}::DOUBLE AS v, {y} AS y FROM {table} WHERE {c} IS NOT NULL" for c in columns)


@query(
    "ks_columns",
    f"""{EV}, l AS ({_long_sql(NUMBERS, "ev", "declined")}), g AS (SELECT name, v, count(*) FILTER (y) AS a, count(*) FILTER (NOT y) AS b FROM l GROUP BY name, v),
    w AS (SELECT name, sum(a) OVER o AS x, sum(b) OVER o AS z, sum(a) OVER (PARTITION BY name) AS n, sum(b) OVER (PARTITION BY name) AS m FROM g WINDOW o AS (PARTITION BY name ORDER BY v))
    SELECT name, max(n)::BIGINT AS n, max(m)::BIGINT AS m, round(max(abs(x::DOUBLE / nullif(n, 0) - z::DOUBLE / nullif(m, 0))), 9) AS ks, round(1.63 * sqrt((max(n) + max(m))::DOUBLE / nullif(max(n) * max(m), 0)), 9) AS band FROM w GROUP BY name""",
)
def ks_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    return distances.ks_columns(e.where("declined"), e.where("not declined"), NUMBERS)


@query(
    "level_marginals",
    f"""{IT}, l AS ({" UNION ALL ".join(f"SELECT '{c}' AS col, coalesce({c}, '') AS level, declined AS y FROM it" for c in LEVELS)}), s AS (
      SELECT col, level, count(*) FILTER (y)::DOUBLE / any_value(a) AS p, count(*) FILTER (NOT y)::DOUBLE / any_value(b) AS q FROM l JOIN (SELECT col, count(*) FILTER (y) AS a, count(*) FILTER (NOT y) AS b FROM l GROUP BY col) USING (col) GROUP BY col, level
    ) SELECT col AS "column", round(sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2), 9) AS jsd, count(*) AS levels,
      arg_min(level, (-round(abs(p - q), 9), level)) AS worst_level, max(round(abs(p - q), 9)) AS worst_gap FROM s GROUP BY col""",
)
def level_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_items(spark, sf_dir)
    return fidelity.level_marginals(e.where("declined"), e.where("not declined"), LEVELS)


@query("quantiles_by_brand", f"{IT} SELECT brand, count(amount) AS n, quantile_cont(amount, 0.25) AS q0, quantile_cont(amount, 0.5) AS q1, quantile_cont(amount, 0.99) AS q2 FROM it GROUP BY brand")
def quantiles_by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.quantiles_by(auth_items(spark, sf_dir), "brand", "amount", [0.25, 0.5, 0.99])


_RANKED = ["amount", "merchant", "customer"]
_PAIRS = [("amount", "merchant"), ("amount", "customer"), ("merchant", "customer")]


def _rho(side: str, name: str) -> str:
    ranks = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in _RANKED)
    return f"{name} AS (SELECT {', '.join(f'round(corr({a}, {b}), 9) AS c{i}' for i, (a, b) in enumerate(_PAIRS))} FROM (SELECT {ranks} FROM ev WHERE {side}))"


@query(
    "correlation_distance",
    f"""{EV}, {_rho("declined", "x")}, {_rho("NOT declined", "y")}, g AS ({" UNION ALL ".join(f"SELECT round(x.c{i} - y.c{i}, 9) AS gap FROM x, y" for i in range(3))})
    SELECT round(sqrt(2 * sum(gap * gap)), 9) AS frobenius, round(sqrt(avg(gap * gap)), 9) AS rms_off_diagonal FROM g""",
)
def correlation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    return distances.correlation_distance(distances.correlation_gap(e.where("declined"), e.where("not declined"), _RANKED))[0]


@query("discriminator_columns")
def discriminator_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which columns trees tell declined lines from others, out of fold."""
    e = auth_items(spark, sf_dir)
    return fidelity.discrimination(e.where("declined"), e.where("not declined"), ["amount", "lag", "merchant", "country"], folds=3, rounds=3).columns
