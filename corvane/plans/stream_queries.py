"""Registered queries that run as streams over the event log, each with the SQL of its batch twin."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import velocity
from corvane.plans.queries import EV, query
from corvane.plans.session import checkpoint_folder
from corvane.sources.lenses import DAY, EVENTS_SQL, HOUR, as_auth_events, auth_events
from corvane.streaming import stateful


def streamed(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``make`` gives for the event log read as a stream up to its present end."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    stateful.use_rocksdb(own)
    path, folder = f"{sf_dir}/events.parquet", f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    source = own.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")  # a pattern, since the table may be one file
    made = make(as_auth_events(source))
    q = made.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/rows")


def _outcomes(events: DataFrame) -> DataFrame:
    """Each event's outcome, known as many hours later as its merchant's number says; one in ten never."""
    return events.where(F.col("merchant") % 10 > 0).select("seq", (F.col("t") + F.col("merchant") * HOUR).alias("t"), F.col("t").alias("t0"), "customer", "declined")


@query("stream_velocity_customer", f"SELECT *, NULL::BIGINT AS late_by, (SELECT customer FROM ev0 WHERE ev0.seq = v.seq) AS customer FROM ({velocity.velocity_sql(EVENTS_SQL, '(SELECT * FROM ev WHERE customer IS NOT NULL)', ['customer'])}) v".replace("SELECT *, NULL", f"WITH {EVENTS_SQL.replace('ev AS (', 'ev0 AS (', 1)} SELECT *, NULL", 1))
def stream_velocity_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda e: stateful.stream_velocity(e, ["customer"], ("t", "seq")))


_LATE = f"{EV}, j AS (SELECT seq, t - (merchant % 7) * {HOUR} AS t, customer FROM ev), w AS (SELECT *, max(t) OVER (PARTITION BY customer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - t AS behind FROM j) SELECT seq, customer, CASE WHEN behind > 0 THEN behind END AS late_by FROM w"


@query("stream_late_rows", _LATE)
def stream_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose time lags by up to six hours behind their place in the log."""
    found = streamed(spark, sf_dir, lambda e: stateful.stream_velocity(e.withColumn("t", F.col("t") - F.col("merchant") % 7 * HOUR), ["customer"], ("seq",)))
    return found.select("seq", "customer", "late_by")


_DELAYED = f"""{EV}, o AS (SELECT seq, t + merchant * {HOUR} AS t, t AS t0, customer, declined FROM ev WHERE merchant % 10 > 0)
    SELECT e.seq, {", ".join(f"count(o.seq) FILTER (o.t0 >= e.t - {w})::BIGINT AS known_{n}, count(o.seq) FILTER (o.t0 >= e.t - {w} AND o.declined)::BIGINT AS declined_{n}, count(o.seq) FILTER (o.t0 >= e.t - {w} AND o.declined)::DOUBLE / nullif(count(o.seq) FILTER (o.t0 >= e.t - {w}), 0) AS decline_ratio_{n}" for n, w in velocity.WINDOWS.items())}
    FROM ev e LEFT JOIN o ON o.customer = e.customer AND o.t < e.t WHERE e.customer IS NOT NULL GROUP BY e.seq"""


@query("delayed_outcomes", _DELAYED)
def delayed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = auth_events(spark, sf_dir)
    return velocity.delayed_outcomes(events, _outcomes(events), "customer")


@query("stream_delayed_outcomes", _DELAYED)
def stream_delayed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda e: stateful.stream_outcomes(e, _outcomes(e), "customer")).drop("late_by")


@query(
    "stream_merchant_customers",
    f"""{EV}, f AS (SELECT seq, row_number() OVER (PARTITION BY merchant, customer ORDER BY t, seq) = 1 AS first FROM ev), d AS (
      SELECT seq, least(256, coalesce(sum(first::INTEGER) OVER (PARTITION BY merchant ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS degree FROM ev JOIN f USING (seq) WHERE merchant IS NOT NULL
    ) SELECT e.seq, any_value(degree) AS degree, count(DISTINCT p.customer)::BIGINT AS distinct
    FROM ev e JOIN d USING (seq) LEFT JOIN ev p ON p.merchant = e.merchant AND (p.t < e.t OR p.t = e.t AND p.seq < e.seq) AND p.t >= e.t - {DAY} GROUP BY e.seq""".replace("AS distinct", 'AS "distinct"'),
)
def stream_merchant_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streamed(spark, sf_dir, lambda e: stateful.stream_distinct(e, "merchant", "customer", DAY)).drop("late_by")
