"""Lenses: views of general tables in the form of authorisation streams.

``auth_events`` reads an event log, ``auth_items`` order lines with their orders
(lines without an order have null keys).  ``auth_sessions`` is the event log with a
customer for each user and six hours of the day, mostly on a device of their own, so that the
identity graph has many components.  ``EVENTS_SQL``, ``ITEMS_SQL`` and
``SESSIONS_SQL`` say the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR, DAY = 3_600_000_000, 86_400_000_000


def micros(ts: Column) -> Column:
    """Microseconds of the wall clock since 1970, whatever the session's zone."""
    second = (F.extract(F.lit("SECONDS"), ts) * 1_000_000).cast("long")
    return F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * DAY + F.hour(ts).cast("long") * HOUR + F.minute(ts).cast("long") * 60_000_000 + second


def auth_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_auth_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def as_auth_events(events: DataFrame) -> DataFrame:
    """The event log, read as a table or as a stream, in the form of authorisations."""
    k = F.get_json_object("props", "$.k").cast("long")
    agent = F.when(F.col("event_type") == "click", F.col("user_id") % 7)
    return events.select(
        F.col("event_id").alias("seq"), micros(F.col("ts")).alias("t"), F.col("user_id").alias("customer"), k.alias("merchant"), (k % 20).alias("device"), agent.alias("agent"),
        F.when(agent.isNotNull(), F.col("user_id") % 7 * 10 + k % 3).alias("mandate"), F.when(k % 10 != 0, F.col("user_id") % 50).alias("ip"), (F.col("user_id") % 16).alias("bin"),
        F.rint(F.col("value") * 100).cast("long").alias("cents"), F.col("value").alias("amount"), (F.col("event_type") == "error").alias("declined"), (F.col("event_type") != "signup").alias("known"),
        (F.col("event_type") == "view").alias("refund"), F.when(F.col("event_type") != "error", k % 48).alias("lag"), F.col("event_type").alias("kind"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id AS seq, epoch_us(ts) AS t, user_id AS customer, k AS merchant, k % 20 AS device, CASE WHEN event_type = 'click' THEN user_id % 7 END AS agent,
    CASE WHEN event_type = 'click' THEN user_id % 7 * 10 + k % 3 END AS mandate, CASE WHEN k % 10 <> 0 THEN user_id % 50 END AS ip, user_id % 16 AS bin,
    round(value * 100)::BIGINT AS cents, value AS amount, event_type = 'error' AS declined, event_type <> 'signup' AS known, event_type = 'view' AS refund,
    CASE WHEN event_type <> 'error' THEN k % 48 END AS lag, event_type AS kind
  FROM (SELECT *, (props::JSON->>'k')::BIGINT AS k FROM events)
)"""


def auth_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = auth_events(spark, sf_dir)
    customer = F.col("customer") * 4 + F.floor(F.col("t") / (6 * HOUR)) % 4
    own, shared = customer * 3 + F.col("merchant") % 3, -1 - F.floor(customer / 3)
    agent = F.when(F.col("agent").isNotNull() & (F.col("merchant") % 4 == 0), F.floor((customer + 1) / 5))
    return e.withColumns({"customer": customer, "device": F.when(F.col("merchant") % 9 == 0, shared).when(F.col("merchant") % 5 > 0, own), "agent": agent})


SESSIONS_SQL = f"""{EVENTS_SQL.replace("ev AS (", "ev0 AS (", 1)}, ev1 AS (SELECT *, customer * 4 + t // {6 * HOUR} % 4 AS c4 FROM ev0), ev AS (
  SELECT * EXCLUDE (c4) REPLACE (c4 AS customer, CASE WHEN merchant % 9 = 0 THEN -1 - c4 // 3 WHEN merchant % 5 > 0 THEN c4 * 3 + merchant % 3 END AS device, CASE WHEN agent IS NOT NULL AND merchant % 4 = 0 THEN (c4 + 1) // 5 END AS agent) FROM ev1
)"""


#: Table -> its key and the columns of ``auth_items`` that need it.
ITEM_TABLES = {"orders": ("o_orderkey", {"customer", "bin", "channel", "status", "lag"}), "part": ("p_partkey", {"mcc", "brand"}), "customer": ("c_custkey", {"bin"}), "supplier": ("s_suppkey", {"country"})}


def auth_items(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """Order lines as authorisations, all columns or those asked for.

    A table that no column asks for is joined only if its keys repeat, and so would its lines.
    """

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")

    def repeats(name: str, key: str) -> bool:
        return not read(name).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").isEmpty()

    joined = {n: columns is None or bool(needs & set(columns)) or repeats(n, key) for n, (key, needs) in ITEM_TABLES.items()}
    joined["orders"] |= joined["customer"]
    lines = read("lineitem")
    if joined["orders"]:
        o = read("orders").select("o_orderkey", F.col("o_custkey").alias("customer"), "o_orderdate", F.col("o_orderpriority").alias("channel"), F.col("o_orderstatus").alias("status"))
        lines = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    if joined["part"]:
        lines = lines.join(read("part").select("p_partkey", F.col("p_type").alias("mcc"), F.col("p_brand").alias("brand")), F.col("l_partkey") == F.col("p_partkey"), "left")
    if joined["customer"]:
        lines = lines.join(read("customer").select("c_custkey", F.col("c_nationkey").alias("home")), F.col("customer") == F.col("c_custkey"), "left")
    if joined["supplier"]:
        lines = lines.join(read("supplier").select("s_suppkey", F.col("s_nationkey").alias("country")), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    there = {
        "seq": F.col("l_orderkey") * 100 + F.col("l_linenumber"), "t": micros(F.col("l_shipdate")), "customer": F.col("customer"), "merchant": F.col("l_suppkey"), "mcc": F.col("mcc"), "brand": F.col("brand"),
        "bin": F.col("home"), "country": F.col("country"), "channel": F.col("channel"), "status": F.col("status"), "cents": F.rint(F.col("l_extendedprice") * 100).cast("long"), "amount": F.col("l_extendedprice"),
        "txn_type": F.when(F.col("l_returnflag") == "R", "refund").otherwise("purchase"), "settled": F.col("l_linestatus") == "F",
        "lag": F.when(F.col("o_orderdate").isNotNull(), F.datediff(F.col("l_shipdate"), F.col("o_orderdate"))).cast("long"), "declined": F.col("l_returnflag") == "A",
    }
    return lines.select(*[c.alias(n) for n, c in there.items() if columns is None or n in columns])


ITEMS_SQL = """it AS (
  SELECT l_orderkey * 100 + l_linenumber AS seq, epoch_us(l_shipdate) AS t, o_custkey AS customer, l_suppkey AS merchant, p_type AS mcc, p_brand AS brand, c_nationkey AS bin, s_nationkey AS country,
    o_orderpriority AS channel, o_orderstatus AS status, round(l_extendedprice * 100)::BIGINT AS cents, l_extendedprice AS amount, CASE WHEN l_returnflag = 'R' THEN 'refund' ELSE 'purchase' END AS txn_type,
    l_linestatus = 'F' AS settled, date_diff('day', o_orderdate, l_shipdate) AS lag, l_returnflag = 'A' AS declined
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""
