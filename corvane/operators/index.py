"""The population index: what a panel of events says about its entities, and picks from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.scalars import km_from, seed32
from corvane.sources.lenses import micros

from .ordered import group_quantiles, numbered, quantiles_by, with_quantiles

GAP = 1_500_000_000
BANDS = [0.05, 0.25, 0.5, 0.75, 0.95]


def customer_index(flat: DataFrame) -> DataFrame:
    """Per customer: first and last time, events, median, 99th percentile and maximum of the amount, agentic share."""
    grouped = flat.groupBy("customer_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.max("amount").alias("most"), F.avg(F.col("ag_agent_id").isNotNull().cast("double")).alias("agentic_share"))
    out = with_quantiles(grouped, flat, "customer_id", {"p50": ("amount", 0.5), "p99": ("amount", 0.99)})
    return out.select("customer_id", "first_ts", "last_ts", "n", "p50", "p99", "most", "agentic_share")


def merchant_index(flat: DataFrame) -> DataFrame:
    """Per merchant: category and country of its first event, events, medians of place and amount."""
    first = F.struct("ts", "event_id")
    grouped = flat.groupBy("merchant_id").agg(F.min_by("mcc", first).alias("mcc"), F.min_by("merchant_country", first).alias("country"), F.count("*").alias("n"))
    return with_quantiles(grouped, flat, "merchant_id", {c: (c, 0.5) for c in ("lat", "lon", "amount")})


def hour_shares(flat: DataFrame) -> DataFrame:
    """(hour, share) of the events."""
    n = flat.groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return n.select("hour", (F.col("n").cast("double") / F.sum("n").over(Window.partitionBy())).alias("share"))  # at most 24 rows


def channel_lags(flat: DataFrame) -> DataFrame:
    """(channel, lag): the median settlement lag."""
    return flat.groupBy("channel").agg(F.percentile("settlement_lag_hours", 0.5).alias("lag"))


def amount_bands(flat: DataFrame, at: list[float] = BANDS) -> DataFrame:
    """(mcc, band, amount): quantiles of each category's amounts."""
    cuts = quantiles_by(flat.select("mcc", "amount"), "mcc", "amount", at)
    return cuts.select("mcc", F.explode(F.array(*[F.struct(F.lit(q).alias("band"), F.col(f"q{i}").alias("amount")) for i, q in enumerate(at)])).alias("x")).select("mcc", "x.band", "x.amount")


def within_band(flat: DataFrame, low: float, high: float) -> DataFrame:
    """Events whose amount lies between two quantiles of their category."""
    cuts = quantiles_by(flat.where("mcc is not null").select("mcc", "amount"), "mcc", "amount", [low, high]).select(F.col("mcc").alias("of"), "q0", "q1")
    return flat.join(cuts, F.col("mcc") == F.col("of")).where(F.col("amount").between(F.col("q0"), F.col("q1"))).select(*flat.columns)


def calibration(flat: DataFrame) -> DataFrame:
    """(metric, value): amount quantiles, channel mix, distinct entities and missing rates."""
    n = F.count("*").cast("double")
    channels = ["agentic", "card_present", "ecom", "transfer", "upi"]
    at = [0.01, 0.25, 0.5, 0.75, 0.99]
    metrics: dict[str, Column] = {f"share_{c}": F.count_if(F.col("channel") == c) / n for c in channels}
    metrics |= {f"distinct_{c}": F.countDistinct(c).cast("double") for c in ("customer_id", "merchant_id", "device_id", "card_bin")}
    metrics |= {f"missing_{c}": F.count_if(F.col(c).isNull()) / n for c in ("device_id", "ip", "lat", "terminal_id")}
    row = flat.agg(*[v.alias(k) for k, v in metrics.items()])
    cuts = quantiles_by(flat.select(F.lit("amount").alias("of"), F.col("amount").cast("double").alias("amount")), "of", "amount", at)
    cells = F.array(*[F.struct(F.lit(f"amount_p{round(100 * q):02d}").alias("metric"), F.col(f"q{i}").alias("value")) for i, q in enumerate(at)])
    rest = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])).alias("x")).select("x.*")
    return rest.unionByName(cuts.select(F.explode(cells).alias("x")).select("x.*"))


def fit_amounts(flat: DataFrame, least: int = 200) -> DataFrame:
    """Per category with enough events: mean and deviation of the log amount, and the gamma shape by moments."""
    fit = flat.where("amount > 0").groupBy("mcc").agg(F.count("*").alias("n"), F.avg(F.log("amount")).alias("log_mean"), F.stddev_pop(F.log("amount")).alias("log_std"), F.avg("amount").alias("m"), F.var_pop("amount").alias("v"))
    return fit.where(F.col("n") >= least).select("mcc", "n", "log_mean", "log_std", F.when(F.col("v") > 0, F.col("m") * F.col("m") / F.col("v")).alias("gamma_shape"))


def burst_share(flat: DataFrame, gap: int = GAP) -> DataFrame:
    """One row: the share of a customer's events that follow the one before within the gap."""
    t = micros(F.col("ts"))
    before = F.lag(t).over(Window.partitionBy("customer_id").orderBy("ts", "event_id"))
    gaps = flat.select((t - before).alias("gap")).where("gap IS NOT NULL")
    return gaps.agg(F.count("*").alias("gaps"), (F.count_if(F.col("gap") <= gap).cast("double") / F.count("*")).alias("burst_share"))


def entity_caps(flat: DataFrame) -> DataFrame:
    """(measure, most): the most cards, devices and merchants of a customer, and the most customers of an agent."""
    out = None
    for key, value in (("customer_id", "card_bin"), ("customer_id", "device_id"), ("customer_id", "merchant_id"), ("ag_agent_id", "customer_id")):
        most = flat.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(value).alias("n")).agg(F.max("n").alias("most")).select(F.lit(f"{value} per {key}").alias("measure"), "most")
        out = most if out is None else out.unionByName(most)
    return out


def class_balance(pooled: DataFrame, seed: str = "seed") -> DataFrame:
    """Per seed: events, attacks and their share."""
    return pooled.groupBy(seed).agg(F.count("*").alias("n"), F.count_if("is_fraud").alias("attacks"), F.avg(F.col("is_fraud").cast("double")).alias("share"))


def home_distance(flat: DataFrame) -> DataFrame:
    """(event_id, km): distance of each placed event from its customer's median place."""
    placed = flat.where("lat IS NOT NULL AND lon IS NOT NULL")
    home = group_quantiles(placed.where("customer_id is not null"), "customer_id", {"lat0": ("lat", 0.5), "lon0": ("lon", 0.5)})
    return placed.join(home, "customer_id").select("event_id", km_from(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0")).alias("km"))


def entity_weights(flat: DataFrame, key: str) -> DataFrame:
    """(key, n): how many events each entity has."""
    return flat.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))


def least_active(flat: DataFrame, k: int, key: str = "customer_id") -> DataFrame:
    """The k entities with the fewest events (ties by name)."""
    return entity_weights(flat, key).orderBy("n", key).limit(k)


def popularity_slice(flat: DataFrame, low: float, high: float, key: str = "merchant_id") -> DataFrame:
    """Entities between two quantiles of the ranking by events, the busiest first (ties by name)."""
    ranked = numbered(entity_weights(flat, key).withColumn("down", -F.col("n")), "down", key)
    total = ranked.count()
    place = F.col("ordinal").cast("double") / max(total, 1)
    return ranked.where((place >= low) & (place < high)).select(key, "n", F.col("ordinal").alias("place"))


def planted(flat: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per kind of artefact: how often events ingest it, in attacks and elsewhere; artifacts(content_id, kind)."""
    used = flat.select("is_fraud", F.explode("ag_ingested_content_ids").alias("content_id")).join(artifacts, "content_id")
    return used.groupBy("kind").agg(F.count_if("is_fraud").alias("in_attacks"), F.count_if(~F.col("is_fraud")).alias("elsewhere"), F.countDistinct("content_id").alias("artifacts"))


def on_the_wire(flat: DataFrame, truth: list[str]) -> tuple[DataFrame, DataFrame]:
    """The event as a scorer may see it, and its truth, as two frames with the id."""
    return flat.select(*[c for c in flat.columns if c not in truth]), flat.select("event_id", *truth)


def hex_ids(df: DataFrame, number: str, width: int, seed: str, out: str = "hex_id") -> DataFrame:
    """Distinct ids of ``width`` hex digits: a walk with an odd stride meets no value of 16 ** width twice."""
    if not 1 <= width <= 8:
        raise ValueError("products with wider ids would not fit a long")
    start, n = seed32(F.lit(f"{seed}/start")), F.lit(16**width)
    stride, at = F.pmod(seed32(F.lit(f"{seed}/stride")).bitwiseOR(F.lit(1)), n), F.pmod(F.col(number).cast("long"), n)
    # The number in two halves of 16 bits: no product passes 2 ** 48.
    low, high = at.bitwiseAND(F.lit(0xFFFF)), F.shiftright(at, 16)
    value = F.pmod(start + stride * low + F.pmod(stride * high, n) * F.lit(1 << 16), n)
    return df.withColumn(out, F.lower(F.lpad(F.hex(value), width, "0")))


def weighted_sample(df: DataFrame, k: int, weight: str, key: str, seed: str) -> DataFrame:
    """k rows without replacement, each round in proportion to the weights: the least of -ln(u) / weight."""
    u = (seed32(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))) + 0.5) / float(1 << 32)
    rows = df.where(F.col(weight) > 0).withColumn("draw_", -F.log(u) / F.col(weight))
    return rows.orderBy("draw_", key).limit(k).drop("draw_")


def corpus_plan(spark_rows: DataFrame, subjects: list[str], variants: dict[str, int]) -> DataFrame:
    """A row for each artefact to write: every subject in every variant of every kind, over any one-row frame."""
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in variants.items()])
    rows = spark_rows.select(F.explode(F.array(*map(F.lit, subjects))).alias("subject")).select("subject", F.explode(kinds).alias("x"))
    return rows.select("subject", "x.kind", F.explode(F.sequence(F.lit(1), F.col("x.n"))).alias("variant")).withColumn("title", F.format_string("%s (%s v%d)", "subject", "kind", "variant"))


def late_rows(events: DataFrame, arrival: str = "arrival", time: str = "t", span: int = 100_000, by: list[str] | None = None) -> DataFrame:
    """Events with a time below that of an event (of the same ``by``, if given) that arrived before them, and by how much.

    The greatest time so far is taken within spans of arrivals and over the spans before.
    """
    key = by or []
    cut = events.withColumn("span_", F.floor(F.col(arrival) / span))
    inside = Window.partitionBy(*key, "span_").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*key).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each span
    heads = cut.groupBy(*key, "span_").agg(F.max(time).alias("most_")).select(*key, "span_", F.max("most_").over(before).alias("earlier_"))
    marked = cut.withColumn("so_far_", F.max(time).over(inside)).join(heads, [*key, "span_"])
    behind = F.greatest("so_far_", "earlier_") - F.col(time)
    return marked.withColumn("late_by", behind).where("late_by > 0").select(*events.columns, "late_by")


class OrderError(ValueError):
    """Events do not come in order of time."""


def assert_ordered(events: DataFrame, arrival: str = "arrival", time: str = "t") -> None:
    """Raise if an event is earlier than one that arrived before it."""
    if not late_rows(events, arrival, time).isEmpty():
        raise OrderError("events must come in order of time")
