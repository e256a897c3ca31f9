"""Operators over the order of events within an owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import average_rank, quantiles_by


def own(key: str) -> Window:
    return Window.partitionBy(key).orderBy("t", "seq")


def gaps(events: DataFrame, key: str = "customer") -> DataFrame:
    """seq, gap to the owner's previous event in seconds (null on the first), its log ratio to the owner's median gap, burst flag."""
    rows = events.where(F.col(key).isNotNull()).select("seq", key, F.greatest(F.lit(0.0), (F.col("t") - F.lag("t").over(own(key))) / 1e6).alias("gap"), "t")
    rows = rows.withColumn("gap", F.when(F.lag("t").over(own(key)).isNotNull(), F.col("gap")))
    median = rows.groupBy(key).agg(F.percentile("gap", 0.5).alias("median"))
    ratio = F.when((F.col("gap") > 0) & (F.col("median") > 0), F.log(F.col("gap") / F.col("median")))
    return rows.join(median, key).select("seq", "gap", F.round(ratio, 9).alias("gap_ratio"), (F.col("gap") <= 3600).cast("int").alias("burst_1h"))


def category_shift(events: DataFrame, key: str = "customer", category: str = "kind") -> DataFrame:
    """seq and whether the category differs from the owner's previous one (null on the first)."""
    before = F.lag(category).over(own(key))
    return events.where(F.col(key).isNotNull()).select("seq", (F.col(category) != before).cast("int").alias("category_shift"))


def robust_z(events: DataFrame, category: str, value: str) -> DataFrame:
    """seq and (value - median) / IQR within its category; 0 where the IQR is 0."""
    stats = quantiles_by(events.where(F.col(category).isNotNull()).select(F.col(category).alias("of"), value), "of", value, [0.25, 0.5, 0.75])
    iqr = F.col("q2") - F.col("q0")
    rows = events.where(F.col(category).isNotNull()).join(stats, F.col(category) == F.col("of"), "left")
    return rows.select("seq", F.when(iqr > 0, F.round((F.col(value) - F.col("q1")) / iqr, 9)).otherwise(F.lit(0.0)).alias("robust_z"))


def deviation(events: DataFrame, key: str = "customer") -> DataFrame:
    """seq and the amount in cents less the owner's mean."""
    mean = events.where(F.col(key).isNotNull()).groupBy(key).agg((F.sum("cents").cast("double") / F.count("*")).alias("mean"))
    return events.join(mean, key).select("seq", (F.col("cents") - F.col("mean")).alias("deviation"))


def popularity_rank(events: DataFrame, key: str = "merchant") -> DataFrame:
    """(key, n, rank_pct): average rank by volume, the most frequent first, over the number of keys."""
    n = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).withColumn("down", -F.col("n"))
    keys = n.agg(F.count("*").alias("keys"))
    return n.join(average_rank(n, "down"), "down").crossJoin(F.broadcast(keys)).select(key, "n", (F.col("rank") / F.col("keys")).alias("rank_pct"))  # one row of totals


def place_in_owner(events: DataFrame, key: str) -> DataFrame:
    return events.select("seq", F.row_number().over(own(key)).alias("place"))


def burst_move(events: DataFrame, chance: Column, gap: Column, key: str = "customer") -> DataFrame:
    """Pull an event to ``gap`` microseconds behind its predecessor where ``chance`` says so and the predecessor stays."""
    rows = events.withColumn("wants", F.coalesce(chance, F.lit(False)) & F.lag("t").over(own(key)).isNotNull())
    stays = ~F.coalesce(F.lag("wants").over(own(key)), F.lit(False))
    before = F.lag("t").over(own(key))
    return rows.select("seq", key, F.when(F.col("wants") & stays, F.least(F.col("t"), before + gap)).otherwise(F.col("t")).alias("t"), (F.col("wants") & stays).alias("moved"))


def split_blocks(events: DataFrame, campaign: str, blocks: int) -> DataFrame:
    """seq and block (from 0): each campaign cut by time into blocks of nearly equal size."""
    return events.where(F.col(campaign).isNotNull()).select("seq", campaign, (F.ntile(blocks).over(Window.partitionBy(campaign).orderBy("t", "seq")) - 1).alias("block"))


def stretch(events: DataFrame, campaign: str, factor: float, shift: int, low: int, high: int) -> DataFrame:
    """seq and t moved away from the campaign's mean time by ``factor``, shifted, and clipped."""
    mean = events.groupBy(campaign).agg(F.floor(F.sum(F.col("t").cast("decimal(38,0)")) / F.count("*")).cast("long").alias("mean"))
    moved = F.rint(F.col("mean") + (F.col("t") - F.col("mean")) * factor).cast("long") + shift
    return events.join(mean, campaign).select("seq", F.greatest(F.lit(low), F.least(F.lit(high), moved)).alias("t"))


def ramp(events: DataFrame, campaign: str) -> DataFrame:
    """seq and progress 0 to 1 along the campaign."""
    w = Window.partitionBy(campaign)
    return events.where(F.col(campaign).isNotNull()).select("seq", (F.row_number().over(w.orderBy("t", "seq")).cast("double") / F.count("*").over(w)).alias("progress"))
