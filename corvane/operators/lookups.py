"""Joins: resolution with fall-back, chains, novelty by anti-join, interval binding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered, running


def resolve(ids: DataFrame, bindings: DataFrame, fallback: DataFrame) -> DataFrame:
    """(content_id, artifact): the explicit binding, else the fall-back artifact of ordinal hex8 mod n.

    ids(content_id), bindings(content_id, artifact), fallback(ordinal from 0, artifact).
    """
    n = max(fallback.count(), 1)
    hex8 = F.conv(F.substring(F.regexp_replace("content_id", "^sha256:", ""), 1, 8), 16, 10).cast("long")
    rows = ids.join(bindings.withColumnRenamed("artifact", "bound"), "content_id", "left").withColumn("ordinal", F.pmod(hex8, F.lit(n)))
    return rows.join(fallback, "ordinal", "left").select("content_id", F.coalesce("bound", "artifact").alias("artifact"))


def chain_score(chains: DataFrame, scores: DataFrame, most: int = 12, runner_up: float = 0.02) -> DataFrame:
    """(seq, score): best score plus a little of the runner-up over a chain's first items; null without any.

    chains(seq, chain array), scores(item, score).
    """
    items = chains.select("seq", F.explode_outer(F.slice("chain", 1, most)).alias("item")).join(scores, "item", "left")
    top = F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2)  # at most ``most`` items
    return items.groupBy("seq").agg(top.alias("s")).select("seq", (F.get("s", F.lit(0)) + runner_up * F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))).alias("score"))


def _hex8(*parts: Column) -> Column:
    """A number from the first 8 hex digits of the MD5 of the parts joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def never_used(pairs: DataFrame, candidates: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): for each key one candidate never seen with it, at a hashed place among all of those.

    ``candidates`` has an ``ordinal`` from 0 without gaps.  The free candidate at
    place h follows from the used ordinals alone: below the i-th of them, u, lie
    u - i free ones, so it is h plus the number of those with u - i at most h.  A
    key that has used every candidate gets one of them.
    """
    n = max(candidates.count(), 1)
    used = pairs.select(key, value).distinct().join(candidates, value).select(key, "ordinal")
    rank = F.row_number().over(Window.partitionBy(key).orderBy("ordinal")) - 1
    free = used.select(key, (F.col("ordinal") - rank).alias("free"))
    counts = pairs.select(key).distinct().join(used.groupBy(key).agg(F.count("*").alias("used")), key, "left").select(key, F.coalesce("used", F.lit(0)).alias("used"))
    place = counts.select(key, F.pmod(_hex8(F.col(key)), F.when(F.col("used") < n, n - F.col("used")).otherwise(n)).alias("place"), (F.col("used") < n).alias("some"))
    passed = free.join(place.where("some"), key).where(F.col("free") <= F.col("place")).groupBy(key).agg(F.count("*").alias("passed"))
    picked = place.join(passed, key, "left").select(key, (F.col("place") + F.coalesce("passed", F.lit(0))).alias("ordinal"))
    return picked.join(candidates, "ordinal").select(key, value)


def bind_source(returns: DataFrame, purchases: DataFrame, band: int) -> DataFrame:
    """(seq, source): each return's purchase with t in [target - band, target], at a hashed place among them.

    returns(seq, target), purchases(seq, t).  If the band holds none, it is one of
    all purchases up to the target; null if there is none at all.  Purchases are
    numbered in order of time; a return finds the numbers at both ends of its band
    by running counts, and its source by number: no pairs are formed.
    """
    pool = purchases.select(F.col("seq").alias("source"), F.col("t").alias("at"))
    asked = returns.select("seq", "target", (F.col("target") - band).alias("least"))
    points = pool.select("at", F.lit(1).alias("n")).unionByName(asked.select(F.explode(F.array("target", "least")).alias("at"), F.lit(0).alias("n")))
    counted = running(points, "at", {"n": F.col("n")})
    place = F.row_number().over(Window.partitionBy("at").orderBy("source")) - 1
    numbers = pool.withColumn("place", place).join(counted, "at").select("source", (F.col("n_below") + F.col("place")).alias("ordinal"))
    ends = asked.join(counted.select(F.col("at").alias("target"), (F.col("n_below") + F.col("n")).alias("high")), "target").join(counted.select(F.col("at").alias("least"), F.col("n_below").alias("low")), "least")
    low = F.when(F.col("low") < F.col("high"), F.col("low")).otherwise(0)
    picked = ends.where("high > 0").select("seq", (low + F.pmod(_hex8(F.col("seq")), F.col("high") - low)).alias("ordinal"))
    return returns.select("seq").join(picked.join(numbers, "ordinal").select("seq", "source"), "seq", "left")


def inherit(returns: DataFrame, purchases: DataFrame, bound: DataFrame, columns: list[str]) -> DataFrame:
    """returns with ``columns`` taken from the bound purchase where there is one, nulls included."""
    source = purchases.select(F.col("seq").alias("source"), *[F.col(c).alias(f"s_{c}") for c in columns])
    rows = returns.join(bound, "seq", "left").join(source, "source", "left")
    return rows.select(*[F.when(F.col("source").isNull(), F.col(c)).otherwise(F.col(f"s_{c}")).alias(c) if c in columns else F.col(c) for c in returns.columns], "source")


def active(events: DataFrame, key: str, least: int) -> DataFrame:
    """Events of keys with at least ``least`` events."""
    kept = events.groupBy(key).count().where(F.col("count") >= least).select(key)
    return events.join(kept, key, "left_semi")


def opaque(events: DataFrame, key: str, prefix: str) -> DataFrame:
    """(key, opaque): '<prefix>-000001' by order of first appearance (t, seq)."""
    first = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("t", "seq")).alias("f")).select(key, F.col("f.t").alias("t"), F.col("f.seq").alias("seq"))
    return numbered(first, "t", "seq").select(key, F.format_string(f"{prefix}-%06d", "ordinal").alias("opaque"))


def time_window(events: DataFrame, start: int, length: int) -> DataFrame:
    """All events of [start, start + length): windows, not rows, are sampled, so that velocity keeps its meaning."""
    return events.where((F.col("t") >= start) & (F.col("t") < start + length))


def sample_exact(df: DataFrame, n: int, seed: str, key: str = "seq") -> DataFrame:
    """n rows that a seeded hash of the key puts first."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def consistency(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one of two registries has."""
    x, y = a.select(key).distinct().withColumn("in_a", F.lit(True)), b.select(key).distinct().withColumn("in_b", F.lit(True))
    return x.join(y, key, "full_outer").where(F.col("in_a").isNull() | F.col("in_b").isNull()).select(key, F.when(F.col("in_a").isNotNull(), "a").otherwise("b").alias("side"))


def namespaced(df: DataFrame, seed: int, ids: list[str], times: list[str], days: int) -> DataFrame:
    """Ids prefixed by the seed and times shifted by whole days (kept apart when seeds are pooled)."""
    def column(c: str) -> Column:
        if c in ids:
            return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"s{seed}-"), F.col(c))).alias(c)
        if c in times:
            return (F.col(c) + F.make_interval(days=F.lit(days * seed))).alias(c)
        return F.col(c)
    return df.select(*map(column, df.columns))
