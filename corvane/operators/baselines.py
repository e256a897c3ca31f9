"""Fitted baselines of entities and mandates, looked up for each event.

``fit`` is done on training rows; ``apply`` joins a narrow table of statistics.
Spark broadcasts a table only below its own size threshold.  Unseen keys give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_quantiles

LEAST = 5


def _share(c: Column) -> Column:
    return F.count_if(c).cast("double") / F.count("*")


def customer_profile(train: DataFrame, least: int = LEAST, quantiles: bool = True) -> DataFrame:
    """n always; the rest only from ``least`` events up."""
    x = F.log1p("amount")
    stats = {"mean": F.avg(x), "std": F.stddev_samp(x)} | ({"outbound_share": _share(F.col("txn_type") == "refund")} if "txn_type" in train.columns else {})
    g = train.where("customer is not null").groupBy("customer").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in stats.items()])
    if quantiles:
        g = with_quantiles(g, train.where("customer is not null"), "customer", {"p99": ("amount", 0.99)})
    kept = F.col("n") >= least
    return g.select("customer", "n", *[F.when(kept, F.col(c)).alias(c) for c in ("mean", "std", "p99", "outbound_share") if c in g.columns])


def merchant_profile(train: DataFrame, wanted: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """n always; the rest, or what of it is wanted, only from ``least`` events up."""
    x = F.log1p("amount")
    stats = {
        "mean": lambda: F.avg(x), "std": lambda: F.stddev_samp(x), "outbound_share": lambda: _share(F.col("txn_type") == "refund"), "decline_share": lambda: _share(F.col("declined")),
        "customers": lambda: F.count_distinct("customer"), "mean_lag": lambda: F.sum(F.when(F.col("settled"), F.col("lag"))).cast("double") / F.count(F.when(F.col("settled"), F.col("lag"))),
    }
    stats = {n: f() for n, f in stats.items() if wanted is None or n in wanted}
    g = train.where("merchant is not null").groupBy("merchant").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in stats.items()])
    kept = F.col("n") >= least
    return g.select("merchant", "n", *[F.when(kept, F.col(c)).alias(c) for c in stats])


def bin_profile(train: DataFrame) -> DataFrame:
    return train.where("bin is not null").groupBy("bin").agg(_share(F.col("declined")).alias("decline_share"))


def mcc_profile(train: DataFrame) -> DataFrame:
    x = F.log1p("amount")
    return train.where("mcc is not null").groupBy("mcc").agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"))


def channel_profile(train: DataFrame) -> DataFrame:
    return train.where("channel is not null").groupBy("channel").agg(F.percentile("lag", 0.5).alias("median_lag"))


def _z(x: Column, mean: Column, std: Column) -> Column:
    return F.when(std > 0, (x - mean) / std)


def entity_features(events: DataFrame, train: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """seq and z scores, ratios and unseen flags against profiles fitted on ``train``: all, or the wanted ones, with the profiles' columns that they need only."""
    x, c = F.log1p("amount"), F.col
    features = {
        "customer_z": (_z(x, c("c_mean"), c("c_std")), ["c_mean", "c_std"]), "amount_vs_p99": (F.when(c("c_p99") > 0, c("amount") / c("c_p99")), ["c_p99"]), "customer_outbound_share": (c("c_outbound_share"), ["c_outbound_share"]),
        "merchant_z": (_z(x, c("m_mean"), c("m_std")), ["m_mean", "m_std"]), "merchant_decline_share": (c("m_decline_share"), ["m_decline_share"]), "merchant_customers": (c("m_customers"), ["m_customers"]),
        "lag_vs_merchant": (F.when(c("m_mean_lag") > 0, c("lag") / c("m_mean_lag")), ["m_mean_lag"]), "mcc_z": (_z(x, c("k_mean"), c("k_std")), ["k_mean", "k_std"]), "bin_decline_share": (c("b_decline_share"), ["b_decline_share"]),
        "lag_vs_channel": (F.when(c("h_median_lag") > 0, c("lag") / c("h_median_lag")), ["h_median_lag"]), "customer_unseen": (c("c_n").isNull().cast("int"), ["c_n"]), "merchant_unseen": (c("m_n").isNull().cast("int"), ["m_n"]),
    }
    wanted = list(features) if wanted is None else wanted
    needed = {n for f in wanted for n in features[f][1]}
    profiles = {"c": (lambda: customer_profile(train, quantiles="c_p99" in needed), "customer"), "m": (lambda: merchant_profile(train, [n[2:] for n in needed if n.startswith("m_")]), "merchant"), "k": (lambda: mcc_profile(train), "mcc"), "b": (lambda: bin_profile(train), "bin"), "h": (lambda: channel_profile(train), "channel")}
    out = events
    for name, (make, key) in profiles.items():
        if any(n.startswith(f"{name}_") for n in needed):
            table = make()
            out = out.join(table.select(key, *[c(n).alias(f"{name}_{n}") for n in table.columns if f"{name}_{n}" in needed]), key, "left")
    return out.select("seq", *[features[f][0].alias(f) for f in wanted])


def latency_line(train: DataFrame, latency: str, amount: str, least: int = 100) -> DataFrame:
    """One row: slope, intercept and population sigma of log(latency) on log1p(amount); zero sigma counts as 1."""
    rows = train.where((F.col(latency) > 0) & F.col(amount).isNotNull()).select(F.log(latency).alias("y"), F.log1p(amount).alias("x"))
    fit = rows.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_syy("y", "x").alias("syy"), F.regr_sxy("y", "x").alias("sxy"))
    sigma = F.sqrt(F.greatest(F.lit(0.0), (F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n")))
    enough = F.col("n") >= least
    return fit.select("n", F.when(enough, F.col("slope")).alias("slope"), F.when(enough, F.col("intercept")).alias("intercept"), F.when(enough, F.when(sigma > 0, sigma).otherwise(1.0)).alias("sigma"))


def entropy(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Shannon entropy in nats of each key's distribution over values."""
    n = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    # -sum(p ln p) = ln N - sum(n ln n) / N
    return n.groupBy(key).agg((F.log(F.sum("n").cast("double")) - F.sum(F.col("n") * F.log(F.col("n").cast("double"))) / F.sum("n")).alias(out))


def entity_vectors(events: DataFrame, key: str, other: str) -> DataFrame:
    """A wide vector per entity: counts, moments, shares, distinct partners, span, rate, gaps and entropies.

    A missing device is not counted as a device.
    """
    g = events.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("n"), F.avg("amount").alias("mean"), F.stddev_samp("amount").alias("std"), F.max("amount").alias("max"), (F.sum("cents") / 100).alias("sum"), _share(F.col("declined")).alias("decline_share"),
        _share(F.col("agent").isNotNull()).alias("agentic_share"), _share(F.col("refund")).alias("outbound_share"), F.count_distinct(other).alias("partners"), F.count_distinct("device").alias("devices"),
        F.count_distinct("bin").alias("bins"), ((F.max("t") - F.min("t")) / 3.6e9).alias("span_hours"),
    )
    hours = events.withColumn("hour", F.floor(F.col("t") / 3_600_000_000) % 24)
    g = g.join(entropy(hours, key, "hour", "hour_entropy"), key, "left").join(entropy(events, key, other, "partner_entropy"), key, "left")
    return g.select(
        key, "n", "mean", "std", "max", "sum", F.when(F.col("mean") > 0, F.col("std") / F.col("mean")).alias("cv"), "decline_share", "agentic_share", "outbound_share", "partners", "devices", "bins",
        (F.col("partners").cast("double") / F.col("n")).alias("partner_ratio"), (F.col("devices").cast("double") / F.col("n")).alias("device_ratio"), "span_hours",
        F.when(F.col("span_hours") > 0, F.col("n") / F.col("span_hours")).alias("rate"), F.when(F.col("n") > 1, F.col("span_hours") / (F.col("n") - 1)).alias("mean_gap_hours"), "hour_entropy", "partner_entropy",
    )


def zipf_exponent(df: DataFrame, key: str, least: int = 5, most_rank: int = 2000, least_points: int = 20) -> DataFrame:
    """Minus the slope of log count on log rank, over the ``most_rank`` most frequent keys seen ``least`` times or more."""
    from pyspark.sql import Window

    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = n.orderBy(F.desc("n"), key).limit(most_rank)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), key)))  # at most most_rank rows
    return ranked.agg(F.count("*").alias("points"), F.when(F.count("*") >= least_points, F.round(-F.regr_slope(F.log(F.col("n").cast("double")), F.log(F.col("r").cast("double"))), 9)).alias("exponent"))


def summary_with_total(events: DataFrame, by: str, label: Column) -> DataFrame:
    """Per group and in total (group null): volume, marked rows, prevalence and lift over the total."""
    g = events.select(F.col(by).alias("g"), label.cast("int").alias("y")).rollup("g").agg(F.grouping("g").alias("is_total"), F.count("*").alias("volume"), F.sum("y").alias("marked"))
    whole = g.where("is_total = 1").select(F.col("volume").alias("v"), F.col("marked").alias("m"))
    rate = F.col("marked").cast("double") / F.col("volume")
    return g.crossJoin(F.broadcast(whole)).select(F.col("g").alias(by), "is_total", "volume", "marked", rate.alias("prevalence"), F.when(F.col("m") > 0, F.round(rate / (F.col("m").cast("double") / F.col("v")), 9)).alias("lift"))  # one row of totals
