"""Protocol rules: clauses over scope, mandate and provenance, and how they do.

Clauses apply to rows with an agent.  A registry maps names to columns; the first
clause that fires, in order, names the reason.  Unknown is handled in each clause.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scalars import host, shop_slug

MAX_DEPTH = 5
LEAST_HOST_ROWS = 20


def _false(c: str) -> Column:
    return F.coalesce(~F.col(c), F.lit(False))


def clauses() -> dict[str, Column]:
    c = F.col
    last = F.when(F.size("ag_provenance_chain") > 0, F.element_at("ag_provenance_chain", -1))
    slug = shop_slug(last)
    age = F.unix_timestamp("ts") - F.unix_timestamp("ag_mandate_issued_ts")
    out = {
        "scope_mcc": (F.size("ag_scope_categories") > 0) & ~F.coalesce(F.array_contains("ag_scope_categories", c("mcc")), F.lit(False)),
        "scope_merchant": (F.size("ag_scope_allowed_merchants") > 0) & ~F.coalesce(F.array_contains("ag_scope_allowed_merchants", c("merchant_id")), F.lit(False)),
        "amount_over_cap": (c("ag_scope_max_amount") > 0) & (c("amount") > c("ag_scope_max_amount")),
        "mandate_expired": (c("ag_mandate_ttl_seconds") > 0) & (age > c("ag_mandate_ttl_seconds")),
        "delegation_depth": c("ag_delegation_depth") > MAX_DEPTH,
        "consent_invalid": _false("ag_consent_sig_valid"),
        "kya_unregistered": ~F.coalesce(c("ag_kya_registered"), F.lit(False)),
        "mandate_missing": F.coalesce(c("ag_mandate_type"), F.lit("none")) == "none",
        "provenance_mismatch": slug.isNotNull() & ~F.lower("merchant_id").endswith(slug),
    }
    return {k: F.coalesce(c("ag_agent_id").isNotNull() & v, F.lit(False)) for k, v in out.items()}


def apply_rules(flat: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """flat with a boolean per clause (``l0_<name>``), ``l0_reason`` and ``l0_fired``."""
    rules = clauses() if rules is None else rules
    out = flat.withColumns({f"l0_{n}": v for n, v in rules.items()})
    reason = F.coalesce(*[F.when(F.col(f"l0_{n}"), F.lit(n)) for n in rules])
    return out.withColumn("l0_reason", reason).withColumn("l0_fired", F.col("l0_reason").isNotNull())


def host_allow_list(legit: DataFrame, chain: str = "ag_provenance_chain", least: int = LEAST_HOST_ROWS) -> DataFrame:
    """(host, n): hosts of legitimate chains seen at least ``least`` times."""
    return legit.select(F.explode(chain).alias("url")).select(host(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def untrusted_domain(flat: DataFrame, allowed: DataFrame, key: str = "event_id", chain: str = "ag_provenance_chain") -> DataFrame:
    """(key, untrusted): whether any host of the chain is neither allowed nor a shop (measured only, never a reason)."""
    urls = flat.select(key, F.explode(chain).alias("url"))
    bad = urls.where(shop_slug(F.col("url")).isNull()).select(key, host(F.col("url")).alias("host")).where("host is not null").join(allowed, "host", "left_anti").select(key).distinct().withColumn("untrusted", F.lit(True))
    return flat.select(key).join(bad, key, "left").select(key, F.coalesce("untrusted", F.lit(False)).alias("untrusted"))


def clause_table(df: DataFrame, names: list[str], agentic: Column, prefix: str = "l0_") -> DataFrame:
    """Per clause, and ANY: fires, precision, false-positive rate over all and over agentic legitimate rows."""
    rows = df.withColumn("agentic", agentic).select("is_fraud", "agentic", *[F.col(prefix + n).alias(n) for n in names], F.greatest(*[F.col(prefix + n) for n in names]).alias("ANY"))
    long = rows.select("is_fraud", "agentic", F.explode(F.array(*[F.struct(F.lit(n).alias("clause"), F.col(n).alias("fired")) for n in [*names, "ANY"]])).alias("x")).select("is_fraud", "agentic", "x.*")
    legit = ~F.col("is_fraud")
    def share(a: Column, b: Column) -> Column:
        return F.when(F.count_if(b) > 0, F.count_if(a & b).cast("double") / F.count_if(b))
    return long.groupBy("clause").agg(F.count_if("fired").alias("fires"), share(F.col("is_fraud"), F.col("fired")).alias("precision"), share(F.col("fired"), legit).alias("fpr"), share(F.col("fired"), legit & F.col("agentic")).alias("agentic_fpr"))


def strongest_clause(df: DataFrame, group: str, names: list[str], prefix: str = "l0_") -> DataFrame:
    """Per group: events, recall of any clause, the strongest clause (ties: first by name), its share."""
    long = df.where(F.col(group).isNotNull()).select(F.col(group), F.explode(F.array(*[F.struct(F.lit(n).alias("clause"), F.col(prefix + n).cast("int").alias("hit")) for n in names])).alias("x"), F.greatest(*[F.col(prefix + n).cast("int") for n in names]).alias("any"))
    per = long.select(group, "any", "x.*").groupBy(group, "clause").agg(F.count("*").alias("events"), F.sum("hit").alias("hits"), F.sum("any").alias("any"))
    best = per.groupBy(group).agg(F.max("events").alias("events"), F.max("any").alias("any"), F.min(F.struct(-F.col("hits"), "clause")).alias("b"))
    n = F.col("events").cast("double")
    return best.select(group, "events", (F.col("any") / n).alias("recall"), F.col("b.clause").alias("clause"), (-F.col("b.col1") / n).alias("share"))


def bucket_verdict(strongest: DataFrame, least_share: float = 0.3) -> DataFrame:
    """CLEAN: no clause ever fires.  HARD: one clause fires on at least the share.  SOFT: between."""
    return strongest.withColumn("bucket", F.when(F.col("recall") == 0, "CLEAN").when(F.col("share") >= least_share, "HARD").otherwise("SOFT"))


def price_thresholds(df: DataFrame, value: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: recall and false-positive rate of value > threshold."""
    x = df.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).withColumn("hit", F.coalesce(F.col(value) > F.col("threshold"), F.lit(False)))
    return x.groupBy("threshold").agg((F.count_if(F.col("hit") & F.col("is_fraud")).cast("double") / F.count_if("is_fraud")).alias("recall"), (F.count_if(F.col("hit") & ~F.col("is_fraud")).cast("double") / F.count_if(~F.col("is_fraud"))).alias("fpr"))
