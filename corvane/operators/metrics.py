"""Rank metrics with exact ties: ROC and PR areas, thresholds at a false-positive rate, recall, campaigns.

Input: score (double, null if unscored), fraud (boolean) and, where named,
campaign and an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import quantiles, running

RATES = (0.001, 0.005, 0.01)


def _curve(df: DataFrame) -> DataFrame:
    """Distinct scores with positives and negatives at and below each."""
    return running(df, "score", {"pos": F.col("fraud").cast("long"), "neg": (~F.col("fraud")).cast("long")})


def areas(df: DataFrame) -> DataFrame:
    """One row: positives, negatives, roc_auc (ties count half), auc_pr (stepwise average precision)."""
    c = _curve(df)
    total = df.where(F.col("score").isNotNull()).agg(F.count_if("fraud").alias("p"), F.count_if(~F.col("fraud")).alias("n"))
    above_pos = F.col("p") - F.col("pos_below")
    above = above_pos + F.col("n") - F.col("neg_below")
    joined = c.crossJoin(F.broadcast(total))  # one row of totals
    pairs = F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg")))
    ap = F.sum(F.when(F.col("pos") > 0, F.col("pos").cast("double") / F.col("p") * above_pos / above))
    out = joined.agg(F.max("p").alias("positives"), F.max("n").alias("negatives"), pairs.alias("pairs"), ap.alias("ap"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return out.select("positives", "negatives", F.when(both, F.round(F.col("pairs") / 2 / (F.col("positives") * F.col("negatives")), 9)).alias("roc_auc"), F.round("ap", 9).alias("auc_pr"))


def threshold_at_fpr(df: DataFrame, rate: float) -> float:
    """Linear quantile 1 - rate of the legitimate scores; infinite if they are fewer than 1 / rate."""
    legit = df.where(~F.col("fraud") & F.col("score").isNotNull())
    if legit.count() < int(1 / rate):
        return float("inf")
    return quantiles(legit, "score", [1 - rate])[0]


def recall_curve(df: DataFrame, rates: tuple[float, ...] = RATES) -> DataFrame:
    """(rate, threshold, recall, realised_fpr) at each false-positive rate."""
    legit = df.where(~F.col("fraud") & F.col("score").isNotNull())
    n = legit.count()
    enough = [r for r in rates if n >= int(1 / r)]
    found = dict(zip(enough, quantiles(legit, "score", [1 - r for r in enough]), strict=True)) if enough else {}
    limits = [(r, found.get(r, float("inf"))) for r in rates]
    cells = F.array(*[F.struct(F.lit(r).alias("rate"), F.lit(t).alias("threshold")) for r, t in limits])
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False)).cast("long")
    found = df.withColumn("x", F.explode(cells)).select("score", "fraud", "x.*").groupBy("rate", "threshold")
    out = found.agg(F.sum(F.when(F.col("fraud"), hit)).alias("tp"), F.count_if("fraud").alias("p"), F.sum(F.when(~F.col("fraud"), hit)).alias("fp"), F.count_if(~F.col("fraud")).alias("n"))
    return out.select("rate", "threshold", F.when(F.col("p") > 0, F.col("tp").cast("double") / F.col("p")).alias("recall"), F.when(F.col("n") > 0, F.col("fp").cast("double") / F.col("n")).alias("realised_fpr"))


def recall_at(df: DataFrame, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Recall and realised false-positive rate at a threshold fitted elsewhere, by group."""
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    def share(c: Column) -> Column:
        return F.when(F.count_if(c) > 0, F.count_if(c & hit).cast("double") / F.count_if(c))
    return df.groupBy(*(by or [])).agg(F.count_if("fraud").alias("frauds"), share(F.col("fraud")).alias("recall"), share(~F.col("fraud")).alias("realised_fpr"))


def campaigns(df: DataFrame, threshold: float) -> DataFrame:
    """Per campaign: size, whether caught, the 1-based place of its first alert and the share of its time gone by then."""
    w = Window.partitionBy("campaign").orderBy("t", "seq")
    rows = df.where("fraud and campaign is not null and campaign <> ''").withColumn("place", F.row_number().over(w)).withColumn("hit", F.coalesce(F.col("score") >= threshold, F.lit(False)))
    out = rows.groupBy("campaign").agg(F.count("*").alias("size"), F.max("hit").alias("caught"), F.min(F.when(F.col("hit"), F.col("place"))).cast("long").alias("first_alert"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.min(F.when(F.col("hit"), F.col("t"))).alias("ta"))
    elapsed = F.when(F.col("t1") > F.col("t0"), (F.col("ta") - F.col("t0")).cast("double") / (F.col("t1") - F.col("t0"))).when(F.col("ta").isNotNull(), F.lit(0.0))
    return out.select("campaign", "size", "caught", "first_alert", elapsed.alias("elapsed_share"))


def campaign_summary(per: DataFrame) -> DataFrame:
    """One row: campaigns, caught, median and mean first alert, median size, median elapsed share."""
    return per.agg(
        F.count("*").alias("campaigns"), F.count_if("caught").alias("caught"), F.percentile("first_alert", 0.5).alias("median_first_alert"),
        (F.sum("first_alert").cast("double") / F.count("first_alert")).alias("mean_first_alert"), F.percentile("size", 0.5).alias("median_size"), F.percentile("elapsed_share", 0.5).alias("median_elapsed_share"),
    )
