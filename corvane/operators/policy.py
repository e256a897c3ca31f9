"""Score fusion, decision thresholds, decisions and attributions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import quantiles, running

DECISIONS = ["approve", "challenge", "review", "decline"]


def legit_percentile(scores: DataFrame, reference: DataFrame, column: str, key: str = "seq") -> DataFrame:
    """(key, percentile): share of reference scores below the score; null scores give 0.5."""
    both = reference.select(F.col(column).alias("v"), F.lit(1).alias("r")).unionByName(scores.select(F.col(column).alias("v"), F.lit(0).alias("r")))
    below = running(both, "v", {"r": F.col("r")}).select(F.col("v").alias(column), "r_below")
    n = reference.where(F.col(column).isNotNull()).count()
    share = F.col("r_below").cast("double") / max(n, 1)
    return scores.select(key, column).join(below, column, "left").select(key, F.coalesce(share, F.lit(0.5)).alias("percentile"))


def fusion_design(scores: DataFrame, legit: DataFrame, layers: list[str], key: str = "seq") -> DataFrame:
    """Per row and layer: percentile among legitimate scores, standardised raw score (0 if absent), presence."""
    out = scores
    for layer in layers:
        out = out.join(legit_percentile(scores, legit, layer, key).withColumnRenamed("percentile", f"{layer}_pct"), key)
        m = legit.agg(F.avg(layer).alias("m"), F.stddev_pop(layer).alias("s")).first()
        z = (F.col(layer) - (m["m"] or 0.0)) / (m["s"] or 1.0)
        out = out.withColumn(f"{layer}_raw", F.coalesce(z, F.lit(0.0))).withColumn(f"{layer}_there", F.col(layer).isNotNull().cast("double"))
    return out


@dataclass
class Fusion:
    columns: list[str]
    model: object

    def score(self, design: DataFrame) -> DataFrame:
        x = VectorAssembler(inputCols=self.columns, outputCol="features").transform(design)
        return self.model.transform(x).withColumn("fused", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    def weights(self, spark) -> DataFrame:
        return spark.createDataFrame(list(zip(self.columns, map(float, self.model.coefficients), strict=True)), "feature string, weight double")


def fit_fusion(design: DataFrame, layers: list[str], label: str = "fraud") -> Fusion:
    """A balanced logistic stacker; a presence column is used only if it varies."""
    columns = [f"{x}_{k}" for x in layers for k in ("pct", "raw")]
    spread = design.agg(*[F.count_distinct(f"{x}_there").alias(x) for x in layers]).first()
    columns += [f"{x}_there" for x in layers if spread[x] > 1]
    y = F.col(label).cast("double")
    n = design.agg(F.count("*").alias("n"), F.sum(y).alias("p")).first()
    weight = F.when(F.col(label), n["n"] / (2 * max(n["p"], 1))).otherwise(n["n"] / (2 * max(n["n"] - n["p"], 1)))
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(design).withColumn("y", y).withColumn("w", weight)
    return Fusion(columns, LogisticRegression(labelCol="y", weightCol="w", maxIter=100, regParam=1e-4).fit(rows))


def policy_thresholds(legit: DataFrame, column: str = "score", rates: tuple[float, float, float] = (0.01, 0.005, 0.001)) -> tuple[float, ...]:
    """Scores from which to challenge, review and decline: quantiles of legitimate scores."""
    return tuple(quantiles(legit, column, [1 - r for r in rates]))


def escalate(a: Column, b: Column) -> Column:
    """The more severe of two decisions."""
    def rank(c: Column) -> Column:
        return F.array_position(F.array(*map(F.lit, DECISIONS)), c)
    return F.when(rank(a) >= rank(b), a).otherwise(b)


def decide(score: Column, thresholds: tuple[float, ...], l0_violation: Column, can_answer: Column) -> Column:
    """approve < challenge < review < decline; a challenge nobody can answer is a review; a rule violation declines."""
    challenge, review, decline = thresholds
    asked = F.when(F.coalesce(can_answer, F.lit(True)), F.lit("challenge")).otherwise(F.lit("review"))
    by_score = F.when(score >= decline, F.lit("decline")).when(score >= review, F.lit("review")).when(score >= challenge, asked).otherwise(F.lit("approve"))
    return escalate(by_score, F.when(F.coalesce(l0_violation, F.lit(False)), F.lit("decline")).otherwise(F.lit("approve")))


def tallies(df: DataFrame, decision: str = "decision") -> DataFrame:
    return df.groupBy(decision).agg(F.count("*").alias("n"))


def top_contributions(design: DataFrame, fusion: Fusion, k: int = 3, key: str = "seq") -> DataFrame:
    """(key, rank, feature, contribution): a linear score's largest terms by size."""
    terms = F.array(*[F.struct(F.abs(F.col(c) * float(w)).alias("size"), F.lit(c).alias("feature"), (F.col(c) * float(w)).alias("contribution")) for c, w in zip(fusion.columns, fusion.model.coefficients, strict=True)])
    best = F.slice(F.reverse(F.array_sort(terms)), 1, k)
    return design.select(key, F.posexplode(best).alias("rank", "x")).select(key, (F.col("rank") + 1).alias("rank"), "x.feature", "x.contribution")
