"""Registered queries of the supervised layer: numbered levels, trees over them, and what each column adds to a score."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import models, trees
from corvane.plans.queries import IT, query
from corvane.plans.session import checkpointed
from corvane.sources.lenses import auth_items

CATEGORICAL = ["channel", "brand", "mcc", "txn_type"]


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose label depends on a set of brands, on two channels, and on the amount."""
    odd = (F.crc32(F.col("brand").cast("binary")) % 4 == 0) & F.col("channel").isin("1-URGENT", "2-HIGH")
    columns = ["seq", "t", "amount", "lag", *CATEGORICAL]
    return auth_items(spark, sf_dir, columns).select(*columns, F.coalesce(odd | (F.col("amount") > 80_000), F.lit(False)).alias("fraud"))


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[models.Supervised, DataFrame]:
    train, test = models.time_split(checkpointed(_labelled(spark, sf_dir)), 0.7)
    return models.fit_supervised(train, ["amount", "lag"], rounds=5, categorical=CATEGORICAL), test


@query(
    "level_numbers",
    f"""{IT}, c AS (
      SELECT merchant::VARCHAR AS level, count(*) AS n, count(*) FILTER (declined) AS positives FROM it WHERE merchant IS NOT NULL GROUP BY merchant
    ), o AS (
      SELECT *, coalesce(sum(n) OVER w, 0) AS rows_below, coalesce(count(*) OVER w, 0) AS levels_below, sum(n) OVER () AS total, count(*) OVER () AS levels FROM c
      WINDOW w AS (ORDER BY positives::DOUBLE / n, level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    )
    SELECT level, n, positives, (2 + CASE WHEN levels <= 62 THEN levels_below ELSE floor(rows_below * 62 / total) END)::INTEGER AS number FROM o""",
)
def level_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.level_numbers(auth_items(spark, sf_dir), "merchant", "declined")


@query("gbt_levels")
def gbt_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _fitted(spark, sf_dir)
    return model.score(test).select("seq", "fraud", "l1")


@query("tree_contributions_add_up", f"{IT}, c AS (SELECT quantile_cont(t, 0.7) AS cut FROM it) SELECT seq, true AS additive, true AS as_scored FROM it, c WHERE t > cut")
def tree_contributions_add_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each row: do the contributions add up to the raw score, and is that the score that the ensemble gives?"""
    model, test = _fitted(spark, sf_dir)
    raw = vector_to_array("rawPrediction")[1].alias("raw")
    found = model.contributions(model.ensemble.transform(model.assembled(test)).select(*test.columns, raw), ["seq", "raw"])
    total = F.aggregate(F.map_values("contributions"), F.col("base"), lambda s, x: s + x)
    return found.select("seq", (F.abs(total - F.col("margin")) < 1e-9).alias("additive"), (F.abs(2 * F.col("raw") - F.col("margin")) < 1e-9).alias("as_scored"))


@query("tree_attributions")
def tree_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, test = _fitted(spark, sf_dir)
    return model.explain(test, "seq", 3)
