"""How close a synthetic panel is to a real one: common shape, marginals, transfer, discriminator, adjudication."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import distances, metrics, sequences, trees
from .ordered import long_form, quantiles_by

SHAPE = ["robust_z", "deviation", "gap", "gap_ratio", "burst_1h", "rank_pct", "category_shift", "hour"]


def common(events: DataFrame) -> DataFrame:
    """Purchases on classic rails only: seq, t, customer, merchant, category, amount, cents, fraud."""
    return events.where("agent is null and not refund").select("seq", "t", "customer", "merchant", "category", "amount", "cents", "fraud")


def shape(rows: DataFrame) -> DataFrame:
    """The shape matrix: eight features free of scale and of names."""
    out = rows.select("seq", "merchant", "fraud", (F.floor(F.col("t") / 3_600_000_000) % 24).alias("hour"))
    for block in (sequences.robust_z(rows, "category", "amount"), sequences.deviation(rows), sequences.gaps(rows), sequences.category_shift(rows, category="category")):
        out = out.join(block, "seq", "left")
    return out.join(sequences.popularity_rank(rows).select("merchant", "rank_pct"), "merchant", "left").select("seq", "fraud", *[F.col(c).cast("double").alias(c) for c in SHAPE])


def marginals(synthetic: DataFrame, real: DataFrame, columns: list[str] = SHAPE) -> DataFrame:
    """Per column: KS, its band, their ratio, and the medians and interquartile ranges of both; the worst first."""
    out = distances.ks_columns(synthetic, real, columns)
    for side, df in (("synthetic", synthetic), ("real", real)):
        q = quantiles_by(long_form(df, columns), "name", "value", [0.25, 0.5, 0.75])
        out = out.join(q.select("name", F.col("q1").alias(f"median_{side}"), (F.col("q2") - F.col("q0")).alias(f"iqr_{side}")), "name", "left")
    ratio = F.when(F.col("band") > 0, F.col("ks") / F.col("band")).otherwise(0.0)
    return out.select(F.col("name").alias("column"), "ks", "band", ratio.alias("ratio"), "median_synthetic", "median_real", "iqr_synthetic", "iqr_real").orderBy(F.desc("ratio"), "column")


def level_marginals(synthetic: DataFrame, real: DataFrame, columns: list[str]) -> DataFrame:
    """Per column of levels: Jensen-Shannon divergence in bits, how many levels, and the level whose share differs most (of equal ones the first); the worst first."""
    def counted(df: DataFrame, side: str) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("")).alias("level")) for c in columns])
        n = df.select(F.explode(cells).alias("x")).groupBy("x.column", "x.level").agg(F.count("*").alias("n"))
        return n.join(n.groupBy("column").agg(F.sum("n").alias("all")), "column").select("column", "level", (F.col("n") / F.col("all")).alias(side))

    both = counted(synthetic, "p").join(counted(real, "q"), ["column", "level"], "full_outer").select("column", "level", F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    m, gap = (F.col("p") + F.col("q")) / 2, F.abs(F.col("p") - F.col("q"))
    part = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    out = both.groupBy("column").agg(F.round(F.sum((part("p") + part("q")) / 2), 9).alias("jsd"), F.count("*").alias("levels"), F.min(F.struct((-F.round(gap, 9)).alias("gap"), "level")).alias("worst"))
    return out.select("column", "jsd", "levels", F.col("worst.level").alias("worst_level"), (-F.col("worst.gap")).alias("worst_gap")).orderBy(F.desc("jsd"), "column")


def _features(df: DataFrame, columns: list[str], y: str) -> DataFrame:
    filled = df.select(F.col(y).cast("double").alias("label_"), *[F.coalesce(c, F.lit(-9.0)).alias(c) for c in columns], *[c for c in ("fold", "seq") if c in df.columns])
    return VectorAssembler(inputCols=columns, outputCol="features").transform(filled)


def _trees(df: DataFrame, columns: list[str], y: str, rounds: int) -> object:
    return GBTClassifier(labelCol="label_", maxIter=rounds, maxDepth=4, seed=7).fit(_features(df, columns, y))


def _fit(df: DataFrame, columns: list[str], y: str, rounds: int) -> Callable[[DataFrame], DataFrame]:
    model = _trees(df, columns, y, rounds)
    return lambda d: model.transform(_features(d, columns, y)).select((F.col("label_") > 0).alias("fraud"), vector_to_array("probability")[1].alias("score"))


def transfer(synthetic: DataFrame, real: DataFrame, columns: list[str] = SHAPE, rounds: int = 10) -> dict[str, float]:
    """Train on one panel and test on the other (halves by a hash of seq): average precision of each pair and the transfer ratio."""
    half = F.pmod(F.xxhash64("seq"), F.lit(2)) == 0
    on_real, on_synthetic = _fit(real.where(half), columns, "fraud", rounds), _fit(synthetic, columns, "fraud", rounds)
    held = real.where(~half)
    def ap(d: DataFrame) -> float:
        return float(metrics.areas(d).first()["auc_pr"] or 0.0)
    out = {"tstr": ap(on_synthetic(held)), "trtr": ap(on_real(held)), "trts": ap(on_real(synthetic))}
    return out | {"transfer_ratio": out["tstr"] / out["trtr"] if out["trtr"] else 0.0}


@dataclass
class Discrimination:
    """Out-of-fold AUC, rows a side, and a table by column: alone_auc, gain_share, mean_abs_contribution, contribution_share."""

    auc: float
    per_side: int
    columns: DataFrame


def folded(synthetic: DataFrame, real: DataFrame, folds: int, per_side: int) -> DataFrame:
    """Equally many rows of both sides (``y0``), those of the least hashes of seq, at most ``per_side``, dealt to ``fold`` in turn.

    Every fold has the same number of rows of each side, but for one row.
    """
    from corvane.plans.session import checkpointed

    def side(df: DataFrame, y: int) -> DataFrame:
        return df.withColumn("hash_", F.xxhash64(F.lit(y), "seq")).orderBy("hash_", "seq").limit(per_side).withColumn("y0", F.lit(y))  # a bounded sample: at most ``per_side`` rows

    a, b = checkpointed(side(synthetic, 1)), checkpointed(side(real, 0))
    n = min(a.count(), b.count())
    placed = [x.withColumn("place_", F.row_number().over(Window.partitionBy("y0").orderBy("hash_", "seq")) - 1).where(F.col("place_") < n) for x in (a, b)]
    return placed[0].unionByName(placed[1], allowMissingColumns=True).withColumn("fold", (F.col("place_") % folds).cast("int")).drop("hash_", "place_")


def discrimination(synthetic: DataFrame, real: DataFrame, columns: list[str] = SHAPE, folds: int = 5, per_side: int = 20_000, rounds: int = 10) -> Discrimination:
    """How well trees tell the panels apart out of fold, over balanced samples of at most ``per_side`` rows, and by which columns.

    Gains are summed over the folds' models; contributions are those of the last
    fold's model to its own held-out rows.
    """
    from corvane.plans.session import checkpointed

    rows = checkpointed(folded(synthetic, real, folds, per_side))
    out, gains, model = None, np.zeros(len(columns)), None
    for k in range(folds):
        model = _trees(rows.where(F.col("fold") != k), columns, "y0", rounds)
        gains += np.array(model.featureImportances.toArray())
        one = model.transform(_features(rows.where(F.col("fold") == k), columns, "y0")).select((F.col("label_") > 0).alias("fraud"), vector_to_array("probability")[1].alias("score"))
        out = one if out is None else out.unionByName(one)
    held = _features(rows.where(F.col("fold") == folds - 1), columns, "y0")
    told = trees.attribute(held, ["label_"], vector_to_array("features"), trees.Attributor(trees.read_trees(model, held), len(columns)))
    mean = told.agg(*[F.avg(F.abs(F.col("contributions")[i])).alias(f"m{i}") for i in range(len(columns))]).first()
    sizes, whole = [float(mean[f"m{i}"] or 0.0) for i in range(len(columns))], float(gains.sum()) or 1.0
    table = held.sparkSession.createDataFrame([(c, float(gains[i]) / whole, sizes[i], sizes[i] / (sum(sizes) or 1.0)) for i, c in enumerate(columns)], "column string, gain_share double, mean_abs_contribution double, contribution_share double")
    filled = rows.select((F.col("y0") == 1).alias("y"), *[F.coalesce(F.col(c).cast("double"), F.lit(-9.0)).alias(f"x_{c}") for c in columns])
    alone = distances.separability(filled, [f"x_{c}" for c in columns]).select(F.expr("substring(column, 3)").alias("column"), F.col("rank_auc").alias("alone_auc"))
    by_column = table.join(alone, "column").select("column", "alone_auc", "gain_share", "mean_abs_contribution", "contribution_share").orderBy(F.desc("contribution_share"), "column")
    return Discrimination(float(metrics.areas(checkpointed(out)).first()["roc_auc"] or 0.5), rows.count() // 2, by_column)


def discriminate(synthetic: DataFrame, real: DataFrame, columns: list[str] = SHAPE, **options) -> float:
    """The out-of-fold AUC alone."""
    return discrimination(synthetic, real, columns, **options).auc


def naive_contrast(synthetic: DataFrame, real: DataFrame, raw: list[str], columns: list[str] = SHAPE, **options) -> DataFrame:
    """One row: the AUC over raw columns (ids, currency and all) beside that over the shape, and their difference; ids are taken as hashes."""
    def hashed(df: DataFrame) -> DataFrame:
        kinds = dict(df.dtypes)
        return df.select("seq", *[(F.pmod(F.xxhash64(c), F.lit(1 << 20)) if kinds[c] in ("string", "boolean") else F.col(c)).cast("double").alias(c) for c in raw])

    naive, shaped = discriminate(hashed(synthetic), hashed(real), raw, **options), discriminate(synthetic, real, columns, **options)
    return synthetic.sparkSession.createDataFrame([(naive, shaped, naive - shaped)], "naive_auc double, shape_auc double, difference double")


def ablation_path(synthetic: DataFrame, real: DataFrame, columns: list[str] = SHAPE, most: int = 3, **fit) -> list[tuple[str, float]]:
    """Drop, one after another, the column that tells the panels apart best by itself; AUC of the rest."""
    labelled = synthetic.withColumn("y", F.lit(True)).select("y", *columns).unionByName(real.withColumn("y", F.lit(False)).select("y", *columns))
    order = [r["column"] for r in distances.separability(labelled, columns).orderBy(F.desc("rank_auc"), "column").collect()]
    left, out = list(columns), []
    for c in order[:most]:
        left.remove(c)
        out.append((c, discriminate(synthetic, real, left, **fit)))
    return out


def adjudicate(rows: DataFrame) -> DataFrame:
    """One row: peak-to-trough ratio of the hours and the share of the busiest tenth of merchants, with verdicts."""
    hours = rows.groupBy((F.floor(F.col("t") / 3_600_000_000) % 24).alias("h")).agg(F.count("*").alias("n")).agg((F.max("n").cast("double") / F.min("n")).alias("peak_to_trough"))
    top = distances.top_share(rows, "merchant", 0.1).select("top_share")
    verdict = F.when(F.col("peak_to_trough") < 1.5, "flat clock").otherwise("diurnal")
    return hours.crossJoin(F.broadcast(top)).select("peak_to_trough", "top_share", verdict.alias("clock"), F.when(F.col("top_share") < 0.15, "uniform estate").otherwise("concentrated").alias("estate"))  # one row each


def drift(events: DataFrame, priors: dict[str, dict[str, float]]) -> DataFrame:
    """Per column and level: observed share, prior share and their gap."""
    out = None
    for column, prior in priors.items():
        target = events.sparkSession.createDataFrame(list(prior.items()), "level string, prior double")
        one = distances.shares(events.withColumn("level_", F.col(column).cast("string")), "level_").join(target, "level", "full_outer")
        one = one.select(F.lit(column).alias("column"), "level", F.coalesce("share", F.lit(0.0)).alias("observed"), F.coalesce("prior", F.lit(0.0)).alias("prior"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("gap", F.col("observed") - F.col("prior"))


def passive_share(observed: float, passive: float, human: float) -> float:
    """The mixing weight of passive events that explains an observed rate."""
    return min(1.0, max(0.0, (observed - human) / (passive - human))) if passive != human else 0.0
