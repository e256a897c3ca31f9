"""Supervised and novelty models over feature matrices."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import trees
from .ordered import average_rank, quantiles, quantiles_by


def time_split(events: DataFrame, share: float = 0.7, time: str = "t") -> tuple[DataFrame, DataFrame]:
    """Rows up to, and after, the exact quantile of time."""
    cut = quantiles(events, time, [share])[0]
    return events.where(F.col(time) <= cut), events.where(F.col(time) > cut)


def with_indicators(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Nulls become -1 beside a column that marks them; trees can tell missing from zero."""
    out = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"x_{c}") for c in columns], *[F.col(c).isNull().cast("double").alias(f"null_{c}") for c in columns])
    return out, [f"x_{c}" for c in columns] + [f"null_{c}" for c in columns]


@dataclass
class Supervised:
    columns: list[str]
    levels: list[trees.Levels]
    ensemble: object
    curve: object | None

    def assembled(self, df: DataFrame) -> DataFrame:
        """df with ``features``: numbers, their null marks, and nominal levels."""
        rows, inputs = with_indicators(df, self.columns)
        for one in self.levels:
            rows = one.apply(rows, f"level_{one.column}")
        return VectorAssembler(inputCols=[*inputs, *[f"level_{one.column}" for one in self.levels]], outputCol="features").transform(rows)

    @property
    def names(self) -> list[str]:
        """The column that each feature comes from."""
        return [*self.columns, *self.columns, *[one.column for one in self.levels]]

    def score(self, df: DataFrame) -> DataFrame:
        """df with ``l1``: calibrated, with a trace of the raw score to keep order within a step."""
        raw = vector_to_array("probability")[1]
        out = self.ensemble.transform(self.assembled(df)).withColumn("raw", raw)
        value = F.col("raw")
        if self.curve is not None:
            out = self.curve.transform(out.drop("prediction"))
            value = F.col("prediction") + 1e-6 * F.col("raw")
        return out.withColumn("l1", value).select(*df.columns, "l1")

    def importance(self) -> list[tuple[str, float]]:
        names = [f"x_{c}" for c in self.columns] + [f"null_{c}" for c in self.columns] + [f"level_{one.column}" for one in self.levels]
        return sorted(zip(names, map(float, self.ensemble.featureImportances.toArray()), strict=True), key=lambda x: -x[1])

    def contributions(self, df: DataFrame, keep: list[str], method: str = "shapley") -> DataFrame:
        """(*keep, base, margin, contributions): what each column adds to the raw score in log-odds, its null mark included; the calibration is left out."""
        model = trees.Attributor(trees.read_trees(self.ensemble, df), len(self.names), method)
        found = trees.attribute(self.assembled(df), keep, vector_to_array("features"), model)
        columns = list(dict.fromkeys(self.names))
        by_column = F.array(*[sum((F.col("contributions")[i] for i, n in enumerate(self.names) if n == c), F.lit(0.0)) for c in columns])
        return found.select(*keep, "base", "margin", F.map_from_arrays(F.array(*map(F.lit, columns)), by_column).alias("contributions"))

    def explain(self, df: DataFrame, key: str, k: int = 6, method: str = "shapley") -> DataFrame:
        """(key, rank, feature, value, contribution): the k columns that move the score most, by size and then name; a null's value is ``absent``."""
        columns = list(dict.fromkeys(self.names))
        values = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("absent")) for c in columns]))
        terms = F.transform(F.map_entries("contributions"), lambda e: F.struct((-F.abs(e["value"])).alias("size"), e["key"].alias("feature"), e["value"].alias("contribution")))
        best = self.contributions(df.withColumn("told", values), [key, "told"], method).select(key, "told", F.posexplode(F.slice(F.sort_array(terms), 1, k)).alias("rank", "x"))
        feature = F.col("x.feature")
        return best.select(key, (F.col("rank") + 1).alias("rank"), feature.alias("feature"), F.element_at("told", feature).alias("value"), F.col("x.contribution").alias("contribution"))


def fit_supervised(
    train: DataFrame, columns: list[str], label: str = "fraud", time: str = "t", rounds: int = 20, depth: int = 4, seed: int = 7, categorical: list[str] | None = None, most_levels: int = 64
) -> Supervised:
    """Boosted trees, calibrated on the last fifth of training time unless it has fewer than 10 positives.

    ``categorical`` columns are split into sets of levels; levels are numbered on the rows that the trees are fitted on.
    """
    early, late = time_split(train, 0.8, time)
    levels = trees.fit_levels(early, categorical or [], label, most_levels)
    model = Supervised(columns, levels, None, None)

    def assembled(df: DataFrame) -> DataFrame:
        return model.assembled(df).select("features", F.col(label).cast("double").alias("y"))

    bins = max([32, *[one.size for one in levels]])
    model.ensemble = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=depth, maxBins=bins, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.7", minInstancesPerNode=20, seed=seed).fit(assembled(early))
    held = assembled(late)
    if held.where("y > 0").limit(10).count() == 10:
        scored = model.ensemble.transform(held).select("y", vector_to_array("probability")[1].alias("raw"))
        model.curve = IsotonicRegression(featuresCol="raw", labelCol="y").fit(scored)
    return model


@dataclass
class Forest:
    """Isolation forest: trees as arrays, scored in Arrow batches."""

    columns: list[str]
    medians: list[float]
    grown: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    size: int
    threshold: float | None = None

    @staticmethod
    def usual_depth(n: float) -> float:
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    def score_batch(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for feature, cut, child, path in self.grown:
            at = np.zeros(len(x), np.int64)
            inner = feature[at] >= 0
            while inner.any():
                go = at[inner]
                at[inner] = child[go] + (x[inner, feature[go]] >= cut[go])
                inner = feature[at] >= 0
            depth += path[at]
        return 2.0 ** (-depth / max(len(self.grown), 1) / max(self.usual_depth(self.size), 1e-9))

    def filled(self, df: DataFrame, *keep: str) -> DataFrame:
        """The columns that the forest reads, medians for nulls."""
        return df.select(*keep, *[F.coalesce(F.col(c).cast("double"), F.lit(float(m))).alias(c) for c, m in zip(self.columns, self.medians, strict=True)])

    def score(self, df: DataFrame, key: str, out: str = "novelty") -> DataFrame:
        """(key, novelty)."""
        shared = df.sparkSession.sparkContext.broadcast(self)
        rows = self.filled(df, key)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            f = shared.value
            for b in batches:
                yield pd.DataFrame({key: b[key], out: f.score_batch(b[f.columns].to_numpy(float))})

        return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, {out} double")


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> tuple[list[int], list[float], list[int], list[float]]:
    """One isolation tree over the rows of x: feature (-1 at a leaf), cut, left child (the right one follows), path length."""
    deepest = math.ceil(math.log2(max(len(x), 2)))
    feature: list[int] = []
    cut: list[float] = []
    child: list[int] = []
    path: list[float] = []
    level, nodes = [(x, 0)], 1
    while level:
        following = []
        for rows, depth in level:
            spread = np.flatnonzero(rows.max(0) > rows.min(0)) if len(rows) > 1 else []
            if depth >= deepest or not len(spread):
                feature.append(-1); cut.append(0.0); child.append(0); path.append(depth + Forest.usual_depth(len(rows)))  # noqa: E702
                continue
            f = int(rng.choice(spread))
            c = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            right = rows[:, f] >= c
            feature.append(f); cut.append(c); child.append(nodes); path.append(0.0)  # noqa: E702
            nodes += 2
            following += [(rows[~right], depth + 1), (rows[right], depth + 1)]
        level = following
    return feature, cut, child, path


def tree_samples(rows: DataFrame, key: str, trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, place, row columns): ``sample`` rows for each tree, those of the least hashes of (seed, tree, key), drawn in one pass.

    Rows whose hash passes a bound that about twice as many as needed meet are
    ranked within their tree, so that a tree's ranking stays that small at any
    number of rows.
    """
    n = rows.count()
    share = min(1.0, (2 * sample + 64) / max(n, 1))
    most = (1 << 63) - 1
    draw = F.xxhash64(F.lit(seed), F.col("tree"), F.col(key)).bitwiseAND(F.lit(most))
    bound = F.lit(most if share >= 1 else int(share * most))
    drawn = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("draw", draw).where(F.col("draw") <= bound)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("draw", key))
    return drawn.withColumn("place", place).where(F.col("place") <= sample).drop("draw")


def fit_forest(legit: DataFrame, columns: list[str], key: str, label: str | None = None, trees: int = 100, sample: int = 256, present: float = 0.7, seed: int = 7, contamination: float | None = None) -> Forest:
    """Trees over ``sample`` legitimate rows each, drawn from all of them and grown in tasks; columns present in enough rows; medians fill gaps.

    ``contamination``: the share of training rows beyond ``threshold``.  Only the
    grown trees (``trees`` times twice ``sample`` nodes at most) come to the driver.
    """
    if label is not None and not legit.where(F.col(label)).isEmpty():
        raise ValueError("only legitimate rows may train a novelty model")
    there = legit.agg(F.count("*").alias("n_"), *[F.count(c).alias(c) for c in columns]).first()
    n = there["n_"]
    kept = [c for c in columns if n and there[c] / n >= present]
    if not kept:
        raise ValueError("no column is present in enough rows")
    long = legit.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in kept])).alias("x")).select("x.name", "x.value")
    middle = {r["name"]: r["q0"] for r in quantiles_by(long, "name", "value", [0.5]).collect()}
    forest = Forest(kept, [middle.get(c, 0.0) for c in kept], [], min(sample, n))
    picked = tree_samples(forest.filled(legit, key), key, trees, sample, seed)

    def grow(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        grown = grow_tree(group.sort_values("place")[kept].to_numpy(float), np.random.default_rng([seed, tree]))
        return pd.DataFrame({"tree": [tree], **{name: [v] for name, v in zip(("feature", "cut", "child", "path"), grown, strict=True)}})

    rows = picked.groupBy("tree").applyInPandas(grow, "tree int, feature array<long>, cut array<double>, child array<long>, path array<double>").orderBy("tree").collect()
    forest.grown = [(np.array(r["feature"]), np.array(r["cut"]), np.array(r["child"]), np.array(r["path"])) for r in rows]
    if contamination is not None:
        forest.threshold = quantiles(forest.score(legit, key), "novelty", [1 - contamination])[0]
    return forest


def entity_novelty(vectors: DataFrame, columns: list[str], key: str, least: int = 3, **fit) -> DataFrame:
    """(key, novelty): rank of the forest's score among entities with enough events, 0 to 1."""
    from corvane.plans.session import checkpointed

    rows = checkpointed(vectors.where(F.col("n") >= least))
    scored = fit_forest(rows, columns, key, **fit).score(rows, key)
    scored = checkpointed(scored)
    n = rows.count()
    return scored.join(average_rank(scored, "novelty"), "novelty").select(key, (F.col("rank") / max(n, 1)).alias("novelty"))


def event_novelty(events: DataFrame, customers: DataFrame, merchants: DataFrame) -> DataFrame:
    """(seq, novelty): the greater of two entities' ranks, 0 where unknown."""
    c, m = customers.select("customer", F.col("novelty").alias("nc")), merchants.select("merchant", F.col("novelty").alias("nm"))
    return events.join(c, "customer", "left").join(m, "merchant", "left").select("seq", F.greatest(F.coalesce("nc", F.lit(0.0)), F.coalesce("nm", F.lit(0.0))).alias("novelty"))


def leave_one_out(train: DataFrame, test: DataFrame, columns: list[str], family: Column, families: list[str], rate: float = 0.01) -> list[dict]:
    """Per family: recall with it in training and with it held out, each at its own threshold."""
    from .metrics import threshold_at_fpr

    def recall(fit_on: DataFrame, of: str) -> float | None:
        scored = fit_supervised(fit_on, columns).score(test).withColumn("score", F.col("l1"))
        t = threshold_at_fpr(scored, rate)
        r = scored.where(F.col("fraud") & (family == of)).agg(F.count("*").alias("n"), F.count_if(F.col("score") >= t).alias("hit")).first()
        return r["hit"] / r["n"] if r["n"] else None

    return [{"family": f, "with": recall(train, f), "held_out": recall(train.where(~F.col("fraud") | (family != f)), f)} for f in families]


def ablation(train: DataFrame, test: DataFrame, columns: list[str], drop: str) -> tuple[dict, dict]:
    """Areas with and without one column."""
    from .metrics import areas

    def fitted(cols: list[str]) -> dict:
        return areas(fit_supervised(train, cols).score(test).withColumn("score", F.col("l1"))).first().asDict()

    return fitted(columns), fitted([c for c in columns if c != drop])
