"""Distances between distributions, rank correlations and separability of columns."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.scalars import draw, uniform

from .ordered import long_form, running, running_by
from .skew import look_up


def shares(df: DataFrame, level: str) -> DataFrame:
    """(level, share) over non-null levels."""
    n = df.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("level")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("level", (F.col("n").cast("double") / F.col("total")).alias("share"))  # one row of totals


def aligned(a: DataFrame, b: DataFrame, level: str) -> DataFrame:
    """(level, p, q): shares in both, zero where absent."""
    both = shares(a, level).alias("a").join(shares(b, level).alias("b"), "level", "full_outer")
    return both.select("level", F.coalesce("a.share", F.lit(0.0)).alias("p"), F.coalesce("b.share", F.lit(0.0)).alias("q"))


def jsd(a: DataFrame, b: DataFrame, level: str) -> DataFrame:
    """Jensen-Shannon divergence in bits, total variation and the level that differs most."""
    m = (F.col("p") + F.col("q")) / 2
    def part(x: str) -> Column:
        return F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / m)).otherwise(0.0)
    gap = F.abs(F.col("p") - F.col("q"))
    return aligned(a, b, level).agg(F.round(F.sum((part("p") + part("q")) / 2), 9).alias("jsd"), F.round(F.sum(gap) / 2, 9).alias("total_variation"), F.round(F.max(gap), 9).alias("largest_gap"))


def _round_divergence(counts: DataFrame, target: dict[str, float], level: float) -> float:
    """Over counts(round, level, n): the quantile, across rounds, of the divergence of each round's shares from the target's, in bits."""
    wanted = F.create_map(*[x for k, p in target.items() for x in (F.lit(k), F.lit(p / sum(target.values())))])
    whole = counts.groupBy("round").agg(F.sum("n").alias("whole"))
    q = F.col("n").cast("double") / F.col("whole")
    p = F.element_at(wanted, F.col("level"))
    m = (p + q) / 2
    # A level that a round did not draw adds half its target share; the others' target shares are known.
    seen = counts.join(whole, "round").groupBy("round").agg(F.sum(F.when(q > 0, q * F.log2(q / m)).otherwise(0.0) + p * F.log2(p / m)).alias("d"), F.sum(p).alias("p"))
    return float(seen.select(((F.col("d") + (1 - F.col("p"))) / 2).alias("jsd")).agg(F.percentile("jsd", level)).first()[0])


def chance_divergence(spark: SparkSession, target: dict[str, float], n: int, rounds: int = 200, level: float = 0.99, seed: int = 7) -> float:
    """What divergence n independent events reach by chance: each round draws the counts of all levels, one after another.

    0 if there is but one level; infinite without events.
    """
    target = {k: p for k, p in target.items() if p > 0}
    if len(target) < 2:
        return 0.0
    if n <= 0:
        return math.inf

    def draw_rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, p = list(target), np.array(list(target.values()))
        for b in batches:
            for r in b["round"]:
                yield pd.DataFrame({"round": r, "level": names, "n": np.random.default_rng([seed, int(r)]).multinomial(n, p / p.sum())})

    return _round_divergence(spark.range(rounds).select(F.col("id").alias("round")).mapInPandas(draw_rounds, "round long, level string, n long"), target, level)


def chance_divergence_by_entity(entities: DataFrame, target: dict[str, float], rounds: int = 200, level: float = 0.99, seed: int = 7) -> float:
    """The same where each entity of entities(key, n) draws one level for all of its n events."""
    target = {k: p for k, p in target.items() if p > 0}
    if len(target) < 2 or entities.where("n > 0").isEmpty():
        return 0.0
    cast = entities.where("n > 0").select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round"))
    drawn = cast.select("round", draw(uniform(str(seed), F.col("round"), F.col("key")), target).alias("level"), "n")
    return _round_divergence(drawn.groupBy("round", "level").agg(F.sum("n").alias("n")), target, level)


def over_band(distance: float, band: float) -> float:
    """distance / band, with 0 / 0 = 0."""
    return distance / band if band else (math.inf if distance else 0.0)


def ks_two_sample(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Greatest gap of the two empirical distributions, and the band 1.63 * sqrt((n + m) / (n * m))."""
    both = a.select(F.col(value).alias("v"), F.lit(1).alias("x"), F.lit(0).alias("y")).unionByName(b.select(F.col(value).alias("v"), F.lit(0).alias("x"), F.lit(1).alias("y")))
    r = running(both, "v", {"x": F.col("x"), "y": F.col("y")})
    n = both.where(F.col("v").isNotNull()).agg(F.sum("x").alias("n"), F.sum("y").alias("m"))
    gap = F.abs((F.col("x") + F.col("x_below")).cast("double") / F.col("n") - (F.col("y") + F.col("y_below")).cast("double") / F.col("m"))
    out = r.crossJoin(F.broadcast(n)).agg(F.max("n").alias("n"), F.max("m").alias("m"), F.max(gap).alias("ks"))  # one row of totals
    return out.select("n", "m", F.round("ks", 9).alias("ks"), F.round(1.63 * F.sqrt((F.col("n") + F.col("m")).cast("double") / (F.col("n") * F.col("m"))), 9).alias("band"))


def normal_cdf(x: Column) -> Column:
    """The normal distribution function, by a rational approximation good to 1.5e-7."""
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - (((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * F.exp(-z * z)
    return F.when(x >= 0, (1 + erf) / 2).otherwise((1 - erf) / 2)


def ks_lognormal(df: DataFrame, value: str, mean: float, std: float) -> DataFrame:
    """One-sample KS of positive values against a lognormal."""
    r = running(df.where(F.col(value) > 0), value, {"n": F.lit(1)})
    total = df.where(F.col(value) > 0).agg(F.count("*").alias("total"))
    cdf = normal_cdf((F.log(F.col(value).cast("double")) - mean) / std)
    hi, lo = (F.col("n") + F.col("n_below")).cast("double") / F.col("total"), F.col("n_below").cast("double") / F.col("total")
    return r.crossJoin(F.broadcast(total)).agg(F.round(F.max(F.greatest(F.abs(hi - cdf), F.abs(lo - cdf))), 6).alias("ks"))  # one row of totals


def mixture_cdf(value: Column, parts: list[tuple[float, float, float]]) -> Column:
    """The distribution function of log-normals (weight, mean, deviation of the logarithm) mixed by weight; 0 at or below zero."""
    total = sum(w for w, _, _ in parts)
    mixed = sum((normal_cdf((F.log(value) - mean) / std) * (w / total) for w, mean, std in parts), F.lit(0.0))
    return F.when(value > 0, mixed).otherwise(0.0)


def ks_mixture(df: DataFrame, value: str, parts: list[tuple[float, float, float]]) -> DataFrame:
    """One-sample KS against a mixture of log-normals: n, ks, band (1.63 / sqrt(n)) and the bound of the error of ks.

    The gap is taken on both sides of each distinct value, so ties and values at or
    below zero count in full.
    """
    r = running(df.select(F.col(value).cast("double").alias("v")), "v", {"n": F.lit(1)})
    total = df.where(F.col(value).isNotNull()).agg(F.count("*").alias("total"))
    cdf = mixture_cdf(F.col("v"), parts)
    hi, lo = (F.col("n") + F.col("n_below")).cast("double") / F.col("total"), F.col("n_below").cast("double") / F.col("total")
    gaps = r.crossJoin(F.broadcast(total)).agg(F.max("total").alias("n"), F.max(F.greatest(F.abs(hi - cdf), F.abs(lo - cdf))).alias("ks"))  # one row of totals
    return gaps.select("n", F.round("ks", 9).alias("ks"), F.round(1.63 / F.sqrt(F.col("n").cast("double")), 9).alias("band"), F.lit(1.5e-7).alias("error_bound"))


def ks_columns(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """(name, n, m, ks, band) of each column: ``ks_two_sample`` of all of them in one pass; null where one side has no values."""
    both = long_form(a, columns).withColumn("x", F.lit(1)).unionByName(long_form(b, columns).withColumn("x", F.lit(0)))
    r = running_by(both, "name", "value", {"x": F.col("x"), "y": 1 - F.col("x")})
    share = lambda c: F.try_divide((F.col(c) + F.col(f"{c}_below")).cast("double"), F.col(f"{c}_all"))
    out = r.groupBy("name").agg(F.max("x_all").alias("n"), F.max("y_all").alias("m"), F.max(F.abs(share("x") - share("y"))).alias("ks"))
    return out.select("name", "n", "m", F.round("ks", 9).alias("ks"), F.round(1.63 * F.sqrt(F.try_divide((F.col("n") + F.col("m")).cast("double"), F.col("n") * F.col("m"))), 9).alias("band"))


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, rho) for every pair of columns, over rows without nulls in them.

    The ranks of all columns come from one long table; a frequent value meets its rank by broadcast.
    """
    from corvane.plans.session import checkpointed

    whole = checkpointed(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna())
    r = running_by(long_form(whole, columns), "name", "value", {"n": F.lit(1)})
    ranks = checkpointed(r.select("name", "value", (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank")))
    ranked = whole
    for c in columns:
        ranked = look_up(ranked, c, ranks.where(F.col("name") == c).select(F.col("value").alias("at_"), F.col("rank").alias(f"r_{c}")), "at_")
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    out = ranked.agg(*[F.corr(f"r_{a}", f"r_{b}").alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return out.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(f"c{i}", 9).alias("rho")) for i, (a, b) in enumerate(pairs)])).alias("x")).select("x.*")


def correlation_gap(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Per pair: rho in both frames and their difference."""
    return spearman(a, columns).withColumnRenamed("rho", "rho_a").join(spearman(b, columns).withColumnRenamed("rho", "rho_b"), ["a", "b"]).withColumn("gap", F.round(F.col("rho_a") - F.col("rho_b"), 9))


def correlation_distance(gaps: DataFrame, worst: int = 5) -> tuple[DataFrame, DataFrame]:
    """Of ``correlation_gap``: one row with the Frobenius distance of the two matrices and the root mean square of an entry off the diagonal, and the worst pairs.

    Both triangles count in the distance; an undefined coefficient counts as equal.
    """
    square = F.coalesce(F.col("gap") * F.col("gap"), F.lit(0.0))
    whole = gaps.agg(F.round(F.sqrt(2 * F.sum(square)), 9).alias("frobenius"), F.round(F.sqrt(F.avg(square)), 9).alias("rms_off_diagonal"))
    return whole, gaps.orderBy(F.abs(F.coalesce("gap", F.lit(0.0))).desc(), "a", "b").limit(worst)


def separability(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column: rank AUC of the label ``y`` (folded to 0.5 .. 1), its direction, and the best one-split stump's AUC; all columns in one pass."""
    r = running_by(long_form(df, columns, "y"), "name", "value", {"pos": F.col("y").cast("long"), "neg": (~F.col("y")).cast("long")})
    tpr, fpr = F.try_divide((F.col("pos") + F.col("pos_below")).cast("double"), F.col("pos_all")), F.try_divide((F.col("neg") + F.col("neg_below")).cast("double"), F.col("neg_all"))
    one = r.groupBy("name").agg(F.sum(F.col("pos") * (2 * F.col("neg_below") + F.col("neg"))).alias("pairs"), F.max("pos_all").alias("p"), F.max("neg_all").alias("n"), F.max(F.abs(tpr - fpr)).alias("gap"))
    auc = F.try_divide(F.col("pairs").cast("double") / 2, F.col("p") * F.col("n"))
    return one.select(F.col("name").alias("column"), F.round(F.greatest(auc, 1 - auc), 9).alias("rank_auc"), F.when(auc >= 0.5, "up").otherwise("down").alias("direction"), F.round(0.5 + F.col("gap") / 2, 9).alias("stump_auc"))


def functional_dependency(df: DataFrame, columns: list[str], mask: Column) -> DataFrame:
    """(groups, mixed): groups of equal columns, and those in which the mask is not constant."""
    g = df.groupBy(*columns).agg(F.count_if(mask).alias("yes"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.count_if((F.col("yes") > 0) & (F.col("yes") < F.col("n"))).alias("mixed"))


def top_share(df: DataFrame, key: str, share: float) -> DataFrame:
    """Share of rows that the busiest keys (the given share of keys, at least one) have, and the peak-to-least ratio."""
    n = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("rows"), F.count("*").alias("keys"), F.max("n").alias("most"), F.min("n").alias("least"))
    r = running(n.withColumn("down", -F.col("n")), "down", {"k": F.lit(1), "s": F.col("n")})
    top = r.crossJoin(F.broadcast(total)).withColumn("limit", F.greatest(F.lit(1), F.floor(F.col("keys") * share)))  # one row of totals
    taken = F.least(F.greatest(F.col("limit") - F.col("k_below"), F.lit(0)), F.col("k")) * (F.col("s") / F.col("k"))
    return top.agg(F.round(F.sum(taken) / F.max("rows"), 9).alias("top_share"), (F.max("most").cast("double") / F.max("least")).alias("peak_ratio"))


def digest(df: DataFrame, order: list[str]) -> DataFrame:
    """A digest of the frame's rows that depends on their order by ``order``."""
    w = Window.partitionBy(F.pmod(F.xxhash64(*order), F.lit(64))).orderBy(*order)
    row = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    marked = df.select(row.alias("h"), F.row_number().over(w).alias("r"), F.pmod(F.xxhash64(*order), F.lit(64)).alias("g"))
    per = marked.groupBy("g").agg(F.sum(F.xxhash64("h", "r").cast("decimal(38,0)")).alias("s"))
    return per.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("g", "s"))), lambda x: x["s"].cast("string")), ","), 256).alias("digest"))  # 64 rows
