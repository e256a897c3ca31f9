"""Probes of a labelled panel: its design matrix, the gate on separable columns, leaks and the power of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scalars import uniform

from .distances import separability
from .ordered import quantiles

LEVELS, SENTINEL, GATE, THIN = 32, -1.0, 0.95, 2000


def probe_matrix(df: DataFrame, key: str, label: Column, numbers: list[str], flags: list[str], categories: list[str], most: int = LEVELS) -> DataFrame:
    """(key, y, columns): numbers with a sentinel and a null flag, flags as -1, 0 or 1, categories one-hot.

    A category with more than ``most`` levels has no columns.
    """
    columns: dict[str, Column] = {}
    for c in numbers:
        columns[c] = F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL))
        columns[f"{c}_null"] = F.col(c).isNull().cast("double")
    for c in flags:
        columns[c] = F.when(F.col(c).isNull(), -1.0).otherwise(F.col(c).cast("double"))
    for c in categories:
        levels = [r[0] for r in df.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()]
        if len(levels) <= most:
            columns |= {f"{c}={v}": F.coalesce(F.col(c).cast("string") == v, F.lit(False)).cast("double") for v in sorted(levels)}
    return df.select(key, label.alias("y"), *[v.alias(k) for k, v in columns.items()])


def gate(matrix: DataFrame, columns: list[str], most: float = GATE) -> DataFrame:
    """Per column: the greater of its rank and stump AUC, and whether it passes the gate."""
    named = matrix.select("y", *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    found = separability(named, [f"c{i}" for i in range(len(columns))])
    score = F.greatest("rank_auc", "stump_auc")
    real = F.element_at(F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"c{i}"), F.lit(c))]), F.col("column"))
    return found.select(real.alias("column"), score.alias("score"), "direction", (score < most).alias("passed"))


def gate_slices(matrix: DataFrame, columns: list[str], slices: dict[str, Column], least: int = THIN, most: float = GATE) -> DataFrame:
    """The gate within each named slice; slices with fewer than ``least`` rows are marked thin and not judged."""
    out = None
    counts = matrix.agg(*[F.count_if(v).alias(k) for k, v in slices.items()]).first()
    for name, where in slices.items():
        thin = counts[name] < least
        one = gate(matrix.where(where), columns, most).withColumn("passed", F.lit(None).cast("boolean") if thin else F.col("passed"))
        one = one.select(F.lit(name).alias("slice"), F.lit(counts[name]).cast("long").alias("n"), F.lit(thin).alias("thin"), "column", "score", "passed")
        out = one if out is None else out.unionByName(one)
    return out


def null_leaks(df: DataFrame, label: Column, columns: list[str]) -> DataFrame:
    """Per column: the AUC of its being null, folded to 0.5 .. 1, in one pass."""
    y = F.coalesce(label, F.lit(False))
    pos, neg = F.count_if(y), F.count_if(~y)
    row = df.agg(*[F.abs(F.count_if(y & F.col(c).isNull()) / pos - F.count_if(~y & F.col(c).isNull()) / neg).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), (0.5 + F.col(c) / 2).alias("auc")) for c in columns])).alias("x")).select("x.*")


def null_control(matrix: DataFrame, columns: list[str], key: str, label: str = "y", seed: str = "control", most: float = GATE) -> DataFrame:
    """The gate against a label that cannot leak: drawn by a hash of the key, as often true as the real one.

    A column that fails here fails by its shape or by too few rows, not by what it knows.
    """
    share = matrix.agg(F.avg(F.col(label).cast("double"))).first()[0] or 0.0
    drawn = uniform(seed, F.col(key)) < share
    return gate(matrix.withColumn(label, drawn), columns, most)


def target_leaks(df: DataFrame, key: str, label: Column, columns: list[str]) -> DataFrame:
    """Per category: the AUC of its target mean, each half of the rows encoded by the other half."""
    base = df.select(F.col(key).alias("key_"), label.alias("y"), *columns).withColumn("half", F.pmod(F.conv(F.substring(F.md5(F.col("key_").cast("string")), 1, 8), 16, 10).cast("long"), F.lit(2)))
    out = None
    overall = base.groupBy("half").agg(F.avg(F.col("y").cast("double")).alias("whole")).select((1 - F.col("half")).alias("half"), "whole")
    for c in columns:
        rate = base.groupBy("half", c).agg(F.avg(F.col("y").cast("double")).alias("rate")).select((1 - F.col("half")).alias("half"), F.col(c).alias("level"), "rate")
        coded = base.join(rate, (base["half"] == rate["half"]) & base[c].eqNullSafe(rate["level"]), "left").select(base["half"], "y", "rate").join(F.broadcast(overall), "half", "left")  # two rows
        one = separability(coded.select("y", F.coalesce("rate", "whole").alias("x")), ["x"]).select(F.lit(c).alias("column"), F.col("rank_auc").alias("auc"))
        out = one if out is None else out.unionByName(one)
    return out


def power(matrix: DataFrame, attack: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per pair (feature, attack): the rank AUC against all attacks and against that one; gaps filled by medians."""
    out = None
    for feature, target in pairs:
        middle = quantiles(matrix.select(F.col(feature).cast("double").alias("v")), "v", [0.5])[0]
        filled = matrix.select("y", F.col(attack).alias("attack_"), F.coalesce(F.col(feature).cast("double"), F.lit(middle)).alias("x"))
        one = separability(filled, ["x"]).select(F.col("rank_auc").alias("against_all"))
        own = separability(filled.where(~F.col("y") | (F.col("attack_") == target)), ["x"]).select(F.col("rank_auc").alias("against_target"))
        row = one.crossJoin(own).select(F.lit(feature).alias("feature"), F.lit(target).alias("attack"), "against_all", "against_target")  # one row each
        out = row if out is None else out.unionByName(row)
    return out
