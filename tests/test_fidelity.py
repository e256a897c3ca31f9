"""Fidelity measures against plain readings."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import distances, fidelity


def panel(spark, n, seed, shift=0.0):
    rng = random.Random(seed)
    rows = [(i, rng.random() < 0.1, rng.gauss(shift, 1), rng.gauss(0, 1), float(rng.randrange(4)), rng.choice(["a", "b", "c"])) for i in range(n)]
    return spark.createDataFrame(rows, "seq long, fraud boolean, x double, y double, z double, name string")


def test_folds_are_balanced(spark):
    rows = fidelity.folded(panel(spark, 103, 1), panel(spark, 71, 2), 5, 1000)
    counts = {(r["y0"], r["fold"]): r["count"] for r in rows.groupBy("y0", "fold").count().collect()}
    assert len(counts) == 10 and set(counts.values()) <= {14, 15} and sum(counts.values()) == 142
    assert fidelity.folded(panel(spark, 103, 1), panel(spark, 71, 2), 5, 20).count() == 40


def test_discrimination_names_the_column(spark):
    a, b = panel(spark, 500, 1, 2.0), panel(spark, 400, 2)
    found = fidelity.discrimination(a, b, ["x", "y", "z"], folds=3, per_side=300, rounds=3)
    by = {r["column"]: r for r in found.columns.collect()}
    assert found.auc > 0.85 and found.per_side == 300 and [r["column"] for r in found.columns.collect()][0] == "x"
    assert by["x"]["alone_auc"] > 0.85 and by["y"]["alone_auc"] < 0.6
    assert sum(r["contribution_share"] for r in by.values()) == pytest.approx(1) and sum(r["gain_share"] for r in by.values()) == pytest.approx(1)
    same = fidelity.naive_contrast(a.withColumn("name", F.lit("mine")), a.withColumn("name", F.lit("theirs")), ["x", "name"], ["x", "y"], folds=2, per_side=200, rounds=2).first()
    assert same["naive_auc"] > 0.95 > same["shape_auc"]  # a name gives the panel away, the shape does not


def test_marginals(spark):
    a, b = panel(spark, 300, 1, 1.0), panel(spark, 200, 2)
    out = {r["column"]: r for r in fidelity.marginals(a, b, ["x", "y", "z"]).collect()}
    assert list(out) == sorted(out, key=lambda c: (-out[c]["ratio"], c)) and next(iter(out)) == "x"
    for c, r in out.items():
        for side, df in (("synthetic", a), ("real", b)):
            v = np.array([x[c] for x in df.collect()])
            assert r[f"median_{side}"] == pytest.approx(np.median(v)) and r[f"iqr_{side}"] == pytest.approx(np.subtract(*np.percentile(v, [75, 25])))
        one = distances.ks_two_sample(a, b, c).first()
        assert (r["ks"], r["band"]) == (one["ks"], one["band"])


def test_ks_against_a_mixture(spark):
    rng = random.Random(1)
    parts = [(2.0, 1.0, 0.5), (1.0, 3.0, 0.2)]
    values = [round(math.exp(rng.gauss(1.2, 0.6)), 1) for _ in range(400)] + [0.0, 0.0, -3.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")

    def cdf(v):
        return sum(w / 3 * 0.5 * (1 + math.erf((math.log(v) - m) / s / math.sqrt(2))) for w, m, s in parts) if v > 0 else 0.0

    n, want = len(values), 0.0
    for v in set(values):
        below, upto = sum(x < v for x in values) / n, sum(x <= v for x in values) / n
        want = max(want, abs(upto - cdf(v)), abs(below - cdf(v)))
    got = distances.ks_mixture(df, "v", parts).first()
    assert got["n"] == n and got["ks"] == pytest.approx(want, abs=got["error_bound"]) and got["band"] == pytest.approx(1.63 / math.sqrt(n), abs=1e-9)


def test_correlation_distance(spark):
    a, b = panel(spark, 300, 1), panel(spark, 300, 2)
    tied = b.withColumn("y", F.round(F.col("x"), 0))
    gaps = distances.correlation_gap(a, tied, ["x", "y", "z"])
    rows = {(r["a"], r["b"]): r["gap"] for r in gaps.collect()}
    whole, worst = distances.correlation_distance(gaps, 2)
    one = whole.first()
    assert one["frobenius"] == pytest.approx(math.sqrt(2 * sum(g * g for g in rows.values())), abs=1e-8) and one["rms_off_diagonal"] == pytest.approx(math.sqrt(sum(g * g for g in rows.values()) / 3), abs=1e-8)
    assert [(r["a"], r["b"]) for r in worst.collect()] == sorted(rows, key=lambda p: (-abs(rows[p]), p))[:2]
