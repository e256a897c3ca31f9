"""Levels, attributions and the isolation forest against plain readings."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from corvane.operators import metrics, models, ordered, trees


def labelled(spark, n=3000, seed=5, levels=9):
    """The label depends on a set of levels and, for half of the rows, on a number."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c, d, x = rng.randrange(levels), rng.choice(["u", "v", None]), rng.random() if rng.random() > 0.1 else None
        y = (c % 3 == 1) != ((x or 0) > 0.7 and d != "v")
        rows.append((i, i, f"c{c}", d, x, y if rng.random() > 0.05 else not y))
    return spark.createDataFrame(rows, "seq long, t long, c string, d string, x double, fraud boolean")


@pytest.fixture(scope="module")
def fitted(spark):
    data = labelled(spark)
    return data, models.fit_supervised(data, ["x"], rounds=6, depth=4, categorical=["c", "d"])


def test_sets_of_levels_are_learnt_and_unseen_levels_score(spark, fitted):
    data, model = fitted
    area = lambda m: metrics.areas(m.score(labelled(spark, seed=6)).withColumn("score", F.col("l1"))).first()["roc_auc"]
    assert area(model) > 0.9
    assert area(models.fit_supervised(data, ["x"], rounds=6, depth=4)) < 0.7  # the numbers alone do not tell
    odd = spark.createDataFrame([(1, 1, "never seen", "u", 0.5, False), (2, 2, None, None, None, False)], data.schema)
    assert all(0 <= r["l1"] <= 1 for r in model.score(odd).collect()) and model.score(odd).columns == [*data.columns, "l1"]


def test_many_levels_share_numbers_in_the_order_of_the_target(spark):
    data = labelled(spark, levels=200)
    table = {r["level"]: r for r in trees.level_numbers(data, "c", "fraud", 16).collect()}
    assert len(table) == 200 and {r["number"] for r in table.values()} <= set(range(2, 16))
    by_mean = sorted(table.values(), key=lambda r: (r["positives"] / r["n"], r["level"]))
    below, total = 0, sum(r["n"] for r in by_mean)
    for r in by_mean:
        assert r["number"] == 2 + below * 14 // total
        below += r["n"]
    assert metrics.areas(models.fit_supervised(data, [], rounds=6, depth=4, categorical=["c"], most_levels=16).score(labelled(spark, seed=6, levels=200)).withColumn("score", F.col("l1"))).first()["roc_auc"] > 0.7
    assert trees.fit_levels(data.where("false"), ["c"], "fraud")[0].size == 2


def given(tree, x, known, node=0):
    """The mean of a tree's value where only the columns ``known`` are."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if f in known:
        return given(tree, x, known, a if tree.goes_left(node, x[None, f])[0] else b)
    return (tree.cover[a] * given(tree, x, known, a) + tree.cover[b] * given(tree, x, known, b)) / (tree.cover[a] + tree.cover[b])


def plain_shapley(tree, x, features):
    out = np.zeros(features)
    for j in range(features):
        rest = [i for i in range(features) if i != j]
        for k in range(features):
            for known in itertools.combinations(rest, k):
                out[j] += math.factorial(k) * math.factorial(features - k - 1) / math.factorial(features) * (given(tree, x, {*known, j}) - given(tree, x, set(known)))
    return out


def plain_path(tree, x, features):
    out, node = np.zeros(features), 0
    mean = lambda n: given(tree, x, set(), n)
    while tree.feature[node] >= 0:
        f = tree.feature[node]
        child = tree.left[node] if tree.goes_left(node, x[None, f])[0] else tree.right[node]
        out[f] += mean(child) - mean(node)
        node = child
    return out


@pytest.mark.parametrize("tabled", [8, 1])
@pytest.mark.parametrize(("method", "plain"), [("shapley", plain_shapley), ("path", plain_path)])
def test_contributions_equal_brute_force(spark, fitted, monkeypatch, method, plain, tabled):
    monkeypatch.setattr(trees, "TABLED", tabled)
    data, model = fitted
    rows = model.assembled(data.limit(40)).select("seq", vector_to_array("features").alias("x"), "features")
    raw = {r["seq"]: r["raw"] for r in model.ensemble.transform(rows).select("seq", (vector_to_array("rawPrediction")[1]).alias("raw")).collect()}
    ensemble = trees.read_trees(model.ensemble, data)
    # Every row goes where Spark sends it, and the parts add up.
    a = trees.Attributor(ensemble, len(model.names), method)
    x = np.array([r["x"] for r in rows.orderBy("seq").collect()])
    assert a.margins(x) == pytest.approx([raw[s] for s in sorted(raw)], abs=1e-9)
    found = a.contributions(x)
    assert found.sum(1) + a.base == pytest.approx(a.margins(x), abs=1e-9)
    for r in range(len(x)):
        assert found[r] == pytest.approx(sum(t.weight * plain(t, x[r], len(model.names)) for t in ensemble), abs=1e-9)


def test_explanations(spark, fitted):
    data, model = fitted
    rows = {r["seq"]: r for r in model.contributions(data, ["seq"]).collect()}
    assert len(rows) == data.count()
    for r in rows.values():
        assert r["base"] + sum(r["contributions"].values()) == pytest.approx(r["margin"], abs=1e-9)
    told = {}
    for r in model.explain(data, "seq", 2).collect():
        told.setdefault(r["seq"], []).append(r)
    values = {r["seq"]: r for r in data.collect()}
    for seq, best in told.items():
        ranked = sorted(rows[seq]["contributions"].items(), key=lambda e: (-abs(e[1]), e[0]))[:2]
        assert [(r["feature"], r["contribution"]) for r in sorted(best, key=lambda r: r["rank"])] == ranked
        for r in best:
            v = values[seq][r["feature"]]
            assert r["value"] == "absent" if v is None else (float(r["value"]) if r["feature"] == "x" else r["value"]) == v
    assert model.explain(data.where("false"), "seq").count() == 0


def cloud(spark, n=900):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(0, 1) if rng.random() > 0.1 else None, None, False) for i in range(n)]
    return spark.createDataFrame([*rows, (n, 50.0, -40.0, None, False)], "seq long, a double, b double, c double, fraud boolean")


def test_forest_finds_the_planted_row(spark):
    data = cloud(spark)
    # A tree splits within its sample's range, so only trees that were grown with the row tell it from the greatest other one.
    forest = models.fit_forest(data, ["a", "b", "c"], "seq", label="fraud", trees=60, sample=2000, contamination=0.01)
    assert forest.columns == ["a", "b"] and forest.size == 901 and len(forest.grown) == 60
    scores = {r["seq"]: r["novelty"] for r in forest.score(data, "seq").collect()}
    planted = scores.pop(900)
    assert planted > max(scores.values()) + 0.02
    assert sum(s > forest.threshold for s in [*scores.values(), planted]) == 9
    # The same trees and the same rows, however the table is partitioned.
    again = models.fit_forest(data.repartition(7), ["a", "b", "c"], "seq", trees=60, sample=2000)
    assert all((x == y).all() for s, t in zip(forest.grown, again.grown, strict=True) for x, y in zip(s, t, strict=True))


def test_forest_equals_a_plain_one(spark):
    data = cloud(spark, 300)
    forest = models.fit_forest(data, ["a", "b"], "seq", trees=5, sample=64)
    taken = models.tree_samples(forest.filled(data, "seq"), "seq", 5, 64, 7)
    rows = taken.orderBy("tree", "place").collect()
    assert {t: sum(r["tree"] == t for r in rows) for t in range(5)} == dict.fromkeys(range(5), 64)

    def depth(x, sample, tree, node=0, down=0):
        feature, cut, child, _ = (c[node] for c in tree)
        if feature < 0:
            return down + models.Forest.usual_depth(len(sample))
        side = x[feature] >= cut
        return depth(x, [s for s in sample if (s[feature] >= cut) == side], tree, child + side, down + 1)

    points = [(r["a"], r["b"]) for r in forest.filled(data).collect()]
    want = []
    for p in points:
        paths = [depth(p, [(r["a"], r["b"]) for r in rows if r["tree"] == t], tree) for t, tree in enumerate(forest.grown)]
        want.append(2 ** (-sum(paths) / 5 / models.Forest.usual_depth(64)))
    assert forest.score_batch(np.array(points)) == pytest.approx(want, abs=1e-12)


def test_quantiles_of_groups(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 1, 2, rng.random()])) for k in ("a", "b", None) for _ in range(rng.randrange(30, 200))] + [("one", 7.0), ("none", None)]
    rows = [(k, None if v is None else float(v)) for k, v in rows]
    got = {r["k"]: r for r in ordered.quantiles_by(spark.createDataFrame(rows, "k string, v double"), "k", "v", [0.0, 0.3, 0.5, 1.0]).collect()}
    for k in ("a", "b", None, "one"):
        own = [v for x, v in rows if x == k and v is not None]
        assert got[k]["n"] == len(own) and [got[k][f"q{i}"] for i in range(4)] == pytest.approx(list(np.quantile(own, [0.0, 0.3, 0.5, 1.0])))
    assert "none" not in got
