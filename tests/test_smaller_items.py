"""One check each for small operators that no registered query compares."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane import schema
from corvane.functions import scalars
from corvane.operators import lookups, models, policy, probe, sequences, text
from corvane.sources import readers


def test_events_are_read_in_the_contracts_types(spark, tmp_path):
    kind = schema.flatten(spark.createDataFrame([], schema.EVENT)).schema
    spark.createDataFrame([("e1", 12.5)], "event_id string, amount double").write.parquet(f"{tmp_path}/old")
    old = readers.read_events(spark, f"{tmp_path}/old")
    assert old.schema == kind and old.first()["event_id"] == "e1" and old.first()["customer_id"] is None
    readers.write_events(old, f"{tmp_path}/new", ["card_bin"])
    assert readers.read_events(spark, f"{tmp_path}/new").select("event_id", "amount").collect() == old.select("event_id", "amount").collect()
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        readers.write_events(old, f"{tmp_path}/new")


def test_manifest_replay_and_cache(spark, tmp_path):
    readers.write_manifest(spark, f"{tmp_path}/m", {"b": 1, "a": [2]})
    assert spark.read.text(f"{tmp_path}/m").first()["value"] == '{"a": [2], "b": 1}'
    scored = spark.createDataFrame([(i, i % 4 == 0, None if i % 4 else ("F1-02" if i % 8 else "F2-01")) for i in range(1000)], "seq long, is_fraud boolean, attack_id string")
    got = [r["seq"] for r in readers.replay(scored, "F1", 500).collect()]
    want = [i for i in [*range(500, 1000), *range(500)] if i % 4 or i % 8]
    assert got == want[:600] and len(readers.replay(scored, None, 0, 10).collect()) == 10
    prompts = spark.createDataFrame([("page", "p1"), ("page", "p2"), ("page", "p2"), ("note", "p1")], "kind string, prompt string")
    first = readers.fill_cache(prompts, f"{tmp_path}/cache").collect()
    held = spark.read.parquet(f"{tmp_path}/cache")
    assert held.count() == 3 and len(first) == 4
    held.where("digest = '" + first[0]["digest"] + "'").count()
    again = readers.fill_cache(prompts.unionByName(spark.createDataFrame([("note", "p9")], prompts.schema)), f"{tmp_path}/cache", "another template {kind} {key}")
    texts = {r["digest"]: r["text"] for r in again.collect()}
    assert all(texts[r["digest"]] == r["text"] for r in first)  # what is held is not written anew
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 4


def test_scalars(spark):
    df = spark.createDataFrame([("F3-11", 1.5), (None, float("nan")), ("F1-02", float("-inf")), ("x", None)], "a string, x double")
    assert [tuple(r) for r in df.select(scalars.family(F.col("a")), scalars.finite(F.col("x"))).collect()] == [("F3", 1.5), (None, None), ("F1", None), ("x", None)]


def test_pooled_seeds_are_kept_apart(spark):
    import datetime

    df = spark.createDataFrame([("c1", None, datetime.datetime(2024, 1, 1), 5)], "customer string, device string, ts timestamp, n int")
    assert tuple(lookups.namespaced(df, 3, ["customer", "device"], ["ts"], 30).first()) == ("s3-c1", None, datetime.datetime(2024, 3, 31), 5)


def test_place_in_owner(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(20), rng.choice([1, 2, None])) for i in range(60)]
    got = {r["seq"]: r["place"] for r in sequences.place_in_owner(spark.createDataFrame(rows, "seq long, t long, customer long"), "customer").collect()}
    for i, t, c in rows:
        assert got[i] == 1 + sum(1 for j, u, d in rows if d == c and (u, j) < (t, i))


def test_events_with_withheld_artefacts(spark):
    chains = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"]), (3, []), (4, ["b", "b"])], "seq long, chain array<string>")
    withheld = spark.createDataFrame([("b",), ("z",)], "artifact string")
    assert sorted(r["seq"] for r in text.withheld_events(chains, withheld).collect()) == [1, 4]


def test_event_novelty_is_the_greater_rank(spark):
    events = spark.createDataFrame([(1, 1, 7), (2, 2, 7), (3, 1, None), (4, None, None)], "seq long, customer long, merchant long")
    customers, merchants = spark.createDataFrame([(1, 0.3)], "customer long, novelty double"), spark.createDataFrame([(7, 0.2)], "merchant long, novelty double")
    assert dict(models.event_novelty(events, customers, merchants).collect()) == {1: 0.3, 2: 0.2, 3: 0.3, 4: 0.0}


def layered(spark, n=1200, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        f = rng.choice(["F1", "F2"]) if rng.random() < 0.25 else None
        rows.append((i, i, rng.gauss(3 if f == "F1" else 0, 1), rng.gauss(3 if f == "F2" else 0, 1), f is not None, f))
    return spark.createDataFrame(rows, "seq long, t long, x double, y double, fraud boolean, family string")


def test_families_held_out_and_columns_dropped(spark):
    train, test = layered(spark), layered(spark, seed=2)
    out = {r["family"]: r for r in models.leave_one_out(train, test, ["x", "y"], F.col("family"), ["F1", "F2", "F9"], 0.05)}
    for f in ("F1", "F2"):
        assert out[f]["with"] > 0.6 and out[f]["held_out"] < out[f]["with"]  # a family that was not seen is found less often
    assert out["F9"]["with"] is None
    whole, without = models.ablation(train, test, ["x", "y"], "x")
    assert whole["roc_auc"] > without["roc_auc"] + 0.05


def test_weights_of_the_stacker(spark):
    data = layered(spark).withColumn("l1", F.col("x")).withColumn("l2", F.when(F.col("seq") % 3 > 0, F.col("y")))
    design = policy.fusion_design(data, data.where("not fraud"), ["l1", "l2"])
    fusion = policy.fit_fusion(design, ["l1", "l2"])
    weights = dict(fusion.weights(spark).collect())
    assert set(weights) == set(fusion.columns)
    row = fusion.score(design).first()
    margin = float(fusion.model.intercept) + sum(w * row[c] for c, w in weights.items())
    assert row["fused"] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-12)


def test_gate_against_a_label_that_cannot_leak(spark):
    m = layered(spark, 3000).withColumn("y", F.col("fraud"))
    real = {r["column"]: r["passed"] for r in probe.gate(m, ["x", "t"]).collect()}
    control = {r["column"]: r for r in probe.null_control(m, ["x", "t"], "seq", most=0.6).collect()}
    assert real["t"] and all(r["passed"] for r in control.values()) and control["x"]["score"] < 0.56 < {r["column"]: r["score"] for r in probe.gate(m, ["x"]).collect()}["x"]
