from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane.generators import population, scenarios
from corvane.operators import fidelity
from corvane.plans import experiment
from corvane.plans.session import checkpointed


@pytest.fixture(scope="module")
def pool(spark):
    base = checkpointed(population.simulate(spark, population.Config(events=4000, customers=250, merchants=300)))
    return checkpointed(base.unionByName(scenarios.inject_all(base, 1.0, cards=["F1-10", "F4-27", "F3-19"])))


def test_experiment_runs_and_ranks(pool):
    r = experiment.run(pool, {"customer": ["customer"], "bin": ["bin"]}, rounds=4)
    areas = {x["layer"]: x["roc_auc"] for x in r.layers.collect()}
    assert areas["l1"] > 0.7 and areas["fused"] > 0.7
    assert {x["decision"] for x in r.tallies.collect()} <= {"approve", "challenge", "review", "decline"}
    assert r.decided.where("l0_fired and decision <> 'decline'").count() == 0
    assert r.campaigns.first()["campaigns"] > 0


def test_fidelity(pool):
    rows = experiment.stream_view(pool).withColumn("category", F.col("mcc"))
    one = checkpointed(fidelity.shape(fidelity.common(rows)))
    assert one.columns == ["seq", "fraud", *fidelity.SHAPE]
    assert all(r["ks"] == 0 for r in fidelity.marginals(one, one, ["gap", "hour"]).collect())
    other = one.withColumn("hour", F.col("hour") + 30)
    assert fidelity.discriminate(one, other, folds=2, per_side=500, rounds=2) > 0.95
    assert 0 <= fidelity.passive_share(0.3, 0.5, 0.1) <= 1
    assert fidelity.adjudicate(fidelity.common(rows)).first()["clock"] == "diurnal"
    assert fidelity.drift(pool, {"channel": {"upi": 0.5, "ecom": 0.5}}).count() >= 5
