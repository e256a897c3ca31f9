from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvane import schema
from corvane.generators import evolution, population, scenarios
from corvane.operators import rules
from corvane.plans.session import checkpointed


@pytest.fixture(scope="module")
def background(spark):
    return checkpointed(population.simulate(spark, population.Config(events=8000, customers=400, merchants=600)))


@pytest.fixture(scope="module")
def attacks(background):
    return checkpointed(scenarios.inject_all(background, cards=["F1-01", "F1-03", "F1-10", "F2-13", "F4-27"]))


def test_population_is_valid_and_nests(background):
    assert background.columns == schema.ALL_COLUMNS and len(schema.ALL_COLUMNS) == 50
    assert schema.violations(background).where("n > 0").count() == 0
    assert schema.flatten(schema.nest(background)).exceptAll(background).count() == 0


def test_population_does_not_depend_on_partitions(spark, background):
    again = population.simulate(spark, population.Config(events=8000, customers=400, merchants=600)).repartition(7)
    assert again.select("event_id", "amount", "merchant_id", "ts").exceptAll(background.select("event_id", "amount", "merchant_id", "ts")).count() == 0


@pytest.mark.parametrize(
    ("column", "value", "broken"),
    [("mcc", "581", "mcc"), ("currency", "inr", "currency"), ("card_bin", "12", "card_bin"), ("merchant_country", "ind", "country"), ("amount", -1.0, "ranges"), ("original_event_id", "x", "original"), ("attack_id", "F1-01", "label"), ("channel", "agentic", "agentic_block")],
)
def test_constraints_catch(background, column, value, broken):
    bad = background.where("txn_type = 'purchase' and ag_agent_id is null").limit(5).withColumn(column, F.lit(value))
    assert dict(schema.violations(bad).collect())[broken] == 5


def test_refunds_are_bound_to_earlier_purchases(background):
    p = background.select(F.col("event_id").alias("original_event_id"), F.col("ts").alias("p_ts"), F.col("txn_type").alias("p_type"), F.col("amount").alias("p_amount"), F.col("customer_id").alias("p_customer"), F.col("merchant_id").alias("p_merchant"), F.col("channel").alias("p_channel"))
    refunds = background.where("txn_type = 'refund'")
    n = refunds.count()
    assert n > 100 and background.where("original_event_id IS NOT NULL").count() == n
    good = "p_ts < ts AND p_type = 'purchase' AND p_customer = customer_id AND p_merchant = merchant_id AND p_channel = channel AND amount <= greatest(1.0, p_amount) AND auth_response = 'approved'"
    assert refunds.join(p, "original_event_id").where(good).count() == n


def test_leakage_guard():
    schema.assert_no_leakage(["vel_customer_count_1h", "txn_hour"])
    for name in ("is_fraud", "dispute_outcome", "auth_response", "x_attack_id_y"):
        with pytest.raises(schema.LeakageError):
            schema.assert_no_leakage([name])


def test_scenarios_pass_the_checks(background, attacks):
    assert schema.violations(attacks).where("n > 0").count() == 0
    assert schema.check_attack(attacks, background).where("n > 0").count() == 0
    assert len(scenarios.SCENARIOS) == 15


def test_clean_scenarios_break_no_rule(attacks):
    r = rules.apply_rules(attacks)
    fired = dict(r.groupBy("attack_id").agg(F.count_if("l0_fired")).collect())
    assert fired["F1-03"] == 0 and fired["F1-01"] == 0 and fired["F1-10"] > 0


def test_rules_name_the_first_clause(background):
    row = background.where("ag_agent_id is not null").limit(1)
    bad = row.withColumn("amount", F.col("ag_scope_max_amount") + 1).withColumn("mcc", F.lit("9999")).withColumn("ag_scope_categories", F.array(F.lit("5411")))
    out = rules.apply_rules(bad).first()
    assert out["l0_reason"] == "scope_mcc" and out["l0_amount_over_cap"]
    empty = rules.apply_rules(bad.withColumn("ag_scope_categories", F.array().cast("array<string>"))).first()
    assert not empty["l0_scope_mcc"]


def test_genomes():
    import random

    rng = random.Random(1)
    for _ in range(50):
        g = evolution.mutate_genome(evolution.random_genome("F1-01", rng), rng)
        assert all(lo <= v <= hi for v, (lo, hi, _) in zip(g.genes, evolution.BOUNDS.values(), strict=True))
    with pytest.raises(ValueError):
        evolution.cross(evolution.identity("F1-01"), evolution.identity("F1-02"), rng)


def test_expressed_variants_stay_valid(background, attacks):
    import random

    one = attacks.where("attack_id = 'F1-01'")
    g = evolution.random_genome("F1-01", random.Random(3))
    out = checkpointed(evolution.express(one, background, g))
    assert out.count() == one.count() and schema.violations(out).where("n > 0").count() == 0
    arena = evolution.evolve(background, one, "F1-01", lambda v, seen: v.where("amount > 3000").select("event_id"), 2, 2, 1)
    assert len(arena.evasion_curve()) == 2


def test_each_draw_is_hashed_once_a_row(spark):
    """The population's plan names a draw's hash a few times (events, refunds, their sources), not once in each case; no whole row is shuffled for refunds."""
    plan = population.simulate(spark, population.Config(events=200, customers=50, merchants=50))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/hour") <= 3 and plan.count("/city") <= 9 and "Join" not in plan


def test_scenarios_read_whole_rows_of_the_background_once(background, attacks, monkeypatch):
    """Scenarios see a narrow background, and what they make is what each makes of the whole one."""
    seen = []
    inject = scenarios.inject
    monkeypatch.setattr(scenarios, "inject", lambda b, *a, **k: seen.append(b.columns) or inject(b, *a, **k))
    made = scenarios.inject_all(background, cards=["F1-04", "F3-19"])
    assert len(seen) == 2 and all(len(c) < 15 for c in seen)
    alone = inject(background, "F1-04").unionByName(inject(background, "F3-19"))
    assert made.exceptAll(alone).isEmpty() and alone.exceptAll(made).isEmpty()
