from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import index, lookups
from corvane.operators.ordered import numbered, running_by_span


def test_order_assertion(spark):
    rows = [(i, 10 * i) for i in range(50)]
    index.assert_ordered(spark.createDataFrame(rows, "arrival long, t long"))
    rows[30] = (30, 120)
    with pytest.raises(index.OrderError):
        index.assert_ordered(spark.createDataFrame(rows, "arrival long, t long"))
    late = index.late_rows(spark.createDataFrame(rows, "arrival long, t long"), span=7).collect()
    assert [(r["arrival"], r["late_by"]) for r in late] == [(30, 170)]


def test_hex_ids_are_distinct(spark):
    ids = [r["hex_id"] for r in index.hex_ids(spark.range(4096), "id", 3, "x").collect()]
    assert len(set(ids)) == 4096 and all(len(i) == 3 for i in ids)


def test_hex_ids_of_full_width(spark):
    numbers = [*range(5), *range(3_000_000_000, 3_000_000_200), 2**31 - 1, 2**31, 2**32 - 1]
    ids = [r["hex_id"] for r in index.hex_ids(spark.createDataFrame([(n,) for n in numbers], "id long"), "id", 8, "x").collect()]
    assert len(set(ids)) == len(numbers) and all(len(i) == 8 for i in ids)
    # A walk: equal steps between neighbours.
    assert len({(int(b, 16) - int(a, 16)) % 2**32 for a, b in zip(ids[5:204], ids[6:205], strict=True)}) == 1


def test_weighted_sample_follows_the_weights(spark):
    rows = spark.range(2000).select("id", F.when(F.col("id") < 1000, 9.0).otherwise(1.0).alias("w"))
    heavy = sum(r["id"] < 1000 for r in index.weighted_sample(rows, 200, "w", "id", "s").collect())
    assert 160 < heavy <= 200


def test_sources_lie_in_their_band(spark):
    rng = random.Random(4)
    purchases = [(1000 + i, rng.randrange(5000)) for i in range(200)]
    returns = [(i, rng.randrange(-500, 6000)) for i in range(120)]
    got = lookups.bind_source(spark.createDataFrame(returns, "seq long, target long"), spark.createDataFrame(purchases, "seq long, t long"), 60).collect()
    at, bound = dict(purchases), {r["seq"]: r["source"] for r in got}
    assert len(got) == len(returns)
    for seq, target in returns:
        inside = {s for s, t in purchases if target - 60 <= t <= target}
        earlier = {s for s, t in purchases if t <= target}
        assert bound[seq] in (inside or earlier) if earlier else bound[seq] is None
        assert bound[seq] is None or at[bound[seq]] <= target
    assert len({b for b in bound.values() if b is not None}) > 40


def test_never_used_is_exact(spark):
    """Every key gets a value it never had, but the key that had them all."""
    rng = random.Random(9)
    pairs = [(k, v) for k in range(30) for v in rng.sample(range(20), rng.randint(1, 19))] + [(99, v) for v in range(20)]
    candidates = numbered(spark.range(20).select(F.col("id").alias("v")), "v", "v")
    got = {r["k"]: r["v"] for r in lookups.never_used(spark.createDataFrame(pairs, "k long, v long"), candidates, "k", "v").collect()}
    assert set(got) == {k for k, _ in pairs} and all((k, v) not in pairs for k, v in got.items() if k != 99)


def test_running_by_span_equals_a_plain_sum(spark):
    rng = random.Random(2)
    rows = [(i, rng.randrange(3), rng.randrange(400), rng.randrange(9)) for i in range(300)]
    got = {r["id"]: r["s"] for r in running_by_span(spark.createDataFrame(rows, "id long, k long, t long, x long"), ["k"], F.floor(F.col("t") / 50), ["t", "id"], {"s": F.col("x")}).collect()}
    assert got == {i: sum(x for j, b, u, x in rows if b == k and (u, j) < (t, i)) for i, k, t, _ in rows}


def test_wire_and_plan(spark):
    scored, truth = index.on_the_wire(spark.createDataFrame([("e", 1.0, True)], "event_id string, amount double, is_fraud boolean"), ["is_fraud"])
    assert scored.columns == ["event_id", "amount"] and truth.columns == ["event_id", "is_fraud"]
    assert index.corpus_plan(spark.range(1), ["a", "b"], {"page": 3, "note": 2}).count() == 10
