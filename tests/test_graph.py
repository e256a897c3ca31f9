from __future__ import annotations

import random

import pytest

from corvane.operators import graph, skew

COLUMNS = "seq long, t long, customer long, device long, merchant long, agent long, bin long, cents long, declined boolean"


def micro(n, seed, many=1):
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 0, 5, 40])
        out.append((i, t, rng.randint(1, 9 * many), rng.choice([None, 1, 2, 3, 4, 5, 6] if many == 1 else [None, *range(1, 12 * many)]), rng.randint(1, 4), rng.choice([None, None, 1, 2] if many == 1 else [None] * 30 + list(range(1, many * 2))), rng.randint(1, 3), rng.randint(1, 50), rng.random() < 0.3))
    return out


def components_before(events):
    """Components of customers, devices and agents by repeated merging, read before each event."""
    groups, facts, out = [], {}, {}

    def of(x):
        for g in groups:
            if x in g:
                return g
        groups.append({x})
        return groups[-1]

    for e in sorted(events, key=lambda e: (e[1], e[0])):
        c, d, a = ("c", e[2]), e[3] and ("d", e[3]), e[5] and ("a", e[5])
        g = of(c)
        past = [p for p in facts.values() if ("c", p[2]) in g]
        out[e[0]] = (len(g), sum(x[0] == "c" for x in g), sum(x[0] == "d" for x in g), len(past), sum(p[7] for p in past), sum(p[8] for p in past), sum(p[5] is not None for p in past))
        for x in (d, a):
            if x:
                g, h = of(c), of(x)
                if g is not h:
                    groups.remove(h)
                    g |= h
        facts[e[0]] = e
    return out


@pytest.mark.parametrize(("parts", "small", "many"), [(1000, 1_000_000, 1), (3, 5, 1), (20, 5, 8)])
def test_component_state_equals_replay(spark, monkeypatch, parts, small, many):
    monkeypatch.setattr(skew.look_up, "__defaults__", ("inner", parts))
    monkeypatch.setattr(skew, "SMALL", small)
    events = micro(120 * many, 5, many)
    got = {r["seq"]: tuple(r)[1:8] for r in graph.component_state(spark.createDataFrame(events, COLUMNS), 50).collect()}
    assert got == components_before(events)


def roots_after(events):
    """The customer's root after each event, by union by rank in the order of events."""
    parent, rank, out = {}, {}, {}

    def find(x):
        return x if parent.setdefault(x, x) == x else find(parent[x])

    for e in sorted(events, key=lambda e: (e[1], e[0])):
        c, d, a = f"c:{e[2]}", e[3] and f"d:{e[3]}", e[5] and f"a:{e[5]}"
        for x, y in ((c, d), (c, a), (d, a)):
            if x and y and find(x) != find(y):
                x, y = find(x), find(y)
                if rank.get(x, 0) < rank.get(y, 0):
                    x, y = y, x
                parent[y] = x
                rank[x] = rank.get(x, 0) + (rank.get(x, 0) == rank.get(y, 0))
        out[e[0]] = find(c)
    return out


def test_roots_and_fan_in_equal_replay(spark):
    events = micro(400, 3, 6)
    df = spark.createDataFrame(events, COLUMNS)
    state = graph.component_state(df)
    roots = roots_after(events)
    assert {r["seq"]: r["root"] for r in state.collect()} == roots
    got = {r["seq"]: r for r in graph.fan_in(df, state, 60, 420).collect()}
    for e in events:
        past = [p for p in events if p[4] == e[4] and (p[1], p[0]) < (e[1], e[0])]
        week, day = [p for p in past if p[1] >= e[1] - 420], {p[2] for p in past if p[1] >= e[1] - 60}
        customers, groups = {p[2] for p in week}, {roots[p[0]] for p in week}
        r = got[e[0]]
        assert (r["customers_24h"], r["customers_7d"], r["components_7d"]) == (len(day), len(customers), len(groups))
        assert r["fanin_per_component"] == (len(customers) / len(groups) if groups else None)
        assert r["fanin_burst"] == (len(day) / (len(customers) / 7) if customers else None)


def test_sliding_distinct_equals_replay(spark):
    events = micro(300, 8)
    got = {r["seq"]: r["n"] for r in graph.sliding_distinct(spark.createDataFrame(events, COLUMNS), "merchant", "device", 60, "n").collect()}
    for e in events:
        past = {p[3] for p in events if p[4] == e[4] and (p[1], p[0]) < (e[1], e[0]) and p[1] >= e[1] - 60 and p[3] is not None}
        assert got[e[0]] == len(past)


def test_degree_cap(spark):
    events = [(i, i, i, 1, 1, None, 1, 1, False) for i in range(300)]
    got = {r["seq"]: r for r in graph.capped_degrees(spark.createDataFrame(events, COLUMNS)).collect()}
    assert got[299]["device_customers"] == 256 and got[0]["device_customers"] == 0 and got[5]["agent_customers"] is None


def test_connected_components_of_a_chain(spark):
    edges = spark.createDataFrame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(40)] + [("z1", "z2")], "a string, b string")
    got = dict(graph.connected_components(edges).collect())
    assert got == {f"n{i:02d}": "n00" for i in range(41)} | {"z1": "z1", "z2": "z1"}


def test_fan_in_broadcasts_nothing_and_finds_the_roots_once(spark):
    """Tables that grow with the nodes are not sent to the driver, and the three counts read one written table."""
    df = spark.createDataFrame([(i, i * 10, i % 7, i % 5, i % 3, None if i % 2 else i % 4, 100 + i, i % 6 == 0) for i in range(60)], "seq long, t long, customer long, device long, merchant long, agent long, cents long, declined boolean")
    state = {r["seq"]: r["root"] for r in graph.component_state(df).collect()}
    roots = graph.component_roots(df)
    assert {r["seq"]: r["root"] for r in roots.collect()} == state
    for out in (graph.fan_in(df, roots, 60, 420), graph.component_state(df)):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "LocalTableScan" not in plan
