from __future__ import annotations

import random

from corvane.operators import velocity

COLUMNS = "seq long, t long, customer long, bin long, cents long, amount double, declined boolean, known boolean, refund boolean, lag long"


def stream(n: int, seed: int, tied: bool = True):
    """Events with many equal times, gaps around the windows' bounds and absent keys."""
    rng, t, out = random.Random(seed), 1_700_000_000_000_000, []
    for i in range(n):
        t += rng.choice([0, 0, 1, velocity.HOUR, velocity.HOUR - 1, 24 * velocity.HOUR, 60_000_000, 50 * velocity.HOUR] if tied else [1_000_000, velocity.HOUR])
        c = rng.randint(1, 900)
        out.append((i, t, rng.choice([1, 2, 3, None]), rng.choice([7, 8]), c, c / 100, rng.random() < 0.3, rng.random() < 0.8, rng.random() < 0.2, rng.choice([None, 5, 30])))
    return out


def brute(events, key):
    """Each event against all earlier ones."""
    out = {}
    for e in events:
        if any(e[k] is None for k in key):
            out[e[0]] = [None] * len(velocity.feature_names())
            continue
        past = [p for p in events if all(p[k] == e[k] for k in key) and (p[1], p[0]) < (e[1], e[0])]
        row = []
        for width in velocity.WINDOWS.values():
            w = [p for p in past if p[1] >= e[1] - width]
            known = [p for p in w if p[7]]
            row += [len(w) if past else None, sum(p[4] for p in w) if past else None, sum(p[6] for p in known) / len(known) if known else None, sum(p[8] for p in w) / len(w) if w else None]
        lags = [p[9] for p in past if p[1] >= e[1] - velocity.WINDOWS["7d"] and p[9] is not None]
        total = sum(p[4] for p in past)
        row += [len(past) or None, (e[1] - past[0][1]) / 1e6 if past else None, (e[1] - past[-1][1]) / 1e6 if past else None, e[4] * len(past) / total if total else None, sum(lags) / len(lags) if lags else None]
        out[e[0]] = row
    return out


def test_equals_replay(spark):
    events = stream(250, 3)
    df = spark.createDataFrame(events, COLUMNS)
    for key, at in ((["customer"], [2]), (["customer", "bin"], [2, 3])):
        got = {r["seq"]: [r[f] for f in velocity.feature_names()] for r in velocity.velocity(df, key).collect()}
        assert got == brute(events, at)


def test_spans_of_any_length(spark, monkeypatch):
    """Rows held twice are just those that a window of the next span can reach."""
    events = stream(150, 5)
    df = spark.createDataFrame(events, COLUMNS)
    want = brute(events, [2])
    for span in (1, 3):
        monkeypatch.setattr(velocity, "SPAN", span)
        assert {r["seq"]: [r[f] for f in velocity.feature_names()] for r in velocity.velocity(df, ["customer"]).collect()} == want
    assert velocity.SPAN > 1


def test_first_sight_is_null_and_own_outcome_hidden(spark):
    t = 1_700_000_000_000_000
    rows = [(i, t + i, 1, 1, 100, 1.0, False, True, False, None) for i in range(4)] + [(4, t + 10, 1, 1, 100, 1.0, True, True, False, None), (5, t + 20, 1, 1, 100, 1.0, False, True, False, None)]
    got = {r["seq"]: r for r in velocity.velocity(spark.createDataFrame(rows, COLUMNS), ["customer"]).collect()}
    assert all(got[0][f] is None for f in velocity.feature_names())
    assert got[4]["decline_ratio_1h"] == 0.0 and got[5]["decline_ratio_1h"] == 1 / 5


def test_block_has_all_columns(spark):
    df = spark.createDataFrame(stream(40, 1), COLUMNS)
    out = velocity.velocity_block(df, {"customer": ["customer"], "card": ["customer", "bin"]})
    assert len(out.columns) == 1 + 2 * 17 and out.count() == 40
