"""Streams with state against their batch twins and plain replays."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from test_velocity import COLUMNS, stream

from corvane.operators import graph, index, velocity
from corvane.streaming import stateful

DAY = stateful.DAY


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.use_rocksdb(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def fed(spark, tmp_path, parts, schema, make, name):
    """What ``make`` gives for a stream of these parts, a micro-batch each, and the query."""
    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}/{i:02d}")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{name}")
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}_cp").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect(), q


def cut(rows, n):
    return [rows[i : i + n] for i in range(0, len(rows), n)]


def test_velocity_in_order_equals_batch_and_state_is_bounded(spark, tmp_path):
    events = stream(240, 11)
    got, q = fed(spark, tmp_path, cut(events, 80), COLUMNS, lambda s: stateful.stream_velocity(s, ["customer", "bin"], delay="0 seconds"), "ordered")
    names = velocity.feature_names()
    df = spark.createDataFrame(events, COLUMNS)
    want = {r["seq"]: [r[f] for f in names] for r in velocity.velocity(df.dropna(subset=["customer"]), ["customer", "bin"]).collect()}
    assert {r["seq"]: [r[f] for f in names] for r in got} == want and not any(r["late_by"] for r in got)
    # Days that the longest window has left are gone: at most eight before the watermark's day, and those after it.
    held = spark.read.format("statestore").option("stateVarName", "days").load(f"{tmp_path}/ordered_cp").select("key", F.col("user_map_key.day").alias("day")).collect()
    days = {e[1] // DAY for e in events if e[2] is not None}
    assert len(days) > 30 and max(r["day"] for r in held) == max(days) and {r["day"] for r in held} <= set(range(max(days) - 8, max(days) + 1))
    table = stateful.stage_latency(spark, q.recentProgress).collect()
    assert {"addBatch", "triggerExecution"} <= {r["stage"] for r in table} and all(r["p50"] <= r["p95"] <= r["p99"] and r["batches"] == 3 for r in table)


def test_late_rows_are_set_aside(spark, tmp_path):
    rng = random.Random(2)
    events = [(i, t + rng.choice([0, 0, 0, -3, -40, -3000]) * 1_000_000, *rest) for i, t, *rest in stream(200, 5)]
    got, _ = fed(spark, tmp_path, cut(events, 70), COLUMNS, lambda s: stateful.stream_velocity(s, ["customer"], delay="9999 days"), "jumbled")
    df = spark.createDataFrame(events, COLUMNS).dropna(subset=["customer"])
    late = {r["seq"]: r["late_by"] for r in index.late_rows(df, "seq", "t", 30, ["customer"]).collect()}
    assert len(late) > 10 and {r["seq"]: r["late_by"] for r in got if r["late_by"]} == late
    names = velocity.feature_names()
    on_time = df.where(~F.col("seq").isin(list(late)))
    want = {r["seq"]: [r[f] for f in names] for r in velocity.velocity(on_time, ["customer"]).collect()}
    assert {r["seq"]: [r[f] for f in names] for r in got if not r["late_by"]} == want


def test_idle_keys_are_forgotten(spark, tmp_path):
    day = DAY
    row = lambda i, t, c: (i, t, c, 1, 100, 1.0, False, True, False, None)
    parts = [[row(0, 0, 1), row(1, day, 1)], [row(2, 40 * day, 2)], [row(3, 41 * day, 2)], [row(4, 42 * day, 1), row(5, 3 * day, 2)]]
    got, _ = fed(spark, tmp_path, parts, COLUMNS, lambda s: stateful.stream_velocity(s, ["customer"], delay="0 seconds", forget=20 * day), "idle")
    by = {r["seq"]: r for r in got}
    assert by[1]["lifetime_count"] == 1 and by[3]["lifetime_count"] == 1
    assert by[4]["lifetime_count"] is None  # its history was dropped
    assert by[5]["late_by"] == 38 * day and by[5]["count_1h"] is None


def outcomes_of(events, seed):
    rng = random.Random(seed)
    return [(e[0], e[1] + rng.choice([0, 1, velocity.HOUR, 30 * velocity.HOUR, 200 * velocity.HOUR]), e[1], e[2], e[6]) for e in events if rng.random() < 0.9]


def test_outcomes_count_once_they_are_known(spark, tmp_path):
    events = stream(150, 7)
    told = outcomes_of(events, 1)
    df, known = spark.createDataFrame(events, COLUMNS), spark.createDataFrame(told, "seq long, t long, t0 long, customer long, declined boolean")
    want = {}
    for e in events:
        if e[2] is not None:
            row = []
            for width in velocity.WINDOWS.values():
                inside = [o[4] for o in told if o[3] == e[2] and o[1] < e[1] and o[2] >= e[1] - width]
                row += [len(inside), sum(inside), sum(inside) / len(inside) if inside else None]
            want[e[0]] = row
    batch = {r["seq"]: list(r)[1:] for r in velocity.delayed_outcomes(df, known, "customer").collect()}
    assert batch == want
    # Both streams in steps of time, as they would come.
    both = sorted([(0, *e[:3], e[1], False) for e in events] + [(1, o[0], o[1], o[3], o[2], o[4]) for o in told], key=lambda x: (x[2], x[0]))
    schema = "kind int, seq long, t long, customer long, t0 long, declined boolean"
    make = lambda s: stateful.stream_outcomes(s.where("kind = 0"), s.where("kind = 1"), "customer", delay="0 seconds")
    got, _ = fed(spark, tmp_path, cut(both, 100), schema, make, "told")
    assert not any(r["late_by"] for r in got) and {r["seq"]: list(r)[2:] for r in got} == want


def test_degrees_and_sliding_distinct_equal_batch(spark, tmp_path):
    rng = random.Random(9)
    t, events = 50 * DAY, []
    for i in range(260):
        t += rng.choice([0, 0, 1, DAY // 3, DAY // 24, 2 * DAY])
        events.append((i, t, rng.choice([1, 1, 2, None]), rng.choice([None, *range(12)])))
    schema = "seq long, t long, merchant long, customer long"
    got, _ = fed(spark, tmp_path, cut(events, 90), schema, lambda s: stateful.stream_distinct(s, "merchant", "customer", 2 * DAY, cap=7, delay="0 seconds"), "degrees")
    df = spark.createDataFrame(events, schema)
    slid = {r["seq"]: r["n"] for r in graph.sliding_distinct(df, "merchant", "customer", 2 * DAY, "n").collect()}
    degree = {r["seq"]: r["d"] for r in graph.capped_degrees(df, {"d": ("merchant", "customer")}, 7).collect() if r["d"] is not None}
    assert {r["seq"]: r["distinct"] for r in got} == slid and {r["seq"]: r["degree"] for r in got} == degree
    held = spark.read.format("statestore").option("stateVarName", "last").load(f"{tmp_path}/degrees_cp").count()
    assert held <= 24 and max(slid.values()) > 4


def test_a_key_has_one_timer_and_only_days_of_use(spark, tmp_path):
    """One micro-batch over two months of one key: neither a timer nor a stored day for each of its days."""
    rows = [(i, i * DAY // 2, 1, 1, 100, 1.0, False, True, False, None) for i in range(120)]
    told = [(0, i, i * DAY // 2, 1, i * DAY // 2, False) for i in range(120)] + [(1, i, i * DAY // 2 + 1, 1, i * DAY // 2, True) for i in range(120)]
    streams = {
        "one_v": (rows, COLUMNS, lambda s: stateful.stream_velocity(s, ["customer"], delay="9999 days")),
        "one_o": (told, "kind int, seq long, t long, customer long, t0 long, declined boolean", lambda s: stateful.stream_outcomes(s.where("kind = 0"), s.where("kind = 1"), "customer", delay="9999 days")),
        "one_d": (rows, COLUMNS, lambda s: stateful.stream_distinct(s, "customer", "bin", 2 * DAY, delay="9999 days")),
    }
    for name, (data, schema, make) in streams.items():
        fed(spark, tmp_path, [data], schema, make, name)
        days = spark.read.format("statestore").option("stateVarName", "days").load(f"{tmp_path}/{name}_cp").select("user_map_key.day").collect()
        timers = spark.read.format("statestore").option("readRegisteredTimers", "true").load(f"{tmp_path}/{name}_cp").count()
        assert 1 <= len(days) <= 9 and min(r["day"] for r in days) >= 59 - 8 and timers == 1


def test_times_before_1970_are_not_late(spark, tmp_path):
    rows = [(i, t, 1, 1, 100, 1.0, False, True, False, None) for i, t in enumerate([-9 * DAY, -8 * DAY, -8 * DAY - 5, 0, -1])]
    got, _ = fed(spark, tmp_path, [rows], COLUMNS, lambda s: stateful.stream_velocity(s, ["customer"]), "early")
    assert {r["seq"]: r["late_by"] for r in got} == {0: None, 1: None, 2: 5, 3: None, 4: 1}
