"""Trailing windows over keyed history, read before the event is folded in.

For each key: counts, sums and ratios over 1 h, 24 h and 7 d, and lifetime
figures, from events strictly earlier in (t, seq).  A window is the difference of
two growing frames: all earlier rows, less those older than the window (the bound
itself is inside).  A key's history is cut into spans of ``SPAN`` longest windows; each
span also holds those rows of the one before that its windows can reach, so a hot
key is spread over its spans, and lifetime figures come from sums over earlier spans.

Null: the key is absent or not seen before, or a ratio has nothing below it.
Zero: the key is known and its window is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000
WINDOWS = {"1h": HOUR, "24h": 24 * HOUR, "7d": 168 * HOUR}
#: Length of a span in longest windows: one row in so many is held twice.
SPAN = 4
#: Name -> columns of the key.
KEYS: dict[str, list[str]] = {
    "customer": ["customer"], "card": ["customer", "bin"], "bin": ["bin"], "device": ["device"], "merchant": ["merchant"], "agent": ["agent"], "mandate": ["mandate"], "ip": ["ip"],
}


def feature_names(windows: dict[str, int] = WINDOWS) -> list[str]:
    per = [f"{s}_{w}" for w in windows for s in ("count", "amount_cents", "decline_ratio", "refund_ratio")]
    return [*per, "lifetime_count", "age_seconds", "seconds_since_prior", "amount_vs_mean", "mean_settlement_lag"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def velocity(events: DataFrame, key: list[str], windows: dict[str, int] = WINDOWS, lag_window: str = "7d", keep: list[str] | None = None) -> DataFrame:
    """Per event: seq, the columns ``keep`` of the key, and the features of the key.

    events: seq, t (microseconds), cents, amount, declined, known, refund, lag and the key's columns.
    """
    reach = max(windows.values())
    span = SPAN * reach
    here = F.lit(True)
    for c in key:
        here = here & F.col(c).isNotNull()
    base = events.select(
        "seq", "t", "cents", *key, F.col("declined").cast("int").alias("dec"), F.col("known").cast("int").alias("kno"), F.col("refund").cast("int").alias("ref"),
        F.coalesce(F.col("lag"), F.lit(0)).cast("long").alias("lag"), F.col("lag").isNotNull().cast("int").alias("lags"),
    )
    rows = base.where(here).withColumn("dec", F.col("dec") * F.col("kno")).withColumn("span", F.floor(F.col("t") / span))
    own, next_ = F.struct(F.col("span").alias("s"), F.lit(True).alias("own")), F.struct((F.col("span") + 1).alias("s"), F.lit(False).alias("own"))
    spans = F.when(F.col("t") >= (F.col("span") + 1) * span - reach, F.array(own, next_)).otherwise(F.array(own))
    held = rows.withColumn("x", F.explode(spans)).select("*", F.col("x.s").alias("s"), F.col("x.own").alias("own")).drop("x", "span")
    part = Window.partitionBy(*key, "s")
    prev = part.orderBy("t", "seq").rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col("own").cast("int")
    totals: dict[str, Column] = {"n": F.count("*").over(prev)}
    sums = ["cents", "dec", "kno", "ref"]
    for c in sums:
        totals[c] = F.coalesce(F.sum(c).over(prev), F.lit(0))
    out = held
    for c, v in totals.items():
        out = out.withColumn(f"p_{c}", v)
    out = out.withColumn("own_n", F.coalesce(F.sum(mine).over(prev), F.lit(0))).withColumn("own_cents", F.coalesce(F.sum(mine * F.col("cents")).over(prev), F.lit(0)))
    out = out.withColumn("own_first", F.min(F.when(F.col("own"), F.col("t"))).over(prev)).withColumn("last", F.max("t").over(prev))
    out = out.withColumn("p_lag", F.coalesce(F.sum("lag").over(prev), F.lit(0))).withColumn("p_lags", F.coalesce(F.sum("lags").over(prev), F.lit(0)))
    for name, width in windows.items():
        old = part.orderBy("t").rangeBetween(Window.unboundedPreceding, -(width + 1))
        out = out.withColumn(f"n_{name}", F.col("p_n") - F.count("*").over(old))
        for c in sums + (["lag", "lags"] if name == lag_window else []):
            out = out.withColumn(f"{c}_{name}", F.col(f"p_{c}") - F.coalesce(F.sum(c).over(old), F.lit(0)))
    before = Window.partitionBy(*key).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    sums_of = rows.groupBy(*key, F.col("span").alias("s")).agg(F.count("*").alias("b_n"), F.sum("cents").alias("b_cents"), F.min("t").alias("b_first"), F.max("t").alias("b_last"))
    earlier = sums_of.select(*key, "s", F.sum("b_n").over(before).alias("e_n"), F.sum("b_cents").over(before).alias("e_cents"), F.min("b_first").over(before).alias("e_first"), F.max("b_last").over(before).alias("e_last"))
    out = out.where("own").join(earlier, [*key, "s"])
    life = F.col("own_n") + F.coalesce("e_n", F.lit(0))
    cents = F.col("own_cents") + F.coalesce("e_cents", F.lit(0))
    seen = life > 0
    picked: list[Column] = [F.col("seq"), *[F.col(c) for c in keep or []]]
    for name in windows:
        n = F.col(f"n_{name}")
        picked += [
            F.when(seen, n).alias(f"count_{name}"), F.when(seen, F.col(f"cents_{name}")).alias(f"amount_cents_{name}"),
            _ratio(F.col(f"dec_{name}"), F.col(f"kno_{name}")).alias(f"decline_ratio_{name}"), _ratio(F.col(f"ref_{name}"), n).alias(f"refund_ratio_{name}"),
        ]
    picked += [
        F.when(seen, life).alias("lifetime_count"), ((F.col("t") - F.coalesce("e_first", "own_first")) / 1e6).alias("age_seconds"),
        ((F.col("t") - F.coalesce("last", "e_last")) / 1e6).alias("seconds_since_prior"),
        F.when(cents != 0, (F.col("cents") * life).cast("double") / cents).alias("amount_vs_mean"), _ratio(F.col(f"lag_{lag_window}"), F.col(f"lags_{lag_window}")).alias("mean_settlement_lag"),
    ]
    absent = events.where(~here).select("seq")
    return out.select(*picked).unionByName(absent, allowMissingColumns=True)


def velocity_block(events: DataFrame, keys: dict[str, list[str]] = KEYS, windows: dict[str, int] = WINDOWS) -> DataFrame:
    """All keys side by side: seq and ``vel_<key>_<feature>``.

    One pass over a long form with a row for each key of an event; an event's rows
    come together again by seq.
    """
    names = feature_names(windows)

    def value(columns: list[str]) -> Column:
        there = F.lit(True)
        for c in columns:
            there = there & F.col(c).isNotNull()
        return F.when(there, F.to_json(F.struct(*columns)) if len(columns) > 1 else F.col(columns[0]).cast("string"))

    held = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), value(key).alias("value")) for name, key in keys.items()]))
    long = events.select("seq", "t", "cents", "declined", "known", "refund", "lag", held.alias("x")).where("x.value is not null")
    long = long.select("*", F.col("x.name").alias("key_name"), F.col("x.value").alias("key_value")).drop("x")
    found = velocity(long, ["key_name", "key_value"], windows, keep=["key_name"])
    rows = found.select("seq", "key_name", F.struct(*names).alias("of")).unionByName(events.select("seq"), allowMissingColumns=True)
    entry = F.when(F.col("key_name").isNotNull(), F.struct("key_name", "of"))
    whole = rows.groupBy("seq").agg(F.map_from_entries(F.collect_list(entry)).alias("by_key"))  # an entry for each key
    return whole.select("seq", *[F.col("by_key")[name][f].alias(f"vel_{name}_{f}") for name in keys for f in names])


def delayed_outcomes(events: DataFrame, outcomes: DataFrame, key: str, windows: dict[str, int] = WINDOWS, span: int = 24 * HOUR) -> DataFrame:
    """Per event with a key: seq and, by window, known, declined and decline_ratio over the key's earlier events whose outcome is known before the event.

    events(seq, t, key), outcomes(seq, t, t0, key, declined): ``t`` is when the outcome
    is known, ``t0`` its event's time.  A sweep: an outcome enters each window at
    ``t``, if its event is still inside then, and leaves it at ``t0`` plus the width.
    """
    from .ordered import running_by_span

    names = [f"{c}_{w}" for w in windows for c in ("known", "declined")]
    none = {n: F.lit(0).cast("long") for n in names}

    def moves(sign: int, at: Column, of: list[str], kind: int) -> DataFrame:
        own = none | {f"{c}_{w}": F.when(F.col("t") <= F.col("t0") + windows[w], sign * (F.lit(1) if c == "known" else F.col("declined").cast("int"))).otherwise(0).cast("long") for w in of for c in ("known", "declined")}
        return outcomes.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), at.alias("at"), F.lit(kind).alias("kind"), "seq", *[v.alias(f"d_{n}") for n, v in own.items()])

    rows = events.where(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col("t").alias("at"), F.lit(0).alias("kind"), "seq", *[v.alias(f"d_{n}") for n, v in none.items()])
    rows = rows.unionByName(moves(1, F.col("t"), list(windows), 1))
    for name, width in windows.items():
        rows = rows.unionByName(moves(-1, F.col("t0") + width, [name], 1))
    swept = running_by_span(rows, ["k"], F.floor(F.col("at") / span), ["at", "kind", "seq"], {n: F.col(f"d_{n}") for n in names}).where("kind = 0")
    return swept.select("seq", *[c for w in windows for c in (F.col(f"known_{w}"), F.col(f"declined_{w}"), _ratio(F.col(f"declined_{w}"), F.col(f"known_{w}")).alias(f"decline_ratio_{w}"))])


def velocity_sql(source: str, table: str, key: list[str]) -> str:
    """The same by a self-join, for comparison."""
    same = " AND ".join(f"p.{c} = e.{c}" for c in key)
    per = []
    for name, width in WINDOWS.items():
        inside = f"p.t >= e.t - {width}"
        per += [
            f"CASE WHEN count(p.seq) > 0 THEN count(*) FILTER ({inside}) END::BIGINT AS count_{name}", f"CASE WHEN count(p.seq) > 0 THEN coalesce(sum(p.cents) FILTER ({inside}), 0) END::BIGINT AS amount_cents_{name}",
            f"(count(*) FILTER ({inside} AND p.known AND p.declined))::DOUBLE / nullif(count(*) FILTER ({inside} AND p.known), 0) AS decline_ratio_{name}",
            f"(count(*) FILTER ({inside} AND p.refund))::DOUBLE / nullif(count(*) FILTER ({inside}), 0) AS refund_ratio_{name}",
        ]
    return f"""WITH {source}
    SELECT e.seq, {", ".join(per)}, nullif(count(p.seq), 0)::BIGINT AS lifetime_count, (e.t - min(p.t)) / 1e6::DOUBLE AS age_seconds, (e.t - max(p.t)) / 1e6::DOUBLE AS seconds_since_prior,
      (any_value(e.cents) * count(p.seq))::DOUBLE / nullif(sum(p.cents), 0) AS amount_vs_mean,
      (sum(p.lag) FILTER (p.t >= e.t - {WINDOWS["7d"]}))::DOUBLE / nullif(count(p.lag) FILTER (p.t >= e.t - {WINDOWS["7d"]}), 0) AS mean_settlement_lag
    FROM {table} e LEFT JOIN {table} p ON {same} AND (p.t < e.t OR p.t = e.t AND p.seq < e.seq) GROUP BY e.seq, e.t"""
