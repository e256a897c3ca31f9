"""Keyed state with timers: windows that forget, late rows set aside, outcomes that come later, degrees.

Each stream is ``transformWithStateInPandas`` over a key, on the RocksDB state store
(``use_rocksdb``).  A key's rows of a micro-batch are taken in order of arrival.  A
row is late if an earlier arrival of its key had a greater time, or if its time is
below the watermark; it changes no state and comes out in the same stream with
``late_by`` set and no figures.  Old rows are dropped by an event-time timer, a day
after the other; the watermark's delay says how far keys may lag behind each other.

State of a key: the days within the longest window, each with its times and running
sums, so that reading a window is a binary search; and one row of lifetime figures,
which goes after ``forget`` microseconds without events, if that is given.

A key's state is read once a micro-batch and its changes are written once, whatever
the number of its rows; days that its latest row has left behind are never written,
and the days that one micro-batch brings are written together, under the last of them.
A key has one timer at a time, for its oldest days.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.velocity import WINDOWS, feature_names

DAY = 86_400_000_000
SUMS = ["cents", "dec", "kno", "ref", "lag", "lags"]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """events with a watermark on ``t``.  The time column itself is not handed on, since Spark would drop rows below the watermark unseen."""
    return events.withColumn("ts_", F.timestamp_micros("t")).withWatermark("ts_", delay).select(*events.columns)


class _Keyed(StatefulProcessor):
    """What the processors share: the greatest time so far, days, and the timer that drops them."""

    #: How long a day is of use after its end, in microseconds.
    span = max(WINDOWS.values())
    day_schema = ""
    #: Lifetime figures, kept beside the greatest time.
    life_schema = ""
    arrival: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.days = handle.getMapState("days", "day bigint", self.day_schema)
        self.latest = handle.getValueState("latest", f"t bigint, timer bigint{self.life_schema}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows))
        table = table.iloc[np.lexsort([table[c].to_numpy() for c in reversed(self.arrival)])]
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        held = self.latest.get()
        latest, timer, *self.life = (None, None) if held is None else held
        held_days = self.held_days() if held is not None else {}
        t = table["t"].to_numpy(np.int64)
        # Before its first move the watermark is zero, which is no bound.
        floor = max(mark if mark > 0 else _NEVER, _NEVER if latest is None else latest)
        before = np.maximum.accumulate(np.concatenate([[floor], t]))[:-1]
        late = t < before
        now = t[~late]
        out = self.steps(table[~late] if late.any() else table, now, held_days, latest)
        if len(now):
            latest = int(now[-1])
            first = (latest - self.span) // DAY
            for day in held_days:
                if day < first:
                    self.days.removeKey((day,))
            days = {d for d in held_days if d >= first}
            for day, value in self.written(first):
                self.days.updateValue((day,), value)
                days.add(day)
            if timer is None and days:
                timer = self.due(min(days))
                self.handle.registerTimer(timer)
            self.latest.update((latest, timer, *self.life))
        if late.any():
            yield self.frame(key, self.aside(table["seq"].to_numpy()[late], (before - t)[late]))
        yield self.frame(key, out)

    def due(self, day: int) -> int:
        return ((day + 1) * DAY + self.span) // 1000 + 1

    def held_days(self) -> dict[int, tuple]:
        return {int(k[0]): tuple(v) for k, v in sorted(self.days.iterator(), key=lambda x: x[0][0])}

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark_ms = timerValues.getCurrentWatermarkInMs()
        held = self.latest.get()
        if held is not None:
            days = self.held_days()
            for day in days:
                if self.due(day) <= mark_ms:
                    self.days.removeKey((day,))
            left = [self.due(d) for d in days if self.due(d) > mark_ms]
            again = self.expired(mark_ms * 1000, days, int(held[0]))
            timer = min(left, default=again)
            if timer is not None:
                self.handle.registerTimer(timer)
            if self.latest.exists():
                self.latest.update((held[0], timer, *held[2:]))
        yield self.frame(key, self.aside(np.empty(0, np.int64), np.empty(0, np.int64)))

    def aside(self, seq: np.ndarray, by: np.ndarray) -> dict[str, object]:
        """Late rows: no figures."""
        return {"seq": seq, "late_by": by}

    def steps(self, table: pd.DataFrame, now: np.ndarray, days: dict[int, tuple], latest: int | None) -> dict[str, object]:
        """The output of rows in time, by column."""
        raise NotImplementedError

    def written(self, first: int) -> Iterator[tuple[int, tuple]]:
        """The days from ``first`` on that the rows have changed."""
        raise NotImplementedError

    def frame(self, key, out: dict[str, object]) -> pd.DataFrame:
        raise NotImplementedError

    def expired(self, mark: int, days: dict[int, tuple], latest: int) -> int | None:
        """What else goes with the days; when to look again if no day is left."""
        return None

    def close(self) -> None: ...


#: Before all times.
_NEVER = np.iinfo(np.int64).min


def _whole(values, null=None) -> pd.arrays.IntegerArray:
    """A column of integers that are null where ``null`` says."""
    values = np.asarray(values, np.int64)
    return pd.arrays.IntegerArray(values, np.zeros(len(values), bool) if null is None else np.asarray(null, bool))


def _frame(out: dict[str, object], whole: list[str], double: list[str], order: list[str]) -> pd.DataFrame:
    n = len(out["seq"])
    nothing = {**{c: _whole(np.zeros(n), np.ones(n)) for c in whole}, **{c: np.full(n, np.nan) for c in double}}
    given = {c: _whole(v) if isinstance(v, np.ndarray) and c in whole else v for c, v in out.items()}
    return pd.DataFrame({c: given.get(c, nothing.get(c)) for c in order})


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, null where b is zero."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


class Velocity(_Keyed):
    day_schema = "start bigint, base array<bigint>, times array<bigint>, sums array<array<bigint>>"
    life_schema = ", n bigint, first bigint, totals array<bigint>"

    def __init__(self, key: list[str], arrival: list[str], forget: int | None):
        self.key, self.arrival, self.forget = key, arrival, forget

    def expired(self, mark: int, days: dict[int, tuple], latest: int) -> int | None:
        if self.forget is None:
            return None
        if latest + self.forget <= mark:
            self.latest.clear()
            for day in days:
                self.days.removeKey((day,))
            return None
        return (latest + self.forget) // 1000 + 1

    def steps(self, table: pd.DataFrame, now: np.ndarray, days: dict[int, tuple], latest: int | None) -> dict[str, object]:
        seq = table["seq"].to_numpy(np.int64)
        if not len(now):
            return {"seq": seq}
        n, first, totals = (0, int(now[0]), [0] * len(SUMS)) if latest is None else (int(self.life[0]), int(self.life[1]), list(map(int, self.life[2])))
        # Running sums after each row of the days held and of the new rows; column 0 is what came before them.
        old = [np.asarray(d[2], np.int64) for d in days.values()]
        base = next(iter(days.values()))[1] if days else totals
        added = np.cumsum(np.array([table[c].to_numpy(np.int64) for c in SUMS]), axis=1) + np.asarray(totals, np.int64)[:, None]
        self.sums = np.concatenate([np.asarray(base, np.int64)[:, None], *[np.array([list(x) for x in d[3]], np.int64) for d in days.values()], added], axis=1)
        self.times = np.concatenate([*old, now])
        m, k = len(self.times) - len(now), len(now)
        self.below = n - m  # rows before those at hand
        at = np.arange(m, m + k)
        here, count = self.sums[:, m : m + k], n + np.arange(k)
        new = count == 0
        out: dict[str, object] = {"seq": seq}
        for w, width in WINDOWS.items():
            start = np.searchsorted(self.times, now - width)
            cents, dec, kno, ref, lag, lags = here - self.sums[:, start]
            out |= {f"count_{w}": _whole(at - start, new), f"amount_cents_{w}": _whole(cents, new), f"decline_ratio_{w}": _divided(dec, kno), f"refund_ratio_{w}": _divided(ref, at - start)}
        prior = np.concatenate([[first if latest is None else latest], now[:-1]])
        known = ~new
        paid = np.where(table["priced"].to_numpy(bool), _divided(table["cents"].to_numpy(np.int64) * count, here[0]), np.nan)
        out |= {
            "lifetime_count": _whole(count, new), "age_seconds": np.where(known, (now - first) / 1e6, np.nan), "seconds_since_prior": np.where(known, (now - prior) / 1e6, np.nan),
            "amount_vs_mean": paid, "mean_settlement_lag": _divided(lag, lags),
        }
        self.life = (n + k, first, self.sums[:, -1].tolist())
        # The days that these rows bring are one entry, with what its last day held before.
        self.at = m - len(days[day][2]) if (day := int(now[-1]) // DAY) in days else m
        return out

    def written(self, first: int) -> Iterator[tuple[int, tuple]]:
        a = max(self.at, int(np.searchsorted(self.times, first * DAY)))
        yield int(self.times[-1]) // DAY, (self.below + a, self.sums[:, a].tolist(), self.times[a:].tolist(), self.sums[:, a + 1 :].tolist())

    def frame(self, key, out: dict[str, object]) -> pd.DataFrame:
        names = feature_names()
        n = len(out["seq"])
        keys = {c: [key[i]] * n for i, c in enumerate(self.key)}
        return _frame({**out, **keys}, ["seq", "late_by", *[c for c in names if not _is_double(c)]], [c for c in names if _is_double(c)], ["seq", *self.key, "late_by", *names])


def _is_double(name: str) -> bool:
    return any(d in name for d in ("ratio", "seconds", "mean", "lag"))


def _or_zero(c: Column) -> Column:
    return F.coalesce(c.cast("long"), F.lit(0).cast("long"))


def stream_velocity(events: DataFrame, key: list[str], arrival: tuple[str, ...] = ("seq",), delay: str = "1 day", forget: int | None = None) -> DataFrame:
    """seq, the key, late_by, and the features of ``velocity`` of a stream; late rows have ``late_by`` only.  Rows without the key are left out."""
    types = dict(events.dtypes)
    known = F.col("known").cast("long")
    rows = events.dropna(subset=key).select(
        *dict.fromkeys(["seq", *arrival, *key, "t"]), _or_zero(F.col("cents")).alias("cents"), F.col("cents").isNotNull().alias("priced"), _or_zero(F.col("declined").cast("long") * known).alias("dec"), _or_zero(known).alias("kno"),
        _or_zero(F.col("refund")).alias("ref"), _or_zero(F.col("lag")).alias("lag"), F.col("lag").isNotNull().cast("long").alias("lags"),
    )
    schema = ", ".join(["seq long", *[f"{k} {types[k]}" for k in key], "late_by long", *[f"{f} {'double' if _is_double(f) else 'long'}" for f in feature_names()]])
    return _timed(rows, delay).groupBy(*key).transformWithStateInPandas(Velocity(key, list(arrival), forget), schema, "append", "eventTime")


class Outcomes(_Keyed):
    """Events read how many of the key's earlier events have a known outcome by now, and how many of those were declines."""

    day_schema = "known array<bigint>, declined array<bigint>"
    arrival = ["t", "kind", "seq"]

    def __init__(self, windows: dict[str, int]):
        self.windows, self.span = windows, max(windows.values())

    def steps(self, table: pd.DataFrame, now: np.ndarray, days: dict[int, tuple], latest: int | None) -> dict[str, object]:
        known, declined = (sorted(int(t) for d in days.values() for t in d[i]) for i in (0, 1))
        self.held, self.told = days, ([], [])
        seqs, counts = [], []
        widths, day = list(self.windows.values()), None
        for t, kind, t0, no, seq in zip(now.tolist(), table["kind"].tolist(), table["t0"].tolist(), table["declined"].tolist(), table["seq"].tolist(), strict=True):
            if t // DAY != day:  # what has left the longest window goes
                day = t // DAY
                for x in (known, declined):
                    del x[: bisect_left(x, t - self.span)]
            if kind == 1:
                if t - t0 <= self.span:
                    for x, y in zip((known, declined), self.told, strict=True) if no else ((known, self.told[0]),):
                        insort(x, t0)
                        y.append(t0)
            else:
                seqs.append(seq)
                row = []
                for width in widths:
                    row += [len(known) - bisect_left(known, t - width), len(declined) - bisect_left(declined, t - width)]
                counts.append(row)
        found = np.array(counts, np.int64).reshape(-1, 2 * len(widths)).T
        out: dict[str, object] = {"seq": np.array(seqs, np.int64)}
        for i, w in enumerate(self.windows):
            out |= {f"known_{w}": found[2 * i], f"declined_{w}": found[2 * i + 1], f"decline_ratio_{w}": _divided(found[2 * i + 1], found[2 * i])}
        return out

    def written(self, first: int) -> Iterator[tuple[int, tuple]]:
        told = [[t for t in x if t >= first * DAY] for x in self.told]
        if told[0]:  # one entry, with what its last day held before
            day = max(told[0]) // DAY
            yield day, tuple([*map(int, held), *new] for held, new in zip(self.held.get(day, ((), ())), told, strict=True))

    def frame(self, key, out: dict[str, object]) -> pd.DataFrame:
        names = [f"{c}_{w}" for w in self.windows for c in ("known", "declined", "decline_ratio")]
        return _frame(out, ["seq", "late_by", *[c for c in names if not c.startswith("decline_ratio")]], [c for c in names if c.startswith("decline_ratio")], ["seq", "late_by", *names])


def stream_outcomes(events: DataFrame, outcomes: DataFrame, key: str, windows: dict[str, int] = WINDOWS, delay: str = "1 day") -> DataFrame:
    """seq, late_by, known_*, declined_* and decline_ratio_* of two streams: events(seq, t, key) and outcomes(seq, t, t0, key, declined).

    An outcome is folded at its own time ``t`` and counts for events after it, for the window that holds its event's time ``t0``.
    Late outcomes come out too, under their event's seq.
    """
    asked = events.dropna(subset=[key]).select("seq", "t", F.col(key).alias("k"), F.lit(0).alias("kind"), F.col("t").alias("t0"), F.lit(False).alias("declined"))
    told = outcomes.dropna(subset=[key]).select("seq", "t", F.col(key).alias("k"), F.lit(1).alias("kind"), "t0", "declined")
    schema = ", ".join(["seq long, late_by long", *[f"known_{w} long, declined_{w} long, decline_ratio_{w} double" for w in windows]])
    return _timed(asked.unionByName(told), delay).groupBy("k").transformWithStateInPandas(Outcomes(windows), schema, "append", "eventTime")


class Distinct(_Keyed):
    """Distinct values of a key: of its whole life up to a cap, and of a trailing window.

    The window's values are a map from value to its latest time, and a queue by days
    of the events that may still hold one in; what falls out of the window is taken
    off the queue's front once.  State is bounded by the window's events and the cap.
    """

    day_schema = "times array<bigint>, vals array<string>"
    arrival = ["t", "seq"]

    def __init__(self, width: int, cap: int):
        self.width, self.cap, self.span = width, cap, width

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.ever = handle.getMapState("ever", "v string", "one boolean")
        self.last = handle.getMapState("last", "v string", "t bigint")

    def steps(self, table: pd.DataFrame, now: np.ndarray, days: dict[int, tuple], latest: int | None) -> dict[str, object]:
        self.times, self.values = [int(t) for d in days.values() for t in d[0]], [v for d in days.values() for v in d[1]]
        times, values = self.times, self.values
        before = {} if latest is None else {k[0]: int(v[0]) for k, v in self.last.iterator()}
        ever = set() if latest is None else {k[0] for k, _ in self.ever.iterator()}
        last, cap, width = dict(before), self.cap, self.width
        head, new, seen, distinct = 0, len(ever), [], []
        known = set(ever)
        self.moved: set[int] = set()
        for t, v in zip(now.tolist(), table["v"].tolist(), strict=True):
            cut = t - width
            while head < len(times) and times[head] < cut:  # the queue's front
                if last.get(values[head]) == times[head]:  # its latest event: the value leaves
                    del last[values[head]]
                head += 1
            if head > _QUEUE and 2 * head > len(times):
                del times[:head], values[:head]
                head = 0
            seen.append(new)
            distinct.append(len(last))
            if v is not None:
                # Of a value's events with one time the first stays.
                if last.get(v) != t:
                    times.append(t)
                    values.append(v)
                    last[v] = t
                    self.moved.add(t // DAY)
                if new < cap and v not in ever:
                    ever.add(v)
                    new += 1
        for v in ever - known:
            self.ever.updateValue((v,), (True,))
        for v, t in last.items():
            if before.get(v) != t:
                self.last.updateValue((v,), (t,))
        for v in before.keys() - last.keys():
            self.last.removeKey((v,))
        return {"seq": table["seq"].to_numpy(np.int64), "degree": np.array(seen, np.int64), "distinct": np.array(distinct, np.int64)}

    def written(self, first: int) -> Iterator[tuple[int, tuple]]:
        for day in sorted(d for d in self.moved if d >= first):
            part = slice(bisect_left(self.times, day * DAY), bisect_left(self.times, (day + 1) * DAY))
            yield day, (self.times[part], self.values[part])

    def expired(self, mark: int, days: dict[int, tuple], latest: int) -> int | None:
        # An idle key's values leave here.
        for k, v in list(self.last.iterator()):
            if int(v[0]) < mark - self.width:
                self.last.removeKey(k)
        return None

    def frame(self, key, out: dict[str, object]) -> pd.DataFrame:
        names = ["seq", "late_by", "degree", "distinct"]
        return _frame(out, names, [], names)


#: Events that may lie taken at a queue's front before it is cut.
_QUEUE = 1 << 16


def stream_distinct(events: DataFrame, key: str, value: str, width: int, cap: int = 256, delay: str = "1 day") -> DataFrame:
    """seq, late_by, degree (distinct earlier values of the key, at most ``cap``) and distinct (those within ``width``) of a stream."""
    rows = events.dropna(subset=[key]).select("seq", "t", F.col(key).alias("k"), F.col(value).cast("string").alias("v"))
    return _timed(rows, delay).groupBy("k").transformWithStateInPandas(Distinct(width, cap), "seq long, late_by long, degree long, distinct long", "append", "eventTime")


def stage_latency(spark: SparkSession, progress: list) -> DataFrame:
    """(stage, batches, p50, p95, p99) in milliseconds over a query's progress reports, such as ``query.recentProgress``; batches without rows are left out."""
    rows = [(stage, float(ms)) for p in progress if p["numInputRows"] for stage, ms in p["durationMs"].items()]
    table = spark.createDataFrame(rows, "stage string, ms double")
    return table.groupBy("stage").agg(F.count("*").alias("batches"), *[F.percentile("ms", q).alias(name) for name, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))])
