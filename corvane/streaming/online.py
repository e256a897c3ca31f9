"""Structured Streaming twins: trailing windows kept in state, late rows set aside, running tallies."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.velocity import WINDOWS, feature_names

FIELDS = ["t", "cents", "dec", "kno", "ref", "lag", "lags"]
STATE = "rows array<array<bigint>>, life bigint, cents bigint, first bigint, last bigint"


def _output(key: list[str], types: dict[str, str]) -> str:
    doubles = ("ratio", "seconds", "mean", "lag")
    return ", ".join(["seq long", *[f"{k} {types[k]}" for k in key], *[f"{f} {'double' if any(d in f for d in doubles) else 'long'}" for f in feature_names()]])


def online_velocity(events: DataFrame, key: list[str]) -> DataFrame:
    """The features of ``velocity`` for a stream whose rows come in order of (t, seq) within a key.

    State per key: the rows of the longest window, and lifetime sums.  Rows older
    than the window go when the key is next read.
    """
    span = max(WINDOWS.values())
    types = dict(events.dtypes)
    here = F.lit(True)
    for c in key:
        here = here & F.col(c).isNotNull()
    known = F.col("known").cast("long")
    rows = events.where(here).select(
        "seq", *key, "t", "cents", (F.col("declined").cast("long") * known).alias("dec"), known.alias("kno"), F.col("refund").cast("long").alias("ref"),
        F.coalesce(F.col("lag"), F.lit(0)).cast("long").alias("lag"), F.col("lag").isNotNull().cast("long").alias("lags"),
    )

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, life, total, first, last = state.get if state.exists else ([], 0, 0, None, None)
        held = [list(map(int, r)) for r in held]
        out = []
        for r in pd.concat(list(batches)).sort_values(["t", "seq"]).itertuples():
            now = int(r.t)
            held = held[bisect_left([h[0] for h in held], now - span) :]
            times = [h[0] for h in held]
            row: list[float | int | None] = []
            for width in WINDOWS.values():
                part = held[bisect_left(times, now - width) :]
                n, kno = len(part), sum(h[3] for h in part)
                row += [n if life else None, sum(h[1] for h in part) if life else None, sum(h[2] for h in part) / kno if kno else None, sum(h[4] for h in part) / n if n else None]
            lags = sum(h[6] for h in held)
            row += [life or None, (now - first) / 1e6 if life else None, (now - last) / 1e6 if life else None, int(r.cents) * life / total if total else None, sum(h[5] for h in held) / lags if lags else None]
            out.append([int(r.seq), *k, *row])
            held.append([now, *(int(getattr(r, f)) for f in FIELDS[1:])])
            life, total, first, last = life + 1, total + int(r.cents), now if first is None else first, now
        state.update((held, life, total, first, last))
        yield pd.DataFrame(out, columns=["seq", *key, *feature_names()]).astype({f: "Int64" for f in feature_names() if not any(d in f for d in ("ratio", "seconds", "mean", "lag"))})

    return rows.groupBy(*key).applyInPandasWithState(step, _output(key, types), STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per key and window of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))


def split_late(events: DataFrame, last_seen: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a micro-batch in time, and rows earlier than what was already folded, for quarantine."""
    return events.where(F.col("t") >= last_seen), events.where(F.col("t") < last_seen)


def tally_stream(scored: DataFrame, name: str) -> DataStreamWriter:
    """Decisions so far, as an in-memory table."""
    return scored.groupBy("decision").agg(F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName(name)


def score_stream(events: DataFrame, score, path: str, checkpoint: str) -> DataStreamWriter:
    """Score each micro-batch with ``score`` and append the result as Parquet; a repeated batch overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
