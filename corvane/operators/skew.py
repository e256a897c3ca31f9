"""Joins that a frequent key does not pile up in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that hold more than this part of the rows are looked up by broadcast: so many keys at most, at any size.
PARTS = 1000
#: Rows of a table so small that one key may hold all of them.
SMALL = 1_000_000


def is_small(df: DataFrame) -> bool:
    return df.limit(SMALL + 1).count() <= SMALL


def look_up(rows: DataFrame, key: str, table: DataFrame, table_key: str, how: str = "inner", parts: int = PARTS) -> DataFrame:
    """rows joined with the one row of ``table`` that their key has; ``table`` has unique keys, and no other column of ``rows``.

    Keys of more than a ``parts``-th of the rows meet their row by broadcast (they
    are fewer than ``parts``), the others by an ordinary join; null keys match nothing.
    ``rows`` is read four times: hand in a table or a checkpoint.
    """
    if is_small(rows):
        return rows.join(table, F.col(key) == F.col(table_key), how).drop(table_key)
    counts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("hot_key")).agg(F.count("*").alias("hot_n"))
    total = counts.agg(F.sum("hot_n"), F.max("hot_n")).first()
    rest, found = rows, None
    if total[0] and total[1] > max(1, total[0] // parts):
        hot = counts.where(F.col("hot_n") > max(1, total[0] // parts)).select("hot_key")
        near = F.broadcast(table.join(F.broadcast(hot), F.col(table_key) == F.col("hot_key"), "left_semi"))
        found = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left_semi").join(near, F.col(key) == F.col(table_key), how)
        rest = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left_anti")
    cold = rest.join(table, F.col(key) == F.col(table_key), how)
    return (cold if found is None else found.unionByName(cold)).drop(table_key)

