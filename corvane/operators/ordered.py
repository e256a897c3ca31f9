"""Running sums and ranks over a global order, without a task that sees all rows.

Distinct values are dealt into ranges by Spark's range partitioning (equal values
share a range), as many as the session has shuffle partitions.  Sums run within a
range, and a range's start comes from the totals of the ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, value: str, sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """A row per distinct non-null value: value, each sum at it (``x``) and below it (``x_below``)."""
    from corvane.plans.session import checkpointed

    points = df.where(F.col(value).isNotNull()).groupBy(value).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # The range number is fixed by the checkpoint.
    cut = points.repartitionByRange(value) if ranges is None else points.repartitionByRange(ranges, value)
    points = checkpointed(cut.withColumn("part", F.spark_partition_id()))
    totals = points.groupBy("part").agg(*[F.sum(n).alias(f"{n}_all") for n in sums])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select("part", *[F.coalesce(F.sum(f"{n}_all").over(earlier), F.lit(0)).alias(f"{n}_start") for n in sums])
    below = Window.partitionBy("part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    within = points.select(value, "part", *sums, *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"{n}_in") for n in sums])
    return within.join(F.broadcast(starts), "part").select(value, *sums, *[(F.col(f"{n}_in") + F.col(f"{n}_start")).alias(f"{n}_below") for n in sums])


def running_by_span(rows: DataFrame, key: list[str], span: Column, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """rows with each sum over the key's earlier rows by ``order``.

    A key's rows are cut by ``span``, which must not fall along the order; sums run
    within a span and begin at the totals of the key's earlier spans, so that a
    frequent key is spread over its spans.
    """
    marked = rows.withColumn("span_", span).withColumns({f"v_{n}": c for n, c in sums.items()})
    before = Window.partitionBy(*key).orderBy("span_").rowsBetween(Window.unboundedPreceding, -1)
    totals = marked.groupBy(*key, "span_").agg(*[F.sum(f"v_{n}").alias(f"all_{n}") for n in sums])
    starts = totals.select(*key, "span_", *[F.coalesce(F.sum(f"all_{n}").over(before), F.lit(0)).alias(f"start_{n}") for n in sums])
    inside = Window.partitionBy(*key, "span_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = marked.withColumns({f"in_{n}": F.coalesce(F.sum(f"v_{n}").over(inside), F.lit(0)) for n in sums}).join(starts.hint("merge"), [*key, "span_"])
    return summed.select(*rows.columns, *[(F.col(f"in_{n}") + F.col(f"start_{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, value: str, tie: str, out: str = "ordinal") -> DataFrame:
    """df with the place from 0 of each row by (value, tie); values must not be null."""
    r = running(df, value, {"rows_n": F.lit(1)}).select(value, "rows_n_below")
    within = F.row_number().over(Window.partitionBy(value).orderBy(tie)) - 1
    return df.withColumn(out, within).join(r, value).select(*df.columns, (F.col(out) + F.col("rows_n_below")).alias(out))


def average_rank(df: DataFrame, value: str, out: str = "rank") -> DataFrame:
    """(value, rank): the 1-based average rank of each distinct value."""
    r = running(df, value, {"rows_n": F.lit(1)})
    return r.select(value, (F.col("rows_n_below") + (F.col("rows_n") + 1) / 2).alias(out))


def quantiles(df: DataFrame, value: str, at: list[float]) -> list[float | None]:
    """Exact quantiles with linear interpolation between neighbours."""
    r = running(df, value, {"rows_n": F.lit(1)})
    n = r.agg(F.sum("rows_n")).first()[0]
    if not n:
        return [None] * len(at)
    places = sorted({p for q in at for p in (int(q * (n - 1)), min(int(q * (n - 1)) + 1, n - 1))})
    wanted = F.array(*[F.lit(p) for p in places])
    rows = r.select(value, F.filter(wanted, lambda p: (p >= F.col("rows_n_below")) & (p < F.col("rows_n_below") + F.col("rows_n"))).alias("p")).where(F.size("p") > 0).select(value, F.explode("p").alias("p")).collect()
    of = {x["p"]: float(x[value]) for x in rows}
    out = []
    for q in at:
        lo = int(q * (n - 1))
        frac = q * (n - 1) - lo
        a, b = of[lo], of[min(lo + 1, n - 1)]
        out.append(a + (b - a) * frac)
    return out




def long_form(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(*keep, name, value): a row for each non-null value of the columns, as doubles."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("cell_")).select(*keep, "cell_.name", "cell_.value").where("value is not null")


def running_by(df: DataFrame, by: str, value: str, sums: dict[str, Column]) -> DataFrame:
    """As ``running`` within each group: by, value, each sum at it (``x``), below it in its group (``x_below``) and over its group (``x_all``).

    Groups of any number and size in one pass: distinct (by, value) in ranges, never a group in one task.
    """
    there = df.where(F.col(value).isNotNull()).withColumn("at_", F.struct(F.col(by).alias("by"), F.col(value).alias("value")))
    r = running(there, "at_", sums)
    groups = r.groupBy(F.col("at_.by").alias("group_")).agg(*[f(c).alias(f"{n}{end}") for n in sums for f, c, end in ((F.min, f"{n}_below", "_start"), (F.sum, n, "_all"))])
    placed = r.join(groups, F.col("at_.by").eqNullSafe(F.col("group_")))
    return placed.select(F.col("at_.by").alias(by), F.col("at_.value").alias(value), *sums, *[(F.col(f"{n}_below") - F.col(f"{n}_start")).alias(f"{n}_below") for n in sums], *[f"{n}_all" for n in sums])


def quantiles_by(df: DataFrame, by: str, value: str, at: list[float]) -> DataFrame:
    """(by, n, q0, q1, ...): exact quantiles of each group, with linear interpolation between neighbours; null values are left out."""
    r = running_by(df, by, value, {"n": F.lit(1)})
    place = [q * (F.col("n_all") - 1) for q in at]
    low = [F.floor(p) for p in place]

    def inside(p: Column) -> Column:
        return (p >= F.col("n_below")) & (p < F.col("n_below") + F.col("n"))

    ends = [(inside(p), inside(F.least(p + 1, F.col("n_all") - 1))) for p in low]
    wanted = ends[0][0] | ends[0][1]
    for a, b in ends[1:]:
        wanted = wanted | a | b
    v = F.col(value).cast("double")
    found = r.where(wanted).groupBy(by, "n_all").agg(*[F.max(F.when(side, v)).alias(f"{name}{i}") for i, both in enumerate(ends) for name, side in zip("ab", both, strict=True)])
    return found.select(by, F.col("n_all").alias("n"), *[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * (place[i] - low[i])).alias(f"q{i}") for i in range(len(at))])


def group_quantiles(df: DataFrame, key: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(key, *wanted): exact quantiles (column, share) of each group, all of them in one pass; groups without any value are left out."""
    columns, shares = list(dict.fromkeys(c for c, _ in wanted.values())), list(dict.fromkeys(q for _, q in wanted.values()))
    long = long_form(df.withColumn("key_", F.struct(F.col(key).alias("k"))), columns, "key_").select(F.struct("key_", "name").alias("group_key"), "value")
    found = quantiles_by(long, "group_key", "value", shares)
    picked = [F.max(F.when(F.col("group_key.name") == c, F.col(f"q{shares.index(q)}"))).alias(out) for out, (c, q) in wanted.items()]
    return found.groupBy(F.col("group_key.key_.k").alias(key)).agg(*picked)


def with_quantiles(grouped: DataFrame, df: DataFrame, key: str, wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """grouped, a row for each non-null key of df, with quantiles of df's columns (null without values)."""
    return grouped.join(group_quantiles(df, key, wanted), key, "left")
