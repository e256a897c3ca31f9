"""Mixing sources to target weights by capped water-filling.

Targets: every source gets a share of the budget by weight; sources whose share
exceeds ``max_epochs`` times their size are clamped there, and what they leave is
shared among the rest by weight, until none is above.  Each round is one
aggregate over the table of sources (a row for each source).

Sampling: a source's target is a number of whole passes over it and a rest.  All
documents are taken once for each whole pass; for the rest, documents are taken
in the order of a seeded hash until the rest is met as nearly as whole documents
can.  The place where a source stops is found from sums over ranges of the hash,
so that a source with a third of all rows is still spread over many tasks.

Defined results: null is a source of its own, last; a null or empty text has size
0 and nothing is taken of it; rows with one id share a fate; an empty table gives
an empty result; runs with one seed agree.  Only id, source and text are read by
``mix``; ``repeat_mixed`` returns the columns of its input, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, documents, hash60, unused, words_of

#: A table of stops up to this many rows (some 40 bytes each) is sent to all executors; a larger one is joined by salted keys.
BROADCAST_ROWS = 50_000
SALTS = 64
BUCKET_BITS = 12
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.size(words_of(text)).cast("long")


def water_fill(sources: DataFrame, budget: float, max_epochs: float) -> DataFrame:
    """Add ``target`` to sources(source, source_size, weight)."""
    capped = F.col("cap") <= F.col("level") * F.col("weight")
    table = sources.withColumn("cap", max_epochs * F.col("source_size"))
    level = None
    while True:
        at = table.withColumn("level", F.lit(level if level is not None else -1.0).cast("double"))
        row = at.agg(F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("used"), F.sum(F.when(~capped, F.col("weight")).otherwise(0)).alias("free")).first()
        if not row["free"]:
            return table.select("source", "source_size", "weight", F.col("cap").cast("double").alias("target"))
        new = (budget - row["used"]) / row["free"]
        if level is not None and new <= level:
            break
        level = new
    return table.select("source", "source_size", "weight", F.least(F.col("cap"), F.lit(level) * F.col("weight")).cast("double").alias("target"))


def _position(id_col: Column, seed: str) -> Column:
    return hash60(F.lit(seed), id_col)


def plan_mix(df: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """The stops: source, source_size, target, passes, stop (largest hash of the rest; null: none).

    Sources in code-point order, null last, take ``weights`` in turn.
    """
    rows = df.select(F.col(source_col).alias("source"), _position(F.col(id_col), seed).alias("h"), n_words(F.col(text_col)).alias("size"))
    rows = rows.withColumn("bucket", F.shiftright("h", 60 - BUCKET_BITS))
    points = checkpointed(rows.groupBy("source", "bucket", "h").agg(F.sum("size").alias("size")))
    buckets = checkpointed(points.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    sources = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    sources = checkpointed(sources.withColumn("weight", F.get(turn, (F.row_number().over(place) - 1) % len(weights))))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    filled = water_fill(sources, budget, max_epochs)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    filled = filled.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("l.source").eqNullSafe(F.col("r.source"))
    starts = buckets.withColumn("start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    starts = starts.alias("l").join(filled.alias("r"), same).select("l.source", "bucket", "start", "bucket_size", "rest")
    # The rest ends in one bucket of each source at most: only its rows are put in order.
    inside = starts.where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("bucket_size")))
    both = same & (F.col("l.bucket") == F.col("r.bucket"))
    run = Window.partitionBy("source", "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    last = points.alias("l").join(inside.alias("r"), both).select("l.source", "l.bucket", "h", "size", "start", "rest")
    last = last.withColumn("at", F.col("start") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    stops = last.groupBy("source").agg(F.max(F.when(F.col("at") + F.col("size") / 2 <= F.col("rest"), F.col("h"))).alias("within"), F.min(F.shiftleft(F.col("bucket"), 60 - BUCKET_BITS)).alias("floor"))
    stop = F.when(F.col("rest") > 0, F.coalesce(F.col("within"), F.col("floor") - 1))
    return filled.alias("l").join(stops.alias("r"), same, "left").select("l.source", "source_size", "target", "passes", stop.alias("stop"))


def _with_copies(df: DataFrame, stops: DataFrame, source_col: str, position: Column) -> tuple[DataFrame, str]:
    """df and its stop's columns in one struct column, whose name is returned."""
    name, salt = unused(df, "mix"), unused(df, "mix_salt")
    stops = checkpointed(stops)
    few = stops.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    right = stops.select(F.struct(*stops.columns).alias(name))
    same = F.col(f"`{source_col}`").eqNullSafe(F.col(name)["source"])
    if few:
        joined = df.join(F.broadcast(right), same)
    else:
        salted = right.withColumn(salt + "r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = df.withColumn(salt, F.pmod(position, F.lit(SALTS)).cast("int")).join(salted, same & (F.col(salt) == F.col(salt + "r"))).drop(salt, salt + "r")
    return joined, name


def _copies(mix: str, position: Column) -> Column:
    extra = F.when(position <= F.col(mix)["stop"], 1).otherwise(0)
    return (F.col(mix)["passes"] + extra).cast("long")


def mix(df: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """Per row: id, size, its source's source_size and target, taken (words, repeats counted)."""
    stops = plan_mix(df, weights, share, max_epochs, id_col, source_col, text_col, seed)
    position = _position(F.col(id_col), seed)
    narrow = df.select(F.col(id_col), F.col(source_col), n_words(F.col(text_col)).alias("size"))
    joined, name = _with_copies(narrow, stops, source_col, position)
    return joined.select(F.col(id_col), "size", F.col(name)["source_size"].alias("source_size"), F.col(name)["target"].alias("target"), (_copies(name, position) * F.col("size")).alias("taken"))


def repeat_mixed(df: DataFrame, weights: list[int], share: float = 1.5, max_epochs: float = 2.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken, with the columns of ``df``."""
    stops = plan_mix(df, weights, share, max_epochs, id_col, source_col, text_col, seed)
    position = _position(F.col(id_col), seed)
    joined, name = _with_copies(df, stops, source_col, position)
    copy = unused(joined, "mix_copy")
    taken = joined.where(_copies(name, position) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), _copies(name, position))))
    return taken.select(*[F.col(f"`{c}`") for c in df.columns])


WEIGHTS = [3, 1, 2]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir), WEIGHTS)


def mix_sql(table: str = "documents", result: str = "doc_id, size, source_size, target, (copies * size)::BIGINT AS taken") -> str:
    """DuckDB's form: the clamped sources are a prefix in the order of size by weight."""
    return rf"""
    WITH d AS (
      SELECT *, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
        ('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
      FROM {table}
    ), s AS (
      SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
    ), t AS (
      SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s
    ), o AS (
      SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
        sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM t
    ), c AS (
      SELECT *, cap <= (budget - used) / free * weight AS capped FROM o
    ), lv AS (
      SELECT (max(budget) - coalesce(sum(cap) FILTER (capped), 0)) / sum(weight) FILTER (NOT capped) AS level FROM c
    ), f AS (
      SELECT source, source_size, CASE WHEN capped THEN cap ELSE least(cap, level::DOUBLE * weight) END::DOUBLE AS target FROM c, lv
    ), g AS (
      SELECT source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS passes FROM f
    ), p AS (
      SELECT source, h, sum(size) AS points FROM d GROUP BY source, h
    ), q AS (
      SELECT source, h, points, coalesce(sum(points) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p
    ), r AS (
      SELECT q.source, q.h, g.source_size, g.target,
        g.passes + CASE WHEN g.target - g.passes * g.source_size > 0 AND start + points / 2.0 <= g.target - g.passes * g.source_size THEN 1 ELSE 0 END AS copies
      FROM q JOIN g ON q.source IS NOT DISTINCT FROM g.source
    ), mixed AS (
      SELECT d.*, r.source_size, r.target, r.copies FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.h = r.h
    )
    SELECT {result} FROM mixed
    """


SQL = mix_sql()
