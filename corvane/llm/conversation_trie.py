"""Prefix trie of conversations, built level by level.

A node of depth d is a distinct sequence of the first d turns; it is named by its
depth and the least conv_id among its members.  Construction is level-synchronous:
at each depth the live conversations are grouped by (parent node, next turn) and
each group's least conv_id becomes the child's name.  A conversation is live while
it shares its node; once it is alone, its other turns are nodes of their own that
need no more grouping, so there are as many rounds as turns are shared.  Then
joins from the deepest shared level up to the root roll up leaves and savings.

Hot keys: groups are made by aggregates, which combine within tasks before the
shuffle; groups of more than a thousandth of a level's rows (a thousand at most) are
joined back by broadcast, the others by shuffle; a conversation's turns are numbered
by ranges and joined by blocks of 1024, so that one that holds a third of all turns
is spread over tasks.  The ids that end at a node are joined into text by blocks of
4096 numbers, and a digest over many blocks reads them in order as a stream.

Defined results: a null conv_id takes no part; a null role or text is empty; turns
come in the order of turn (null first), those with equal turn in the order of
their digest, repeated turns all count; the remainder of a negative conv_id is SQL's
(towards zero); conversations of any length and texts of any
length are taken whole; no conversation gives an empty result, else there is a
root.  Turns are told apart by the SHA-256 of role and text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import _checkpoint_folder, checkpointed, words_of, written

#: Bits of the number of turns in a block of a conversation, and of the ids in a block of a node's ends.
TURN_BLOCK, END_BLOCK = 10, 12
#: A level's groups of more than its rows divided by this are joined by broadcast: so many rows at most.
HOT_GROUPS = 1000
COLUMNS = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_key(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def numbered_turns(df: DataFrame) -> DataFrame:
    """(conv_id, place, key, words): the turns of each conversation, numbered from 1.

    Rows are dealt into ranges of (conv_id, turn); numbers run within a range and
    begin at the counts of the conversation's earlier ranges.
    """
    narrow = df.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.size(words_of(F.col("text"))).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")
    )
    order = [F.col("turn").asc_nulls_first(), F.col("key"), F.col("row")]
    cut = written(narrow.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    counts = cut.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.sum("n").over(before)).where("start is not null").select("conv_id", "part", "start")  # a range has one at most
    within = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*order))
    return cut.withColumn("place", within).join(F.broadcast(starts), ["conv_id", "part"], "left").select("conv_id", (F.col("place") + F.coalesce("start", F.lit(0))).alias("place"), "key", "words")


def _by_blocks(rows: DataFrame, place: str, convs: DataFrame, first: Column, last: Column) -> DataFrame:
    """Join rows(conv_id, place, ...) with convs, a row for each conversation, by blocks of places from first to last."""
    blocks = convs.withColumn("block", F.explode(F.sequence(F.shiftright(first, TURN_BLOCK), F.shiftright(last, TURN_BLOCK))))
    return rows.withColumn("block", F.shiftright(F.col(place), TURN_BLOCK)).join(blocks, ["conv_id", "block"]).drop("block")


def plain_steps(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """steps(conv_id, d, key, words) and convs(conv_id, length) of numbered turns as they are."""
    return turns.withColumnRenamed("place", "d"), turns.groupBy("conv_id").agg(F.count("*").alias("length"))


def rebuilt_steps(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """As ``plain_steps``, each conversation c rebuilt from the first h turns of c - c % family and its own turns after its first h; h = crc32(c) % most."""
    turns = written(turns)
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = lengths.withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    bases = lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("h", F.coalesce("base_n", F.lit(0))).cast("long")
    convs = checkpointed(convs.join(bases, "base", "left").select("conv_id", "base", "n", "h", taken.alias("m")).withColumn("length", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    heads = turns.where(F.col("place") < most).withColumnRenamed("conv_id", "base").join(convs.where("m > 0").select("conv_id", "base", "m"), "base").where("place <= m")
    own = _by_blocks(turns.where(F.col("place") > head), "place", convs.where("n > h").select("conv_id", "h", "m", "n"), F.col("h") + 1, F.col("n"))
    steps = heads.select("conv_id", F.col("place").cast("long").alias("d"), "key", "words").unionByName(own.select("conv_id", (F.col("m") + F.col("place") - F.col("h")).cast("long").alias("d"), "key", "words"))
    return steps, convs.select("conv_id", "length")


def _down(steps: DataFrame, convs: DataFrame, folder: str) -> int:
    """Write nodes/d=.. (node, parent, n, words, length) and, of shared nodes, members/d=.. (conv_id, node, length); return the deepest level that has nodes."""
    spark = steps.sparkSession
    read = lambda kind, d: spark.read.parquet(f"{folder}/{kind}/d={d}")
    convs.agg(F.min("conv_id").alias("node"), F.lit(None).cast("long").alias("parent"), F.count("*").alias("n"), F.lit(0).cast("long").alias("words"), F.max("length").alias("length")).where("n > 0").write.parquet(f"{folder}/nodes/d=0")
    root = read("nodes", 0).first()
    if root is None:
        return -1
    convs.select("conv_id", F.lit(root["node"]).cast("long").alias("node"), "length").write.parquet(f"{folder}/members/d=0")
    d = 0
    while True:
        live = read("members", d).where(F.col("length") > d)
        d += 1
        nexts = written(live.join(steps.where(F.col("d") == d).select("conv_id", "key", "words"), "conv_id"))
        groups = nexts.groupBy("node", "key").agg(F.min("conv_id").alias("child"), F.count("*").alias("n"), F.min("words").alias("words"), F.max("length").alias("length"))
        groups.select(F.col("child").alias("node"), F.col("node").alias("parent"), "n", "words", "length", "key").write.parquet(f"{folder}/nodes/d={d}")
        made = read("nodes", d).select(F.col("parent").alias("node"), "key", F.col("node").alias("child"), "n")
        size = made.agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("n") > 1, F.col("n"))).alias("shared")).first()
        if not size["shared"]:
            return d if size["rows"] else d - 1
        hot = F.broadcast(made.where(F.col("n") > max(1, size["rows"] // HOT_GROUPS)).select("node", "key", "child"))
        cold = made.where((F.col("n") > 1) & (F.col("n") <= max(1, size["rows"] // HOT_GROUPS))).select("node", "key", "child")
        kept = [F.col("conv_id"), F.col("child").alias("node"), F.col("length")]
        by_hot = nexts.join(hot, ["node", "key"]).select(*kept)
        by_cold = nexts.join(hot, ["node", "key"], "left_anti").join(cold, ["node", "key"]).select(*kept)
        by_hot.unionByName(by_cold).write.parquet(f"{folder}/members/d={d}")


def _up(spark: SparkSession, folder: str, deepest: int) -> DataFrame:
    """(depth, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of the root and all shared nodes."""
    below = None
    for d in range(deepest, -1, -1):
        nodes = spark.read.parquet(f"{folder}/nodes/d={d}").select("node", "parent", "n", "words")
        shared = nodes if d == 0 else nodes.where("n > 1")
        if below is None:
            rolled = shared.select("*", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("under"))
        else:
            sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("under")).withColumnRenamed("parent", "node")
            zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
            rolled = shared.join(sums, "node", "left").select(*shared.columns, F.coalesce("n_children", zero).alias("n_children"), F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("under", zero).alias("under"))
        rolled.select("node", "parent", "n", "n_children", "n_leaves", ((F.col("n") - 1) * F.col("words") + F.col("under")).alias("saved")).write.parquet(f"{folder}/rolled/d={d}")
        alone = nodes.where("n = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved"))
        below = spark.read.parquet(f"{folder}/rolled/d={d}").select("parent", "n_leaves", "saved").unionByName(alone) if d else None
    rolled = spark.read.parquet(f"{folder}/rolled")
    return rolled.select(F.col("d").cast("long").alias("depth"), F.col("node").alias("conv_id"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", F.col("saved").alias("saved_tokens"))


def _ends(members: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of members(d, node, conv_id): the digest of each node's ids, joined in order."""
    ids = F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string"))
    blocks = members.groupBy("d", "node", F.shiftright("conv_id", END_BLOCK).alias("block")).agg(F.array_join(ids, ",").alias("said"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["depth", "conv_id", "ends_sha256"])

        at, digest = None, None
        for batch in batches:
            made = []
            for d, node, said in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (d, node) == at:
                    digest.update(b",")
                else:
                    if at is not None:
                        made.append((*at, digest.hexdigest()))
                    at, digest = (d, node), hashlib.sha256()
                digest.update(said.as_buffer())
            yield done(made)
        if at is not None:
            yield done([(*at, digest.hexdigest())])

    ordered = blocks.repartition("d", "node").sortWithinPartitions("d", "node", "block").select(F.col("d").cast("long"), "node", "said")
    return ordered.mapInArrow(run, "depth long, conv_id long, ends_sha256 string")


def build_trie(steps: DataFrame, convs: DataFrame) -> DataFrame:
    """A row for each node, as in ``COLUMNS``, of steps(conv_id, d, key, words) and convs(conv_id, length), d from 1 to length."""
    spark = steps.sparkSession
    folder = f"{_checkpoint_folder(spark)}/trie-{uuid.uuid4().hex}"
    # Sorted by level, so that a round reads its own level's row groups.
    steps = written(steps.repartitionByRange("d", "conv_id").sortWithinPartitions("d", "conv_id"))
    deepest = _down(steps, convs, folder)
    if deepest < 0:
        return spark.createDataFrame([], COLUMNS)
    ends = _ends(spark.read.parquet(f"{folder}/members").where(F.col("length") == F.col("d")))
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    shared = _up(spark, folder, deepest).join(ends, ["depth", "conv_id"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nobody))
    alone = spark.read.parquet(f"{folder}/nodes").where("n = 1 and d > 0").select(F.col("node").alias("conv_id"), F.col("d").cast("long").alias("since"), "parent", "length")
    last = F.col("d") == F.col("length")
    tails = _by_blocks(steps, "d", alone, F.col("since"), F.col("length")).where("d >= since").select(
        F.col("d").alias("depth"), "conv_id", F.when(F.col("d") == F.col("since"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nobody).alias("ends_sha256"),
    )
    return shared.unionByName(tails).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(df: DataFrame) -> DataFrame:
    """The trie of the conversations of df(conv_id, turn, role, text) as they are."""
    turns = written(numbered_turns(df))
    return build_trie(*plain_steps(turns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_trie(*rebuilt_steps(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


# DuckDB has no crc32: the checksum is the usual reflected polynomial, a bit table of 256 entries made by rule.
SQL = r"""
WITH RECURSIVE bits AS (
  SELECT b AS b, b::BIGINT AS v, 0 AS k FROM range(256) t(b)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crc AS (
  SELECT list(v ORDER BY b) AS tab FROM bits WHERE k = 8
), t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), l AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || text)) AS ts FROM t GROUP BY conv_id
), c AS (
  SELECT conv_id, ts, xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
      lambda a, x: xor(tab[(xor(a, x) & 255) + 1], a >> 8))) % 4 AS h
  FROM l, crc
), r AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM c LEFT JOIN l b ON b.conv_id = c.conv_id - c.conv_id % 20
), p AS (
  SELECT conv_id, d, len(ts) AS n_turns, ts[1:d] AS p FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)
), g AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (n_turns = d), '') AS ends FROM p GROUP BY d, p
), k AS (
  SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL
), m AS (
  SELECT g.*, coalesce(n_children, 0) AS n_children,
    CASE WHEN g.d = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split_regex(g.p[g.d].t, '[\x20\x09-\x0D]+'), lambda x: x <> '')) END AS own
  FROM g LEFT JOIN k ON g.d = k.d AND g.p = k.p
), a AS (
  SELECT a AS d, p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM m) GROUP BY ALL
)
SELECT m.conv_id::BIGINT AS conv_id, m.d::BIGINT AS depth, u.conv_id::BIGINT AS parent_conv_id, m.n_convs::BIGINT AS n_convs, m.n_children::BIGINT AS n_children,
  a.n_leaves::BIGINT AS n_leaves, a.saved::BIGINT AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN a ON m.d = a.d AND m.p = a.p LEFT JOIN g u ON u.d = m.d - 1 AND u.p = m.p[1:m.d - 1]
"""
