"""Language-model scoring by prediction by partial matching (PPM) over bytes.

A text is the byte string of its words, A-Z lower-cased, each followed by a
space, then an end byte.  The model is a trie of byte contexts up to ``ORDER``
with the counts of the bytes that follow them, gathered from all training texts;
no context and no follower is left out, so the trie grows with the corpus.  A
byte is coded in the longest context known; a byte new to a context costs an
escape, estimated by a discount on the count of each distinct follower (a form of
method D), and is coded in the next shorter context from which the followers
already excluded are left out.  Below the empty context the byte values left are
equally likely.

The trie is a table of grams (a context and its follower), never held in one
place.  A shorter context has all followers of the longer ones, so what remains of
it under exclusion depends on the longer context alone: two numbers a context,
found by joins of the table with itself, make every code length a sum of table
entries.  Texts are cut into blocks of about ``BLOCK`` bytes; a block's distinct
grams and words are tallied in its task, priced by joins on the gram and the word,
and sent back to the block's texts, which look up every byte.  A gram or word
occurs at most once for each block on either side of those joins, so none is
frequent enough to fill a task.

Defined results: a null or empty text has the end token alone; rows are scored
one by one, repeated ids included, and equal texts get equal scores; a text of any
length is scored whole; with no training text every byte value is equally likely; an empty table gives an empty
result.  Only id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, checkpointed, documents, id_remainder, slices, written

#: Bytes of context; a gram, one byte longer, fits a long.  Each byte more about trebles the trie and what is shuffled.
ORDER = 4
#: Taken from each follower's count and given to the escape.
DISCOUNT = 0.4
END = b"\n"
#: A block ends once it has so many bytes of text, or so many distinct grams and words; a task holds one block.
BLOCK, ENTRIES = 24 << 20, 2_000_000
#: Grams held before they are summed, besides twice those summed already.
MERGE = 1 << 20


def serialised(text: bytes) -> bytes:
    words = text.translate(LOWER_AZ).split()
    return b" ".join(words) + b" " + END if words else END


def grams_of(strings: list[bytes], order: int) -> np.ndarray:
    """For each byte: itself in the low byte, the ``order`` bytes before it above (end bytes before the first)."""
    pad = END * order
    flat = np.frombuffer(b"".join(x for s in strings for x in (pad, s)), np.uint8)
    code = np.zeros(len(flat), np.int64)
    for k in range(order + 1):
        code[order:] |= flat[order - k : len(flat) - k].astype(np.int64) << (8 * k)
    scored = np.ones(len(flat), bool)
    starts = np.cumsum([len(s) + order for s in strings]) - [len(s) for s in strings]
    for k in range(1, order + 1):
        scored[starts - k] = False
    return code[scored]


def cut_blocks(df: DataFrame, train: Column, order: int, id_col: str, text_col: str) -> DataFrame:
    """Texts in blocks, and what the blocks hold: rows of two kinds in one table.

    A row of a text has block, k (its id), learn (whether to learn from it) and s
    (serialised); a row of a distinct gram or word of a block has block, gram or
    word, and n, its count in the block's texts to learn from.
    """
    text = F.col(f"`{text_col}`").cast("string")
    narrow = df.select(F.col(f"`{id_col}`").alias("k"), text.alias("t"), F.coalesce(train, F.lit(False)).alias("learn"))
    size = narrow.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    # A partition ends a block: fewer, larger partitions make fuller blocks.
    narrow = narrow.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-size // BLOCK)))
    names = ["block", "k", "learn", "s", "gram", "word", "n"]
    types = [pa.int64(), None, pa.bool_(), pa.binary(), pa.int64(), pa.binary(), pa.int64()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, merged = TaskContext.get().partitionId() << 32, 0, 0
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        words: Counter[bytes] = Counter()
        key = None

        def rows(length: int, **columns: pa.Array) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(length, t or key)) for c, t in zip(names, types, strict=True)], names=names)

        def merge() -> int:
            codes, inverse = np.unique(np.concatenate([c for c, _ in grams]), return_inverse=True)
            grams[:] = [(codes, np.bincount(inverse, np.concatenate([n for _, n in grams])).astype(np.int64))]
            return len(codes)

        def found() -> Iterator[pa.RecordBatch]:
            merge()
            codes, n = grams[0]
            yield rows(len(codes), block=pa.array(np.full(len(codes), block)), gram=pa.array(codes), n=pa.array(n))
            yield rows(len(words), block=pa.array(np.full(len(words), block, np.int64)), word=pa.array(list(words), pa.binary()), n=pa.array(list(words.values()), pa.int64()))
            grams.clear()
            words.clear()

        for part, raw in slices(batches, 1):
            key = part.column(0).type
            strings, learns = [serialised(t) for t in raw], part.column(2).to_pylist()
            yield rows(len(strings), block=pa.array(np.full(len(strings), block)), k=part.column(0), learn=part.column(2), s=pa.array(strings, pa.binary()))
            size += sum(map(len, strings))
            for learn in (True, False):
                mine = [s for s, x in zip(strings, learns, strict=True) if x == learn]
                if mine:
                    codes, n = np.unique(grams_of(mine, order), return_counts=True)
                    grams.append((codes, n if learn else np.zeros(len(n), np.int64)))
                    seen = Counter(chain.from_iterable(map(bytes.split, mine)))
                    words.update(seen if learn else dict.fromkeys(seen, 0))
            if sum(len(c) for c, _ in grams) > 2 * merged + MERGE:
                merged = merge()
            if size >= BLOCK or merged + len(words) >= ENTRIES:
                yield from found()
                block, size, merged = block + 1, 0, 0
        if grams:
            yield from found()

    return narrow.mapInArrow(run, f"block long, k {narrow.schema['k'].dataType.simpleString()}, learn boolean, s binary, gram long, word binary, n long")


def _tail(gram: Column, k: int) -> Column:
    """The gram's follower and the last ``k`` bytes of its context."""
    return gram.bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))


def trie(grams: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """The trie of grams(gram, n): its grams (k, g, n), k from 0 to ``order``, and its contexts.

    contexts(k, context, ...): ``whole`` and ``escape`` are log10 of the count of
    all followers and of the probability of a new one; ``rest`` and ``onward`` are
    those of the context one byte shorter, without the followers of this one.
    """
    levels = F.array(*[F.struct(F.lit(k).alias("k"), _tail(F.col("gram"), k).alias("g")) for k in range(order + 1)])
    table = written(grams.where("n > 0").select(F.explode(levels).alias("x"), "n").groupBy("x.k", "x.g").agg(F.sum("n").alias("n")))
    shorter = table.select((F.col("k") + 1).alias("k"), F.col("g").alias("tail"), F.col("n").alias("tail_n"))
    cut = F.element_at(F.array(*[F.lit((1 << 8 * k) - 1) for k in range(order + 1)]), F.col("k") + 1)
    with_tail = table.withColumn("tail", F.when(F.col("k") > 0, F.col("g").bitwiseAND(cut))).join(shorter, ["k", "tail"], "left")
    sums = with_tail.groupBy("k", F.shiftright("g", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("followers"), F.sum("tail_n").alias("covered"))
    sums = written(sums)
    above = sums.select((F.col("k") + 1).alias("k"), F.col("context").alias("up"), F.col("total").alias("up_total"), F.col("followers").alias("up_followers"))
    up = F.when(F.col("k") > 0, F.shiftright(F.shiftleft("context", 8).bitwiseAND(cut), 8))
    rest, new = F.col("up_total") - F.col("covered"), F.col("up_followers") - F.col("followers")
    contexts = sums.withColumn("up", up).join(above, ["k", "up"], "left").select(
        "k", "context", "followers", F.log10("total").alias("whole"), F.log10(DISCOUNT * F.col("followers") / F.col("total")).alias("escape"),
        F.when(rest > 0, F.log10(rest)).alias("rest"), F.when(rest > 0, F.log10(DISCOUNT * new / rest)).otherwise(F.lit(0.0)).alias("onward"),
    )
    return table, written(contexts)


def price(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, value): log10 probability of each gram's last byte after the others, for all of grams(gram, n); ``n`` counts it in the training texts."""
    table, contexts = trie(grams, order)

    def contexts_of(k: int) -> DataFrame:
        return contexts.where(F.col("k") == k).drop("k")

    seen = grams.where("n > 0").withColumn("context", F.shiftright("gram", 8)).join(contexts_of(order), "context").select("gram", (F.log10(F.col("n") - DISCOUNT) - F.col("whole")).alias("value"))
    # Grams that training lacks: down through their ends until all are known, then up again.
    levels, missing = [], grams.where("n = 0").select(F.col("gram").alias("g"))
    for k in range(order, -1, -1):
        known = table.where(F.col("k") == k).select("g", "n")
        level = missing.join(known, "g", "left").withColumn("context", F.shiftright("g", 8)).join(contexts_of(k), "context", "left")
        levels.append(checkpointed(level))
        missing = levels[-1].where("n IS NULL").select(_tail(F.col("g"), k - 1).alias("g")).distinct() if k else None
    direct, found = F.log10(F.col("n") - DISCOUNT) - F.col("whole"), None
    for k, level in enumerate(reversed(levels)):
        if not k:
            after = F.when(F.col("n").isNull(), -F.log10(F.lit(256) - F.coalesce("followers", F.lit(0))))
            value = F.coalesce(direct, F.coalesce("escape", F.lit(0.0)) + after)
        else:
            level = level.withColumn("tail", F.when(F.col("n").isNull(), _tail(F.col("g"), k - 1))).join(found, "tail", "left")
            # ``after``: the value once the byte has escaped from this context.
            after = F.coalesce(F.log10(F.col("tail_n") - DISCOUNT) - F.col("rest"), F.col("onward") + F.col("tail_after"))
            value = F.coalesce(direct, F.col("escape") + after, F.col("tail_value"))
        found = level.select(F.col("g").alias("tail"), F.col("n").alias("tail_n"), after.alias("tail_after"), value.alias("tail_value"))
    return seen.unionByName(found.select(F.col("tail").alias("gram"), F.col("tail_value").alias("value")))


def score_texts(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score; ``train`` marks the rows to learn from.

    ``score`` is the model's log10 probability, ``base_score`` that of a plain
    word model with half a count added to each word.
    """
    if not 1 <= order <= 6:
        raise ValueError("a gram of order + 1 bytes must fit a positive long")
    found = written(cut_blocks(df, train, order, id_col, text_col))
    texts = found.where("s IS NOT NULL").select("block", "k", "learn", "s")
    words = written(found.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("c"), F.count("*").alias("blocks")))
    grams = written(found.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n").alias("n")))
    n_docs = texts.where("learn").count()
    sums = words.agg(F.sum("c").alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    n = (sums["c"] or 0) + n_docs
    norm = math.log10(n + 0.5 * (sums["v"] + (n_docs > 0) + 1))
    prices = written(price(grams, order))
    # A word of one block has all its counts there.
    spread = words.where("blocks > 1").select("word", "c")
    needs = found.where("gram IS NOT NULL").select("block", "gram").join(prices, "gram").select(F.col("block").alias("of"), "gram", F.lit(None).cast("binary").alias("word"), "value").unionByName(
        found.where("word IS NOT NULL").select("block", "word").join(spread, "word").select(F.col("block").alias("of"), F.lit(None).cast("long").alias("gram"), "word", F.col("c").cast("double").alias("value"))
    )

    def run(rows: pa.Table, table: pa.Table) -> pa.Table:
        is_gram = table["gram"].is_valid()
        priced, counted = table.filter(is_gram), table.filter(pa.compute.invert(is_gram))
        known, first = np.unique(priced["gram"].to_numpy(), return_index=True)
        values = priced["value"].to_numpy()[first]
        count_of = Counter(chain.from_iterable(s.split() for s in rows.filter(rows["learn"])["s"].to_pylist()))
        count_of.update({w: int(c) - count_of[w] for w, c in zip(counted["word"].to_pylist(), counted["value"].to_pylist(), strict=True)})
        index = dict(zip(count_of, range(1, len(count_of) + 1), strict=True))
        counts = np.array([0, *count_of.values()])
        logs, there = np.log10(counts + 0.5), counts > 0
        out = []
        for part, strings in slices(rows.to_batches(), 1):
            codes, inverse = np.unique(grams_of(strings, order), return_inverse=True)
            each = values[np.searchsorted(known, codes)][inverse]
            score = np.add.reduceat(each, np.cumsum([0, *map(len, strings[:-1])]))
            split = [s.split() for s in strings]
            lengths = np.array([len(w) for w in split])
            ids = np.fromiter((index.get(w, 0) for w in chain.from_iterable(split)), np.int64, int(lengths.sum()))
            owner = np.repeat(np.arange(len(split)), lengths)
            base = np.bincount(owner, logs[ids], len(split)) + math.log10(n_docs + 0.5) - norm * (lengths + 1)
            n_known = np.bincount(owner, there[ids], len(split)).astype(np.int64) + (1 if n_docs else 0)
            out.append(pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths + 1), pa.array(n_known), pa.array(np.full(len(split), n)), pa.array(base), pa.array(score)], names=["k", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.Table.from_batches(out)

    schema = f"k {texts.schema['k'].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = texts.select("block", "k", "s", "learn").groupBy("block").cogroup(needs.groupBy("of")).applyInArrow(lambda rows, table: run(rows.select(["k", "s", "learn"]), table), schema)
    return scored.withColumnRenamed("k", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_texts(docs, id_remainder(F.col("doc_id"), 5) != 1)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
