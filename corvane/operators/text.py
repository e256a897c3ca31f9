"""Text layer: TF-IDF over word 1-2 grams and a balanced logistic model of artefacts.

``tfidf`` makes rows of (key, term, weight).  The model finds terms by 64-bit hashes
of words and pairs, which Spark deals to groups as blocks of NumPy arrays: there they
are counted, fitted and scored.  No term is dropped; two of a hundred million terms
share a hash, and so a coefficient, less often than once in 3,000 runs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.scalars import variant

from .logistic import chunk_of, fit_balanced, groups_for, learn_vocabulary, margins, planed, row_of, small
from .skew import look_up

#: Words of the texts that a task makes a block for each group of, about, and their occurrences sorted at a time; the odd factor of a pair's first word.
OCCURRENCES, RANGE, PAIR = 1_000_000, 500_000, np.uint64(0x9E3779B97F4A7C15)

ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def words_in(text: Column) -> Column:
    """Words of two characters or more."""
    return F.regexp_extract_all(plain(text), F.lit(r"(?U)\w\w+"), F.lit(0))


def terms(text: Column) -> Column:
    """Array of word 1-grams and 2-grams; words have two characters or more."""
    words = words_in(text)
    pairs = F.when(F.size(words) > 1, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf) of the terms of each document."""
    docs = docs.select(key, text).repartition(key)  # texts are shuffled, not their terms
    return docs.select(F.col(key), F.explode(terms(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def weighted(counts: DataFrame, vocabulary: DataFrame, key: str) -> DataFrame:
    """(key, *vocabulary's columns, weight): (1 + ln tf) * idf of the terms in the vocabulary, each document normalised to length 1."""
    found = look_up(counts, "term", vocabulary.withColumnRenamed("term", "word"), "word")
    raw = found.withColumn("w", (1 + F.log(F.col("tf").cast("double"))) * F.col("idf"))
    norm = raw.groupBy(F.col(key).alias("of")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    kept = [c for c in vocabulary.columns if c != "idf"]
    return raw.join(norm, F.col(key) == F.col("of")).select(key, *kept, (F.col("w") / F.col("norm")).alias("weight"))


def tfidf(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, weight): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), each document normalised to length 1."""
    from corvane.plans.session import checkpointed

    counts = checkpointed(term_counts(docs, key, text))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return weighted(counts, df.select("term", (F.log(F.lit(1.0 + docs.count()) / (1 + F.col("df"))) + 1).alias("idf")), key)


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in their order."""
    return F.transform(words_in(text), lambda w: F.xxhash64(w))


def _pair_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of consecutive words' 2-grams, by those of the words."""
    return words[:-1] * PAIR + words[1:]


def _occurrences(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lists of word hashes: the words' and the pairs' rows and hashes, words first, and which of the values begin a pair."""
    ends = lists.offsets.to_numpy()
    words = lists.values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), np.diff(ends))
    pair = row[:-1] == row[1:]
    return np.concatenate([row, row[:-1][pair]]), np.concatenate([words, _pair_hashes(words)[pair]]), pair


def _blocks(chunk: int, first: int, lists: pa.ListArray, groups: int) -> Iterator[tuple]:
    """(group, (chunk, row, terms, many, tf)) of some consecutive rows of a chunk."""
    rows, all_terms, _ = _occurrences(lists)
    # About RANGE occurrences are sorted at a time.
    ranges = max(1, min(groups, len(rows) // RANGE))
    for r in range(ranges):
        low, high = groups * r // ranges, groups * (r + 1) // ranges
        here = slice(None)
        if ranges > 1:
            here = (all_terms >= _lowest(low, groups)) & (all_terms <= np.uint64(((high << 64) - 1) // groups))
        term, row = all_terms[here], rows[here]
        order = np.argsort(term)
        term, row = term[order], row[order]
        new = np.diff(term, prepend=~term[:1]) != 0
        key = (np.cumsum(new) - 1) * len(lists) + row
        key.sort()
        start = np.flatnonzero(np.diff(key, prepend=-1))
        tf, terms, key = np.diff(start, append=len(key)), term[new], key[start]
        many = np.bincount(key // len(lists), minlength=len(terms))
        cuts = np.searchsorted(terms, np.array([_lowest(g, groups) for g in range(low, high)], np.uint64)).tolist() + [len(terms)]
        ends = np.concatenate([[0], np.cumsum(many)])
        for g, (a, b) in enumerate(pairwise(cuts), low):
            if a < b:
                part = slice(ends[a], ends[b])
                yield g, (chunk, small(first + key[part] % len(lists)), planed(terms[a:b]), small(many[a:b]), small(tf[part]))


def _lowest(group: int, groups: int) -> np.uint64:
    """The least hash of a group."""
    return np.uint64(-(-(group << 64) // groups))


def dealt_terms(docs: DataFrame, text: str, groups: int) -> RDD:
    """All terms of docs(doc, text) as blocks, dealt by ranges of the terms' hashes.

    doc: ids as ``monotonically_increasing_id`` makes them.
    """
    found = docs.select(chunk_of(F.col("doc")).alias("chunk"), row_of(F.col("doc")).alias("row"), word_hashes(F.col(text)).alias("words"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk, row, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            ends = lists.offsets.to_numpy()
            a = 0
            while a < len(row):
                # Rows of one chunk, of about OCCURRENCES words; no text is cut.
                b = int(np.searchsorted(ends, ends[a] + OCCURRENCES, "right")) - 1
                other = np.flatnonzero(chunk[a:] != chunk[a])
                b = min(max(a + 1, b), a + int(other[0]) if len(other) else len(row))
                for group, item in _blocks(int(chunk[a]), int(row[a]), lists.slice(a, b - a), groups):
                    yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([pickle.dumps(item, 5)], pa.binary())], names=["group", "block"])
                a = b

    return found.mapInArrow(run, "group int, block binary").rdd.map(lambda r: (r[0], pickle.loads(bytes(r[1])))).partitionBy(groups)  # noqa: S301  (made above)


def _groups(docs: DataFrame, text: str) -> int:
    """Groups of terms for so much text, at about four characters an entry."""
    size = docs.agg(F.sum(F.length(text).cast("long"))).first()[0] or 0
    return groups_for(size // 4, docs.sparkSession.sparkContext.defaultParallelism)


@dataclass
class TextModel:
    """Coefficients of terms by their hashes, in groups: (group, (hashes, idf, coefficients)); the intercept, the number of terms, and the training texts."""

    coefficients: RDD
    groups: int
    intercept: float
    size: int
    docs: DataFrame
    text: str

    @property
    def terms(self) -> DataFrame:
        """(term, number, idf, coefficient), numbered from 0 in the terms' order."""
        from corvane.plans.session import checkpointed

        from .ordered import running

        docs = self.docs.select(words_in(F.col(self.text)).alias("words"), word_hashes(F.col(self.text)).alias("hashes"))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = batch.column(0).flatten()
                _, term, pair = _occurrences(batch.column(1))
                both = pa.compute.binary_join_element_wise(words[:-1].filter(pa.array(pair)), words[1:].filter(pa.array(pair)), " ")
                found, first = np.unique(term, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.concat_arrays([words, both]).take(pa.array(first))], names=["hash", "term"])

        named = docs.mapInArrow(run, "hash long, term string").groupBy("hash").agg(F.min("term").alias("term"))
        rows = self.coefficients.flatMap(lambda x: zip(x[1][0].view(np.int64).tolist(), x[1][1].tolist(), x[1][2].tolist(), strict=True))
        known = docs.sparkSession.createDataFrame(rows, "of long, idf double, coefficient double")
        found = checkpointed(named.join(known.hint("merge"), F.col("hash") == F.col("of")).select("term", "idf", "coefficient"))
        numbers = running(found, "term", {"n": F.lit(1)}).select(F.col("term").alias("at"), F.col("n_below").alias("number"))
        return found.join(numbers.hint("merge"), F.col("term") == F.col("at")).select("term", "number", "idf", "coefficient")


def _fitted(dealt: RDD, told: DataFrame, docs: DataFrame, text: str, groups: int, c: float, rounds: int) -> TextModel:
    sizes = told.agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros")).first()
    ones, zeros = sizes["ones"] or 0, sizes["zeros"] or 0
    if not ones or not zeros:
        raise ValueError("both kinds of artefacts are needed in training")
    n = ones + zeros
    vocabulary = learn_vocabulary(dealt, told, groups, n)
    coefficients, intercept = fit_balanced(vocabulary, n / (2 * ones), n / (2 * zeros), c, rounds)
    return TextModel(coefficients, groups, intercept, vocabulary.size, docs, text)


def text_model(train: DataFrame, text: str, label: str, c: float = 4.0, rounds: int = 200) -> TextModel:
    """Balanced logistic regression over normalised TF-IDF of all terms; the label marks artefacts, never events.

    The penalty is on the plain coefficients: half their squares over ``c``, beside
    the summed loss.  Rows without a label take no part.
    """
    from corvane.plans.session import checkpointed

    label = F.col(label).cast("int")
    docs = checkpointed(train.where(label.isNotNull()).select(F.monotonically_increasing_id().alias("doc"), F.col(text).alias("text"), label.alias("y")))
    groups = _groups(docs, "text")
    told = docs.select("doc", (F.col("y") > 0).cast("long").alias("ones"), (F.col("y") <= 0).cast("long").alias("zeros"))
    return _fitted(dealt_terms(docs, "text", groups), told, docs, "text", groups, c, rounds)


def _scored(docs: DataFrame, dealt: RDD, model: TextModel, key: str) -> DataFrame:
    from corvane.plans.session import written

    found = docs.sparkSession.createDataFrame(margins(dealt, model.coefficients), "chunk long, row int, margin double")
    here = docs.select(F.col(key).alias("key_"), chunk_of(F.col("doc")).alias("chunk"), row_of(F.col("doc")).alias("row"))
    margin = F.coalesce("margin", F.lit(0.0)) + model.intercept
    return written(here.join(found.hint("merge"), ["chunk", "row"], "left").select(F.col("key_").alias(key), (1 / (1 + F.exp(-margin))).alias("score")))


def score_texts(docs: DataFrame, model: TextModel, key: str, text: str) -> DataFrame:
    """(key, score) of each artefact, once; terms that training did not see count for nothing."""
    from corvane.plans.session import written

    docs = written(docs.select(key, F.col(text).alias("text"))).withColumn("doc", F.monotonically_increasing_id())
    return _scored(docs, dealt_terms(docs, "text", model.groups), model, key)


def learn_and_score(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, c: float = 4.0, rounds: int = 200) -> DataFrame:
    """(key, score) of every row of docs, by a ``text_model`` of those that labels(key, label) has: a row for each time a row is labelled.

    Terms are found and dealt once, for training and scores.  ``docs`` must read
    alike each time: hand in a table or a checkpoint.
    """
    docs = docs.select(key, text).withColumn("doc", F.monotonically_increasing_id())
    groups = _groups(docs, text)
    dealt = dealt_terms(docs, text, groups)
    y = F.col(label).cast("int")
    counted = labels.where(y.isNotNull()).groupBy(F.col(key).alias("of")).agg(F.count_if(y > 0).alias("ones"), F.count_if(y <= 0).alias("zeros"))
    told = docs.select("doc", key).join(counted.hint("merge"), F.col(key) == F.col("of")).select("doc", "ones", "zeros")
    from corvane.plans.session import checkpointed

    model = _fitted(dealt, checkpointed(told), docs, text, groups, c, rounds)
    out = _scored(docs, dealt, model, key)
    model.coefficients.unpersist()
    return out


def top_terms(model: TextModel, spark: SparkSession, k: int = 20) -> DataFrame:
    return model.terms.orderBy(F.desc("coefficient"), "term").limit(k).select("term", "coefficient")


def held_out(artifacts: DataFrame, variants: list[int], kind: str | None = None) -> DataFrame:
    """Artefacts withheld from training: by variant number of their title, or a whole kind."""
    by_variant = F.coalesce(variant(F.col("title")).isin(variants), F.lit(False))
    return artifacts.where(by_variant if kind is None else (F.col("kind") == kind))


def withheld_events(chains: DataFrame, withheld: DataFrame) -> DataFrame:
    """(seq): events whose chain holds any withheld artefact."""
    return chains.select("seq", F.explode("chain").alias("artifact")).join(withheld.select("artifact").distinct(), "artifact", "left_semi").select("seq").distinct()


def ood_panel(scores: DataFrame, at: float = 0.5) -> DataFrame:
    """One row: recall and false positives at a threshold, and at one just above the best benign control."""
    best = scores.agg(F.max(F.when(~F.col("fraud"), F.col("score"))).alias("best"))
    s = scores.crossJoin(F.broadcast(best))  # one row
    def share(hit: Column, of: Column) -> Column:
        return F.count_if(hit & of).cast("double") / F.count_if(of)
    return s.agg(share(F.col("score") >= at, F.col("fraud")).alias("recall"), share(F.col("score") >= at, ~F.col("fraud")).alias("fpr"), share(F.col("score") > F.col("best"), F.col("fraud")).alias("oracle_recall"))
