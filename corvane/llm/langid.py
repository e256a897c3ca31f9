"""Language identification by nearest centroid.

A text is a vector of hashed byte 3-grams of its lower-cased letters (whatever
stands between words is one space), weighted by
1 + ln(tf) and by an inverse document frequency taken over all training texts,
and normalised.  Each language has several centroids, found by spherical k-means
over a sample of its training texts of bounded size (``SAMPLE`` texts per
language, picked by a hash of the id), in a task for each language; a text gets
the language of the centroid with the greatest cosine.  A text farther from its
centroid than nearly all of that language's sample is rejected.  There may be any number of
languages: they are compared ``LANGUAGES`` at a time, and a text carries the best so far.

Defined results: a null text and a text without a letter are ``und`` with score
0; with ``reject`` so is a rejected text; without training rows every text is
``und``; of languages with equal cosines the first by name is taken; texts that are
not UTF-8 are read with replacement characters, texts of any length whole; repeated
rows get equal results; an empty table gives an empty result.  Only id, text and, for
training rows, the language are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, hash60, id_remainder, slices

DIMS = 2048
#: Texts per language that the centroids are fitted on, about.
SAMPLE = 500
#: Languages that are sent to all executors and compared at a time (64 KB each).
LANGUAGES = 256
#: Counts of languages sent to all executors at most; a longer table is joined.
BROADCAST_LANGUAGES = 50_000
CENTROIDS = 4
ROUNDS = 12
#: Share of a language's own sample that lies beyond its rejection distance.
REJECTED_SHARE = 0.005
SHARPNESS = 25.0
NO_LETTERS = re.compile(r"[\W\d_]+")


def gram_counts(texts: list[str]) -> np.ndarray:
    """Counts (texts, DIMS) of hashed byte 3-grams."""
    raw = [NO_LETTERS.sub(" ", f" {t.lower()} ").encode() for t in texts]
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    lengths = np.array([len(r) for r in raw])
    if len(flat) < 3:
        return np.zeros((len(texts), DIMS))
    code = flat[:-2] << 16 | flat[1:-1] << 8 | flat[2:]
    cell = (code * np.uint32(2654435761)) >> np.uint32(32 - DIMS.bit_length() + 1)
    owner = np.repeat(np.arange(len(texts)), lengths)
    inside = owner[:-2] == owner[2:]
    return np.bincount(owner[:-2][inside] * DIMS + cell[inside], minlength=len(texts) * DIMS).reshape(len(texts), DIMS).astype(np.float64)


def weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0.0) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from far-apart seeds; the same rows in the same order give the same centroids."""
    seeds = [int(np.argmax(x @ x.mean(0)))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(1))))
    centre = x[seeds]
    for _ in range(ROUNDS):
        of = np.argmax(x @ centre.T, 1)
        centre = np.stack([x[of == i].mean(0) if (of == i).any() else centre[i] for i in range(len(centre))])
        centre /= np.maximum(np.sqrt((centre * centre).sum(1, keepdims=True)), 1e-12)
    return centre


def _document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each dimension occurs, over all of them, and how many there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS, np.int64), 0
        for _, raw in slices(batches, 0, 1 << 20):
            for a in range(0, len(raw), 512):
                total += (gram_counts([t.decode(errors="replace") for t in raw[a : a + 512]]) > 0).sum(0)
            n += len(raw)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIMS + 1)), pa.array(np.append(total, n))], names=["cell", "n"])

    out = np.zeros(DIMS + 1, np.int64)
    for r in texts.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out[:DIMS], int(out[DIMS])


def fit_centroids(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The model: idf, the languages in order, and a table(lang, centroids, least) of a row for each."""
    rows = df.where(F.coalesce(train, F.lit(False)) & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"), F.col(lang_col).cast("string").alias("lang"))
    sizes = checkpointed(rows.groupBy("lang").agg(F.least(F.lit(1.0), SAMPLE / F.count("*")).alias("share")))
    frequency, n = _document_frequencies(rows.select("t"))
    idf = np.log((n + 1) / (frequency + 1)) + 1
    few = sizes.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    picked = rows.join(F.broadcast(sizes) if few else sizes, "lang").where(hash60(F.lit("lang"), F.col("k")) < F.col("share") * float(1 << 60))

    def vectors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in slices(batches, 1, 1 << 20):
            x = weigh(gram_counts([t.decode(errors="replace") for t in raw]), idf).astype(np.float16)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    def fitted(sample: pa.Table) -> pa.Table:  # about SAMPLE rows of one language
        x = np.frombuffer(b"".join(sorted(sample["x"].to_pylist())), np.float16).reshape(-1, DIMS).astype(np.float64)
        x = x[(x > 0).any(1)]
        if not len(x):
            return pa.table({"lang": pa.array([], pa.string()), "centroids": pa.array([], pa.binary()), "least": pa.array([], pa.float64())})
        c = cluster(x, CENTROIDS)
        return pa.table({"lang": sample["lang"][:1], "centroids": pa.array([c.tobytes()], pa.binary()), "least": [float(np.quantile((x @ c.T).max(1), REJECTED_SHARE))]})

    table = checkpointed(picked.select("lang", "t").mapInArrow(vectors, "lang string, x binary").groupBy("lang").applyInArrow(fitted, "lang string, centroids binary, least double"))
    return {"idf": idf, "langs": sorted(r["lang"] for r in table.select("lang").collect()), "table": table}


def identify_languages(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """Per row: id, lang_pred, score (share of the best language, 0 to 1), similarity (cosine), rejected."""
    key = df.schema[id_col].dataType.simpleString()
    state = "best string, cosine double, least double, total double"
    found = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"), *[F.lit(None).cast(c.split()[1]).alias(c.split()[0]) for c in state.split(", ")])

    def against(names: list[str], last: bool) -> DataFrame:
        """found, compared with some languages: best, its cosine and rejection cosine, and the sum of exp(SHARPNESS * (cosine - best cosine))."""
        rows = {r["lang"]: r for r in model["table"].where(F.col("lang").isin(names)).collect()}
        centroids = [np.frombuffer(rows[lang]["centroids"], np.float64).reshape(-1, DIMS) for lang in names]
        starts = np.cumsum([0, *[len(c) for c in centroids]])[:-1]
        shared = df.sparkSession.sparkContext.broadcast((names, np.concatenate(centroids), starts, np.array([rows[lang]["least"] for lang in names]), model["idf"]))

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, stacked, at, least, idf = shared.value
            for part, raw in slices(batches, 1, 1 << 20):
                best, cosine, far, total = (part.column(i).to_pylist() for i in (2, 3, 4, 5))
                letters = []
                for a in range(0, len(raw), 512):
                    texts = [t.decode(errors="replace") for t in raw[a : a + 512]]
                    letters += [any(c.isalpha() for c in t) for t in texts]
                    by_lang = np.maximum.reduceat(weigh(gram_counts(texts), idf) @ stacked.T, at, axis=1)
                    of, top = by_lang.argmax(1), by_lang.max(1)
                    sums = np.exp(SHARPNESS * (by_lang - top[:, None])).sum(1)
                    for i in range(len(texts)):
                        j, new, add = a + i, float(top[i]), float(sums[i])
                        if best[j] is None or new > cosine[j]:
                            total[j] = add + (0.0 if best[j] is None else total[j] * float(np.exp(SHARPNESS * (cosine[j] - new))))
                            best[j], cosine[j], far[j] = own[of[i]], new, float(least[of[i]])
                        else:
                            total[j] += add * float(np.exp(SHARPNESS * (new - cosine[j])))
                made = [pa.array(best, pa.string()), *[pa.array(v, pa.float64()) for v in (cosine, far, total)]]
                text = pa.array(letters, pa.bool_()) if last else part.column(1)
                yield pa.RecordBatch.from_arrays([part.column(0), text, *made], names=["k", "t", "best", "cosine", "least", "total"])

        return found.mapInArrow(run, f"k {key}, t {'boolean' if last else 'string'}, {state}")

    names = model["langs"]
    for a in range(0, len(names), LANGUAGES):
        found = against(names[a : a + LANGUAGES], a + LANGUAGES >= len(names))
    if not names:
        found = found.withColumn("t", F.lit(False))
    letter, out = F.col("t") & F.col("best").isNotNull(), F.coalesce(F.col("cosine") < F.col("least"), F.lit(True))
    none = ~letter | out if reject else ~letter
    return found.select(
        F.col("k").alias(id_col), F.when(none, "und").otherwise(F.col("best")).alias("lang_pred"), F.when(none, 0.0).otherwise(1 / F.col("total")).alias("score"),
        F.when(letter, F.least(F.greatest("cosine", F.lit(0.0)), F.lit(1.0))).otherwise(0.0).alias("similarity"), (out | ~letter).alias("rejected"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit_centroids(docs, id_remainder(F.col("doc_id"), 5) != 0)
    found = identify_languages(docs, model, reject=False)
    return found.select("doc_id", (id_remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "similarity", "rejected")
