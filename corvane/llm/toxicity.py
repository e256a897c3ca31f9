"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a lexicon, lexicon words near second-person
words, capitals, punctuation and obfuscation rates.  The lexicon has a few fixed
words and units (words and word beginnings) learned from labelled training texts
by their log odds.  The trees and the calibration are fitted on a sample of
labelled rows of bounded size (``MAX_TRAIN`` rows, picked by a hash of the id);
one part of it fits the trees and the other the calibration.

Defined results: a null text counts as empty; every text gets a score, empty ones
too; without labels of both kinds every score is the share of toxic labels (0
without labels); rows with equal texts get equal scores; an empty table gives an
empty result.  Only id and text of the documents are read; ``keep_clean`` returns
the columns of its input.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, documents, hash60, id_remainder, slices, unused

#: Labelled rows that lexicon, trees and calibration are fitted on, about.
MAX_TRAIN = 20_000
#: A text to learn from is seen by the lexicon of the other ones of so many folds.
FOLDS = 5
#: A unit counts if its log odds, less so many standard errors, are at least this.
LEAST_LOG_ODDS, SURENESS = 1.5, 1.28
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
TREES, DEPTH, STEP = 25, 3, 0.2
#: Of ten parts of the sample, those that calibrate.
CALIBRATION_PARTS = 3
NEAR = 5
#: Words held with their weight by a worker.
HELD = 200_000

FIXED = "idiot moron stupid loser pathetic scum trash worthless disgusting clown dumb fool imbecile cretin jerk garbage filth vermin".split()
SECOND_PERSON = frozenset("you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes ti tus vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W\d_]+")
MASKED = re.compile(r"(?<![^\W\d_])[^\W\d_]+(?:[0-9@$*!#]+[^\W\d_]+)+")
#: What every masked word has; most texts lack it, and finding that out is cheap.
MASK_HINT = re.compile(r"[0-9@$*!#][^\W\d_]")
CAPITALS = bytes(range(65, 91))
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_]){3,}[^\W\d_](?!\w)")
LONG_RUN = re.compile(r"([^\W\d_])\1{3,}")
SHOUT = re.compile(r"[!?]{2,}")
CAPS = re.compile(r"(?<!\w)[A-ZÀ-ÖØ-Þ]{3,}(?!\w)")
FEATURES = [
    "log_words", "lexicon_density", "lexicon_weight", "lexicon_hits", "lexicon_distinct", "lexicon_most", "fixed_density", "near_second_person", "second_person",
    "upper_ratio", "caps_words", "exclamations", "questions", "punctuation", "shouts", "masked", "spaced", "long_runs", "revealed_hits", "digits", "odd_letters",
]


def units_of(word: str) -> list[str]:
    return [word] + [word[:k] + "-" for k in PREFIXES if len(word) > k]


def learn_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Unit -> log odds, from sample(t, toxic, part): units that mark toxic texts.

    One lexicon for each fold, from the texts of all other folds, then one from
    all texts.  The sample is of bounded size, hence the lexicons too.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], Counter[str]] = {}

        def out() -> pa.RecordBatch:
            rows = [(u, y, fold, n) for (y, fold), c in held.items() for u, n in c.items()]
            columns = zip(*rows, strict=True) if rows else ([], [], [], [])
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["unit", "toxic", "fold", "n"])

        for part, raw in slices(batches, 0):
            for t, toxic, fold in zip(raw, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                held.setdefault((toxic, fold % FOLDS), Counter()).update({u for w in set(WORD.findall(t.decode(errors="replace").lower())) for u in units_of(w)} | {""})
            if sum(map(len, held.values())) > 1_000_000:
                yield out()
                held = {}
        yield out()

    def total(toxic: int, fold: int) -> Column:
        return F.sum(F.when((F.col("toxic") == toxic) & (F.col("fold") == fold), F.col("n")).otherwise(0)).alias(f"n{toxic}{fold}")

    made = sample.select("t", "toxic", F.col("part").cast("int")).mapInArrow(run, "unit string, toxic int, fold int, n long")
    counts = made.groupBy("unit").agg(*[total(y, k) for y in (0, 1) for k in range(FOLDS)])
    counts = checkpointed(counts.where((sum(F.col(f"n1{k}") for k in range(FOLDS)) >= 2) | (F.col("unit") == "")))
    whole = counts.where(F.col("unit") == "").first()
    out = []
    for left_out in [*range(FOLDS), None]:
        folds = [k for k in range(FOLDS) if k != left_out]
        a, b = (sum((F.col(f"n{y}{k}") for k in folds), F.lit(0)) for y in (1, 0))
        na, nb = (sum(whole[f"n{y}{k}"] for k in folds) if whole else 0 for y in (1, 0))
        odds = F.log((a + 0.5) / (na + 1)) - F.log((b + 0.5) / (nb + 1))
        sure = odds - SURENESS * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        found = counts.where((F.col("unit") != "") & (a >= max(2, math.ceil(0.003 * na)))).select("unit", odds.alias("odds"), sure.alias("sure")).where(F.col("sure") >= LEAST_LOG_ODDS)
        out.append({r["unit"]: r["odds"] for r in found.collect()})
    return out


class Featurizer:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.fixed = lexicon, frozenset(FIXED)
        self.held: dict[str, float] = {}

    def weight(self, word: str) -> float:
        w = self.held.get(word)
        if w is None:
            if len(self.held) > HELD:
                self.held.clear()
            w = self.held[word] = max((self.lexicon.get(u, 0.0) for u in units_of(word)), default=0.0)
        return w

    def features(self, text: str) -> list[float]:
        low, raw = text.lower(), text.encode()
        words = WORD.findall(low)
        n, chars = max(len(words), 1), max(len(text), 1)
        hits = [(i, v) for i, v in enumerate(map(self.weight, words)) if v]
        persons = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        near = 0
        if hits and persons:
            marks = {j for i in persons for j in range(i - NEAR, i + NEAR + 1)}
            near = sum(i in marks for i, _ in hits)
        masked = MASKED.findall(low) if MASK_HINT.search(low) else []
        spaced = SPACED.findall(low)
        plain = [m.translate(LEET).replace("*", "") for m in masked] + [re.sub(r"[ .\-_]", "", s) for s in spaced]
        revealed = sum(bool(self.weight(p)) or p in self.fixed for p in plain)
        bangs, asks = text.count("!"), text.count("?")
        return [
            math.log1p(len(words)), 100 * len(hits) / n, 100 * sum(v for _, v in hits) / n, math.log1p(len(hits)), math.log1p(len({words[i] for i, _ in hits})), max((v for _, v in hits), default=0.0),
            100 * sum(map(self.fixed.__contains__, words)) / n, 100 * near / n, 100 * len(persons) / n,
            (len(raw) - len(raw.translate(None, CAPITALS))) / chars,
            100 * len(CAPS.findall(text)) / n, 100 * bangs / chars, 100 * asks / chars, 100 * sum(map(text.count, ".,;:-\"'()")) / chars, 100 * len(SHOUT.findall(text)) / n,
            100 * len(masked) / n, 100 * len(spaced) / n, 100 * len(LONG_RUN.findall(low)) / n, float(revealed), 100 * sum(map(text.count, "0123456789")) / chars,
            100 * (len(raw) - len(text)) / chars,  # letters outside ASCII, such as look-alikes
        ]


_made: dict[int, list[Featurizer]] = {}


def featurize(rows: DataFrame, lexicons: list[dict[str, float]]) -> DataFrame:
    """rows(id, t, use) -> (id, x): the dense features of t by the lexicon number ``use``."""
    key = hash(tuple(frozenset(x.items()) for x in lexicons))
    shared = rows.sparkSession.sparkContext.broadcast((key, lexicons))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, words = shared.value
        if k not in _made:
            _made.clear()
            _made[k] = [Featurizer(w) for w in words]
        made = _made[k]
        for part, raw in slices(batches, 1):
            x = [made[u].features(t.decode(errors="replace")) for t, u in zip(raw, part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    narrow = rows.select("id", "t", F.col("use").cast("int"))
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, x array<double>")


def _vectors(featurized: DataFrame) -> DataFrame:
    wide = featurized.select("id", *[F.col("x")[i].alias(c) for i, c in enumerate(FEATURES)])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(wide).select("id", "features")


def _sample(labels: DataFrame, train: Column, id_col: str, label_col: str) -> DataFrame:
    """(id, toxic, part): at most about MAX_TRAIN labelled training rows, one for each id."""
    rows = labels.where(F.coalesce(train, F.lit(False)) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("label_id"), F.col(label_col).cast("int").alias("toxic"))
    n = rows.count()
    h = hash60(F.lit("toxic"), F.col("label_id"))
    picked = rows.where(h < F.lit(min(1.0, MAX_TRAIN / max(n, 1)) * float(1 << 60)))
    return picked.groupBy("label_id").agg(F.max("toxic").alias("toxic")).withColumn("part", h % 10)


def score_toxicity(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id", key: Column | None = None) -> DataFrame:
    """Per row: id, score (0 to 1) and raw (the trees' probability); ``train`` is a condition over ``labels``.

    ``key`` names the rows instead of the id, under the id's column.
    """
    # A sample of bounded size, hence small enough to be sent to all executors.
    sample = F.broadcast(checkpointed(_sample(labels, train, label_id_col, label_col)))
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    labelled = checkpointed(texts.join(sample, texts["id"] == sample["label_id"]).select("id", "t", "toxic", "part").repartition(12, "id"))
    lexicons = learn_lexicons(labelled)
    # A text to learn from is seen by the lexicon of the other folds, as a new text will be seen.
    learned = _vectors(featurize(labelled.withColumn("use", F.col("part") % FOLDS), lexicons))
    known = checkpointed(learned.join(sample, learned["id"] == sample["label_id"]).select("features", F.col("toxic").cast("double").alias("label"), "part").repartition(4))
    named = texts if key is None else df.select(key.alias("id"), F.col(text_col).cast("string").alias("t"))
    vectors = _vectors(featurize(named.withColumn("use", F.lit(FOLDS)), lexicons))
    counts = {(int(r["label"]), r["late"]): r["count"] for r in known.groupBy("label", (F.col("part") < CALIBRATION_PARTS).alias("late")).count().collect()}
    toxic, total = sum(n for (y, _), n in counts.items() if y), sum(counts.values())
    if not toxic or toxic == total:
        return vectors.select(F.col("id").alias(id_col), F.lit(toxic / max(total, 1)).alias("score"), F.lit(toxic / max(total, 1)).alias("raw"))
    apart = min(counts.get((y, late), 0) for y in (0, 1) for late in (False, True)) >= 5
    early = known.where(F.col("part") >= CALIBRATION_PARTS) if apart else known
    late = known.where(F.col("part") < CALIBRATION_PARTS) if apart else known
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, seed=7, minInstancesPerNode=2).fit(early)
    raw = vector_to_array(F.col("probability"))[1]
    curve = IsotonicRegression(featuresCol="raw").fit(trees.transform(late).select("label", raw.alias("raw")))
    scored = curve.transform(trees.transform(vectors).select("id", raw.alias("raw")))
    # Isotonic steps are flat: a little of the trees' own probability keeps the order within a step.
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.98 * F.col("prediction") + 0.02 * F.col("raw")))
    return scored.select(F.col("id").alias(id_col), score.alias("score"), "raw")


def keep_clean(df: DataFrame, labels: DataFrame, train: Column, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose text has no score at or above the threshold, with the columns of ``df``.

    Rows are told apart by id and text: ids can be null or repeat.
    """
    body = F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    key = F.struct(F.col(f"`{id_col}`").alias("id"), body.alias("body"))
    scored = score_toxicity(df, labels, train, id_col, text_col, label_col, label_id_col, key)
    name, text = unused(df, "toxic_id"), unused(df, "toxic_body")
    bad = scored.where(F.col("score") >= threshold).select(F.col(f"{id_col}.id").alias(name), F.col(f"{id_col}.body").alias(text)).distinct()
    return df.join(bad, F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (body == F.col(text)), "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs, labels, id_remainder(F.col("doc_id"), 4) != 2)
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
