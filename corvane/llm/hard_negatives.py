"""Hard-negative mining by distributed radix selection.

Vectors are packed into blocks of rows, and so are the anchors.  Every data block
meets the anchor blocks in tasks, a bounded number of anchor blocks at a time (sent
by broadcast), and only integers leave the tasks.  The first k rows of a window
(an anchor with a range of scores) are found without ever listing its rows: a pass
counts, for each window, how many rows fall into each of 256 buckets of the highest
digit of the distance from the window's top; sums over all blocks tell the bucket
that holds the kth row; the next pass refines that bucket by the next digit.  Where
rows with one score are more than needed, the digits of their ids follow.  A window
is settled as soon as its bucket holds just the rows needed; a last pass gathers the
rows within the settled bounds, k a window.  Positives are selected by the same
passes over the window of all scores.

Scores are recomputed in each pass rather than stored: pairs are never written.
Work is anchors times rows, in blocks; memory is a block of scores and the counts of
``CHUNK`` anchor blocks.

Defined results: rows with a null id, label or vector, or a null or non-finite
component take no part; shorter vectors count as filled up with zeros; the other
rows of an anchor are those with another id; repeated rows each count, and a
repeated anchor gives its rows as often; scores beyond 2**55 count as 2**55; ties go to
the smaller id; an anchor without positives gives no rows; an empty table gives an
empty result.  Only id, label and vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a data block and of an anchor block (fewer if vectors are long: so many components at most), and anchor blocks sent at a time.
BLOCK, ANCHORS, COMPONENTS, CHUNK = 2048, 256, 1 << 19, 16
#: Bits of a digit; scores in a table of windows by rows worked on at a time; the greatest score.
DIGIT, CELLS, TOP = 8, 1 << 20, 1 << 55
STATE = "qb long, i long, j long, hi long, width long, a long, shift int, by_id boolean, ua long, ushift int, need long, last long, tie boolean, done boolean"
NAMES = [c.split()[0] for c in STATE.split(", ")]


def packed(rows: DataFrame, scale: float, most: int) -> DataFrame:
    """(qb, n, dims, top, low, high, ids, labels, kind, q): blocks of up to ``most`` rows(id, label, vector), components scaled and floored.

    ``top`` is the greatest squared length, ``low`` and ``high`` the range of ids.
    """
    cols = ["qb", "n", "dims", "top", "low", "high", "ids", "labels", "kind", "q"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.binary()]

    def block(number: int, ids: np.ndarray, labels: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        kind = "<i2" if np.abs(q).max(initial=0) < 1 << 15 else "<f8"
        row = [number, len(ids), q.shape[1], float((q * q).sum(1).max()), int(ids.min()), int(ids.max()), ids.tobytes(), labels.tobytes(), kind, q.astype(kind).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=cols)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n, dims = TaskContext.get().partitionId() << 32, [], 0, 1

        def flush() -> pa.RecordBatch:
            ids, labels = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            q = np.zeros((len(ids), max(h[2].shape[1] for h in held)))
            at = 0
            for h in held:
                q[at : at + len(h[0]), : h[2].shape[1]] = h[2]
                at += len(h[0])
            return block(number, ids, labels, q)

        for batch in batches:
            for ids, labels, q in _usable(batch, scale):
                a = 0
                while a < len(ids):
                    dims = max(dims, q.shape[1])
                    limit = max(1, min(most, COMPONENTS // dims))
                    if n >= limit:
                        yield flush()
                        number, held, n, dims = number + 1, [], 0, max(1, q.shape[1])
                        continue
                    b = min(len(ids), a + limit - n)
                    held.append((ids[a:b], labels[a:b], q[a:b]))
                    n += b - a
                    a = b
        if n:
            yield flush()

    return rows.select(F.col("id").cast("long"), F.col("label").cast("long"), "vector").mapInArrow(run, "qb long, n long, dims long, top double, low long, high long, ids binary, labels binary, kind string, q binary")


def _usable(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, labels and integer components of a batch's rows that take part, rows of one length of vector at a time."""
    vector = batch.column(2)
    keep = pc.and_(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()), vector.is_valid())
    batch = batch.filter(keep)
    vector = batch.column(2)
    flat = vector.flatten()
    values = np.floor(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) * scale)
    bad = ~np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    values = np.clip(np.where(bad, 0.0, values), -1e300, 1e300)
    ends = np.cumsum(vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    lengths = np.diff(np.concatenate([[0], ends]))
    ruined = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(bad)])[ends]])) > 0
    ids, labels = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
    for length in np.unique(lengths[~ruined]).tolist():
        row = np.flatnonzero(~ruined & (lengths == length))
        yield ids[row], labels[row], values[(ends - lengths)[row][:, None] + np.arange(length)].reshape(len(row), length)


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of x with those of y, exact, cut at ``TOP``."""
    dims = min(x.shape[1], y.shape[1])
    x, y = x[:, :dims].astype(float), y[:, :dims].astype(float)
    large = np.sqrt(2.0**53 / max(dims, 1))
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.clip(np.nan_to_num(x @ y.T), -float(TOP), float(TOP)).astype(np.int64)
    big_x, big_y = (np.flatnonzero(np.abs(v).max(1, initial=0) > large) for v in (x, y))
    whole = lambda v: [[int(c) for c in row] for row in v]
    dot = lambda a, b: max(-TOP, min(TOP, sum(map(int.__mul__, a, b))))
    if len(big_x):
        all_y = whole(y)
        out[big_x] = [[dot(a, b) for b in all_y] for a in whole(x[big_x])]
    if len(big_y):
        all_x = whole(x)
        out[:, big_y] = np.array([[dot(a, b) for b in whole(y[big_y])] for a in all_x], np.int64)
    return out


class _Meeting:
    """One data block against one anchor block: the rows of each window."""

    def __init__(self, row: dict, low: int, same: bool):
        self.windows = {c: np.array([w[c] for w in row["windows"]]) for c in NAMES[1:]}
        self.ids, self.labels, q = _unpacked(row, "")
        self.anchor_ids, self.anchor_labels, anchors = _unpacked(row, "a_")
        self.s = scores(anchors, q)
        self.u = self.ids.view(np.uint64) - np.int64(low).view(np.uint64)
        self.same = same

    def __iter__(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Slices of windows; the distance of each row from each window's top; whether the row lies in the window."""
        step = max(1, CELLS // max(1, len(self.ids)))
        for at in range(0, len(self.windows["i"]), step):
            cut = slice(at, at + step)
            i = self.windows["i"][cut]
            t = self.windows["hi"][cut, None] - self.s[i]
            fits = (t >= 0) & (t < self.windows["width"][cut, None])
            fits &= (self.labels[None, :] == self.anchor_labels[i][:, None]) == self.same
            if self.same:
                fits &= self.ids[None, :] != self.anchor_ids[i][:, None]
            yield cut, t, fits


def _unpacked(row: dict, prefix: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = row[prefix + "n"]
    q = np.frombuffer(row[prefix + "q"], row[prefix + "kind"]).reshape(n, row[prefix + "dims"])
    return np.frombuffer(row[prefix + "ids"], np.int64), np.frombuffer(row[prefix + "labels"], np.int64), q


def _meet(blocks: DataFrame, anchors: DataFrame, state: DataFrame, run: Callable, schema: str) -> DataFrame:
    """Union of ``run`` over every data block with every anchor block that has windows, ``CHUNK`` anchor blocks at a time."""
    windows = state.groupBy("qb").agg(F.collect_list(F.struct(*NAMES[1:])).alias("windows"))
    sides = written(anchors.select("qb", *[F.col(c).alias(f"a_{c}") for c in ("n", "dims", "ids", "labels", "kind", "q")]).join(windows, "qb"))
    numbers = sorted(r["qb"] for r in sides.select("qb").collect())  # one number for each anchor block
    out = None
    for k in range(0, len(numbers), CHUNK):
        chunk = numbers[k : k + CHUNK]
        pairs = blocks.drop("qb", "top", "low", "high").withColumn("qb", F.explode(F.array(*map(F.lit, chunk)))).join(F.broadcast(sides.where(F.col("qb").isin(chunk))), "qb")
        made = pairs.mapInArrow(run, schema)
        out = made if out is None else out.unionByName(made)
    return out


def _counts(low: int, same: bool) -> Callable:
    size = 1 << DIGIT

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                m = _Meeting(row, low, same)
                w = m.windows
                total = held.setdefault(row["qb"], (w["i"], w["j"], np.zeros((len(w["i"]), size), np.int64)))[2]
                for cut, t, fits in m:
                    a, shift, by_id = w["a"][cut, None], w["shift"][cut, None], w["by_id"][cut, None]
                    high = np.minimum(shift + DIGIT, 63)
                    digit = (t - a) >> shift
                    fits &= np.where(by_id, t == a, (t >> high) == (a >> high))
                    if by_id.any():
                        ua, ushift = w["ua"][cut, None].view(np.uint64), w["ushift"][cut, None].astype(np.uint64)
                        u, first = m.u[None, :], ushift + np.uint64(DIGIT) >= np.uint64(64)
                        high = np.minimum(ushift + np.uint64(DIGIT), np.uint64(63))
                        fits &= ~by_id | first | ((u >> high) == (ua >> high))
                        digit = np.where(by_id, ((u - ua) >> ushift).astype(np.int64), digit)
                    place = (np.arange(len(t))[:, None] * size + digit)[fits]
                    total[cut] += np.bincount(place, minlength=len(t) * size).reshape(-1, size)
        for qb, (i, j, total) in held.items():
            r, digit = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(r), qb)), pa.array(i[r]), pa.array(j[r]), pa.array(digit), pa.array(total[r, digit])], names=["qb", "i", "j", "digit", "n"])

    return run


def _rows(low: int, same: bool) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                m = _Meeting(row, low, same)
                w = m.windows
                for cut, t, fits in m:
                    u, tie = m.u[None, :], w["tie"][cut, None]
                    upto = w["ua"][cut, None].view(np.uint64)
                    level = fits & tie & (t == w["a"][cut, None])
                    # Rows with one score and one id are alike: no more than are needed leave the block.
                    alike = level & (u == upto)
                    alike &= np.cumsum(alike, axis=1) <= w["need"][cut, None]
                    r, c = np.nonzero((fits & (t <= w["last"][cut, None])) | (level & (u < upto)) | alike)
                    i, j = w["i"][cut][r], w["j"][cut][r]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r), row["qb"])), pa.array(i), pa.array(j), pa.array(m.anchor_ids[i]), pa.array(m.ids[c]), pa.array(m.s[i, c])], names=["qb", "i", "j", "anchor_id", "id", "score"]
                    )

    return run


def _refined(state: DataFrame, counts: DataFrame, id_shift: int) -> DataFrame:
    """The state after a pass: the bucket of each window that holds its last row, or done."""
    key = ["qb", "i", "j"]
    upto = Window.partitionBy(*key).orderBy("digit")  # 256 rows at most
    cum = counts.groupBy(*key, "digit").agg(F.sum("n").alias("n")).withColumn("upto", F.sum("n").over(upto))
    found = cum.join(state.select(*key, F.col("need").alias("k")), key).where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).drop("k")
    s = state.join(found, key, "left")
    c, few = F.col, F.col("digit").isNull()
    one = F.lit(1).cast("long")
    left = c("need") - (c("upto") - c("n"))
    a = c("a") + F.call_function("shiftleft", c("digit"), c("shift"))
    ua = c("ua").bitwiseOR(F.call_function("shiftleft", c("digit"), c("ushift")))
    exact = c("n") == left
    last = F.when(few, c("width") - 1).when(c("by_id"), c("a") - 1).when(exact, a + F.call_function("shiftleft", one, c("shift")) - 1)
    to_ids = ~c("by_id") & ~exact & (c("shift") == 0)
    return s.select(
        *key, "hi", "width",
        F.when(few | c("by_id"), c("a")).otherwise(a).alias("a"),
        F.when(few | c("by_id") | (c("shift") == 0), c("shift")).otherwise(c("shift") - DIGIT).alias("shift"),
        (c("by_id") | (~few & to_ids)).alias("by_id"),
        F.when(few | ~c("by_id"), c("ua")).when(exact, ua.bitwiseOR(F.call_function("shiftleft", one, c("ushift")) - 1)).otherwise(ua).alias("ua"),
        F.when(few | ~c("by_id"), F.lit(id_shift)).when(c("ushift") == 0, F.lit(0)).otherwise(c("ushift") - DIGIT).alias("ushift"),
        F.when(few, c("need")).otherwise(left).alias("need"),
        last.alias("last"),
        (~few & c("by_id")).alias("tie"),
        (few | exact | (c("by_id") & (c("ushift") == 0))).alias("done"),
    )


def _first_digit(most: int) -> int:
    return DIGIT * max(0, (max(int(most), 1).bit_length() - 1) // DIGIT)


def select_first(blocks: DataFrame, anchors: DataFrame, windows: DataFrame, k: int, same: bool, low: int, high: int) -> DataFrame:
    """The first k rows of each of windows(qb, i, j, hi, width) by score and id: qb, i, j, rank, anchor_id, id, score.

    ``same``: rows of the anchor's own label, itself left out; else of another label.
    """
    spark, id_shift = blocks.sparkSession, _first_digit(high - low)
    bits = F.length(F.conv((F.col("width") - 1).cast("string"), 10, 2))
    zero, never = F.lit(0).cast("long"), F.lit(False)
    state = windows.where("width > 0").select(
        "qb", "i", "j", "hi", "width", zero.alias("a"), (F.floor((bits - 1) / DIGIT) * DIGIT).cast("int").alias("shift"), never.alias("by_id"), zero.alias("ua"), F.lit(id_shift).alias("ushift"),
        F.lit(k).cast("long").alias("need"), F.lit(None).cast("long").alias("last"), never.alias("tie"), never.alias("done"),
    )
    state, settled = written(state), None
    while not state.isEmpty():
        counts = _meet(blocks, anchors, state, _counts(low, same), "qb long, i long, j long, digit long, n long")
        state = written(_refined(state, counts, id_shift))
        done = state.where("done")
        settled = done if settled is None else settled.unionByName(done)
        state = state.where("not done")
    if settled is None:
        return spark.createDataFrame([], "qb long, i long, j long, rank int, anchor_id long, id long, score long")
    order = Window.partitionBy("qb", "i", "j").orderBy(F.col("score").desc(), "id")  # k rows, and copies of the last
    rows = _meet(blocks, anchors, settled, _rows(low, same), "qb long, i long, j long, anchor_id long, id long, score long")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qb", "i", "j", "rank", "anchor_id", "id", "score")


def mine_negatives(
    df: DataFrame, is_anchor: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: float = 256.0, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Of each anchor's first ``positives`` rows of its label, the first ``negatives``
    rows of other labels that score from ``least`` to ``most`` percent of the positive.
    """
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    blocks = written(packed(rows, scale, BLOCK))
    chosen = rows.where("is_anchor")
    anchors = written(packed(chosen.repartition(max(1, -(-chosen.count() // (ANCHORS * CHUNK)))), scale, ANCHORS))
    size = blocks.agg(F.max("top").alias("top"), F.min("low").alias("low"), F.max("high").alias("high")).first()
    if size["top"] is None or anchors.isEmpty():
        return df.sparkSession.createDataFrame([], empty)
    bound = int(min(float(TOP), np.ceil(size["top"] * (1 + 1e-9)) + 1))  # no score is greater
    low, high = size["low"], size["high"]
    each = anchors.select("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    everything = each.select("qb", "i", F.lit(0).cast("long").alias("j"), F.lit(bound).cast("long").alias("hi"), F.lit(2 * bound + 1).cast("long").alias("width"))
    own = written(select_first(blocks, anchors, everything, positives, True, low, high))
    p = F.col("score")
    pairs = own.where(p >= 0).select("qb", "i", F.col("rank").cast("long").alias("j"), F.expr(f"({most} * score) div 100").alias("hi"), F.expr(f"({least} * score + 99) div 100").alias("lo"), F.col("id").alias("positive_id"), p.alias("positive_score"))
    windows = pairs.select("qb", "i", "j", "hi", (F.col("hi") - F.col("lo") + 1).alias("width"))
    found = select_first(blocks, anchors, windows, negatives, False, low, high)
    out = found.join(pairs.select("qb", "i", "j", "positive_id", "positive_score"), ["qb", "i", "j"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""
