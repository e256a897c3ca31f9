"""Trees over levels and numbers, and what each column adds to a score.

Levels: a text column becomes numbers that trees split into sets.  Null is 0, a
level that training did not see is 1, known levels follow.  Where a column has more
levels than a split can hold, neighbours in the order of the target's mean in
the training rows share a number, about equally many rows each.

Attributions are in log-odds and additive: with the base they make the raw score.
``shapley`` credits a column by its mean effect over all orders of learning the
columns, unknown columns being averaged by the training rows in each branch;
``path`` credits each split on the row's own path with the change of the mean.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import running

NULL, UNSEEN, KNOWN = 0, 1, 2
#: Levels sent to all executors at most; a longer table is joined by shuffle.
BROADCAST_LEVELS = 10_000
#: Features of a leaf's path up to which its effects are tabulated by pattern.
TABLED = 8


@dataclass
class Levels:
    """The numbers of one column's levels: table(level, number), ``size`` numbers in all."""

    column: str
    table: DataFrame
    size: int
    few: bool

    def apply(self, df: DataFrame, out: str) -> DataFrame:
        """df with ``out``: the level's number, marked as nominal."""
        table = self.table.select(F.col("level").alias(f"{out}_level"), F.col("number").alias(f"{out}_number"))
        value = F.col(self.column).cast("string")
        joined = df.join(F.broadcast(table) if self.few else table, value == F.col(f"{out}_level"), "left")
        number = F.when(value.isNull(), NULL).otherwise(F.coalesce(F.col(f"{out}_number"), F.lit(UNSEEN)))
        nominal = {"ml_attr": {"type": "nominal", "num_vals": self.size, "name": out}}
        return joined.select(*df.columns, number.cast("double").alias(out, metadata=nominal))


def level_numbers(train: DataFrame, column: str, label: str, most: int = 64) -> DataFrame:
    """(level, n, positives, number) of the non-null levels; at most ``most`` numbers, null's and the unseen's among them."""
    counts = train.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("level")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"))
    at = counts.withColumn("at", F.struct((F.coalesce("positives", F.lit(0)) / F.col("n")).alias("mean"), "level"))
    placed = running(at, "at", {"rows": F.col("n"), "levels": F.lit(1)})
    total = placed.agg(F.sum("rows").alias("rows"), F.count("*").alias("levels")).first()
    room = most - KNOWN
    number = F.col("levels_below") if total["levels"] <= room else F.floor(F.col("rows_below") * room / max(total["rows"] or 0, 1))
    return counts.join(placed.select(F.col("at.level").alias("level"), (number + KNOWN).cast("int").alias("number")), "level").select("level", "n", "positives", "number")


def fit_levels(train: DataFrame, columns: list[str], label: str, most: int = 64) -> list[Levels]:
    from corvane.plans.session import checkpointed

    out = []
    for c in columns:
        table = checkpointed(level_numbers(train, c, label, most).select("level", "number"))
        size = table.agg(F.max("number")).first()[0]
        out.append(Levels(c, table, (UNSEEN if size is None else size) + 1, table.limit(BROADCAST_LEVELS + 1).count() <= BROADCAST_LEVELS))
    return out


@dataclass
class Tree:
    """One tree as arrays, children after their parents; a leaf's feature is -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    sets: dict[int, np.ndarray]  # nominal splits: which numbers go left
    weight: float
    mean: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.mean = self.value.astype(float).copy()
        for node in range(len(self.feature) - 1, -1, -1):
            if self.feature[node] >= 0:
                a, b = self.left[node], self.right[node]
                self.mean[node] = (self.cover[a] * self.mean[a] + self.cover[b] * self.mean[b]) / max(self.cover[a] + self.cover[b], 1)

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        if node not in self.sets:
            return x <= self.threshold[node]
        chosen, number = self.sets[node], x.astype(np.int64)
        return chosen[np.clip(number, 0, len(chosen) - 1)] & (number < len(chosen))

    def leaves(self) -> Iterator[tuple[int, list[tuple[int, bool]]]]:
        """Each leaf with its path: nodes, and whether the path goes left there."""
        stack: list[tuple[int, list[tuple[int, bool]]]] = [(0, [])]
        while stack:
            node, path = stack.pop()
            if self.feature[node] < 0:
                yield node, path
            else:
                stack += [(int(self.right[node]), [*path, (node, False)]), (int(self.left[node]), [*path, (node, True)])]


def read_trees(model: object, df: DataFrame) -> list[Tree]:
    """The trees of a fitted ensemble, from the node table that it is saved as."""
    from corvane.plans.session import checkpoint_folder

    folder = f"{checkpoint_folder(df.sparkSession)}/model-{uuid.uuid4().hex}"
    model.write().save(folder)
    n = F.col("nodeData")
    rows = df.sparkSession.read.parquet(f"{folder}/data").select(
        "treeID", n["id"].alias("id"), n["prediction"].alias("value"), n["rawCount"].cast("double").alias("cover"), n["leftChild"].alias("left"), n["rightChild"].alias("right"),
        n["split"]["featureIndex"].alias("feature"), n["split"]["leftCategoriesOrThreshold"].alias("at"), n["split"]["numCategories"].alias("levels"),
    ).orderBy("treeID", "id").collect()  # fmt: skip  a row for each node of the model
    out = []
    for k, weight in enumerate(model.treeWeights):
        own = [r for r in rows if r["treeID"] == k]
        sets = {}
        for r in own:
            if r["feature"] >= 0 and r["levels"] != -1:
                sets[r["id"]] = np.isin(np.arange(r["levels"]), np.array(r["at"]))
        column = lambda c, kind, own=own: np.array([r[c] for r in own], kind)
        threshold = np.array([r["at"][0] if r["feature"] >= 0 and r["id"] not in sets else 0.0 for r in own])
        out.append(Tree(column("feature", np.int64), threshold, column("left", np.int64), column("right", np.int64), column("value", float), column("cover", float), sets, float(weight)))
    return out


def leaf_effects(known: np.ndarray, shares: np.ndarray, value: float) -> np.ndarray:
    """Shapley values of a leaf: known[r, j] says whether row r meets column j's conditions, shares[j] which part of the training rows does."""
    m = len(shares)
    out = np.zeros(known.shape)
    order = np.array([math.factorial(k) * math.factorial(m - k - 1) / math.factorial(m) for k in range(m)])
    for j in range(m):
        # Coefficient k of the product of (share + met * x) over the other columns: all sets of k known ones.
        terms = np.zeros((len(known), m))
        terms[:, 0] = 1
        for i in range(m):
            if i != j:
                terms[:, 1:] = terms[:, 1:] * shares[i] + terms[:, :-1] * known[:, i, None]
                terms[:, 0] *= shares[i]
        out[:, j] = value * (terms @ order) * (known[:, j] - shares[j])
    return out


@dataclass
class Attributor:
    """Additive contributions of features to the sum of weighted trees."""

    trees: list[Tree]
    features: int
    method: str = "shapley"

    def __post_init__(self) -> None:
        if self.method not in ("shapley", "path"):
            raise ValueError("method is shapley or path")
        self.base = sum(t.weight * t.mean[0] for t in self.trees)
        self.tables: dict[tuple[int, int], np.ndarray] = {}

    def margins(self, x: np.ndarray) -> np.ndarray:
        return sum((t.weight * t.value[self._leaf(t, x)] for t in self.trees), np.zeros(len(x)))

    @staticmethod
    def _leaf(t: Tree, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for node in range(len(t.feature)):  # parents come first
            if t.feature[node] >= 0:
                here = np.flatnonzero(at == node)
                if len(here):
                    at[here] = np.where(t.goes_left(node, x[here, t.feature[node]]), t.left[node], t.right[node])
        return at

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.features))
        for k, t in enumerate(self.trees):
            if self.method == "path":
                at = self._leaf(t, x)
                steps = np.zeros((len(t.feature), self.features))
                for leaf, path in t.leaves():
                    for (node, _), child in zip(path, [*[n for n, _ in path[1:]], leaf], strict=True):
                        steps[leaf, t.feature[node]] += t.mean[child] - t.mean[node]
                out += t.weight * steps[at]
                continue
            met = {node: t.goes_left(node, x[:, t.feature[node]]) for node in range(len(t.feature)) if t.feature[node] >= 0}
            for leaf, path in t.leaves():
                columns = sorted({int(t.feature[n]) for n, _ in path})
                if not columns:
                    continue
                place = {c: j for j, c in enumerate(columns)}
                shares, known = np.ones(len(columns)), np.ones((len(x), len(columns)), bool)
                for node, left in path:
                    j, child = place[int(t.feature[node])], t.left[node] if left else t.right[node]
                    shares[j] *= t.cover[child] / max(t.cover[t.left[node]] + t.cover[t.right[node]], 1)
                    known[:, j] &= met[node] == left
                if len(columns) <= TABLED:
                    if (k, leaf) not in self.tables:
                        patterns = (np.arange(1 << len(columns))[:, None] >> np.arange(len(columns))) & 1
                        self.tables[k, leaf] = leaf_effects(patterns.astype(float), shares, t.weight * float(t.value[leaf]))
                    out[:, columns] += self.tables[k, leaf][known @ (1 << np.arange(len(columns)))]
                else:
                    out[:, columns] += leaf_effects(known.astype(float), shares, t.weight * float(t.value[leaf]))
        return out


def attribute(rows: DataFrame, keep: list[str], features: Column, attributor: Attributor, scale: float = 2.0) -> DataFrame:
    """(*keep, base, margin, contributions): a row each, in units of ``scale`` times the trees' sum (2: log-odds)."""
    narrow = rows.select(features.alias("x"), *keep)
    shared = rows.sparkSession.sparkContext.broadcast(attributor)
    kept = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: Attributor = shared.value
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, a.features)
            found = a.contributions(x) * scale
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * a.features, pa.int32()), pa.array(found.ravel()))
            made = [pa.array(np.full(batch.num_rows, a.base * scale)), pa.array(a.margins(x) * scale), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*keep, "base", "margin", "contributions"])

    return narrow.mapInArrow(run, f"{kept}, base double, margin double, contributions array<double>")
