"""SimHash near-duplicates by generalised pigeonhole.

Fingerprint: 64 bits, each the majority over the XXH64 hashes of a text's word
shingles, repeats included.  Two texts link if their fingerprints differ in at
most ``most_bits`` bits (and, where ``check_bits`` is given, a second fingerprint
from remixed hashes in at most that many).

Search, over distinct fingerprints: bits are grouped into parts, correlated bits
together; by the generalised pigeonhole principle, thresholds that sum to
``most_bits - parts + 1`` (a part with -1 is skipped) lose no pair.  Dynamic
programming picks the thresholds, and the number of parts, that cost least:
candidate counts come from the exact number of pairs that agree on a part,
carried to greater distances by the bits' frequencies, and each signature to be
written costs too.  A probe writes a fingerprint's part and all values within the
threshold; rows with one value meet and are verified.

Groups that share a value are never collected beyond ``GROUP`` squared pairs.  Larger ones
go another exact way: for two bits, fingerprints are linked through the
values one bit away from them (two fingerprints share such a value just if they
differ in two bits or fewer), which is linear; for other distances they are cut into
blocks that meet pairwise.  Tasks hand on links that connect what they found, not
all pairs.  Components come from minimum labels with pointer jumping.

``keep_one`` removes near-duplicates at a Jaccard similarity of 0.8, where two
64-bit fingerprints differ in 9.7 bits on average and the pigeonhole needs a radius
of 15, at which its probes meet several percent of all rows.  There, fingerprints
are longer: every band of their bits deals all texts into buckets, in which
fingerprints are compared with one another, and the exact similarity of the
shingle sets decides on the pairs that are near.  Similar sets that fingerprints did
not connect share one of their first shingles in an order of all; an exact search
over those closes the step, so that no link is lost.

Defined results: a null or empty text has fingerprint zero, linked like any
other; rows with a null id take part, and a component without any id has a null
component_id; repeated rows share a fingerprint; an empty table gives an empty
result.  Only id and text are read; ``keep_one`` returns the columns of its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, checkpointed, documents, slices, unused, written
from .piece_codec import ranges

BITS = 64
SEED = 42
#: A task takes the rows of one part value together if they make at most the square of this many pairs.
GROUP = 4096
#: Cost of writing and shuffling one signature, in candidate checks.
SIGNATURE_COST = 40
#: Pairs verified at a time in a task, and pairs from which a group is compared as a table.
PAIRS, WIDE = 1 << 21, 1 << 12
#: Required Jaccard similarity of near-duplicates in ``keep_one``, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
#: A pair at that similarity shares no band less often than this.
LOSS = 1e-5
#: Fingerprints that a band deals into a bucket, about, and bits of a band at least.
BUCKET, LEAST_BITS = 2048, 4
#: Fingerprints that are compared all with all in a task, at most about; buckets of more are cut into blocks that meet pairwise.
HOT = 4 * BUCKET
#: Words of a fingerprint that are kept, how many of them are compared in buckets, and the bits that may differ in those and in all
#: (29.1 of 192 are expected at 0.8, with a deviation of 5.0, and 77.6 of 512, with one of 8.1).
SKETCH, NARROW, NARROW_BITS, SKETCH_BITS = tuple(f"fp{i}" for i in range(8)), 3, 52, 114
#: Where one set has fewer shingles than that, so many times these bits may differ: for four shingles within five 0.1875 are expected instead of 0.1515.
FEW_SHINGLES, MORE_BITS = 8, 1.2
#: Keys of at most so many sets are compared by a join; those of more in blocks of so many sets and shingles at most, about.
RARE, BLOCK_ROWS, BLOCK_SHINGLES = 32, 512, 1_000_000
#: A token of more prefixes than that goes to the end of the order, so many times anew; tokens that a task takes together.
HOT_TOKEN, TURNS, TOKENS = 512, 3, 250_000
#: Columns of the incidence matrices.
COLUMNS = 2048
#: Links of which a task makes a spanning forest.
LINKS = 1 << 20
#: Texts' hashes that are sent to all executors at most; more are joined.
FEW = 100_000


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _remixed(h: np.ndarray) -> np.ndarray:
    """A second hash from the first: the finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _majority(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half of the hashes."""
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 8192):
        block = np.unpackbits(hashes[a : a + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += block.sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, width: int, second: bool = False) -> tuple[int, int]:
    import xxhash

    words = text.translate(LOWER_AZ).split()
    if not words:
        return 0, 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        found = [digest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        found = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    hashes = np.array(found, np.uint64)
    return _majority(hashes), _majority(_remixed(hashes)) if second else 0


def fingerprints(df: DataFrame, width: int = 3, second: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id (as ``id``), fp and fp2 (signed longs; fp2 is 0 unless asked for)."""
    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            found = np.array([fingerprint(t, width, second) for t in texts], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], names=["id", "fp", "fp2"])

    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, fp long, fp2 long")


@dataclass(frozen=True)
class Plan:
    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]
    cost: float


def _bit_counts(points: DataFrame) -> np.ndarray:
    """How many fingerprints have both bit i and bit j, over all of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            fps = batch.column(0).to_numpy().astype(np.int64).astype(">i8").view(np.uint8).reshape(-1, 8)
            for a in range(0, len(fps), 65_536):
                x = np.unpackbits(fps[a : a + 65_536], axis=1)[:, ::-1].astype(np.float32)
                total += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS)), pa.array(total.ravel())], names=["cell", "n"])

    cells = points.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BITS * BITS)
    for c in cells:
        out[c["cell"]] = c["n"]
    return out.reshape(BITS, BITS)


def group_bits(both: np.ndarray, n: int, parts: int) -> tuple[tuple[int, ...], ...]:
    """Parts of nearly equal width; each takes the free bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(r, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (1 if k < BITS % parts else 0)
        left = sorted(free)
        part = [left[int(np.argmax(r[np.ix_(left, left)].sum(1)))]]
        while len(part) < size:
            left = sorted(free - set(part))
            part.append(left[int(np.argmax(r[np.ix_(left, part)].sum(1)))])
        free -= set(part)
        out.append(tuple(sorted(part)))
    return tuple(out)


def _distance_odds(p: np.ndarray, most: int) -> np.ndarray:
    """P(distance = 0 .. most) of two independent draws with bit frequencies p."""
    odds = np.zeros(most + 1)
    odds[0] = 1
    for q in 2 * p * (1 - p):
        odds[1:] = odds[1:] * (1 - q) + odds[:-1] * q
        odds[0] *= 1 - q
    return odds


def allocate(costs: list[list[float]], total: int) -> tuple[float, tuple[int, ...]]:
    """Thresholds from -1 up, one per part, with the given sum and the least cost; costs[i][t + 1] is part i's cost at t."""
    best: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
    for row in costs:
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for s, (c, ts) in best.items():
            for t, extra in enumerate(row, -1):
                if s + t not in step or c + extra < step[s + t][0]:
                    step[s + t] = (c + extra, (*ts, t))
        best = step
    return best.get(total, (math.inf, ()))


def make_plan(points: DataFrame, most_bits: int) -> Plan:
    both = _bit_counts(points)
    n = points.count()
    p = np.diag(both) / max(n, 1)
    choices = {m: group_bits(both, n, m) for m in range(max(1, most_bits // 3 + 1), most_bits + 2)}
    masks = {(m, i): signed(sum(1 << b for b in part)) for m, parts in choices.items() for i, part in enumerate(parts)}
    keys = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(mask)).alias("v")) for (m, i), mask in masks.items()])
    c = F.col("c").cast("double")
    agree = points.select(F.explode(keys).alias("x")).groupBy("x.m", "x.i", "x.v").agg(F.count("*").alias("c")).groupBy("m", "i").agg(F.sum(c * (c - 1) / 2).alias("pairs"))
    pairs = {(r["m"], r["i"]): r["pairs"] for r in agree.collect()}
    plans = []
    for m, parts in choices.items():
        costs = []
        for i, part in enumerate(parts):
            odds = np.cumsum(_distance_odds(p[list(part)], most_bits))
            row = [0.0]
            for t in range(min(most_bits, 2) + 1):
                signatures = sum(math.comb(len(part), k) for k in range(t + 1))
                row.append((pairs.get((m, i), 0.0) + 1) * odds[t] / max(odds[0], 1e-30) + SIGNATURE_COST * n * signatures)
            costs.append(row)
        cost, thresholds = allocate(costs, most_bits - m + 1)
        if thresholds:
            plans.append(Plan(parts, thresholds, cost))
    return min(plans, key=lambda x: x.cost)


def signatures(plan: Plan) -> Column:
    """Array of (part, v, own) for the column fp: own parts, and the values within the threshold."""
    out = []
    for i, (part, t) in enumerate(zip(plan.parts, plan.thresholds, strict=True)):
        if t < 0:
            continue
        mask = F.lit(signed(sum(1 << b for b in part)))
        flips = [0] + [signed(sum(1 << b for b in bits)) for k in range(1, t + 1) for bits in combinations(part, k)]
        value = F.col("fp").bitwiseAND(mask)
        out.append(F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(x).alias("v"), (x == 0).alias("own"))))  # noqa: B023
    return F.flatten(F.array(*out))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links with the same components, at most one for each node but the least of its component."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = index[: len(a)], index[len(a) :]
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _verify(most_bits: int, check_bits: int | None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (0, 1):
                lists = batch.column(c)
                rows = lists.flatten()
                sides.append((np.diff(lists.offsets.to_numpy()), [rows.field(f).to_numpy() for f in range(3)]))
            (nd, own), (nq, probes) = sides
            # All rows, group by group: those whose own value it is first, then the probes.
            start_d, start_q = np.cumsum(nd) - nd, np.cumsum(nq) - nq
            start = np.cumsum(nd + nq) - (nd + nq)
            place_d = ranges(start, nd)
            place_q = ranges(start + nd, nq)
            ids, fp, fp2 = (np.empty(len(place_d) + len(place_q), np.int64) for _ in range(3))
            for to, d, q in zip((ids, fp, fp2), own, probes, strict=True):
                to[place_d], to[place_q] = d, q
            links: list[tuple[np.ndarray, np.ndarray]] = []

            def found(x: np.ndarray, y: np.ndarray) -> None:
                """Keep the links among pairs whose first fingerprints are near."""
                if check_bits is not None:
                    near = np.bitwise_count((fp2[x] ^ fp2[y]).view(np.uint64)) <= check_bits  # noqa: B023
                    x, y = x[near], y[near]
                differ = ids[x] != ids[y]  # noqa: B023
                if differ.any():
                    links.append(_spanning(ids[x[differ]], ids[y[differ]]))  # noqa: B023

            wide = nd * (nd + nq) >= WIDE
            # Large groups: tables of own rows against all rows.
            for g in np.flatnonzero(wide).tolist():
                a, b = int(start[g]), int(start[g] + nd[g] + nq[g])
                rows = max(1, PAIRS // (b - a))
                for i in range(a, a + int(nd[g]), rows):
                    stop = min(i + rows, a + int(nd[g]))
                    x, y = np.nonzero(np.bitwise_count((fp[i:stop, None] ^ fp[None, a:b]).view(np.uint64)) <= most_bits)
                    found(x + i, y + a)
            # Small groups: each own row meets all rows after it in its group, over many groups at once.
            few = np.repeat(~wide, nd)
            left = place_d[few]
            many = np.repeat(start + nd + nq, nd)[few] - left - 1
            ends = np.cumsum(many)
            a = 0
            while a < len(left):
                b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, "right")))
                x = np.repeat(left[a:b], many[a:b])
                y = ranges(left[a:b] + 1, many[a:b])
                near = np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= most_bits
                found(x[near], y[near])
                a = b
            if links:
                p, q = _spanning(np.concatenate([x for x, _ in links]), np.concatenate([y for _, y in links]))
                yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["a", "b"])

    return run


def links(points: DataFrame, most_bits: int, check_bits: int | None = None, group: int = GROUP) -> DataFrame:
    """Links (a, b) between ids of points(id, fp, fp2), distinct in (fp, fp2): they connect just what near fingerprints connect."""
    plan = make_plan(points, most_bits)
    rows = points.select("id", "fp", "fp2", F.explode(signatures(plan)).alias("s")).select("id", "fp", "fp2", "s.part", "s.v", "s.own")
    counts = rows.groupBy("part", "v").agg(F.count("*").alias("n"), F.count_if("own").alias("own_n"))
    counts = counts.where((F.col("n") > 1) & (F.col("own_n") > 0))
    large = checkpointed(counts.where((F.col("n") > 16 * group) | (F.col("own_n") * F.col("n") > group * group)))
    point = F.struct("id", "fp", "fp2")

    def meet(grouped: DataFrame, *keys: str) -> DataFrame:
        lists = grouped.groupBy(*keys).agg(F.collect_list(F.when(F.col("own"), point)).alias("d"), F.collect_list(F.when(~F.col("own"), point)).alias("q"))
        lists = lists.where((F.size("d") > 0) & (F.size("d") + F.size("q") > 1)).select("d", "q")
        return lists.mapInArrow(_verify(most_bits, check_bits), "a long, b long")

    if large.isEmpty():
        return meet(rows, "part", "v")
    found = meet(rows.join(large.select("part", "v"), ["part", "v"], "left_anti"), "part", "v")
    hot = rows.join(large, ["part", "v"])
    if most_bits == 2 and check_bits is None:
        # Through the fingerprint itself and the values one bit away: linear in the fingerprints.
        flips = F.array(*[F.lit(x) for x in [0] + [signed(1 << b) for b in range(BITS)]])
        through = hot.where("own").select("id", "fp").distinct().select("id", F.explode(F.transform(flips, lambda x: F.col("fp").bitwiseXOR(x))).alias("v"))
        first = through.groupBy("v").agg(F.min("id").alias("b"), F.count("*").alias("n")).where(F.col("n") > 1)
        return found.unionByName(through.join(first, "v").where(F.col("id") != F.col("b")).select(F.col("id").alias("a"), "b"))
    # Blocks of half a group: every block of own rows meets every block.
    blocks = F.ceil(F.col("n") / (group // 2)).cast("int")
    block = F.pmod(F.xxhash64("id"), blocks).cast("int")
    cut = hot.withColumn("blocks", blocks).withColumn("block", block)
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    mine = cut.where("own").withColumn("o", F.explode(every)).select("id", "fp", "fp2", "part", "v", F.lit(True).alias("own"), F.col("block").alias("x"), F.col("o").alias("y"))
    theirs = cut.withColumn("o", F.explode(every)).select("id", "fp", "fp2", "part", "v", F.lit(False).alias("own"), F.col("o").alias("x"), F.col("block").alias("y"))
    return found.unionByName(meet(mine.unionByName(theirs), "part", "v", "x", "y"))


def fewer_links(found: DataFrame, most: int = LINKS) -> DataFrame:
    """Links (a, b) with the same components as ``found``: about one for each node instead of one for each pair.

    Tasks of about ``most`` links hand on a spanning forest of theirs, until that saves little.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if held:
            a, b = _spanning(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    found = checkpointed(found.select("a", "b"))
    n = found.count()
    while True:
        found = checkpointed(found.coalesce(max(1, math.ceil(n / most))).mapInArrow(run, "a long, b long"))
        left = found.count()
        if n <= most or left > 0.7 * n:
            return found
        n = left


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least id of the component, for every id in edges(a, b)."""
    edges = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    while True:
        near = edges.join(labels, edges["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("low"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("to"))
        new = checkpointed(low.join(jump, low["low"] == jump["at"]).select("node", F.least("low", "to").alias("new"), (F.least("low", "to") != F.col("label")).alias("moved")))
        labels = new.select("node", F.col("new").alias("label"))
        if new.where("moved").isEmpty():
            return labels


def near_duplicates(df: DataFrame, width: int = 3, most_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the least id of the rows in the component).

    Fingerprints are linked under their own values: a repeated id links nothing.
    """
    rows = checkpointed(fingerprints(df, width, False, id_col, text_col))
    points = checkpointed(rows.groupBy("fp", "fp2").agg(F.min("id").alias("least")).select("fp", "fp2", F.col("fp").alias("id"), "least"))
    labels = components(links(points.select("id", "fp", "fp2"), most_bits))
    named = points.join(labels, points["id"] == labels["node"], "left").select("fp", "least", F.coalesce("label", "id").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    found = rows.select("id", "fp").join(named.join(least, "label").select("fp", "component_id"), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """Distinct XXH64 hashes of the text's word shingles, ascending (none without words)."""
    import xxhash

    words = text.translate(LOWER_AZ).split()
    if not words:
        return np.empty(0, np.uint64)
    found = {xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))}
    return np.sort(np.fromiter(found, np.uint64, len(found)))


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) if len(hashes) else 0


def _majorities(hashes: np.ndarray, words: int) -> np.ndarray:
    """``words`` words of fingerprint: each bit the majority over the hashes, remixed anew for every word but the first.

    Bits are counted where they stand, by adders on whole words: ``planes[i]`` holds the bits worth 2**i.
    """
    if not len(hashes):
        return np.zeros(words, np.uint64)
    steps = np.arange(words, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    planes: list[np.ndarray] = []
    for a in range(0, len(hashes), 2048):
        rows = _remixed(hashes[a : a + 2048, None] + steps)
        rows[:, 0] = hashes[a : a + 2048]
        level = 0
        while len(rows):
            if level < len(planes):
                rows = np.concatenate([planes[level], rows])
            carries = [rows[:0]]
            while len(rows) > 1:
                n = max(1, len(rows) // 3)
                x, y = rows[:n], rows[n : 2 * n]
                z = rows[2 * n : 3 * n] if len(rows) > 2 else np.zeros_like(x)
                either = x ^ y
                carries.append((x & y) | (z & either))
                rows = np.concatenate([either ^ z, rows[3 * n :]])
            planes[level : level + 1] = [rows]
            rows = np.concatenate(carries)
            level += 1
    more, equal, half = np.zeros(words, np.uint64), np.full(words, np.iinfo(np.uint64).max, np.uint64), len(hashes) // 2
    for i in reversed(range(len(planes))):
        if half >> i & 1:
            equal &= planes[i][0]
        else:
            more |= equal & planes[i][0]
            equal &= ~planes[i][0]
    return more


def bands_for(n: int) -> tuple[int, int]:
    """Bits of a band, and bands, for ``n`` texts: buckets hold about ``BUCKET`` texts that have nothing in common."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(n, 1) / BUCKET)))
    similarity = NUMERATOR / DENOMINATOR
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, math.ceil(math.log(LOSS) / math.log1p(-(agree**bits)))


def prefix_length(n: int) -> int:
    """So many shingles of a set of ``n``, the first in any order that all sets share, hold one of every similar set's first ones."""
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1 if n else 0


def shingle_sketches(df: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: id, body (a hash of the text as it stands), node (a hash of the shingle set), the set's size, its SimHash fingerprint, the values of its bands and its prefix (``prefix_length`` least shingles)."""
    text = F.col(f"`{text_col}`").cast("string")
    narrow = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("t"), F.xxhash64(text).alias("body"))
    bits, bands = bands_for(df.count())
    words = max(len(SKETCH), math.ceil(bits * bands / BITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            sets = [_shingle_hashes(t, width) for t in texts]
            found = np.array([_majorities(h, words) for h in sets], np.uint64).reshape(-1, words)
            cut = np.unpackbits(found.astype(">u8").view(np.uint8), axis=1)[:, : bits * bands].reshape(len(sets), bands, bits)
            values = (cut @ (1 << np.arange(bits))).astype(np.int32)
            empty = np.array([not len(h) for h in sets], bool)
            keys = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32), pa.array(values[~empty].ravel()))
            nodes = np.array([_node(h) for h in sets], np.uint64)
            least = [h[: prefix_length(len(h))] for h in sets]
            starts = np.concatenate([[0], np.cumsum([len(h) for h in least])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(starts, pa.array(np.concatenate(least).view(np.int64) if least else np.empty(0, np.int64)))
            columns = [nodes.view(np.int64), *found[:, : len(SKETCH)].T.copy().view(np.int64), np.array([len(h) for h in sets], np.int32)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *map(pa.array, columns), keys, prefix], names=["id", "body", "node", *SKETCH, "size", "keys", "prefix"])

    sketch = ", ".join(f"{c} long" for c in SKETCH)
    return narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, body long, node long, {sketch}, size int, keys array<int>, prefix array<long>")


def _likely(a: str, b: str) -> Column:
    """Whether sizes and fingerprints of the structs ``a`` and ``b`` allow the required similarity."""
    small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
    differ = sum(F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH)
    most = F.when(small < FEW_SHINGLES, math.ceil(SKETCH_BITS * MORE_BITS)).otherwise(SKETCH_BITS)
    return (small * DENOMINATOR >= large * NUMERATOR) & (differ <= most)


def _near_in_bucket(table: pa.Table) -> pa.Table:
    """Compare all fingerprints of a bucket, or of two blocks of it.

    Per fingerprint that is near another one: key (the least node that a chain of
    near ones connects it with), node, the nearest node below it (itself, if none is
    below) and the bits in which they differ.
    """
    x, y = (table[c][0].as_py() for c in ("x", "y"))
    table = table.sort_by("size")
    size, node, block = (table[c].to_numpy().astype(np.int64) for c in ("size", "node", "block"))
    words = [table[c].to_numpy().view(np.uint64) for c in SKETCH[:NARROW]]
    most = np.where(size < FEW_SHINGLES, math.ceil(NARROW_BITS * MORE_BITS), NARROW_BITS)
    n = len(node)
    best, below = np.full(n, BITS * NARROW + 1), np.arange(n)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    stops = np.searchsorted(size, size * DENOMINATOR // NUMERATOR, "right")
    rows = max(1, PAIRS // 8 // n)
    for a in range(0, n, rows):
        b = min(a + rows, n)
        stop = int(stops[b - 1])
        differ = np.zeros((b - a, stop - a), np.uint16)
        for w in words:
            differ += np.bitwise_count(w[a:b, None] ^ w[None, a:stop])
        i, j = np.nonzero(differ <= most[a:b, None])
        d = differ[i, j].astype(np.int64)
        i, j = i + a, j + a
        good = (i < j) & (j < stops[i]) & ((x == y) | (block[i] != block[j]))
        i, j, d = i[good], j[good], d[good]
        if not len(i):
            continue
        links.append(_spanning(i, j))
        low, high = np.where(node[i] < node[j], i, j), np.where(node[i] < node[j], j, i)
        order = np.lexsort((node[low], d, high))
        low, high, d = low[order], high[order], d[order]
        first = np.flatnonzero(np.diff(high, prepend=-1))
        low, high, d = low[first], high[first], d[first]
        nearer = (d < best[high]) | ((d == best[high]) & (node[low] < node[below[high]]))
        best[high[nearer]], below[high[nearer]] = d[nearer], low[nearer]
    if not links:
        none = np.empty(0, np.int64)
        return pa.table({"key": none, "node": none, "other": none, "d": none.astype(np.int32)})
    member, root = _spanning(*(np.concatenate([k[c] for k in links]) for c in (0, 1)))
    alone = np.unique(root)
    member, root = np.concatenate([member, alone]), np.concatenate([root, alone])
    order = np.argsort(root, kind="stable")
    member, root = member[order], root[order]
    starts = np.flatnonzero(np.diff(root, prepend=-1))
    key = np.repeat(np.minimum.reduceat(node[member], starts), np.diff(starts, append=len(root)))
    return pa.table({"key": key, "node": node[member], "other": node[below[member]], "d": best[member].astype(np.int32)})


def near_fingerprints(points: DataFrame) -> DataFrame:
    """(key, node, nearest) for points(node, size, fingerprint, keys): near fingerprints connect a node with its key, the least one, in some bucket.

    Fingerprints that are near and share a band share a key.  What several buckets
    connect with one key meets once.  ``nearest`` has the bits ``d`` in which the
    nearest node below differs, and this ``other`` (the node itself, if none is below).
    """
    narrow = ["node", "size", *SKETCH[:NARROW]]
    dealt = points.select(*narrow, F.posexplode("keys").alias("band", "value")).select((F.shiftleft(F.col("band").cast("long"), 32) + F.col("value")).alias("bucket"), *narrow)
    large = checkpointed(dealt.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    none = F.lit(0).alias
    whole = dealt
    if not large.isEmpty():
        whole = dealt.join(large, "bucket", "left_anti")
    met = whole.select("*", none("block"), none("x"), none("y"))
    if not large.isEmpty():
        blocks = F.ceil(F.col("n") / (HOT // 2)).cast("int")
        cut = dealt.join(large, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        met = met.unionByName(cut.select("bucket", *narrow, "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")))
    found = met.groupBy("bucket", "x", "y").applyInArrow(_near_in_bucket, "key long, node long, other long, d int")
    return found.groupBy("key", "node").agg(F.min(F.struct("d", "other")).alias("nearest"))


def texts_of(nodes: DataFrame, rows: DataFrame, df: DataFrame, text_col: str) -> DataFrame:
    """(node, t): a text of each node."""
    bodies = checkpointed(rows.join(nodes.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("body").alias("body")))
    text = F.col(f"`{text_col}`").cast("string")
    texts = df.select(text.cast("binary").alias("t"), F.xxhash64(text).alias("body"))  # bytes, since texts need not be UTF-8
    return written(texts.join(F.broadcast(bodies) if bodies.count() <= FEW else bodies, "body").groupBy("node").agg(F.first("t").alias("t")))


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose shingle sets have at least the required Jaccard similarity, by texts(node, t)."""
    x, y = (texts.select(F.col("node").alias(c), F.col("t").alias(f"t_{c}")) for c in "ab")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, np.empty(0, np.uint64)
        for part, right in slices(batches, 3):
            keep = []
            firsts = part.column(2)
            for i, (node, other) in enumerate(zip(part.column(0).to_pylist(), right, strict=True)):
                if node != last:  # rows of one node mostly follow each other after the join on it
                    last, left = node, _shingle_hashes(firsts[i].as_py() or b"", width)
                h = _shingle_hashes(other, width)
                both = len(np.intersect1d(left, h, assume_unique=True))
                keep.append(both * DENOMINATOR >= (len(left) + len(h) - both) * NUMERATOR)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(y, "b").select("a", "b", "t_b").join(x, "a").select("a", "b", "t_a", "t_b").mapInArrow(run, "a long, b long")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets at ``left`` with those at ``right``, by products of incidence matrices."""
    owner = np.repeat(np.arange(len(sets)), [len(h) for h in sets])
    _, token, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[token] > 1
    token, owner = token[shared], owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    dense = np.cumsum(np.diff(token, prepend=-1) > 0) - 1 if len(token) else token
    out = np.zeros((len(left), len(right)), np.float32)
    for a in range(0, int(dense[-1]) + 1 if len(dense) else 0, COLUMNS):
        part = slice(*np.searchsorted(dense, [a, a + COLUMNS]))
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[part], dense[part] - a] = 1
        out += m[left] @ m[right].T
    return out


def frequent_links(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links (a, b) between similar sets of different labels among members(key, node, label, size) of one key.

    A key's members are cut into blocks of bounded size that meet pairwise, and a
    task compares two blocks: no pairs are formed outside it, and it hands on links
    that connect what it found.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_ROWS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    cut = members.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    met = cut.select("key", "node", "label", "block", other).select("key", "node", "label", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))

    def run(table: pa.Table) -> pa.Table:
        nodes, labels, block = (table[c].to_numpy() for c in ("node", "label", "block"))
        x, y = table["x"][0].as_py(), table["y"][0].as_py()
        sets = [_shingle_hashes(t or b"", width) for t in table["t"].to_pylist()]
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        both, n = _overlaps(sets, left, right), np.array([len(h) for h in sets])
        near = (both * DENOMINATOR >= (n[left][:, None] + n[right][None, :] - both) * NUMERATOR) & (labels[left][:, None] != labels[right][None, :])
        i, j = np.nonzero(near)
        a, b = _spanning(nodes[left[i]], nodes[right[j]]) if len(i) else (np.empty(0, np.int64), np.empty(0, np.int64))
        return pa.table({"a": a, "b": b})

    return met.join(texts, "node").select("key", "x", "y", "block", "node", "label", "t").groupBy("key", "x", "y").applyInArrow(run, "a long, b long")


def _sharing(table: pa.Table) -> pa.Table:
    """Pairs (a, b) of sets of different labels that share a token, if their sizes and the token's places allow the required similarity."""
    order = np.argsort(table["token"].to_numpy())
    token, node, label, size, place = (table[c].to_numpy()[order].astype(np.int64) for c in ("token", "node", "label", "size", "place"))
    starts = np.flatnonzero(np.diff(token, prepend=~token[:1]))
    counts = np.diff(starts, append=len(token))
    mixed = np.minimum.reduceat(label, starts) < np.maximum.reduceat(label, starts)
    left = np.flatnonzero(np.repeat(mixed, counts))
    many = np.repeat(starts + counts, counts)[left] - left - 1
    ends = np.cumsum(many)
    found, a = [np.empty((0, 2), np.int64)], 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS // 8, "right")))
        x, y = np.repeat(left[a:b], many[a:b]), ranges(left[a:b] + 1, many[a:b])
        most = np.minimum(size[x] - place[x], size[y] - place[y])  # the first shared token and all after it
        good = (label[x] != label[y]) & (most * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (size[x] + size[y]))
        x, y = node[x[good]], node[y[good]]
        found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
        a = b
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def _later(hot: np.ndarray, width: int):  # noqa: ANN202
    """Prefixes in the order that has the tokens ``hot`` (ascending) last."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            prefixes = []
            for t in texts:
                h = _shingle_hashes(t, width)
                last = np.isin(h, hot)
                prefixes.append(np.concatenate([h[~last], h[last]])[: prefix_length(len(h))].view(np.int64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prefixes, pa.list_(pa.int64()))], names=["at", "later"])

    return run


def missed_links(points: DataFrame, labels: DataFrame, rows: DataFrame, df: DataFrame, width: int, text_col: str) -> DataFrame:
    """Links (a, b) between similar sets that ``labels`` (node, label) does not connect: none is lost.

    Similar sets share a token of their prefixes, in any one order of all tokens.
    Tokens of many sets go to the order's end, so that few prefixes have them; those
    that still have, with others of more than ``HOT_TOKEN`` sets, meet block by block.
    """
    sets = written(points.select("node", "size", "prefix").join(labels, "node", "left").select("node", "size", "prefix", F.coalesce("label", "node").alias("label")))

    def frequent(held: DataFrame) -> DataFrame:
        tokens = held.select("label", F.explode("prefix").alias("token"))
        counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
        return checkpointed(counts.where((F.col("n") > HOT_TOKEN) & (F.col("low") < F.col("high"))).select("token"))

    hot = np.empty(0, np.uint64)
    for _ in range(TURNS):
        large = frequent(sets)
        # At most a HOT_TOKEN-th of all prefixes' tokens.
        new = np.setdiff1d(np.array([r["token"] for r in large.collect()], np.int64).view(np.uint64), hot)
        if not len(new):
            break
        hot = np.union1d(hot, new)
        those = sets.select("node", F.explode("prefix").alias("token")).join(large, "token", "left_semi").select("node")
        again = texts_of(those, rows, df, text_col).select("node", "t").mapInArrow(_later(hot, width), "at long, later array<long>")
        sets = written(sets.join(again, F.col("node") == F.col("at"), "left").select("node", "size", F.coalesce("later", "prefix").alias("prefix"), "label"))
    else:
        large = frequent(sets)
    tokens = sets.select("node", "label", "size", F.posexplode("prefix").alias("place", "token"))
    n = sets.agg(F.sum(F.size("prefix")).alias("n")).first()["n"] or 0
    few = tokens if large.isEmpty() else tokens.join(large, "token", "left_anti")
    bucket = F.pmod(F.xxhash64("token"), F.lit(max(1, n // TOKENS))).alias("bucket")
    pairs = few.select(bucket, "token", "node", "label", "size", "place").groupBy("bucket").applyInArrow(_sharing, "a long, b long").distinct()
    # Tokens of both prefixes, and at most all others of one set, are shared.
    x, y = (sets.select(F.col("node").alias(c), F.struct("size", "prefix").alias(f"s_{c}")) for c in "ab")
    rest = F.greatest(*[F.col(f"s_{c}.size") - F.size(f"s_{c}.prefix") for c in "ab"])
    enough = (F.size(F.array_intersect("s_a.prefix", "s_b.prefix")) + rest) * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (F.col("s_a.size") + F.col("s_b.size"))
    pairs = checkpointed(pairs.join(x, "a").join(y, "b").where(enough).select("a", "b"))
    found = verified(pairs, texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows, df, text_col), width)
    if large.isEmpty():
        return found
    members = checkpointed(tokens.join(large, "token").select(F.col("token").alias("key"), "node", "label", "size"))
    return found.unionByName(frequent_links(members, texts_of(members.select("node"), rows, df, text_col), width))


def similar_components(rows: DataFrame, df: DataFrame, width: int, text_col: str) -> DataFrame:
    """(node, label) for the nodes of distinct shingle sets that a chain of similar sets connects.

    Sets whose fingerprints share a band and are near are candidates.  First every
    set meets one of its candidates, the nearest below it.  Sets that this connects
    need no more pairs between them.  All other candidate pairs follow: those of
    keys with at most ``RARE`` sets by a join, those of frequent keys block by block.
    What fingerprints miss is then found by shared shingles (``missed_links``).
    """
    sketch = F.struct("size", *SKETCH)
    points = written(rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", *SKETCH, "keys", "prefix")]))
    shared = written(near_fingerprints(points))
    nearest = shared.where("node <> nearest.other").groupBy("node").agg(F.min("nearest").alias("nearest")).select(F.col("nearest.other").alias("a"), F.col("node").alias("b"))
    x, y = (points.select(F.col("node").alias(c), sketch.alias(f"s_{c}")) for c in "ab")
    first = checkpointed(nearest.join(x, "a").join(y, "b").where(_likely("s_a", "s_b")).select("a", "b"))
    texts = texts_of(first.select(F.explode(F.array("a", "b")).alias("node")), rows, df, text_col)
    found = checkpointed(verified(first, texts, width))
    named = checkpointed(shared.select("key", "node").join(components(found), "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")))
    apart = named.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
    ends = checkpointed(named.join(apart, "key").join(points.select("node", sketch.alias("s")), "node").select("key", "n", "label", "node", "s"))
    x, y = (ends.where(F.col("n") <= RARE).select("key", F.struct("label", "node", "s.*").alias(c)) for c in "xy")
    rest = x.join(y, "key").where((F.col("x.label") < F.col("y.label")) & _likely("x", "y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    done = first.unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rest = checkpointed(rest.join(done, ["a", "b"], "left_anti"))
    frequent = ends.where(F.col("n") > RARE).select("key", "node", "label", "s.size")
    more = rest.select(F.explode(F.array("a", "b")).alias("node")).unionByName(frequent.select("node")).distinct().join(texts, "node", "left_anti")
    texts = texts.unionByName(texts_of(more, rows, df, text_col))
    near = fewer_links(found.unionByName(verified(rest, texts, width)).unionByName(frequent_links(frequent, texts, width)))
    labels = components(near)
    missed = fewer_links(missed_links(points, labels, rows, df, width, text_col))
    return labels if missed.isEmpty() else components(fewer_links(near.unionByName(missed)))


def keep_one(df: DataFrame, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates (that of the least id; of equal rows any one), with the columns of ``df``.

    Two texts link just if the Jaccard similarity of their shingle sets is at least 0.8.
    Fingerprints find nearly all links; a pair that shares no band or differs in more
    bits than allowed is found by a shingle that both prefixes have.  Texts that are
    not UTF-8 are compared as bytes.
    """
    rows = written(shingle_sketches(df, width, id_col, text_col))
    labels = similar_components(rows, df, width, text_col)
    named = rows.select("id", "body", "node").join(labels, "node", "left").select("id", "body", F.coalesce("label", "node").alias("component"))
    # Rows are told apart by id and text: ids can be null or repeat.
    best = checkpointed(named.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "body")).alias("best")).select(F.col("best.id").alias("kept_id"), F.col("best.body").alias("kept_body")))
    name, body = unused(df, "kept_id"), unused(df, "kept_body")
    best = best.select(F.col("kept_id").alias(name), F.col("kept_body").alias(body))
    kept = df.join(best, F.col(f"`{id_col}`").eqNullSafe(F.col(name)) & (F.xxhash64(F.col(f"`{text_col}`").cast("string")) == F.col(body)), "left_semi")
    if not rows.groupBy("id", "body").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, text_col])  # rows that share id and text
    return kept.select(*[F.col(f"`{c}`") for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
