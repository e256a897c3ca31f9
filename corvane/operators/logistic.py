"""Logistic regression over sparse rows whose coefficients never meet in one place.

The optimum is a sum of training rows, so coefficients are kept as a number ``a``
for each row (coefficients = X'a) beside the row's part of its margin ``k`` = XX'a.
All the optimiser's vectors are such pairs, in chunks of rows; inner products of
coefficients are sums of ``a`` times ``k``.  Truncated Newton steps by conjugate
gradients need one product with XX' each: the rows' numbers go to groups of terms,
which send back their part.  Only sums come to the driver.

Terms of one row only take part by the sum of their squares in that row.

The entries of X are dealt once, as blocks of NumPy arrays: a group holds a range of
the terms' 64-bit hashes (``text.dealt_terms``), and there terms are counted,
weighed, fitted and met by the texts to be scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a chunk, as a power of two.
CHUNK_BITS = 14
#: Entries of a group of terms below and above which more groups gain nothing or are needed.
FEW_ENTRIES, MANY_ENTRIES = 100_000, 10_000_000
#: Groups of terms that a task of a product may take together: each step sends the rows' numbers to every task.
TOGETHER = 8
#: Chunks that a task takes together.
FEW_CHUNKS = 16
#: Steps between checkpoints of the chunks, and halvings that a line search tries at once.
KEPT, HALVINGS = 8, 12


def groups_for(entries: int, cores: int) -> int:
    return max(1, entries // MANY_ENTRIES + 1, min(cores, entries // FEW_ENTRIES))


def chunk_of(doc: Column) -> Column:
    """Equal for the rows of a chunk, by ids as ``monotonically_increasing_id`` makes them; consecutive chunks and partitions are dealt to different tasks."""
    inner = doc.bitwiseAND((1 << 33) - 1)
    return F.shiftright(doc, 33) + F.shiftright(inner, CHUNK_BITS) * 1_000_003


def row_of(doc: Column) -> Column:
    return doc.bitwiseAND((1 << CHUNK_BITS) - 1).cast("int")


def small(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 up in few bytes."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def planed(terms: np.ndarray) -> np.ndarray:
    """Ascending hashes as the bytes of their differences, the first bytes of all first: those are zeros mostly, and compress."""
    return np.diff(terms, prepend=np.uint64(0)).astype(">u8").view(np.uint8).reshape(-1, 8).T.copy()


def unplaned(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(planes.T.copy().view(">u8").ravel().astype(np.uint64), dtype=np.uint64)


def _chunk(r) -> tuple[int, dict]:  # noqa: ANN001
    held = sorted(r["rows"])
    return r["chunk"], {n: np.array([x[n] for x in held], t) for n, t in (("row", np.int64), ("doc", np.int64), ("ones", np.int64), ("zeros", np.int64))}


@dataclass
class Vocabulary:
    """The terms of training rows, (group, ("terms", hashes ascending, df)), and the entries in blocks (group, (kind, chunk, row, at, many, tf)).

    ``row`` and ``at`` count the chunk's training rows and the group's terms; there is
    an ``at`` for each ``many`` entries.  ``matrix`` has the entries of terms of several
    rows, groups together in ``parts``: (part, (group, idf)) and (part, (group, chunk, row, at, many, tf)).
    """

    held: RDD
    matrix: RDD
    parts: int
    chunks: RDD
    groups: int
    size: int
    n: int


def _sent(chunks: RDD, groups: int, parts: int, f) -> RDD:  # noqa: ANN001
    """(group, (chunk, f(state))) for every group."""

    def run(held: Iterator[tuple]) -> Iterator[tuple]:
        for chunk, state in held:
            x = (chunk, f(state))
            for g in range(groups):
                yield g, x

    return chunks.mapPartitions(run).partitionBy(parts)


def weigh(tf: np.ndarray) -> np.ndarray:
    """1 + ln tf; frequencies that fit into a byte or two by a table."""
    if tf.dtype.itemsize > 2 or not len(tf):
        return 1 + np.log(tf.astype(np.float64))
    return (1 + np.log(np.maximum(np.arange(int(tf.max()) + 1), 1)))[tf]


def rarity(n: int, df: np.ndarray) -> np.ndarray:
    return np.log((1.0 + n) / (1 + df.astype(np.float64))) + 1


def learn_vocabulary(dealt: RDD, told: DataFrame, groups: int, n: int) -> Vocabulary:
    """Terms of the rows told(doc, ones, zeros), with ln((1 + n) / (1 + df)) + 1; each row counts ``ones + zeros`` times.

    dealt: (group, (chunk, row, terms, many, tf)), entries by term: ``many`` of each
    of ``terms`` (as ``planed`` writes them), with their rows and frequencies.
    """
    parts = dealt.getNumPartitions()
    lists = told.select(chunk_of(F.col("doc")).alias("chunk"), F.struct(row_of(F.col("doc")).alias("row"), "doc", "ones", "zeros").alias("r")).groupBy("chunk").agg(F.collect_list("r").alias("rows"))
    chunks = lists.rdd.map(_chunk).persist(StorageLevel.MEMORY_AND_DISK)
    n_chunks = chunks.count()
    size = 1 << CHUNK_BITS

    def learn(held: Iterator[tuple]) -> Iterator[tuple]:
        rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        found: dict[int, list[tuple]] = {}
        for group, item in held:
            if len(item) == 2:  # rows that take part come before all blocks
                rows[item[0]] = item[1]
                continue
            chunk, row, terms, many, tf = item
            mine = found.setdefault(group, [])
            if chunk not in rows:
                continue
            terms, (taken, count) = unplaned(terms), rows[chunk]
            place = np.full(size, -1, np.int32)
            place[taken] = np.arange(len(taken))
            at = place[row]
            there = at >= 0
            if not there.any():
                continue
            at, kept = at[there], tf[there]
            term = np.repeat(np.arange(len(terms)), many)[there]
            several = np.bincount(term, minlength=len(terms))
            seen = several > 0
            mine.append((chunk, small(at), terms[seen], small(several[seen]), kept, small(np.bincount(term, count[at], len(terms))[seen].astype(np.int64))))
        for group, mine in found.items():
            words = np.unique(np.concatenate([x[2] for x in mine])) if mine else np.empty(0, np.uint64)
            places = [np.searchsorted(words, x[2]).astype(np.int32) for x in mine]
            df, entries = np.zeros(len(words)), np.zeros(len(words), np.int64)
            for (_, _, _, several, _, total), at in zip(mine, places, strict=True):
                df[at] += total
                entries[at] += several
            yield group, ("terms", words, small(df.astype(np.int64)))
            for (chunk, row, _, several, tf, _), at in zip(mine, places, strict=True):
                single = entries[at] == 1
                which = np.repeat(single, several)
                for kind, t, e in (("alone", single, which), ("shared", ~single, ~which)):
                    if e.any():
                        yield group, (kind, chunk, row[e], at[t], several[t], tf[e])

    sent = _sent(chunks, groups, parts, lambda s: (small(s["row"]), small(s["ones"] + s["zeros"])))
    held = sent.union(dealt).mapPartitions(learn, True).persist(StorageLevel.DISK_ONLY)  # read three times only
    n_terms = held.map(lambda x: len(x[1][1]) if x[1][0] == "terms" else 0).sum()

    def shared(held: Iterator[tuple]) -> Iterator[tuple]:
        terms, blocks = {}, {}
        for group, item in held:
            if item[0] == "terms":
                terms[group] = rarity(n, item[2])
            elif item[0] == "shared":
                blocks.setdefault(group, []).append(item[1:])
        for group, mine in blocks.items():
            used = np.zeros(len(terms[group]), bool)
            for _, _, at, _, _ in mine:
                used[at] = True
            place = (np.cumsum(used) - 1).astype(np.int32)
            yield group % together, (group, terms[group][used])
            for chunk, row, at, many, tf in mine:
                yield group % together, (group, chunk, row, place[at], many, tf)

    together = min(groups, max(told.sparkSession.sparkContext.defaultParallelism, groups // TOGETHER))
    matrix = held.mapPartitions(shared).partitionBy(together).persist(StorageLevel.MEMORY_AND_DISK)
    return Vocabulary(held, matrix, together, chunks.partitionBy(max(1, n_chunks // FEW_CHUNKS)), groups, int(n_terms), n)


def _start(vocabulary: Vocabulary, v_ones: float, v_zeros: float) -> RDD:
    """Chunks of training rows at coefficients 0, with the lengths of their rows."""

    vocabulary_n = vocabulary.n

    def squares(held: Iterator[tuple]) -> Iterator[tuple]:
        idf = {}
        for group, item in held:
            if item[0] == "terms":
                idf[group] = rarity(vocabulary_n, item[2])
                continue
            kind, chunk, row, at, many, tf = item
            yield chunk, (kind, np.bincount(row, (weigh(tf) * np.repeat(idf[group][at], many)) ** 2))

    def start(held: Iterator[tuple]) -> Iterator[tuple]:
        states, total = {}, {}
        for chunk, item in held:
            if isinstance(item, dict):
                states[chunk], total[chunk] = item, {k: np.zeros(len(item["doc"])) for k in ("alone", "shared")}
            else:
                total[chunk][item[0]][: len(item[1])] += item[1]
        for chunk, s in states.items():
            zeros = {k: np.zeros(len(s["doc"])) for k in ("a", "k", "da", "dk", "ra", "rk", "pa", "pk", "u", "curve")}
            both = total[chunk]["alone"] + total[chunk]["shared"]
            there = both > 0
            v = s["ones"] * v_ones + s["zeros"] * v_zeros
            scale, own = np.ones(len(v)), np.zeros(len(v))
            scale[there], own[there] = 1 / np.sqrt(both[there]), total[chunk]["alone"][there] / both[there]
            yield chunk, zeros | {"doc": s["doc"], "v": v, "y": s["ones"] * v_ones / v, "scale": scale, "own": own}

    back = vocabulary.held.mapPartitions(squares).partitionBy(vocabulary.chunks.getNumPartitions())
    return vocabulary.chunks.union(back).mapPartitions(start, True)


def _times_u(vocabulary: Vocabulary, chunks: RDD, after) -> RDD:  # noqa: ANN001
    """chunks after ``after(state, XX'u)``, for their vectors u."""

    def product(held: Iterator[tuple]) -> Iterator[tuple]:
        u, idf, blocks, out = {}, {}, {}, {}
        for _, item in held:
            if len(item) > 2:
                blocks.setdefault(item[0], []).append(item[1:])
            elif isinstance(item[1], tuple):
                u[item[0]] = item[1][1]
            else:
                idf[item[0]] = item[1]
        for group, mine in blocks.items():
            total = np.zeros(len(idf[group]))
            for chunk, row, at, many, tf in mine:
                total[at] += np.add.reduceat(weigh(tf) * u[chunk][row], np.cumsum(many, dtype=np.int64) - many)
            total *= idf[group] ** 2
            for chunk, row, at, many, tf in mine:
                found = np.bincount(row, weigh(tf) * np.repeat(total[at], many))
                out.setdefault(chunk, np.zeros(len(u[chunk])))[: len(found)] += found
        yield from out.items()

    def gather(held: Iterator[tuple]) -> Iterator[tuple]:
        states, found = {}, {}
        for chunk, item in held:
            if isinstance(item, dict):
                states[chunk], found[chunk] = item, np.zeros(len(item["u"]))
            else:
                found[chunk][: len(item)] += item
        for chunk, state in states.items():
            yield chunk, after(state, state["own"] * state["u"] + state["scale"] * found[chunk])

    # RDDs dealt alike are joined partition by partition, the first one's rows first; the blocks stay where they are.
    sent = _sent(chunks, vocabulary.parts, vocabulary.matrix.getNumPartitions(), lambda s: ("u", s["u"] * s["scale"]))
    back = sent.union(vocabulary.matrix).mapPartitions(product).partitionBy(chunks.getNumPartitions())
    return chunks.union(back).mapPartitions(gather, True)


def _sums(s: dict) -> np.ndarray:
    d = s["curve"]
    return np.array([s["ra"] @ s["rk"], s["ra"] @ s["pk"], s["pa"] @ s["pk"], d @ s["rk"] ** 2, d @ (s["rk"] * s["pk"]), d @ s["pk"] ** 2, d @ s["rk"], d @ s["pk"], d.sum(), (s["v"] * s["slack"]).sum()])


class _Chunks:
    """The chunks of all rows, step by step."""

    def __init__(self, rdd: RDD) -> None:
        self.rdd, self.steps = rdd.persist(StorageLevel.MEMORY_AND_DISK), 0

    def total(self, f) -> np.ndarray:  # noqa: ANN001
        return self.rdd.map(lambda x: f(x[1])).reduce(np.add)

    def move(self, new: RDD, f) -> np.ndarray:  # noqa: ANN001
        """On to ``new``; the totals of f over it."""
        old, self.rdd = self.rdd, new.persist(StorageLevel.MEMORY_AND_DISK)
        self.steps += 1
        if self.steps % KEPT == 0:
            self.rdd.checkpoint()
        out = self.total(f)
        old.unpersist()
        return out


def fit_balanced(vocabulary: Vocabulary, v_ones: float, v_zeros: float, c: float, rounds: int, tol: float = 1e-6) -> tuple[RDD, float]:
    """((group, (hashes, idf, coefficients)), intercept) of the least of the weighted log-loss plus half the squared coefficients over ``c``.

    Rows are brought to length 1, and weigh ``v_ones`` or ``v_zeros`` each time they
    are labelled.  Steps end where the gradient's length is ``tol`` of that at the start.
    """
    chunks = _Chunks(_start(vocabulary, v_ones, v_zeros))
    b, t, start = 0.0, 0.0, None
    for _ in range(rounds):
        # Residuals are u; the gradient is (a / c + u, sum of u).
        def opened(s: dict, b: float = b, t: float = t) -> dict:
            a, k = s["a"] + t * s["da"], s["k"] + t * s["dk"]
            p = 1 / (1 + np.exp(-np.clip(k + b, -700, 700)))
            return s | {"a": a, "k": k, "slack": p - s["y"], "u": s["v"] * (p - s["y"]), "curve": s["v"] * p * (1 - p)}

        def first(s: dict, product: np.ndarray) -> dict:
            ra, rk = -(s["a"] / c + s["u"]), -(s["k"] / c + product)
            return s | {"ra": ra, "rk": rk, "pa": ra, "pk": rk, "da": np.zeros_like(ra), "dk": np.zeros_like(ra)}

        rr, _, _, zz, _, _, z1, _, bend, slope = chunks.move(_times_u(vocabulary, chunks.rdd.mapValues(opened), first), _sums)
        t = 0.0
        length = np.sqrt(max(rr, 0.0) + slope * slope)
        start = start or length
        if length <= tol * start:
            break
        rb, db, bend = -slope, 0.0, max(bend, 1e-300)
        bp = rb / bend
        rz = first_rz = rr + rb * rb / bend
        energy, bhp, beta = rr / c + zz + 2 * bp * z1 + bp * bp * bend, z1 + bp * bend, 0.0
        goal = min(0.1, np.sqrt(length / start)) ** 2 * rz
        for _ in range(500):
            alpha = rz / energy

            def turned(s: dict, beta: float = beta, bp: float = bp) -> dict:
                pa, pk = s["ra"] + beta * s["pa"], s["rk"] + beta * s["pk"]
                return s | {"pa": pa, "pk": pk, "u": s["curve"] * (pk + bp)}

            def moved(s: dict, product: np.ndarray, alpha: float = alpha) -> dict:
                return s | {
                    "da": s["da"] + alpha * s["pa"], "dk": s["dk"] + alpha * s["pk"],
                    "ra": s["ra"] - alpha * (s["pa"] / c + s["u"]), "rk": s["rk"] - alpha * (s["pk"] / c + product),
                }

            db, rb = db + alpha * bp, rb - alpha * bhp
            rr, rp, pp, zz, zp, ww, z1, w1, _, _ = chunks.move(_times_u(vocabulary, chunks.rdd.mapValues(turned), moved), _sums)
            new = rr + rb * rb / bend
            if not goal < new < 1e6 * first_rz:
                break
            beta, rz, bz = new / rz, new, rb / bend
            # The next direction z + beta p by the sums of its parts.
            hz, hp = z1 + bz * bend, w1 + bp * bend
            zz, zp, ww = zz + 2 * bz * z1 + bz * bz * bend, zp + bz * w1 + bp * z1 + bz * bp * bend, ww + 2 * bp * w1 + bp * bp * bend
            energy = (rr + 2 * beta * rp + beta * beta * pp) / c + zz + 2 * beta * zp + beta * beta * ww
            bhp, bp = hz + beta * hp, bz + beta * bp

        steps = [0.0] + [0.5**i for i in range(HALVINGS)]

        def losses(s: dict, b: float = b, db: float = db) -> np.ndarray:
            out = []
            for t in steps:  # noqa: B023
                a, k = s["a"] + t * s["da"], s["k"] + t * s["dk"]
                out.append((s["v"] * (np.logaddexp(0, k + b + t * db) - s["y"] * (k + b + t * db))).sum() + a @ k / (2 * c))
            return np.array(out)

        found = chunks.total(losses)
        t = steps[int(np.argmin(found))]
        if not t:
            break  # no step is left that rounding can tell
        b += t * db

    n = vocabulary.n

    def coefficients(held: Iterator[tuple]) -> Iterator[tuple]:
        shares, found, total = {}, {}, {}
        for group, item in held:
            if len(item) == 2:
                shares[item[0]] = item[1]
            elif item[0] == "terms":
                found[group], total[group] = (item[1], rarity(n, item[2])), np.zeros(len(item[1]))
            else:
                _, chunk, row, at, many, tf = item
                total[group][at] += np.add.reduceat(weigh(tf) * shares[chunk][row], np.cumsum(many, dtype=np.int64) - many)
        for group, (words, idf) in found.items():
            yield group, (words, idf, idf * total[group])

    sent = _sent(chunks.rdd, vocabulary.groups, vocabulary.held.getNumPartitions(), lambda s: (s["a"] + t * s["da"]) * s["scale"])
    out = sent.union(vocabulary.held).mapPartitions(coefficients, True).persist(StorageLevel.MEMORY_AND_DISK)
    out.count()
    for done in (chunks.rdd, vocabulary.held, vocabulary.matrix):
        done.unpersist()
    return out, float(b)


def margins(dealt: RDD, coefficients: RDD) -> RDD:
    """(chunk, (row of the first, sums)) of the rows that have known terms: coefficients times entries of rows brought to length 1."""

    def part(held: Iterator[tuple]) -> Iterator[tuple]:
        known = {}
        for group, item in held:
            if len(item) == 3:  # coefficients come before all blocks
                known[group] = item
                continue
            chunk, row, terms, many, tf = item
            words, idf, coefficient = known.get(group, ((), (), ()))
            if not len(words):
                continue
            terms = unplaned(terms)
            at = np.minimum(np.searchsorted(words, terms), len(words) - 1)
            there = words[at] == terms
            of = np.repeat(np.where(there, at, -1), many)
            row, w, of = row[of >= 0].astype(np.int64), weigh(tf[of >= 0]), of[of >= 0]
            if len(of):
                first = int(row.min())
                w *= idf[of]
                yield chunk, (first, np.bincount(row - first, coefficient[of] * w), np.bincount(row - first, w * w))

    def whole(held: Iterator[tuple]) -> Iterator[tuple]:
        found: dict[int, np.ndarray] = {}
        for chunk, (first, sums, squares) in held:
            total = found.get(chunk)
            if total is None:
                total = found[chunk] = np.zeros((2, size))
            total[0, first : first + len(sums)] += sums
            total[1, first : first + len(sums)] += squares
        for chunk, (sums, squares) in found.items():
            for row in np.flatnonzero(squares).tolist():
                yield chunk, row, float(sums[row] / np.sqrt(squares[row]))

    size = 1 << CHUNK_BITS
    return coefficients.union(dealt).mapPartitions(part).partitionBy(dealt.getNumPartitions()).mapPartitions(whole)
