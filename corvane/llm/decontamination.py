"""Benchmark decontamination by a prefix-filtered set join.

An item's windows are its runs of ``width`` words (a shorter item is one window).
A document holds a window just if it holds all its shingles in place, so one
shingle, the rarest, is a necessary prefix of the window: documents are joined on
that one only.  Shingles are ordered by how often all documents have them, which a
first pass counts; a window with a shingle that no document has is dropped there.
In the second pass a document's shingle that equals a prefix proposes windows; the
shingle's place in the window bounds where the window must begin (positional
bound) and the document must have as many words from there (length bound); then the
words themselves are compared over the window's own size, so results are exact.

The benchmark is cut by a hash of (window, item) into parts of about
``part_bytes``, so what is sent to all executors is bounded at any size of the
benchmark; each part is counted and probed by passes of its own, and the passes
are put together by (id, text).  One part, the usual case, needs no shuffle of
documents at all.

Defined results: a null or empty text has no words and no hits; a null item text
has no windows, a null item id counts as an empty one, items with one id count
once; rows with null or equal ids are told apart by their texts, and equal rows get
equal results; texts that are not UTF-8 are taken as bytes (all bytes from 0x80
are parts of words); texts of any length are taken whole; ties between equally rare
shingles go to the first in the window and change no result; an empty table of
documents gives an empty result, an empty benchmark no hits.  Only id and text of
either table are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, slices, unused, written
from .piece_codec import ranges

#: Words of a window, and of a shingle.
WIDTH, SHINGLE = 10, 5
#: Bytes of windows and ids of one part of the benchmark, about.
PART_BYTES = 8 << 20
#: Bytes of a text split at a time, and proposals verified at a time.
CUT, PAIRS = 4 << 20, 1 << 20
#: Lower-cases A-Z, keeps digits, a-z and all bytes from 0x80, and makes anything else a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Odd multipliers of the shingle hash, one for each place.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def words_of_bytes(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a list for each cut of about ``CUT`` bytes."""
    folded = text.translate(FOLD)
    at = 0
    while at < len(folded):
        end = len(folded) if len(folded) - at <= CUT else folded.find(b" ", at + CUT)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


@dataclass
class Part:
    """One part of the benchmark: words, windows and their items, and the shingles of each length."""

    vocabulary: dict[bytes, int]
    at: np.ndarray  # where window w's word ids begin in ``ids``; one more entry at the end
    ids: np.ndarray
    items: list[list[str]]
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # length -> sorted hashes
    prefixes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, pairs: Iterable[tuple[bytes, str]], shingle: int) -> Part:
        windows: dict[bytes, set[str]] = {}
        for window, item in pairs:
            windows.setdefault(window, set()).add(item)
        vocabulary: dict[bytes, int] = {}
        ids = [[vocabulary.setdefault(w, len(vocabulary) + 1) for w in window.split(b" ")] for window in windows]
        at = np.cumsum([0, *map(len, ids)])
        part = cls(vocabulary, at, np.array([i for row in ids for i in row], np.int32), [sorted(x) for x in windows.values()])
        found: dict[int, list[np.ndarray]] = {}
        for length, _, places in part._by_length(shingle):
            found.setdefault(min(shingle, length), []).append(hashes(part.ids, places.ravel(), min(shingle, length)))
        part.shingles = {s: np.unique(np.concatenate(h)) for s, h in found.items()}
        return part

    def _by_length(self, shingle: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length of window: the length, the windows, and the places of their shingles (a row a window)."""
        lengths = np.diff(self.at)
        for length in np.unique(lengths).tolist():
            w = np.flatnonzero(lengths == length)
            yield length, w, self.at[w][:, None] + np.arange(length - min(shingle, length) + 1)

    def rank(self, counts: dict[int, np.ndarray], shingle: int) -> None:
        """Choose each window's rarest shingle as its prefix; drop windows that have one nobody has."""
        chosen: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for length, w, places in self._by_length(shingle):
            s = min(shingle, length)
            h = hashes(self.ids, places.ravel(), s)
            n = counts[s][np.searchsorted(self.shingles[s], h)].reshape(places.shape)
            offset = n.argmin(1)
            row = np.flatnonzero(n.min(1) > 0)
            chosen.setdefault(s, []).append((h.reshape(places.shape)[row, offset[row]], w[row], offset[row]))
        self.prefixes = {}
        for s, found in chosen.items():
            h, w, offset = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            keys, first = np.unique(h[order], return_index=True)
            self.prefixes[s] = keys, np.append(first, len(h)), w[order], offset[order]
        self.shingles = {}


def hashes(ids: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(places), np.uint64)
    for k in range(length):
        out += ids[places + k].astype(np.uint64) * MULTIPLIERS[k % len(MULTIPLIERS)] * np.uint64(2 * (k // len(MULTIPLIERS)) + 1)
    out ^= out >> np.uint64(29)
    return out


def known(ids: np.ndarray, length: int) -> np.ndarray:
    """Places from which ``length`` words follow that the benchmark has (0: it has not, or a text ends)."""
    if len(ids) < length:
        return np.zeros(0, np.int64)
    gaps = np.concatenate([[0], np.cumsum(ids == 0)])
    return np.flatnonzero(gaps[length:] == gaps[:-length])


def coded(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all texts, a 0 behind each, and where each text begins (one more entry at the end)."""
    out, at = [], [0]
    for text in texts:
        n = 0
        for words in words_of_bytes(text):
            out.append(np.fromiter((vocabulary.get(w, 0) for w in words), np.int32, len(words)))
            n += len(words)
        out.append(np.zeros(1, np.int32))
        at.append(at[-1] + n + 1)
    return np.concatenate(out) if out else np.zeros(0, np.int32), np.array(at)


def occurrences(part: Part, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows occur, and which, once each."""
    starts, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s, (keys, first, windows, offsets) in part.prefixes.items():
        if not len(keys):
            continue
        places = known(ids, s)
        h = hashes(ids, places, s)
        slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        same = np.flatnonzero(keys[slot] == h)
        places, slot = places[same], slot[same]
        n = first[slot + 1] - first[slot]
        cuts = [0, *np.searchsorted(np.cumsum(n), np.arange(PAIRS, n.sum() + PAIRS, PAIRS)) + 1]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            entry = ranges(first[slot[a:b]], n[a:b])
            w, start = windows[entry], np.repeat(places[a:b], n[a:b]) - offsets[entry]
            length = part.at[w + 1] - part.at[w]
            text = np.searchsorted(at, np.repeat(places[a:b], n[a:b]), "right") - 1
            fits = (start >= at[text]) & (start + length < at[text + 1])
            w, start, length = w[fits], start[fits], length[fits]
            for k in range(int(length.max(initial=0))):
                left = np.flatnonzero((k >= length) | (ids[np.minimum(start + k, len(ids) - 1)] == part.ids[np.minimum(part.at[w] + k, len(part.ids) - 1)]))
                w, start, length = w[left], start[left], length[left]
            starts.append(start)
            wins.append(w)
    return np.concatenate(starts), np.concatenate(wins)


def found_in(part: Part, texts: list[bytes]) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[list[str]]]:
    """Of each text: its number of words, the runs of its hit words, and the ids of the items found."""
    ids, at = coded(texts, part.vocabulary)
    start, window = occurrences(part, ids, at)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[list[str]] = [[] for _ in texts]
    if len(start):
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + np.diff(part.at)[window], -1)
        hit = np.diff(np.concatenate([[0], np.cumsum(edge) > 0]).astype(np.int8))
        for a, b in zip(np.flatnonzero(hit == 1).tolist(), np.flatnonzero(hit == -1).tolist(), strict=True):
            d = int(np.searchsorted(at, a, "right")) - 1
            spans[d].append((a - int(at[d]), b - int(at[d])))
        both = np.unique(np.stack([np.searchsorted(at, start, "right") - 1, window]), axis=1)
        texts_hit, first = np.unique(both[0], return_index=True)
        for d, w in zip(texts_hit.tolist(), np.split(both[1], first[1:]), strict=True):
            items[d] = sorted({i for x in w.tolist() for i in part.items[x]})
    return np.diff(at) - 1, spans, items


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def bench_windows(bench: DataFrame, width: int, item_col: str, text_col: str) -> DataFrame:
    """(window, item): every window of every item, its words joined by spaces, once."""
    narrow = bench.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches, 1):
            for item, text in zip(part.column(0).to_pylist(), texts, strict=True):
                words = [w for some in words_of_bytes(text) for w in some]
                made = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
                for a in range(0, len(made), 8192):
                    yield pa.RecordBatch.from_arrays([pa.array(made[a : a + 8192], pa.binary()), pa.array([item] * len(made[a : a + 8192]), pa.string())], names=["window", "item"])

    return narrow.mapInArrow(run, "window binary, item string").distinct()


def _counted(narrow: DataFrame, part: Part) -> dict[int, np.ndarray]:
    """How often all texts have each shingle of the part."""
    shared = narrow.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Part = shared.value
        total = {s: np.zeros(len(keys), np.int64) for s, keys in own.shingles.items()}
        for _, texts in slices(batches, 0):
            ids, _ = coded(texts, own.vocabulary)
            for s, keys in own.shingles.items():
                h = hashes(ids, known(ids, s), s)
                slot = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                total[s] += np.bincount(slot[keys[slot] == h], minlength=len(keys))
        for s, n in total.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), s)), pa.array(some), pa.array(n[some])], names=["s", "slot", "n"])

    rows = narrow.select("t").mapInArrow(run, "s long, slot long, n long").groupBy("s", "slot").agg(F.sum("n").alias("n"))
    out = {s: np.zeros(len(keys), np.int64) for s, keys in part.shingles.items()}
    for r in rows.collect():  # as many rows as the part has shingles, at most
        out[r["s"]][r["slot"]] = r["n"]
    shared.destroy()
    return out


def _probed(narrow: DataFrame, part: Part) -> DataFrame:
    """(k, digest, n_words, spans, items) of every row for one part."""
    shared = narrow.sparkSession.sparkContext.broadcast(part)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in slices(batches, 2):
            n_words, spans, items = found_in(shared.value, texts)
            made = [[{"start": a, "end": b} for a, b in s] for s in spans]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n_words), pa.array(made, SPANS), pa.array(items, pa.list_(pa.string()))], names=["k", "digest", "n_words", "spans", "items"])

    return narrow.mapInArrow(run, f"k {narrow.schema['k'].dataType.simpleString()}, digest binary, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _together(passes: list[DataFrame]) -> DataFrame:
    """The passes of several parts as one: rows with one id and text have equal results and are kept as often as they come."""
    both = passes[0]
    for p in passes[1:]:
        both = both.unionByName(p)
    told = F.when(F.size("items") > 0, F.struct("spans", "items"))  # equal rows make equal structs, so a set holds one for each pass
    merged = both.groupBy("k", "digest", "n_words").agg((F.count("*") / len(passes)).cast("long").alias("copies"), F.collect_set(told).alias("told"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = [], []
            for told in batch.column(3).to_pylist():
                runs: list[dict] = []
                for a, b in sorted((s["start"], s["end"]) for t in told for s in t["spans"]):
                    if runs and a <= runs[-1]["end"]:
                        runs[-1]["end"] = max(b, runs[-1]["end"])
                    else:
                        runs.append({"start": a, "end": b})
                spans.append(runs)
                items.append(sorted({i for t in told for i in t["items"]}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string()))], names=["k", "n_words", "copies", "spans", "items"])

    kind = passes[0].schema["k"].dataType.simpleString()
    out = merged.select("k", "n_words", "copies", "told").mapInArrow(run, f"k {kind}, n_words long, copies long, spans array<struct<start:long,end:long>>, items array<string>")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")


def find_contamination(
    df: DataFrame, bench: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """Per row of ``df``: id, n_words, spans (runs of hit words, end exclusive) and items (ids found, sorted as strings)."""
    windows = written(bench_windows(bench, width, item_col, item_text_col))
    held = windows.agg(F.sum(F.length("window") + F.length("item") + 64)).first()[0] or 0
    parts = max(1, -(-held // part_bytes))
    several = parts > 1
    digest = F.sha2(F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")), 256) if several else F.lit("")
    narrow = df.select(F.col(id_col).alias("k"), digest.cast("binary").alias("digest"), F.col(text_col).cast("binary").alias("t"))
    passes = []
    for i in range(parts):
        mine = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == i)
        part = Part.of(((bytes(r["window"]), r["item"]) for r in mine.toLocalIterator()), shingle)
        part.rank(_counted(narrow, part), shingle)
        passes.append(written(_probed(narrow, part)) if several else _probed(narrow, part))
    found = _together(passes) if several else passes[0]
    return found.select(F.col("k").alias(id_col), "n_words", "spans", "items")


def drop_contaminated(df: DataFrame, bench: DataFrame, most_share: float = 0.0, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` of whose words at most ``most_share`` are hit, with the columns of ``df``."""
    key = unused(df, "row_key")
    keyed = df.withColumn(key, F.sha2(F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b"")), 256))
    found = find_contamination(keyed, bench, id_col=key, text_col=text_col, **options)
    bad = found.where(n_hit(F.col("spans")) > most_share * F.col("n_words")).select(key).distinct()
    return keyed.join(bad, key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


def n_hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    hit = n_hit(F.col("spans"))
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find_contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), w AS (
  SELECT DISTINCT item, n, array_to_string(ws[i + 1 : i + n], ' ') AS win
  FROM (SELECT item, ws, least(len(ws), {WIDTH}) AS n, unnest(range(0, greatest(len(ws) - {WIDTH}, 0) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (
  SELECT DISTINCT n FROM w
), p AS (
  SELECT rid, n, i, array_to_string(ws[i + 1 : i + n], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(range(0, len(ws) - n + 1)) AS i FROM d, sizes WHERE len(ws) >= n)
), h AS (
  SELECT rid, i, p.n, item FROM p JOIN w USING (win)
), hits AS (
  SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM h)) GROUP BY rid
), items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT rid, item FROM h) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN items USING (rid)
"""
