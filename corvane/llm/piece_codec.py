"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text becomes symbols, one a character, and an agenda of adjacent pairs ordered
by the score of the merged piece (ties: the leftmost) says which to merge next.
No piece of such a vocabulary holds a space mark after another character, so a
text falls apart before its space marks and the agendas of the parts are
independent.  Each distinct part is merged once: the agendas of many short parts
advance together, one merge a round each, in NumPy; a long part has a heap.

In every slice of an Arrow batch some texts, picked at random, are encoded and
decoded by the sentencepiece library too, and a difference stops the job.

Defined results: a null or empty text gives the begin and end ids alone and
decodes to an empty text; bytes that are not UTF-8 count as U+FFFD; repeated rows get equal results; an empty table gives
an empty result.  Only the id and the text are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, picked, slices

SPACE = "▁"
#: Parts of more characters than this get a heap of their own.
SHORT = 40
#: Distinct parts, and characters in them, held by a worker; beyond either, the store begins anew.
HELD, HELD_CHARS = 300_000, 16 << 20
#: Characters of text per slice that the library checks (at least one text).
CHECKED = 16_384
NONE = np.int32(2**31 - 1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class PieceCodec:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or spec.name != "identity" or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with identity normalisation, dummy prefix and byte fallback is needed")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == proto.ModelProto.SentencePiece.NORMAL}
        byte_ids = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space mark after another character")
        self.part = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if not any("\n" in p and len(p) > 1 for p in normal) else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        # Symbols: the ids of pieces, then characters that are only parts of pieces.
        symbols = dict(normal)
        for c in sorted({c for p in normal for c in p}):
            if c not in symbols:
                symbols[c] = len(model.pieces) + len(symbols) - len(normal)
        self.of_char = -2 - np.arange(0x110000, dtype=np.int32)  # other characters: below -1, never merged
        self.extra = {s: c for c, s in symbols.items() if s >= len(model.pieces)}
        for c, s in symbols.items():
            if len(c) == 1:
                self.of_char[ord(c)] = s
        order = {s: i for i, s in enumerate(sorted({model.pieces[i].score for i in normal.values()}, reverse=True))}
        self.width = len(model.pieces) + len(self.extra)
        pairs = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = symbols.get(p[:k]), symbols.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (order[model.pieces[i].score], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.rank = np.array([pairs[k][0] for k in self.keys.tolist()], dtype=np.int32)
        self.merged = np.array([pairs[k][1] for k in self.keys.tolist()], dtype=np.int32)
        self.byte_ids = np.array(byte_ids, dtype=np.int32)
        # Bytes of each id, for decoding.
        out = [b""] * len(model.pieces)
        for p, i in normal.items():
            out[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(byte_ids):
            out[i] = bytes([b])
        self.piece_len = np.array([len(x) for x in out])
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.space_first = np.array([x.startswith(b" ") for x in out])
        self._clear()

    def _clear(self) -> None:
        self.held: dict[str, int] = {}
        self.held_chars = 0
        self.ids = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(HELD + 1, np.int64)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged id of pairs; NONE where there is none."""
        key = left.astype(np.int64) * self.width + right
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = (self.keys[i] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.rank[i], NONE), self.merged[i]

    def _short(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of short words after all merges, and how many each word has."""
        n, lengths = len(words), np.fromiter(map(len, words), np.int64, len(words))
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        wide = int(lengths.max()) + 1
        filled = np.arange(wide) < lengths[:, None]
        sym = np.full((n, wide), -1, np.int32)
        sym[filled] = self.of_char[chars]
        rank, merged = (np.full((n, wide), NONE, np.int32), np.zeros((n, wide), np.int32))
        rank[:, :-1], merged[:, :-1] = self._look(sym[:, :-1], sym[:, 1:])
        after = np.tile(np.arange(1, wide + 1, dtype=np.int16), (n, 1))
        before = np.tile(np.arange(-1, wide - 1, dtype=np.int16), (n, 1))
        rows = np.arange(n)
        while len(rows):
            at = rank[rows].argmin(1)
            go = rank[rows, at] != NONE
            rows, at = rows[go], at[go]
            if not len(rows):
                break
            gone = after[rows, at].astype(np.int64)
            then = after[rows, gone].astype(np.int64)
            sym[rows, at] = new = merged[rows, at]
            sym[rows, gone], rank[rows, gone] = -1, NONE
            after[rows, at] = then
            inside = then < wide
            before[rows[inside], then[inside]] = at[inside]
            right = np.where(inside, sym[rows, np.minimum(then, wide - 1)], -1)
            rank[rows, at], merged[rows, at] = self._look(new, right)
            prev = before[rows, at].astype(np.int64)
            has = prev >= 0
            r, p = rows[has], prev[has]
            rank[r, p], merged[r, p] = self._look(sym[r, p], new[has])
        alive = sym != -1
        return sym[alive], alive.sum(1)

    def _long(self, word: str) -> list[int]:
        """Symbols of a long word: a heap of (rank, place) with stale entries skipped."""
        sym = self.of_char[np.frombuffer(word.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n and sym[a] >= 0 and sym[b] >= 0 and (found := self.pairs.get(sym[a] * self.width + sym[b])):
                heapq.heappush(heap, (found[0], a, sym[a], sym[b], found[1]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, a, left, right, new = heapq.heappop(heap)
            b = after[a]
            if sym[a] != left or b >= n or sym[b] != right:
                continue
            sym[a], sym[b] = new, -1
            after[a] = after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [s for s in sym if s != -1]

    def _ids(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols as ids, characters without a piece as the ids of their bytes."""
        odd = np.flatnonzero((symbols < 0) | (symbols >= len(self.piece_len)))
        if not len(odd):
            return symbols, counts
        size = np.ones(len(symbols), np.int64)
        texts = [(self.extra[s] if s >= 0 else chr(-2 - s)).encode() for s in symbols[odd].tolist()]
        size[odd] = [len(t) for t in texts]
        ids = np.repeat(symbols, size)
        ids[ranges((np.cumsum(size) - size)[odd], size[odd])] = self.byte_ids[np.frombuffer(b"".join(texts), np.uint8)]
        owner = np.repeat(np.arange(len(counts)), counts)
        return ids, np.bincount(owner, size, len(counts)).astype(np.int64)

    def _learn(self, words: list[str]) -> None:
        words = sorted(words, key=len)
        start = 0
        while start < len(words):
            if len(words[start]) > SHORT:
                groups, start = [[w] for w in words[start:]], len(words)
            else:  # of nearly equal length, so that little of the tables is empty
                most = max(8, len(words[start]) + 3)
                stop = start
                while stop < len(words) and len(words[stop]) <= most and stop - start < 65_536:
                    stop += 1
                groups, start = [words[start:stop]], stop
            for group in groups:
                if len(group[0]) > SHORT:
                    symbols = np.array(self._long(group[0]), np.int32)
                    counts = np.array([len(symbols)])
                else:
                    symbols, counts = self._short(group)
                ids, counts = self._ids(symbols, counts)
                n, base = len(self.held), self.at[len(self.held)]
                while base + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
                self.ids[base : base + len(ids)] = ids
                if n + len(group) + 1 > len(self.at):
                    self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(group)), np.int64)])
                self.at[n + 1 : n + 1 + len(group)] = base + np.cumsum(counts)
                self.held.update(zip(group, range(n, n + len(group)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, with begin and end."""
        parts = [self.part.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.held) > HELD or self.held_chars > HELD_CHARS:
            self._clear()
        new = set().union(*parts).difference(self.held)
        if new:
            self.held_chars += sum(map(len, new))
            self._learn(list(new))
        index = np.fromiter(map(self.held.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        lengths = self.at[index + 1] - self.at[index]
        flat = self.ids[ranges(self.at[index], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, parts)])]
        return [np.concatenate([[self.begin], flat[a:b], [self.end]]).astype("<u4") for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of each list of ids: one space is dropped from the front, unless the text begins with bytes."""
        flat = np.concatenate(ids).astype(np.int64) if ids else np.zeros(0, np.int64)
        lengths = self.piece_len[flat]
        raw = self.piece_bytes[ranges(self.piece_at[flat], lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum([0, *map(len, ids)])].tolist()
        out = []
        for row, a, b in zip(ids, ends[:-1], ends[1:], strict=True):
            first = next((i for i in row[:3].tolist() if i not in (self.begin, self.end)), None)
            out.append(raw[a + (1 if first is not None and self.space_first[first] else 0) : b])
        return out

    def check(self, texts: list[str], ids: list[np.ndarray], decoded: list[bytes]) -> None:
        """Raise if the library says otherwise for texts picked at random, up to CHECKED characters."""
        for i in picked(texts, CHECKED):
            t = texts[i]
            said = self.library.encode(t, add_bos=True, add_eos=True)
            if said != ids[i].tolist() or self.library.decode(said).encode() != decoded[i]:
                raise RuntimeError(f"the sentencepiece library gives other ids for {t[:80]!r}")


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, ids (packed little-endian unsigned 32-bit), decoded.

    ``model`` is the vocabulary file's path on every executor.
    """
    path = model or public_model()
    narrow = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))
    key = narrow.schema["k"].dataType

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for part, raw in slices(batches, 1):
            texts = [t.decode(errors="replace") for t in raw]
            ids = c.encode(texts)
            decoded = c.decode(ids)
            c.check(texts, ids, decoded)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(len, ids), pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                names=["k", "n_tokens", "ids", "decoded"],
            )

    made = narrow.mapInArrow(run, f"k {key.simpleString()}, n_tokens long, ids binary, decoded string")
    return made.withColumnRenamed("k", id_col)


def digests(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    def sha(c: Column) -> Column:
        return F.sha2(c, 256)

    return encoded.select(id_col, "n_tokens", sha(F.col("ids")).alias("ids_sha256"), sha(F.col("decoded").cast("binary")).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_pieces(documents(spark, sf_dir)))
