"""Token counts by a count-only Viterbi pass over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary matches that end at each
character, the earliest start first; dynamic programming keeps the best score and
the number of pieces up to each character, never the pieces.  A match replaces
what is held only if its score is greater, so of equal paths the one whose last
piece starts first stands, as in the ``tokenizers`` library's unigram model.  A
character without a piece costs the least score of the vocabulary less ten and
counts as its UTF-8 bytes.  A long part is one pass of the automaton, linear in it.

The text is cut before space marks, as that library's metaspace rule does, and
each distinct part is counted once per worker store.  In every slice of an Arrow
batch some texts, picked at random, are counted by the library too; a difference
stops the job.

Defined results: a null or empty text has no tokens and score 0; bytes that are
not UTF-8 count as U+FFFD; repeated rows
get equal results; an empty table gives an empty result.  Only the id and the
text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, picked, slices

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct parts, and characters in them, held by a worker; beyond either, the store begins anew.
HELD, HELD_CHARS = 300_000, 16 << 20
CHECKED = 16_384


class UnigramCounter:
    """vocabulary: (piece, score) in the order of ids; id 0 is the unknown piece; it has all byte pieces."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.unknown_bytes = len(vocabulary[0][0].encode())
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == 0))
        self.automaton.make_automaton()
        self.library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
        self.library.pre_tokenizer = pre_tokenizers.Metaspace(replacement=SPACE, prepend_scheme="always", split=True)
        self.part = re.compile(f"{SPACE}[^{SPACE}]*")
        self._clear()

    def _clear(self) -> None:
        self.held: dict[str, int] = {}
        self.held_chars = 0
        self.pieces = np.zeros(HELD, np.int64)
        self.scores = np.zeros(HELD, np.float64)

    def best(self, part: str) -> tuple[float, int]:
        """Score and number of pieces of the best path over one part.

        Unknown characters and the unknown piece itself, where they follow one
        another, are one unknown string, counted as its bytes; the unknown piece
        alone is one piece.  ``run`` says how the path to a character ends: 0 in a
        piece, 1 in an unknown string, 2 in the unknown piece alone.
        """
        n = len(part)
        score, pieces, run = [float("-inf")] * (n + 1), [0] * (n + 1), bytearray(n + 1)
        score[0] = 0.0
        unknown, more, at, single = self.unknown, self.unknown_bytes - 1, 0, False

        def pass_by(at: int) -> None:
            """The character at ``at`` as an unknown one."""
            if score[at] + unknown > score[at + 1]:
                score[at + 1], run[at + 1] = score[at] + unknown, 1
                pieces[at + 1] = pieces[at] + len(part[at].encode()) + (more if run[at] == 2 else 0)

        for end, (length, value, is_unknown) in self.automaton.iter(part):
            while at < end:  # characters whose matches are all seen
                if not single:
                    pass_by(at)
                at, single = at + 1, False
            start = end + 1 - length
            if score[start] + value > score[end + 1]:
                score[end + 1], pieces[end + 1], run[end + 1] = score[start] + value, pieces[start] + 1, 0
                if is_unknown:
                    run[end + 1] = 1 if run[start] else 2
                    pieces[end + 1] += more * run[start]
            if length == 1:
                single = True
        while at < n:
            if not single:
                pass_by(at)
            at, single = at + 1, False
        return score[n], pieces[n]

    def count(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces and best score of each text."""
        parts = []
        for t in texts:
            marked = t.replace(" ", SPACE)
            parts.append(self.part.findall(marked if marked.startswith(SPACE) else SPACE + marked) if t else [])
        if len(self.held) > HELD or self.held_chars > HELD_CHARS:
            self._clear()
        new = list(set().union(*parts).difference(self.held))
        if new:
            self.held_chars += sum(map(len, new))
            found = [self.best(p) for p in new]
            n = len(self.held)
            while n + len(new) > len(self.pieces):
                self.pieces, self.scores = np.concatenate([self.pieces, np.zeros_like(self.pieces)]), np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[n : n + len(new)] = [s for s, _ in found]
            self.pieces[n : n + len(new)] = [c for _, c in found]
            self.held.update(zip(new, range(n, n + len(new)), strict=True))
        index = np.fromiter(map(self.held.__getitem__, chain.from_iterable(parts)), np.int64, sum(map(len, parts)))
        owner = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        pieces = np.bincount(owner, self.pieces[index], len(texts)).astype(np.int64)
        return pieces, np.bincount(owner, self.scores[index], len(texts)).astype(np.float64)

    def check(self, texts: list[str], pieces: np.ndarray) -> None:
        for i in picked(texts, CHECKED):
            t = texts[i]
            if len(self.library.encode(t, add_special_tokens=False).ids) != pieces[i]:
                raise RuntimeError(f"the tokenizers library counts otherwise for {t[:80]!r}")


def vocabulary_of(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model file, read as a unigram vocabulary."""
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, p.score) for p in model.pieces]


@lru_cache(maxsize=2)
def counter(path: str) -> UnigramCounter:
    return UnigramCounter(vocabulary_of(path))


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """Per row: id, n_tokens, best_score.  ``model`` is the vocabulary file's path on every executor."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    narrow = df.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)
        for part, raw in slices(batches, 1):
            texts = [t.decode(errors="replace") for t in raw]
            pieces, scores = c.count(texts)
            c.check(texts, pieces)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pieces), pa.array(scores)], names=["k", "n_tokens", "best_score"])

    made = narrow.mapInArrow(run, f"k {narrow.schema['k'].dataType.simpleString()}, n_tokens long, best_score double")
    return made.withColumnRenamed("k", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
