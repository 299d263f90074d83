"""Token counts of a unigram vocabulary by a Viterbi search that keeps counts instead of pieces.

An Aho-Corasick automaton names the pieces that end at each character; for each place the best score of any path to it and that path's length are enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from cambium.llm.frames import in_arrow, unclashed, with_text
from cambium.llm.memory import Memory, kept

#: Fixed values of the tokenizer: the sign for a space, and what an unknown character scores under the worst piece.
SPACE, PENALTY = "▁", 10.0
#: Characters of a run up to which its result is remembered.
SHORT = 256


def vocabulary(path: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces that can match text, with scores, and whether unknown characters become bytes, of a sentencepiece model on the driver."""
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(own.get_piece_size())
    plain = [i for i in every if not (own.is_control(i) or own.is_unknown(i) or own.is_byte(i) or own.is_unused(i))]
    return [(own.id_to_piece(i), own.get_score(i)) for i in plain], any(map(own.is_byte, every))


class Counter:
    """Counts pieces of texts. pieces: (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], to_bytes: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown, self.to_bytes = min((s for _, s in pieces), default=0.0) - PENALTY, to_bytes
        self.single = {p for p, _ in pieces if len(p) == 1}
        # Where no piece reaches across, a text falls into runs that are counted alone: before a space after another character, and around characters of no piece.
        own = set("".join(p for p, _ in pieces))
        apart = "".join(c for c in "\n\t\r" if c not in own)
        self.runs = None if any(SPACE in p.lstrip(SPACE) for p, _ in pieces) else re.compile(f"{SPACE}*[^{SPACE}{apart}]+|{SPACE}+" + f"|[{apart}]" * bool(apart))
        self.known: Memory = Memory(self.best)

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path. Of equally good paths to a place the tokenizer keeps the one it meets first: that whose last piece begins first."""
        score, count = [0.0] + [None] * len(text), [0] * (len(text) + 1)
        found = self.automaton.iter(text) if len(self.automaton) else iter(())
        end, (n, own) = next(found, (-1, (0, 0.0)))
        single, unknown = self.single, self.unknown
        for i, c in enumerate(text):
            top, pieces = None, 0
            while end == i:  # the longest first
                at = i + 1 - n
                if top is None or score[at] + own > top:
                    top, pieces = score[at] + own, count[at] + 1
                end, (n, own) = next(found, (-1, (0, 0.0)))
            if c not in single and (top is None or score[i] + unknown > top):
                top, pieces = score[i] + unknown, count[i] + (len(c.encode()) if self.to_bytes else 1)
            score[i + 1], count[i + 1] = top, pieces
        return count[-1], score[-1]

    def count(self, text: str | None) -> tuple[int, float]:
        """As the tokenizer counts: a space is put before a text that isn't empty, spaces become their sign, nothing else is changed."""
        if not text:
            return 0, 0.0
        text = SPACE + text.replace(" ", SPACE)
        if self.runs is None:
            return self.best(text)
        runs = self.runs.findall(text)
        values = list(map(self.known.__getitem__, runs)) if max(map(len, runs)) <= SHORT else [self.known[r] if len(r) <= SHORT else self.best(r) for r in runs]
        counts, scores = zip(*values, strict=True)
        return sum(counts), sum(scores)


def _counted(batches: Iterator[pa.RecordBatch], sent: Broadcast, place: int, n: int) -> Iterator[pa.RecordBatch]:
    own: Counter = kept(("unigram", hash(tuple(sent.value[0])), sent.value[1]), lambda: Counter(*sent.value))
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            made = list(map(own.count, part.column(place).to_pylist()))
            yield pa.RecordBatch.from_arrays([*part.columns[:n], pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.float64())], names=[*part.schema.names[:n], "n_tokens", "score"])


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], to_bytes: bool, keep: list[str]) -> DataFrame:
    """The columns keep of docs, then n_tokens and score, the best path's sum of piece scores, of the whole text.

    Null and empty texts have 0 tokens and score 0. An unknown character is one token, or if to_bytes one for each byte of it. There is no shuffle; the vocabulary is
    sent to the executors. A column of keep called n_tokens or score is an error.
    """
    unclashed(keep, "n_tokens", "score")
    sent = docs.sparkSession.sparkContext.broadcast((pieces, to_bytes))
    rows, place, schema = with_text(docs, keep)
    return in_arrow(rows, lambda batches: _counted(batches, sent, place, len(keep)), f"{schema}, n_tokens long, score double")

