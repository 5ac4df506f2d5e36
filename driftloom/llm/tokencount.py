"""Token counts by a count-only Viterbi search over a unigram vocabulary.

Aho-Corasick enumerates the vocabulary's pieces in a segment; dynamic
programming over the segment's positions carries the best score and the number
of tokens on the best path, never the path itself.

Tie rules are those of the ``tokenizers`` library's Unigram model: positions are
left to right, the pieces that start at one position by increasing length, and a
later candidate must be strictly better.  A character that no single-character
piece covers is an unknown one, scored ten below the worst piece.  A run of unknown ones is one
unknown token, or their bytes where the vocabulary has a piece for each byte.

Where no piece has the space mark after another character and the mark itself is a
piece, no token reaches over the start of a run of marks, and the best path of a text is
the best paths of its segments, cut there.  Segments repeat a lot and are remembered.
Scores are added up in double precision, from the start of the text, as the library does.  A decision
inside a segment depends on what was added before only if two candidates lie within the rounding
of such sums.  Whole-number scores leave none.  With others, a segment that holds a
decision by less than ``CLOSE`` is searched anew each time, from the exact score of
all before it.  Other vocabularies are searched text by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftloom.llm.names import map_in_arrow, with_outputs

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Distinct segments remembered by a worker; beyond that it starts afresh.
CACHE_ENTRIES = 300_000
#: Segments longer than this many characters aren't remembered.
CACHE_CHARS = 64
#: Scores this close may change places by rounding: far above that of sums of up to 2**33.
CLOSE = 1e-5


class Counter:
    """Counts the tokens of texts under one vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]]):
        if not pieces:
            raise ValueError("the vocabulary has no pieces")
        self.automaton = ahocorasick.Automaton()
        self.floor = min(score for _, score in pieces) - UNKNOWN_PENALTY
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        names = {piece for piece, _ in pieces}
        self.by_bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.exact = all(score == int(score) for _, score in pieces)
        apart = MARK in names and not any(regex.search(f"[^{MARK}]{MARK}", piece) for piece in names)
        self.segments = regex.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall if apart else lambda text: [text]
        # (tokens, scores of the path's tokens), or no scores where they don't matter; tokens are negative where decisions are close
        self.known: dict[str, tuple[int, tuple[float, ...]]] = {}

    def search(self, segment: str, base: float = 0.0) -> tuple[int, float, float, list[int]]:
        """(tokens, score with ``base``, smallest margin of a decision, where each token of the path starts by its end)."""
        n = len(segment)
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(segment):
            starts[end + 1 - length].append((end + 1, score))
        best: list[float | None] = [None] * (n + 1)
        count, unknown, came = [0] * (n + 1), [False] * (n + 1), [0] * (n + 1)
        best[0], margin = base, float("inf")
        for i in range(n):
            here, single = best[i], False
            options = sorted(starts[i])
            if not options or options[0][0] != i + 1:
                options.insert(0, (i + 1, None))
            for end, score in options:
                total = here + (self.floor if score is None else score)
                if (before := best[end]) is not None:
                    margin = min(margin, abs(total - before))
                    if total <= before:
                        continue
                best[end], came[end], unknown[end] = total, i, score is None
                if score is not None:
                    count[end] = count[i] + 1
                elif self.by_bytes:
                    count[end] = count[i] + len(segment[i].encode())
                else:
                    count[end] = count[i] + (not unknown[i])
        return count[n], best[n], margin, came

    def _path_scores(self, segment: str, came: list[int]) -> tuple[float, ...]:
        out, end = [], len(segment)
        while end:
            out.append(self.automaton.get(segment[came[end] : end], (0, self.floor))[1])
            end = came[end]
        return tuple(reversed(out))

    def _remember(self, segment: str) -> tuple[int, tuple[float, ...]]:
        tokens, _, margin, came = self.search(segment)
        found = (tokens, ()) if self.exact else (-tokens if margin < CLOSE else tokens, self._path_scores(segment, came))
        if len(segment) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[segment] = found
        return found

    def count(self, text: str) -> int:
        """Tokens of a whole text: a mark goes before it and in place of each space."""
        if not text:
            return 0
        parts = self.segments(MARK + text.replace(" ", MARK))
        get, remember = self.known.get, self._remember
        if self.exact or len(parts) == 1:
            return sum([abs((get(s) or remember(s))[0]) for s in parts])
        total, base, waiting = 0, 0.0, []
        for s in parts:
            tokens, scores = get(s) or remember(s)
            if tokens < 0:  # close: from the exact score of all before
                for earlier in waiting:
                    for score in earlier:
                        base += score
                waiting = []
                tokens, base, _, _ = self.search(s, base)
            else:
                waiting.append(scores)
            total += tokens
        return total


@cache
def counter(path: str) -> Counter:
    """One counter for each worker process, from the pieces and scores of a sentencepiece model file."""
    return Counter(read_pieces(path))


def read_pieces(path: str) -> list[tuple[str, float]]:
    """The (piece, score) list of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", count_col: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text.

    Null or empty text has 0 tokens.  Texts of any length are counted whole; a
    segment of n characters costs O(n) beyond its matches.  A column named like the
    output is replaced, other columns stay; an empty table gives an empty table.
    ``path`` is the model file, which every worker has at that place.
    """
    schema = with_outputs(df, T.StructField(count_col, T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            counts = [own.count(text.as_py() or "") for text in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in schema.names[:-1]] + [pa.array(counts, pa.int64())], names=schema.names)

    return map_in_arrow(df, run, schema)
