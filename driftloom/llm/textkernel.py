"""Vectorised word hashing over Arrow string buffers, shared by the shingle and n-gram operators.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text
with ``A-Z`` lower-cased.  Everything works on whole texts; a batch is cut into
slices of about ``SLICE_BYTES`` only between texts, so memory follows the
longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C55)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Separators for words without ASCII punctuation.
PUNCTUATED = _SPACE.copy()
PUNCTUATED[[c for c in range(33, 127) if not chr(c).isalnum()]] = True

_powers = np.ones(1, dtype=np.uint64)
_inverse = np.ones(1, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that close inputs get unrelated values."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SLICE_BYTES + 1)
        _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE))))
        _inverse = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE_INV))))


def slices(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets into them) of runs of rows; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, end, raw[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the end) for one slice."""
    words, _, first = word_and_stem_hashes(raw, offsets, _SPACE, ())
    return words, first


def word_and_stem_hashes(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray, stems: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """As ``word_hashes`` for any separators, and for each length in ``stems`` the hashes of the words' first bytes."""
    n = len(raw)
    low = _LOWER[raw]
    inside = ~separators[raw]
    begins = inside.copy()
    ends = inside.copy()
    cuts = offsets[(offsets > 0) & (offsets < n)]
    if n:
        before, after = inside[:-1].copy(), inside[1:].copy()
        before[cuts - 1] = False
        after[cuts - 1] = False
        begins[1:] &= ~before
        ends[:-1] &= ~after
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    _grow(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers[:n], out=total[1:])

    def hashed(end: np.ndarray) -> np.ndarray:
        return mix64((total[end] - total[start]) * _inverse[start] + (end - start).astype(np.uint64) * _M2)

    return hashed(stop), [hashed(np.minimum(start + k, stop)) for k in stems], np.searchsorted(start, offsets)


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of ``width`` words of one text, repeats included; all words as one if there are fewer."""
    if not len(words):
        return words
    width = min(width, len(words))
    total = words[: len(words) - width + 1].copy()
    for k in range(1, width):
        total = total * _BASE + words[k : len(words) - width + 1 + k]
    return mix64(total + np.uint64(width))
