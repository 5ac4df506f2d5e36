"""Byte-level BPE encoding and decoding.

Each match of the splitting pattern is encoded by itself.  A segment tree over
its byte positions stores, for every span, the leftmost position whose pair
(the live token starting there and its live right neighbour) has the smallest
rank.  A merge takes the root's position, joins it with its neighbour, and
updates two or three leaves; so a match of n bytes costs O(n log n) however
long it is.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from driftloom.llm.names import map_in_arrow, with_outputs

#: Distinct matches remembered by a worker; beyond that it starts afresh.
CACHE_ENTRIES = 300_000
#: Matches longer than this many characters aren't remembered.
CACHE_CHARS = 64
_NO_RANK = 1 << 40


def merge_ranks(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of ``piece``: always merge the leftmost pair of the smallest rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    # a value is rank * n + position, so the minimum is the smallest rank, leftmost
    tree = [_NO_RANK * n] * (2 * size)
    for i in range(n - 1):
        if (r := ranks.get(piece[i : i + 2])) is not None:
            tree[size + i] = r * n + i
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b
    end = list(range(1, n + 1))  # of the live token that starts here
    left = list(range(-1, n - 1))  # start of the live token before

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            other = tree[k ^ 1]
            k >>= 1
            low = value if value < other else other
            if tree[k] == low:
                return
            tree[k] = value = low

    none = _NO_RANK * n
    while tree[1] < none:
        i = tree[1] % n
        j = end[i]
        stop = end[i] = end[j]
        put(j, none) if j < n - 1 else None
        if stop < n:
            left[stop] = i
            r = ranks.get(piece[i : end[stop]])
            put(i, none if r is None else r * n + i)
        else:
            put(i, none)
        if (h := left[i]) >= 0:
            r = ranks.get(piece[h:stop])
            put(h, none if r is None else r * n + h)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.tokens = pa.array(tokens, pa.large_binary())

    def _packed(self, word: str) -> bytes:
        piece = word.encode()
        rank = self.ranks.get(piece)
        ids = array("I", [rank] if rank is not None else merge_ranks(piece, self.ranks)).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get, packed = self.known.get, self._packed
        return b"".join([get(w) or packed(w) for w in self.split(text)])

    def decode(self, ids: bytes) -> bytes | None:
        """The bytes of ids, or None where these aren't ids of the vocabulary, four bytes each."""
        if len(ids) % 4:
            return None
        numbers = np.frombuffer(ids, dtype="<u4")
        if not len(numbers):
            return b""
        if numbers.max() >= len(self.lengths) or not self.lengths[numbers].all():
            return None
        found = self.tokens.take(pa.array(numbers))
        _, offsets, data = found.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[found.offset : found.offset + len(found) + 1]
        return data[int(at[0]) : int(at[-1])].to_pybytes()


@cache
def coder(path: str, pattern: str) -> Coder:
    """One coder for each worker process."""
    return Coder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the ids of its whole texts as binary, four little-endian bytes an id.

    Null or empty text has no ids (empty binary).  Texts of any length are
    encoded whole, repeated rows alike.  A column named as an output is
    replaced, other columns stay.  An empty table gives an empty table.
    ``decoded_col`` also adds what ``decode`` gives for the ids, in the same pass.
    ``path`` is the rank file, which every worker has at that place.
    """
    fields = [T.StructField(ids_col, T.BinaryType())] + ([T.StructField(decoded_col, T.BinaryType())] if decoded_col else [])
    schema = with_outputs(df, *fields)
    keep = [f.name for f in schema.fields[: -len(fields)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids = [own.encode(text.as_py() or "") for text in part.column(text_col)]
                out = [part.column(name) for name in keep] + [pa.array(ids, pa.binary())]
                if decoded_col:
                    out.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return map_in_arrow(df, run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids of ``ids_col`` stand for.

    Null or empty ids give empty bytes; what isn't ids of the vocabulary, four bytes each, gives null.  Repeated rows are decoded
    alike, ids of any length whole.  A column named like the output is replaced, other columns stay; an empty
    table gives an empty table.
    """
    schema = with_outputs(df, T.StructField(decoded_col, T.BinaryType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        for batch in batches:
            decoded = [own.decode(ids.as_py() or b"") for ids in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in schema.names[:-1]] + [pa.array(decoded, pa.binary())], names=schema.names)

    return map_in_arrow(df, run, schema)
