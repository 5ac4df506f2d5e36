"""Token ids in files of wavelet matrices.

``write_shards`` tokenizes documents in the order of their ids and writes shards: runs of whole
documents of about ``SHARD`` ids.  A shard is one compressed file image with everything that access to its ids needs:
the documents' ids and starts, the alphabet (the distinct ids, so that a symbol takes as few bits as the shard's
own vocabulary asks for), and for each bit of a symbol, from the highest, a bit-plane
with a rank directory.  A plane keeps the order of the plane above but for zeros before ones, which
is what makes rank and select on planes enough to read an id, to count an id in a range, and to find the places of an id.

Images travel as values of a Parquet column, since executors share no other folder
than the one that Spark writes to; ``Shard.from_bytes`` reads one wherever it comes from.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.memory import release
from driftloom.llm.packing import WordEncoder

#: A shard is closed once it has so many ids; only its last document can make it longer.
SHARD = 1 << 21
#: Bits that an entry of the rank directory stands for, and words of 64 bits.
BLOCK = 512
_WORDS = BLOCK // 64
_MAGIC = b"WVM1"
_HEAD = struct.Struct("<4sQQIB")


class Plane:
    """Bits with rank and select: words of 64 bits and the number of ones before each block."""

    def __init__(self, words: np.ndarray, ones: np.ndarray, n: int):
        self.words, self.ones, self.n = words, ones, n

    @classmethod
    def of(cls, bits: np.ndarray) -> Plane:
        packed = np.zeros(-(-max(len(bits), 1) // BLOCK) * BLOCK // 8, dtype=np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        words = packed.view("<u8")
        ones = np.zeros(len(words) // _WORDS + 1, dtype="<u4")
        np.cumsum(np.bitwise_count(words).reshape(-1, _WORDS).sum(axis=1), out=ones[1:])
        return cls(words, ones, len(bits))

    @property
    def zeros(self) -> int:
        return self.n - int(self.ones[-1])

    def bits(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place, 0 <= place <= n."""
        block = at >> 9
        inside = np.minimum(block, len(self.ones) - 2)
        left = (at - (inside << 9))[:, None] - 64 * np.arange(_WORDS)
        words = self.words[inside[:, None] * _WORDS + np.arange(_WORDS)]
        # the bits of a word that lie before the place
        part = np.where(left >= 64, words, words & ((np.uint64(1) << np.clip(left, 0, 63).astype(np.uint64)) - np.uint64(1)))
        return self.ones[inside].astype(np.int64) + np.bitwise_count(part).astype(np.int64).sum(axis=1)

    def select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """Places of the ones, or zeros, with the numbers ``k`` from 0; each must be there."""
        before = self.ones.astype(np.int64) if one else BLOCK * np.arange(len(self.ones)) - self.ones
        block = np.searchsorted(before, k, side="right") - 1
        words = self.words[block[:, None] * _WORDS + np.arange(_WORDS)]
        if not one:
            words = ~words
        upto = np.cumsum(np.bitwise_count(words).astype(np.int64), axis=1)
        k = k - before[block]
        word = (upto <= k[:, None]).sum(axis=1)
        row = np.arange(len(k))
        k = k - np.where(word > 0, upto[row, word - 1], 0)
        bits = (words[row, word][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
        return BLOCK * block + 64 * word + (np.cumsum(bits, axis=1) <= k[:, None].astype(np.uint64)).sum(axis=1)


class Shard:
    """The ids of some documents, one after the other, as a wavelet matrix.  Places count from the shard's first id."""

    def __init__(self, doc_ids: pa.Array, starts: np.ndarray, alphabet: np.ndarray, planes: list[Plane]):
        self.doc_ids, self.starts, self.alphabet, self.planes = doc_ids, starts, alphabet, planes

    @classmethod
    def of(cls, doc_ids: pa.Array, ids: list[np.ndarray]) -> Shard:
        """One array of ids for each of ``doc_ids``."""
        starts = np.zeros(len(ids) + 1, dtype="<i8")
        np.cumsum([len(x) for x in ids], out=starts[1:])
        flat = np.concatenate([np.zeros(0, np.uint32), *ids])
        seen = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
        seen[flat] = True
        alphabet = np.flatnonzero(seen).astype("<u4")
        number = np.zeros(len(seen), dtype=np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        number[alphabet] = np.arange(len(alphabet))
        symbols, planes = number[flat], []
        for shift in range(max(len(alphabet) - 1, 0).bit_length() - 1, -1, -1):
            bit = (symbols >> symbols.dtype.type(shift)) & symbols.dtype.type(1) == 1
            planes.append(Plane.of(bit))
            symbols = np.concatenate([symbols.take(np.flatnonzero(~bit)), symbols.take(np.flatnonzero(bit))])
        return cls(doc_ids, starts, alphabet, planes)

    @property
    def n(self) -> int:
        return int(self.starts[-1])

    def to_bytes(self) -> bytes:
        pack = zstandard.ZstdCompressor(level=1).compress
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([self.doc_ids], names=["doc_id"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        parts = [pack(sink.getvalue().to_pybytes()), pack(self.starts.tobytes()), pack(self.alphabet.tobytes())]
        parts += [pack(x.tobytes()) for plane in self.planes for x in (plane.ones, plane.words)]
        sizes = np.array([len(p) for p in parts], dtype="<u8").tobytes()
        return b"".join([_HEAD.pack(_MAGIC, self.n, len(self.doc_ids), len(self.alphabet), len(self.planes)), sizes, *parts])

    @classmethod
    def from_bytes(cls, data: bytes | memoryview) -> Shard:
        magic, n, _, _, planes = _HEAD.unpack_from(data)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        count = 3 + 2 * planes
        sizes = np.frombuffer(data, "<u8", count, _HEAD.size)
        ends = np.cumsum(sizes) + np.uint64(_HEAD.size + 8 * count)
        unpack = zstandard.ZstdDecompressor().decompress
        part = [unpack(data[int(end - size) : int(end)]) for end, size in zip(ends, sizes, strict=True)]
        doc_ids = pa.ipc.open_stream(part[0]).read_all().column(0).combine_chunks()
        held = [Plane(np.frombuffer(part[i + 1], "<u8"), np.frombuffer(part[i], "<u4"), n) for i in range(3, count, 2)]
        return cls(doc_ids, np.frombuffer(part[1], "<i8"), np.frombuffer(part[2], "<u4"), held)

    def decode(self) -> np.ndarray:
        """All ids: every plane puts the order of the one below it back."""
        symbols = np.zeros(self.n, dtype=np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for shift, plane in enumerate(reversed(self.planes)):
            bit, above = plane.bits(), np.empty_like(symbols)
            above[np.flatnonzero(~bit)] = symbols[: plane.zeros]
            above[np.flatnonzero(bit)] = symbols[plane.zeros :] | symbols.dtype.type(1 << shift)
            symbols = above
        return self.alphabet[symbols] if self.n else np.zeros(0, "<u4")

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at some places, by a rank a plane."""
        at, symbol = np.asarray(at, dtype=np.int64), np.zeros(len(at), dtype=np.int64)
        for plane in self.planes:
            bit, ones = plane.get(at), plane.rank(at)
            symbol = symbol << 1 | bit
            at = np.where(bit, plane.zeros + ones, at - ones)
        return self.alphabet[symbol]

    @cached_property
    def _symbols(self) -> dict[int, int]:
        return {int(token): k for k, token in enumerate(self.alphabet)}

    def _narrowed(self, token: int, low: int, high: int) -> tuple[int, int]:
        """Where the places of ``token`` in [low, high) are under the last plane."""
        symbol = self._symbols.get(int(token))
        if symbol is None or low >= high:
            return 0, 0
        ends = np.array([low, high], dtype=np.int64)
        for k, plane in enumerate(self.planes):
            ones = plane.rank(ends)
            ends = plane.zeros + ones if symbol >> (len(self.planes) - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often ``token`` is there in [low, high)."""
        low, high = self._narrowed(token, low, self.n if high is None else high)
        return high - low

    def places(self, token: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Where ``token`` is in [low, high), ascending: a select a plane, from the last up."""
        at = np.arange(*self._narrowed(token, low, self.n if high is None else high))
        if not len(at):
            return at
        symbol = self._symbols[int(token)]
        for k, plane in reversed(list(enumerate(self.planes))):
            one = bool(symbol >> (len(self.planes) - 1 - k) & 1)
            at = plane.select(at - plane.zeros if one else at, one)
        return at


_SHARDS = "part int, shard int, before long, n_tokens long, n_docs long, data binary"


def write_shards(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Tokenizes whole texts, closes each with ``end_id`` and writes shards in ascending order of the documents' ids to ``folder``.

    - Null or empty text is the end id alone.  A very long text is one document of one shard.
    - Null ids come first; rows that share an id follow each other, in an order of their texts that a repeated run keeps.
    - Other columns aren't read.  An empty table makes files without a shard.

    Documents are dealt by ranges of their ids, and a range may hold several shards: (``part``, ``shard``) order them, and
    ``before`` has the ids of the same range before a shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before = TaskContext.get().partitionId(), 0, 0
        encoder, end = WordEncoder(path), np.array([end_id], dtype="<u4").tobytes()
        doc_ids: list[pa.Array] = []
        held: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            made = Shard.of(pa.concat_arrays(doc_ids), held)
            row = [part, shard, before, made.n, len(held), made.to_bytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        names = [c.split()[0] for c in _SHARDS.split(", ")]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                doc_ids.append(some.column(0).cast(pa.int64()))
                held += [np.frombuffer(ids + end, "<u4") for ids in encoder.encode([t.as_py() or "" for t in some.column(1)])]
                size = size + sum(map(len, held[-some.num_rows :]))
                if size >= SHARD:
                    yield image()
                    shard, before, size = shard + 1, before + size, 0
                    doc_ids.clear(), held.clear()
        if held:
            yield image()
        encoder.close()
        release()

    # rows of one id, and equal ones, are dealt to ranges too
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange("id", "tie", "row").sortWithinPartitions("id", "tie", "row")
    ranged.select("id", "text").mapInArrow(run, _SHARDS).write.option("parquet.block.size", 32 << 20).parquet(folder)


def _shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of ``folder`` with ``base``, all ids before the shard.  One row a range of documents meets in one task and is broadcast."""
    shards = spark.read.parquet(folder)
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", base.alias("base"))
    return shards.join(F.broadcast(parts), "part").withColumn("base", F.col("base") + F.col("before")).drop("before")


def documents(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]): all documents read back from the shards in ``folder``.

    ``start`` counts the ids of all documents before; ``ids`` are little-endian unsigned 32-bit integers.
    """
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0), batch.column(1), strict=True):
                shard = Shard.from_bytes(memoryview(data.as_buffer()))
                ids, starts = shard.decode().astype("<u4", copy=False), shard.starts
                parts = [ids[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)] if with_ids else []
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
                out = [shard.doc_ids, pa.array(base.as_py() + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(out + [pa.array(parts, pa.binary())] * with_ids, names=names)
        release()

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return _shards(spark, folder).select("base", "data").mapInArrow(run, schema)


def count_ids(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, n): how often each of a few ``tokens`` is in all documents, 0 included."""
    wanted = list(dict.fromkeys(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), dtype=np.int64)
        for batch in batches:
            for data in batch.column(0):
                shard = Shard.from_bytes(memoryview(data.as_buffer()))
                total += [shard.count(token) for token in wanted]
        yield pa.RecordBatch.from_arrays([pa.array(wanted, pa.int64()), pa.array(total)], names=["token", "n"])

    none = spark.createDataFrame([(token, 0) for token in wanted], "token long, n long")
    found = spark.read.parquet(folder).select("data").mapInArrow(run, "token long, n long")
    return none.unionByName(found).groupBy("token").agg(F.sum("n").alias("n"))


def find_ids(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """(token, doc_id, offset): every place of a few ``tokens``, counted from the start of its document."""
    wanted = list(dict.fromkeys(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard.from_bytes(memoryview(data.as_buffer()))
                for token in wanted:
                    at = shard.places(token)
                    doc = np.searchsorted(shard.starts, at, side="right") - 1
                    out = [pa.array(np.full(len(at), token, np.int64)), shard.doc_ids.take(pa.array(doc)), pa.array(at - shard.starts[doc])]
                    yield pa.RecordBatch.from_arrays(out, names=["token", "doc_id", "offset"])

    return spark.read.parquet(folder).select("data").mapInArrow(run, "token long, doc_id long, offset long")


def ids_at(places: DataFrame, folder: str) -> DataFrame:
    """(doc_id, offset, token) for the distinct rows (doc_id, offset) of ``places`` that lie inside their document; only their shards are opened.

    Where documents share an id, each of them answers.
    """
    spark = places.sparkSession
    shards = spark.read.parquet(folder)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(batch.column(k) for k in range(3)), strict=True):
                shard = Shard.from_bytes(memoryview(data.as_buffer()))
                n = len(shard.doc_ids)
                fixed = [pa.array(np.full(n, v.as_py(), np.int32)) for v in (part, number)]
                yield pa.RecordBatch.from_arrays([*fixed, shard.doc_ids, pa.array(shard.starts[:-1]), pa.array(np.diff(shard.starts))], names=["part", "shard", "doc_id", "start", "n"])

    def read(key: tuple, wanted: pa.Table, image: pa.Table) -> pa.Table:
        shard = Shard.from_bytes(image.column("data")[0].as_py())
        at = wanted.column("start").to_numpy() + wanted.column("offset").to_numpy()
        return pa.table([wanted.column("doc_id"), wanted.column("offset"), pa.array(shard.access(at).astype(np.int64))], names=["doc_id", "offset", "token"])

    own = places.select(F.col("doc_id").cast("long"), F.col("offset").cast("long")).where("doc_id IS NOT NULL AND offset >= 0").distinct()
    index = shards.select("part", "shard", "data").mapInArrow(listed, "part int, shard int, doc_id long, start long, n long")
    wanted = own.join(index, "doc_id").where("offset < n").select("part", "shard", "doc_id", "offset", "start")
    opened = shards.select("part", "shard", "data").join(wanted.select("part", "shard").distinct(), ["part", "shard"], "left_semi")
    return wanted.groupBy("part", "shard").cogroup(opened.groupBy("part", "shard")).applyInArrow(read, "doc_id long, offset long, token long")
