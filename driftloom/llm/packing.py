"""Best-fit packing by a grouping genetic algorithm on islands.

An individual is a set of bins.  Populations start from best fit in random orders.  Crossover injects
whole well-filled bins of one parent into the other, removes the bins there that share a
document with them, lets displaced documents take the place of one or two shorter ones
where they fill a bin better, and best-fits the rest, the longest first.  Mutation empties
some of the worst bins and does the same with what they held.  Fewer bins are fitter, then
uneven ones, so that free room gathers in few bins.

Spark deals the pieces to shards of about ``SHARD`` pieces, but of ``LEAST_BINS`` bins at least.  Each shard evolves on
``ISLANDS`` islands, every island in a task of its own, for ``EPOCHS`` epochs of
``GENERATIONS`` generations.  Between two epochs each island's elite migrates to the next
island of its shard.  Then the fullest bins of the best island, the part ``KEEP``, are final; what lies
in the other bins is dealt to new shards for the next round, until one shard holds it all.
The rounds are a logarithm of the shards, and no task sees more than a shard.
"""

from __future__ import annotations

import bisect
import os
import random
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.memory import release
from driftloom.plans.lineage import cut

SHARD, LEAST_BINS, ISLANDS = 1500, 64, 2
POPULATION, EPOCHS, GENERATIONS = 4, 3, 6
#: The part of a shard's bins that is final after a round.
KEEP = 0.75
#: Bins that displaced documents are tried in before a best fit, and the longest documents of each that they may replace.
TRIED, LONGEST = 32, 8
#: Distinct words remembered in a task; beyond that it starts afresh.
CACHE_ENTRIES = 1_000_000
#: Words of at most so many bytes are kept for a worker's later tasks, up to so many.
SHORT, SHORT_ENTRIES = 12, 600_000

Bins = list[tuple[int, list[int]]]


def best_fit(bins: Bins, items: list[int], lengths: list[int], capacity: int) -> Bins:
    """``bins`` with ``items`` put, in their order, where the least room stays; new bins are opened as needed."""
    bins = [(fill, list(held)) for fill, held in bins]
    room = sorted((capacity - fill, b) for b, (fill, _) in enumerate(bins))
    for i in items:
        at = bisect.bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, b = room.pop(at)
            fill, held = bins[b]
            held.append(i)
            bins[b] = (fill + lengths[i], held)
        else:
            left, b = capacity, len(bins)
            bins.append((lengths[i], [i]))
        bisect.insort(room, (left - lengths[i], b))
    return bins


def longest_first(items: Iterable[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def random_start(lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    """Best fit in a random order that prefers the longer to a random degree."""
    least = rng.uniform(0.2, 0.9)
    weight = [n * rng.uniform(least, 1) for n in lengths]
    return best_fit([], sorted(range(len(lengths)), key=lambda i: -weight[i]), lengths, capacity)


def exchange(bins: Bins, loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> tuple[Bins, list[int]]:
    """``bins`` and the loose items after some of these took the place of one or two shorter ones, which are loose then."""
    free = sorted((lengths[i], i) for i in loose)
    bins = list(bins)
    for b in rng.sample(range(len(bins)), min(TRIED, len(bins))):
        fill, held = bins[b]
        room = capacity - fill
        if not room or not free:
            continue
        some = longest_first(held, lengths)[:LONGEST]
        gain, best = 0, None
        for out in [(i,) for i in some] + list(combinations(some, 2)):
            size = sum(lengths[i] for i in out)
            at = bisect.bisect_right(free, (size + room, len(lengths))) - 1
            if at >= 0 and free[at][0] - size > gain:
                gain, best = free[at][0] - size, (at, out)
        if best:
            _, new = free.pop(best[0])
            for i in best[1]:
                bisect.insort(free, (lengths[i], i))
            bins[b] = (fill + gain, [i for i in held if i not in best[1]] + [new])
    return bins, [i for _, i in free]


def refit(bins: Bins, loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    bins, loose = exchange(bins, loose, lengths, capacity, rng)
    return best_fit(bins, longest_first(loose, lengths), lengths, capacity)


def fitness(bins: Bins, capacity: int) -> float:
    """Larger is better: few bins first, then uneven fills, which leave room that can be used."""
    return -len(bins) + sum((fill / capacity) ** 2 for fill, _ in bins) / (len(bins) + 1)


def crossover(into: Bins, of: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    ranked = sorted(of, key=lambda b: (-b[0], b[1]))
    injected = [b for b in ranked[: max(1, len(ranked) // 2)] if rng.random() < 0.6]
    taken = {i for _, held in injected for i in held}
    stay, displaced = [], []
    for fill, held in into:
        if taken.isdisjoint(held):
            stay.append((fill, held))
        else:
            displaced += [i for i in held if i not in taken]
    return refit(injected + stay, displaced, lengths, capacity, rng)


def mutate(bins: Bins, lengths: list[int], capacity: int, rng: random.Random) -> Bins:
    ranked = sorted(bins, key=lambda b: (-b[0], b[1]))
    worst = max(1, min(len(ranked) // 20 + 1, 8))
    out = ranked[-worst:] + rng.sample(ranked[:-worst], min(worst, len(ranked) - worst))
    gone = {id(b) for b in out}
    items = [i for _, held in out for i in held]
    return refit([b for b in ranked if id(b) not in gone], items, lengths, capacity, rng)


def evolve(lengths: list[int], seeds: list[Bins], capacity: int, rng: random.Random, generations: int = GENERATIONS) -> tuple[Bins, int]:
    """The best individual after ``generations`` generations, and the number of crossovers; without seeds from random orders."""
    population = list(seeds)
    while len(population) < POPULATION:
        population.append(mutate(population[0], lengths, capacity, rng) if seeds else random_start(lengths, capacity, rng))
    rank = lambda b: -fitness(b, capacity)
    population.sort(key=rank)
    crossovers = 0
    for _ in range(generations):
        a, b = rng.sample(population[: max(2, POPULATION // 2 + 1)], 2)
        children = [crossover(a, b, lengths, capacity, rng), mutate(crossover(b, a, lengths, capacity, rng), lengths, capacity, rng)]
        crossovers += 2
        population = sorted(population + children, key=rank)[:POPULATION]
    return population[0], crossovers


def _bins_of(genes: list[int], lengths: list[int]) -> Bins:
    bins: dict[int, tuple[int, list[int]]] = {}
    for i, g in enumerate(genes):
        fill, held = bins.get(g, (0, []))
        held.append(i)
        bins[g] = (fill + lengths[i], held)
    return list(bins.values())


def _epoch(capacity: int, epoch: int):
    """A grouped function over the rows (shard, island, origin, uid, length, gene) of one island."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("origin", "ascending"), ("uid", "ascending")])
        shard, island = table.column("shard")[0].as_py(), table.column("island")[0].as_py()
        origin = table.column("origin").to_numpy()
        uids, lengths = (table.column(c).to_numpy()[origin == 0] for c in ("uid", "length"))
        sizes = lengths.tolist()
        seeds = []
        if epoch:
            parents = table.column("gene").to_numpy()
            seeds = [_bins_of(parents[origin == o].tolist(), sizes) for o in np.unique(origin)]
        best, crossovers = evolve(sizes, seeds, capacity, random.Random(f"{shard} {island} {epoch}"))
        best.sort(key=lambda b: -b[0])  # the fullest is number 0
        gene, place = (np.zeros(len(sizes), np.int64) for _ in range(2))
        for b, (_, held) in enumerate(best):
            at = 0
            for i in held:
                gene[i], place[i] = b, at
                at += sizes[i]
        n = len(sizes)
        names = ["shard", "island", "uid", "length", "gene", "offset", "bins", "crossovers"]
        columns = [np.full(n, shard), np.full(n, island), uids, lengths, gene, place, np.full(n, len(best)), np.full(n, crossovers)]
        return pa.table([pa.array(np.asarray(c, np.int64)) for c in columns], names=names)

    return run


_PLACED = "shard long, island long, uid long, length long, gene long, offset long, bins long, crossovers long"


def evolved(dealt: DataFrame, shards: int, capacity: int) -> DataFrame:
    """(shard, island, uid, length, gene, offset, bins, crossovers): each island's elite after all epochs, for the rows (shard, uid, length)."""
    none = F.lit(0).cast("long")
    own = dealt.select("shard", F.explode(F.sequence(none, F.lit(ISLANDS - 1).cast("long"))).alias("island"), none.alias("origin"), "uid", "length", none.alias("gene"))
    for epoch in range(EPOCHS):
        if epoch:
            own = elites.select("shard", "island", none.alias("origin"), "uid", "length", "gene")
            own = own.unionByName(own.withColumns({"island": (F.col("island") + 1) % ISLANDS, "origin": none + 1}))
        # no more files than islands
        elites = cut(own.groupBy("shard", "island").applyInArrow(_epoch(capacity, epoch), _PLACED).coalesce(shards * ISLANDS))
    return elites


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """(uid, sequence_id, offset) for the rows (uid, length) of ``pieces``, uid unique and 1 <= length <= capacity.

    Sequences hold ``capacity`` at most and their pieces follow each other without gaps from offset 0.
    An empty table gives an empty table.
    """
    whole = pieces.where(F.col("length") == capacity).select("uid", (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, round_ = cut(pieces.where(F.col("length") < capacity).select("uid", "length")), 0
    while True:
        count, tokens = rest.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        shards = max(1, min(-(-count // SHARD), tokens // (LEAST_BINS * capacity)))
        placed = evolved(rest.withColumn("shard", F.pmod(F.xxhash64("uid", F.lit(round_)), F.lit(shards)).cast("long")), shards, capacity)
        best = placed.groupBy("shard").agg(F.min(F.struct("bins", "island")).alias("b")).select("shard", F.col("b.island").alias("island"))
        placed = placed.join(best, ["shard", "island"])
        sequence = ((F.lit(round_) * (1 << 31) + F.col("shard")) * (1 << 20) + F.col("gene")).alias("sequence_id")
        final = F.lit(shards == 1) | (F.col("gene") < F.floor(F.col("bins") * KEEP))
        whole = whole.unionByName(placed.where(final).select("uid", sequence, "offset"))
        if shards == 1:
            return whole
        rest, round_ = cut(placed.where(~final).select("uid", "length"), count), round_ + 1


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def _short_words(path: str) -> dict[bytes, bytes]:
    """What a worker keeps from task to task."""
    return {}


@cache
def _closing(path: str) -> np.ndarray:
    """Which ids end a word."""
    tokenizer = _tokenizer(path)
    closing = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), dtype=bool)
    closing[[i for token, i in tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
    return closing


class WordEncoder:
    """Ids of whole texts, word by word, for one task.

    The tokenizer drops white space and neither its normalizer nor its model looks across
    it, so the ids of a text are those of its runs without ASCII white
    space.  These repeat a lot and are remembered.
    """

    def __init__(self, path: str):
        self.path, self.tokenizer = path, _tokenizer(path)
        self.known = dict(_short_words(path))

    def close(self) -> None:
        """Hands short words on to the worker's next task."""
        short = _short_words(self.path)
        for word, ids in self.known.items():
            if len(short) >= SHORT_ENTRIES:
                break
            if len(word) <= SHORT:
                short[word] = ids
        self.known = {}

    def _learn(self, words: list[bytes]) -> None:
        """Encodes new words.  Words of letters alone are encoded many at a time, as each ends with one closing id."""
        letters, others = [], []
        for word in words:
            text = word.decode()
            (letters if text.isalpha() and text.lower().isalpha() else others).append(text)
        for at in range(0, len(letters), 512):
            part = letters[at : at + 512]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(_closing(self.path)[ids]) + 1
            if len(ends) != len(part):
                others += part
                continue
            packed, start = ids.tobytes(), 0
            for text, end in zip(part, (4 * ends).tolist(), strict=True):
                self.known[text.encode()] = packed[start:end]
                start = end
        for at in range(0, len(others), 1024):
            part = others[at : at + 1024]
            coded = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w.encode(), array("I", c.ids).tobytes()) for w, c in zip(part, coded, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers, without special tokens."""
        # lower case is the tokenizer's own, but for its special tokens, which begin with <|
        split = [(text.encode() if "<|" in text else text.encode().lower()).split() for text in texts]
        if len(self.known) > CACHE_ENTRIES:
            self.known = dict(_short_words(self.path))
        self._learn(list(set().union(*split).difference(self.known)))
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the tokenized documents, each closed by ``end_id``, cut at ``capacity``.

    Null or empty text is the end id alone.  Only documents of more than
    ``capacity`` ids are cut; the last piece may be shorter.
    """
    fields = [("doc_id", docs.schema[id_col].dataType)] + [("piece", T.IntegerType())] + [(c, T.LongType()) for c in ("start", "length", "ids_crc32")] + ([("ids", T.BinaryType())] if with_ids else [])
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[list] = [[] for _ in range(6)]
                for row, ids in enumerate(encoder.encode([text.as_py() or "" for text in part.column(1)])):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        for column, value in zip(rows, (row, k, start // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                            column.append(value)
                out = [part.column(0).take(pa.array(rows[0], pa.int64()))] + [pa.array(rows[1], pa.int32())] + [pa.array(c, pa.int64()) for c in rows[2:5]]
                yield pa.RecordBatch.from_arrays(out + ([pa.array(rows[5], pa.binary())] if with_ids else []), names=schema.names)
        encoder.close()
        release()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of all documents with ``sequence_id`` and ``offset``: a row a piece.

    Null ids stay null; rows that share an id are packed each by itself; repeated and
    very long texts are packed whole.  Null or empty text is one piece of length 1.
    Other columns aren't read.  An empty table gives an empty table.
    """
    own = cut(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids)).withColumn("uid", F.monotonically_increasing_id())
    return own.join(pack(own.select("uid", "length"), capacity), "uid").drop("uid")
