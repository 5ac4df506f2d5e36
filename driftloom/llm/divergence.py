"""How the sources of a language differ in their words: an audit by pairs of sources and by terms.

1. Tasks count terms a (language, source) group and documents with them; Spark adds these up.  A language keeps
   the terms of at least ``MIN_DOCS`` of its documents.
2. Kept terms are dealt by hash to chunks of about ``CHUNK``, and the counts of a group in a chunk are packed as
   one vector of places and counts.
3. Pairs of groups are tiled in two dimensions: the groups of a language fall into blocks of ``BLOCK``, and a task has a pair
   of blocks and a stripe of ``STRIPE`` chunks.  Vectors are copied to the tasks of their block.  A task works its
   chunks off one after the other, holding the vectors of one, and adds up the submatrix of its
   pairs.  Terms that no group of the task has in a chunk all add the same, so that only present ones are laid out.

Shares are whole numbers, ``1 + floor(SCALE * (count + 1) / (total + kept terms))``, and so are squared
differences; nothing is rounded.  Sums fit 64 bits for fewer than two billion kept terms, and totals
may go up to 9 * 10^15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.llm.memory import release
from driftloom.llm.skew import join_counted
from driftloom.operators.numbering import row_numbers
from driftloom.plans.lineage import cut

MIN_DOCS = 3
SCALE = 1_000_000_000
#: Terms in a chunk more or less, groups in a block, chunks in a stripe.
CHUNK, BLOCK, STRIPE = 1 << 14, 16, 64
#: Counts that a task holds before it hands them on, and bytes of a text that it splits at a time.
ENTRIES, SLICE = 400_000, 1 << 20

#: Bytes of terms as they are, but for A-Z in lower case; all others become spaces.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _slices(text: bytes, size: int) -> Iterator[list[bytes]]:
    """The terms of one text, ``size`` bytes or little more at a time, cut only between terms."""
    text, at = text.translate(_TERM_BYTES), 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, a null term for each group; null columns are read as ''."""
    most, size = ENTRIES, SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in groups.items():
                terms = [None, *n]
                names = [pa.array([v], pa.string()).dictionary_encode().take(pa.array(np.zeros(len(terms), np.int32))).cast(pa.string()) for v in (lang, source)]
                values = [pa.array(terms, pa.binary()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64())]
                yield pa.RecordBatch.from_arrays(names + values, names=["lang", "source", "term", "n", "docs"])
            groups.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
                n, docs = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in _slices(text.as_py(), size):
                    n.update(terms)
                    seen.update(terms)
                docs.update(seen)
            if sum(1 + len(n) for n, _ in groups.values()) >= most:
                yield from flush()
        yield from flush()
        release()

    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + terms))`` in 64 bits, three digits at a time."""
    base = total + terms
    div = lambda a, b: F.call_function("div", a, b)
    out, rest = div(count + 1, base), (count + 1) % base
    for _ in range(3):
        out, rest = out * 1000 + div(rest * 1000, base), rest * 1000 % base
    return out + 1


def _shares(counts: np.ndarray, totals: np.ndarray, terms: int) -> np.ndarray:
    """``share`` of arrays: a row of counts for each total."""
    base = (totals + terms)[:, None]
    out, rest = np.divmod(counts + 1, base)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, base)
        out = out * 1000 + more
    return out + 1


class _Tile:
    """The submatrix of one pair of blocks over one stripe."""

    def __init__(self, key: tuple, size: int):
        self.lang, self.a, self.b, self.stripe = key
        self.size = size
        self.sources: list[str] = []
        self.groups: list[int] = []
        self.totals: list[int] = []
        self.kept = 0
        self.sums: np.ndarray | None = None
        self.chunk, self.held = -1, []

    def group(self, group: int, source: str, total: int, kept: int) -> None:
        self.groups.append(group), self.sources.append(source), self.totals.append(total)
        self.kept = kept

    def _start(self) -> None:
        """The rows and columns of the submatrix, and what a term adds that nobody has."""
        block = np.array(self.groups) // self.size
        self.at = {g: k for k, g in enumerate(self.groups)}
        self.sides = np.flatnonzero(block == self.a), np.flatnonzero(block == self.b)
        self.total = np.array(self.totals, dtype=np.int64)
        shape = (2, len(self.sides[0]), len(self.sides[1]))
        self.absent = self._pairs(_shares(np.zeros((len(self.groups), 1), np.int64), self.total, self.kept)) if self.kept else np.zeros(shape, np.int64)
        # all kept terms are taken for absent once, in the first stripe
        self.sums = self.absent * (self.kept if self.stripe == 0 else 0)

    def _pairs(self, p: np.ndarray) -> np.ndarray:
        """The sums of floor((p - q)^2 / q) over the columns: p of the first side and q of the second, and the other way round."""
        own, other = p[self.sides[0]], p[self.sides[1]]
        out = np.zeros((2, len(own), len(other)), dtype=np.int64)
        for i, row in enumerate(own):
            square = (row - other) ** 2
            out[0, i] = (square // other).sum(axis=1)
            if self.a != self.b:
                out[1, i] = (square // row).sum(axis=1)
        return out

    def _close(self) -> None:
        if self.sums is None:
            self._start()
        if self.held:
            places = np.unique(np.concatenate([at for _, at, _ in self.held]))
            counts = np.zeros((len(self.groups), len(places)), dtype=np.int64)
            for group, at, n in self.held:
                counts[self.at[group], np.searchsorted(places, at)] = n
            self.sums = self.sums + self._pairs(_shares(counts, self.total, self.kept)) - self.absent * len(places)
        self.held = []

    def vector(self, chunk: int, group: int, at: np.ndarray, n: np.ndarray) -> None:
        if chunk != self.chunk:
            self._close()
            self.chunk = chunk
        self.held.append((group, at, n))

    def result(self) -> pa.RecordBatch:
        self._close()
        names, (own, other) = np.array(self.sources, dtype=object), self.sides
        left, right = np.repeat(own, len(other)), np.tile(other, len(own))
        apart = left != right
        ends = [(left[apart], right[apart], self.sums[0].ravel()[apart])]
        if self.a != self.b:
            ends.append((right, left, self.sums[1].ravel()))
        rows = [np.concatenate(x) for x in zip(*ends, strict=True)]
        arrays = [pa.array([self.lang] * len(rows[0]), pa.string()), pa.array(names[rows[0]], pa.string()), pa.array(names[rows[1]], pa.string()), pa.array(rows[2])]
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "item", "value"])


def _tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Submatrices, with blocks of ``size``, of rows ordered by tile and chunk; those of chunk -1 name the groups of a tile."""
    tile, last = None, None
    for batch in batches:
        lang, a, b, stripe, chunk, group, source, total, kept, at, n = (batch.column(k) for k in range(11))
        keys = list(zip(lang.to_pylist(), *(c.to_pylist() for c in (a, b, stripe)), strict=True))
        for i, key in enumerate(keys):
            if key != last:
                if tile:
                    yield tile.result()
                tile, last = _Tile(key, size), key
            if chunk[i].as_py() < 0:
                tile.group(group[i].as_py(), source[i].as_py(), total[i].as_py(), kept[i].as_py())
            else:
                tile.vector(chunk[i].as_py(), group[i].as_py(), at[i].values.to_numpy(), n[i].values.to_numpy())
    if tile:
        yield tile.result()


def audit(docs: DataFrame, top: int = 200, min_docs: int = MIN_DOCS, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): for each group, ``pair`` rows of the other sources of its language and ``term`` rows of its own terms.

    Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` of whole texts with A-Z lower-cased.  With p a group's share of a kept term and q
    the other's, a pair's value is the sum of floor((p - q)^2 / q) over all kept terms, and a term's is floor((p - q)^2 / q)
    against the whole language, for terms that the group has and has more of.  Ranks count from 1 by
    value, the largest first, ties by item; terms go up to rank ``top``.

    - Null languages, sources and texts are ''.  Groups without terms take part with a count of 0.
    - Every row is a document, also where rows are equal or share an id; other columns aren't read.
    - A language without kept terms gives pairs of value 0.  One with a single source has no pairs.
    - Very long texts are used whole.  An empty table gives an empty table.
    """
    counts = cut(term_counts(docs, lang_col, source_col, text_col))
    every = counts.where("term IS NULL").select("lang", "source")
    terms = counts.where("term IS NOT NULL")
    kept = cut(terms.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).drop("docs"))
    langs = cut(kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")))
    total = langs.agg(F.coalesce(F.sum("kept"), F.lit(0))).first()[0]
    placed = join_counted(kept, langs, ["lang"], "kept", total)
    chunks = F.ceil(F.col("kept") / CHUNK)
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("term"), chunks))
    placed = placed.withColumn("at", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")))
    own = cut(terms.drop("docs").join(placed, ["lang", "term"]))

    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    groups = row_numbers(every.join(totals, ["lang", "source"], "left").na.fill(0, ["total", "kinds"]), ["lang"], ["source"], "number")
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(langs, "lang", "left").na.fill(0, ["kept"])
    spread = F.floor((F.col("number") - 1) / BLOCK).alias("block")
    groups = cut(groups.join(sizes.select("lang", "groups", "kept"), "lang").select("lang", "source", "total", "kinds", "kept", "groups", (F.col("number") - 1).alias("number"), spread))
    rows = own.agg(F.count("*")).first()[0]
    own = join_counted(own, groups.where("kinds > 0").select("lang", "source", "total", "kinds", "groups", "number", "block"), ["lang", "source"], "kinds", rows)

    # the tiles of a block: itself with every block of its language
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("groups") / BLOCK) - 1)).alias("beside")
    stripes = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(chunks / STRIPE), F.lit(1)) - 1)).alias("stripe")
    tile = [F.least("block", "beside").alias("a"), F.greatest("block", "beside").alias("b")]
    named = groups.where("groups > 1").select("*", blocks).select("*", stripes)
    named = named.select("lang", *tile, "stripe", F.lit(-1).cast("long").alias("chunk"), "number", "source", "total", "kept", F.expr("CAST(NULL AS array<int>)").alias("at"), F.expr("CAST(NULL AS array<long>)").alias("n"))
    packed = own.where("groups > 1").groupBy("lang", "chunk", "number", "block", "groups").agg(F.collect_list(F.struct("at", "n")).alias("v"))
    packed = packed.select("lang", "chunk", "number", "block", F.col("v.at").alias("at"), F.col("v.n").alias("n"), blocks)
    none = lambda kind: F.lit(None).cast(kind)
    packed = packed.select("lang", *tile, F.floor(F.col("chunk") / STRIPE).alias("stripe"), "chunk", "number", none("string").alias("source"), none("long").alias("total"), none("long").alias("kept"), "at", "n")
    key = ["lang", "a", "b", "stripe"]
    dealt = named.unionByName(packed).repartition(*key).sortWithinPartitions(*key, "chunk", "number")
    size = BLOCK
    summed = dealt.mapInArrow(lambda batches: _tiles(batches, size), "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)

    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
    more = own.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    more = more.select("lang", "source", "part", "item", F.expr("(p - q) * (p - q) div q").alias("value"))
    return pairs.unionByName(more.select("*", rank).where(F.col("rank") <= top))
