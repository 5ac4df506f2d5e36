"""Line dedup on levelled sorted runs of line hashes.

A *run* is a table of line keys, dealt to buckets by key hash and sorted within them, with the
number of documents and lines that hold the key and the largest document id.  Documents come in
batches.  A batch is reduced to one row per key, dealt and sorted likewise, and merge-joined with every
run in turn.  Keys that no run knows are a new run of level 0; what it adds to known
keys is kept beside.  ``FANOUT`` runs of a level, and what lies beside, are compacted into one run of the next level, so
a table of B batches is rewritten about log(B) times and a probe meets few runs.  All runs are bucketed tables of the same buckets,
so a probe shuffles the batch alone and no run again; a compaction deals its rows once.  Runs are deleted once they
are compacted, and all that is stored once the lines to drop are known.

Hot keys cost nothing extra: a key is one row per map task before any shuffle, and the few keys with many lines
reach these by a broadcast (``skew.join_counted``).  The key is 128 bits of hash (two chained 64-bit
hashes), so distinct lines are never taken for each other at any realistic corpus size.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.llm.names import unused
from driftloom.llm.skew import join_counted
from driftloom.plans.lineage import cut, discard, shared_folder

FANOUT = 3
#: Lines of the first batch; each doubling of a table's lines adds a batch, which no table can do ``SLOTS`` times.
BATCH_LINES, SLOTS = 16_384, 64
#: Lines for each bucket of the runs.
BUCKET_LINES = 250_000
_UPPER, _LOWERED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "\t\n\x0b\x0c\r "


def _ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; the fast path is for text that is ASCII throughout."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, _UPPER, _LOWERED))


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(_SPACES))


def _hash(key: Column) -> Column:
    low = _ascii_lower(key)
    return F.struct(F.xxhash64(low).alias("h1"), F.xxhash64(F.lit(7), low, F.lit(11)).alias("h2"))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line of ``text`` its hash, or null for a key of fewer than ``min_chars`` code points."""
    return F.transform(F.split(text, "\n", -1), lambda x: F.when(F.char_length(_key(x)) >= min_chars, _hash(_key(x))))


_KEYS = ["h1", "h2"]


class Run(NamedTuple):
    """One stored table, read by its buckets for probes, and as plain files for compactions."""

    bucketed: DataFrame
    plain: DataFrame
    folder: str

    def where(self, condition: str) -> Run:
        return Run(*(df.where(condition).drop("seen") for df in (self.bucketed, self.plain)), self.folder)


@dataclass
class LineRuns:
    """Sorted runs of keys by level, and what batches since the last compaction add to keys of the runs.

    Every table has (h1, h2, n_docs, n_lines, keeper), one row a key, in ``buckets`` sorted buckets.
    """

    buckets: int
    levels: dict[int, list[Run]] = field(default_factory=dict)
    beside: list[Run] = field(default_factory=list)
    compactions: int = 0

    def runs(self) -> list[Run]:
        return [run for level in sorted(self.levels) for run in self.levels[level]]

    def _stored(self, rows: DataFrame) -> Run:
        """``rows`` as a bucketed, sorted table in the shared folder; only its name leaves the catalog again."""
        spark, name = rows.sparkSession, f"line_run_{uuid.uuid4().hex}"
        path = f"{shared_folder(spark)}/{name}"
        dealt = rows.repartition(self.buckets, *_KEYS).sortWithinPartitions(*_KEYS)
        dealt.write.bucketBy(self.buckets, *_KEYS).sortBy(*_KEYS).option("path", path).saveAsTable(name)
        table = spark.table(name)
        spark.sql(f"DROP TABLE {name}")
        return Run(table, spark.read.schema(table.schema).parquet(path), path)

    def add(self, batch: DataFrame) -> None:
        """Adds a batch, one row a key: the keys that a merge join finds in no run are a new run, the others lie beside."""
        probe = batch.repartition(self.buckets, *_KEYS)
        runs = self.runs()
        for i, run in enumerate(runs):
            probe = probe.hint("merge").join(run.bucketed.select(*_KEYS, F.lit(True).alias(f"in{i}")), _KEYS, "left")
        seen = F.coalesce(*[F.col(f"in{i}") for i in range(len(runs))], F.lit(False))
        marked = self._stored(probe.withColumn("seen", seen).drop(*[f"in{i}" for i in range(len(runs))]))
        if runs:
            self.beside.append(marked.where("seen"))
        self._put(0, marked.where("NOT seen"))

    def _put(self, level: int, run: Run) -> None:
        here = self.levels.setdefault(level, [])
        here.append(run)
        if len(here) >= FANOUT:
            self.levels[level], beside, self.beside = [], self.beside, []
            self.compactions += 1
            compacted = self._stored(merged(here + beside))
            _discard(here + beside)
            self._put(level + 1, compacted)

    def common(self, min_docs: int) -> DataFrame:
        """The keys that at least ``min_docs`` documents hold, over all batches so far."""
        return merged(self.runs() + self.beside).where(F.col("n_docs") >= min_docs)


    def close(self) -> None:
        """Deletes all runs."""
        _discard(self.runs() + self.beside)
        self.levels, self.beside = {}, []


def _discard(runs: list[Run]) -> None:
    """Deletes the tables of runs that nothing reads any more; two runs may be the halves of one."""
    for folder in {run.folder for run in runs}:
        discard(runs[0].plain.sparkSession, folder)


def merged(runs: list[Run]) -> DataFrame:
    """Several tables of keys as one: counts of different batches add up, the largest document keeps the line.

    Plain reads, as Spark 4.1 takes a union of bucketed tables for bucketed even where it then reads them otherwise.
    """
    rows = reduce(DataFrame.unionByName, [run.plain for run in runs])
    return rows.groupBy(*_KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_lines")], F.max("keeper").alias("keeper"))


def places_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc, row, pos, h1, h2): each line with a key, by the document's id, a hash of its text and the line's number."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("row"), F.posexplode(line_hashes(text, min_chars)).alias("pos", "k"))
    return lines.where("k IS NOT NULL").select("doc", "row", "pos", "k.h1", "k.h2")


def batch_keys(places: DataFrame) -> DataFrame:
    """(h1, h2, n_docs, n_lines, keeper) of one batch; a document counts once however many lines or rows of it have the key.

    The first aggregation is keyed by key and document and the second combines
    before its shuffle, so a line that every document holds stays spread.
    """
    once = places.groupBy(*_KEYS, "doc").agg(F.count("*").alias("n"))
    return once.groupBy(*_KEYS).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_lines"), F.max("doc").alias("keeper"))


def batch_count(lines: int) -> int:
    """How many batches a table of so many lines comes in."""
    return min(SLOTS, 1 + int(max(1, lines // BATCH_LINES)).bit_length() - 1)


def build_runs(places: DataFrame, lines: int, batches: int | None = None) -> LineRuns:
    """The runs of all ``places``, which have a ``slot`` by document, after so many batches."""
    batches = batches or batch_count(lines)
    runs = LineRuns(max(1, -(-lines // BUCKET_LINES)))
    for b in range(batches):
        runs.add(batch_keys(places.where(F.col("slot").isin([s for s in range(SLOTS) if s % batches == b]))))
    return runs


def drop_repeated_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int | None = None,
    lines_col: str = "n_lines",
    dropped_col: str = "n_dropped",
) -> DataFrame:
    """``docs`` with the lines of over-common keys gone, plus ``lines_col``, their number before, and ``dropped_col``.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with
    A-Z lower-cased.  Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all their lines, except in the document with
    the largest id that holds the key; there all of them stay.  ``batches``, ``SLOTS`` at most, only says how the work is cut.

    - Null or empty text is one empty line, which stays; the text is then empty.
    - A row with a null id loses no line and counts for no key.
    - Rows that share an id are one document for the counts; each row is cleaned by itself.
    - A text that loses all its lines becomes empty.
    - Very long texts are handled whole; the time is linear in their lines.
    - Other columns are kept as they are; ``lines_col`` and ``dropped_col`` replace columns of that name.
    - An empty table gives an empty table.
    """
    docs = docs.drop(lines_col, dropped_col)
    d, r, g, s = (unused(docs, name) for name in ("_doc", "_row", "_gone", "_lines"))
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # written once, a folder a slot, so that each batch reads its own lines only
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/places"
    slotted = places_of(own, "doc_id", "text", min_chars).withColumn("slot", F.pmod(F.xxhash64("doc"), F.lit(SLOTS)).cast("int"))
    slotted.hint("rebalance", "slot").write.partitionBy("slot").parquet(folder)
    places = spark.read.schema(slotted.schema).parquet(folder)
    total = places.count()
    runs = build_runs(places, total, batches)
    common = cut(runs.common(min_docs).select(*_KEYS, "n_lines", "keeper"))
    runs.close()
    gone = cut(
        join_counted(places, common, _KEYS, "n_lines", total)
        .where(F.col("doc") < F.col("keeper"))
        .groupBy(F.col("doc").alias(d), F.col("row").alias(r))
        .agg(F.collect_set("pos").alias(g))
    )
    discard(spark, folder)
    text = F.coalesce(F.col(text_col), F.lit(""))
    with_gone = docs.join(gone, (docs[id_col] == gone[d]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == gone[r]), "left")
    lines = F.split(text, "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col(g))
    kept = F.when(F.col(g).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(s), i)), "\n"))
    return (
        with_gone.withColumn(s, lines)
        .withColumns({text_col: kept, lines_col: F.size(s).cast("long"), dropped_col: F.coalesce(F.size(g), F.lit(0)).cast("long")})
        .drop(s, d, r, g)
    )
