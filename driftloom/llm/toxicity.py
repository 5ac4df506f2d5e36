"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the 32-bit hashes of its words, of the words' stems (their
first 4, 5 and 6 bytes), of its bigrams, and of its pairs with one word skipped;
words are lower-cased and free of ASCII punctuation.  A feature counts once a text.

The learner keeps per-coordinate rates and L1 sparsity, so that what it learns is
a short list of weights.  It reads a bounded sample of labelled rows
(``max_rows``), in the order of a hash of the id.  Features of the sample are found and counted by parallel tasks; only
the updates, one row after the other, run in one.  The weights, no more than the
sample has features, are broadcast; scoring is one pass over all whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm import textkernel
from driftloom.llm.memory import release
from driftloom.llm.names import map_in_arrow, with_outputs
from driftloom.plans.lineage import cut

STEMS = (4, 5, 6)
_KINDS = textkernel.mix64(np.arange(101, 101 + 3 + len(STEMS), dtype=np.uint64)) | np.uint64(1)
_BITS = 26
#: Rows of the sample for each task that finds features.
SAMPLE_TASK = 1000
_MASK = np.uint64((1 << _BITS) - 1)


@dataclass(frozen=True)
class Params:
    """``max_rows`` bounds the labelled rows that are read; ``min_docs`` is the least number of them with a feature."""

    max_rows: int = 16_000
    min_docs: int = 3
    epochs: int = 3
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 4.0
    l2: float = 0.5


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of texts, features, text of each feature) by slice; features repeat within a text."""
    for at, end, raw, offsets in textkernel.slices(texts):
        words, stems, first = textkernel.word_and_stem_hashes(raw, offsets, textkernel.PUNCTUATED, STEMS)
        owner = np.repeat(np.arange(end - at), np.diff(first))
        found, owners = [words], [owner]
        for kind, gap in ((0, 1), (1, 2)):
            same = owner[gap:] == owner[:-gap]
            found.append(textkernel.mix64(words[:-gap] * _KINDS[kind] + words[gap:])[same])
            owners.append(owner[gap:][same])
        for k, stem in enumerate(stems):
            found.append(textkernel.mix64(stem * _KINDS[3 + k]))
            owners.append(owner)
        yield end - at, np.concatenate(found) >> np.uint64(32), np.concatenate(owners)


def row_features(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct features of each text."""
    for n, found, owner in features(texts):
        order = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[order], np.arange(n + 1))
        found = found[order]
        for i in range(n):
            yield np.unique(found[bounds[i] : bounds[i + 1]])


def fit(rows: list[np.ndarray], labels: np.ndarray, size: int, params: Params) -> tuple[np.ndarray, float]:
    """(weight of each of ``size`` features, bias) after all updates, for rows of feature numbers in order."""
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the last is the bias, which has no penalty

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return -np.sign(zi) * np.maximum(np.abs(zi) - params.l1, 0) / ((params.beta + np.sqrt(ni)) / params.alpha + params.l2)

    def bias() -> float:
        return -z[-1] / ((params.beta + np.sqrt(n[-1])) / params.alpha)

    for _ in range(params.epochs):
        for row, y in zip(rows, labels, strict=True):
            at = np.append(row, size)
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            w[-1] = bias()
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / params.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(z[:-1], n[:-1]), float(bias())


def _sample(docs: DataFrame, labels: DataFrame, params: Params, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(at, text, label): the first ``max_rows`` labelled rows by a hash of the id."""
    own = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col)).cast("double").alias("label"))
    # at most max_rows rows of two numbers, so that it can be broadcast
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.max_rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(own), "doc_id").select(F.xxhash64("doc_id").alias("at"), F.xxhash64("text").alias("of"), "text", "label")
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    if (count := rows.count()) > params.max_rows:
        # rows that repeat an id: which of them, from numbers alone
        chosen = rows.select("at", "of", "row").orderBy("at", "of", "row").limit(params.max_rows).select("row")
        rows, count = rows.join(F.broadcast(chosen), "row", "left_semi"), params.max_rows
    return rows.select("at", "text", "label").repartition(max(1, -(-count // SAMPLE_TASK)))


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "label") -> tuple[np.ndarray, np.ndarray, float]:
    """(features in order, weights, bias) from the labelled rows of ``docs``, ``params.max_rows`` at most.

    ``labels`` has ids and labels 0 or 1; null ids and labels are left out, of
    several labels of an id the larger holds.

    - Null, empty and blank texts have no features; such a row moves the bias alone.
    - Rows that repeat an id are each a row of the sample and count against ``max_rows``; equal rows are rows of their own.
    - Without usable rows, or from empty tables, there are no weights and the bias is 0.
    - Very long texts are used whole.  Other columns aren't read.
    """
    spark = docs.sparkSession
    sample = _sample(docs, labels, params, id_col, text_col, label_col)

    rows = cut(sample)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in row_features(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.uint32).view(np.int32))], names=["feature"])
        release()

    counts = rows.select("text").mapInArrow(each, "feature int").groupBy("feature").agg(F.count("*").alias("n"))
    names = np.sort(counts.where(F.col("n") >= params.min_docs).select("feature").toArrow().column(0).to_numpy().view(np.uint32).astype(np.uint64))
    shared = spark.sparkContext.broadcast(names)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            out = []
            for row in row_features(batch.column(1)):
                at = np.searchsorted(known, row)
                fits = known[np.minimum(at, len(known) - 1)] == row if len(known) else np.zeros(len(row), bool)
                out.append(at[fits].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], names=["at", "row", "label"])
        release()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels = [], []
        for batch in batches:
            held += [np.frombuffer(row.as_buffer(), np.int32).copy() for row in batch.column(1)]
            labels.append(batch.column(2).to_numpy())
        if not held:
            return
        w, b = fit(held, np.concatenate(labels), len(shared.value), params)
        at = np.flatnonzero(w)
        del held
        release()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(w[at], b))], names=["at", "weight"])

    # one task for the bounded sample's numbers, in an order that doesn't depend on how the table is dealt
    numbered = rows.mapInArrow(number, "at long, row binary, label double")
    found = numbered.repartition(1).sortWithinPartitions("at", "row", "label").mapInArrow(learn, "at long, weight double").toArrow()
    if not found.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0), 0.0
    at, w = found.column("at").to_numpy(), found.column("weight").to_numpy()
    return names[at[:-1]], w[:-1], float(w[-1])


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability of label 1 for each whole text.

    Null, empty and blank texts get the bias's probability.  Only the text is
    looked at, so repeated texts get equal scores.  A column named like the output is
    replaced, other columns stay; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    schema = with_outputs(docs, T.StructField(score_col, T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, b = shared.value
        maybe = np.zeros(1 << _BITS, dtype=bool)
        maybe[names & _MASK] = True
        for batch in batches:
            sums = []
            for n, found, owner in features(batch.column(text_col)):
                hit = np.flatnonzero(maybe[found & _MASK])
                found, owner = found[hit], owner[hit]
                at = np.searchsorted(names, found)
                exact = (at < len(names)) & (names[np.minimum(at, len(names) - 1)] == found) if len(names) else np.zeros(len(found), bool)
                once = np.unique(owner[exact] * len(names) + at[exact])
                sums.append(np.bincount(once // max(len(names), 1), weights=w[once % max(len(names), 1)], minlength=n))
            total = np.concatenate(sums) if sums else np.zeros(0)
            value = 1 / (1 + np.exp(-np.clip(total + b, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(name) for name in schema.names[:-1]] + [pa.array(value)], names=schema.names)

    return map_in_arrow(docs, run, schema)


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0 by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))
