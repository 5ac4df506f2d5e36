"""Connected components by alternating stars.

Both star steps are an aggregation with map-side combine and an equi-join, so a
hub with very many neighbours is pre-aggregated before the shuffle.  The smallest neighbours are
dealt anew before the join, so that both of its sides are plain shuffles and adaptive execution may
split the hub's partition.  The number of rounds grows
with the logarithm of the longest path.  Before the first round the edges are dealt to tasks of
even size, and each task turns its edges into stars, up to ``CONTRACT`` at a time.  So few edges need no round at
all, and many start from short paths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.plans.lineage import cut


#: Edges that a task contracts at a time.
CONTRACT = 1_000_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and, for each, the smallest node that the edges connect it with, where that is another."""
    nodes, at = np.unique(np.stack([u, v]), return_inverse=True)
    a, b = at.reshape(2, -1)
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Stars (u, v), v the smallest node, that connect what each ``most`` edges connect."""
    held: list[pa.RecordBatch] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if held:
            u, v = stars(*(np.concatenate([batch.column(k).to_numpy() for batch in held]) for k in (0, 1)))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= most:
            yield from flush()
    yield from flush()


def _star(arcs: DataFrame) -> DataFrame:
    """(u, m) with m the smallest of u and its neighbours in ``arcs(u, v)``."""
    return arcs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).hint("rebalance")


def _unfinished(e: DataFrame) -> DataFrame:
    """Nodes that keep the distinct edges ``e(u, v)``, v < u, from being stars around smallest nodes.

    Such a node has a smaller neighbour and another edge besides: a larger neighbour, or a second smaller one.
    """
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("low")), F.struct(F.col("v").alias("n"), F.lit(None).cast("long").alias("low")))).alias("e")).select("e.n", "e.low")
    return ends.groupBy("n").agg(F.count("low").alias("lower"), F.count("*").alias("edges")).where("lower > 0 AND edges > 1")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None, near: bool = False) -> DataFrame:
    """(node, component): every endpoint of ``edges`` with the smallest node it can reach.

    Direction and repeats don't matter; rows with a null endpoint are left out;
    a self-loop makes its node a component by itself.  ``rows`` may tell how many edges there are at most.  With ``near`` edges are dealt
    by ranges of their ends, where close numbers often hang together: what lies in a range is contracted at once, and rounds join the rest.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    loops = pairs.where("u = v").select("u").distinct()
    most = CONTRACT
    own = pairs.where("u <> v").select(F.col("u").cast("long"), F.col("v").cast("long"))
    dealt = own.repartitionByRange("u", "v").sortWithinPartitions("u", "v") if near else own.hint("rebalance")
    e = cut(dealt.mapInArrow(lambda batches: _contracted(batches, most), "u long, v long").distinct(), rows)
    # a round keeps or lowers the number of edges
    count = e.count()
    while not _unfinished(e).isEmpty():
        # large star: larger neighbours move to the smallest neighbour
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.u", "e.v")
        large = both.join(_star(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours move to the smallest of them
        low = _star(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), count)
    found = e.groupBy("u").agg(F.min("v").alias("v"))
    nodes = found.unionByName(found.select(F.col("v").alias("u"), F.col("v")).distinct())
    alone = loops.join(nodes, "u", "left_anti").select("u", F.col("u").alias("v"))
    return nodes.unionByName(alone).select(F.col("u").alias("node"), F.col("v").alias("component"))


def _numbered(ends: DataFrame) -> DataFrame:
    """The distinct rows of ``ends`` with a number each in ``n``, in their order, written so that it stays the same."""
    by = ["dataset", "node_id"]
    return cut(ends.distinct().repartitionByRange(*by).sortWithinPartitions(*by).withColumn("n", F.monotonically_increasing_id()))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select("dataset", F.explode(F.array("source_id", "target_id")).alias("node_id"))


def _by_number(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``edges`` with the numbers of their ends in ``a`` and ``b``."""
    end = lambda name, to: ids.select("dataset", F.col("node_id").alias(name), F.col("n").alias(to))
    return edges.join(end("source_id", "a"), ["dataset", "source_id"]).join(end("target_id", "b"), ["dataset", "target_id"])


def components_by_dataset(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dataset, node_id, component): the smallest of ``nodes`` that a node's edges reach in either direction.

    Ids needn't be unique over datasets, as each numbers the nodes it adds by itself; so nodes are numbered first, each by
    a number of its own.
    """
    own = edges.select("dataset", "source_id", "target_id")
    ids = _numbered(nodes.select("dataset", "node_id").unionByName(_ends(own)))
    found = connected_components(_by_number(own, ids), "a", "b", near=True).withColumnsRenamed({"node": "n", "component": "part"})
    member = nodes.select("dataset", "node_id").join(ids, ["dataset", "node_id"]).join(found, "n", "left").select("dataset", "node_id", F.coalesce("part", "n").alias("part"))
    first = member.groupBy("part").agg(F.min("node_id").alias("component"))
    return member.join(first, "part").select("dataset", "node_id", "component")


def with_components(edges: DataFrame) -> DataFrame:
    """``edges(dataset, source_id, target_id, ...)`` with ``component``, one number for all that hang together."""
    numbered = cut(_by_number(edges, _numbered(_ends(edges))))
    found = connected_components(numbered, "a", "b", near=True).withColumnRenamed("node", "a")
    return numbered.join(found, "a").drop("a", "b")


def with_meetings(pairs: DataFrame) -> DataFrame:
    """As ``with_components``, where a node as a source and the same node as a target are two: pairs hang together by a shared source or a shared target."""
    source = _numbered(pairs.select("dataset", F.col("source_id").alias("node_id"))).withColumnRenamed("node_id", "source_id").withColumn("a", 2 * F.col("n")).drop("n")
    target = _numbered(pairs.select("dataset", F.col("target_id").alias("node_id"))).withColumnRenamed("node_id", "target_id").withColumn("b", 2 * F.col("n") + 1).drop("n")
    numbered = cut(pairs.join(source, ["dataset", "source_id"]).join(target, ["dataset", "target_id"]))
    found = connected_components(numbered, "a", "b", near=True).withColumnRenamed("node", "a")
    return numbered.join(found, "a").drop("a", "b")
