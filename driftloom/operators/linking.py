"""Linking detections into tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.config import TrackingConfig
from driftloom.operators.assign import assign_candidates, assign_frames, assign_sparse
from driftloom.operators.division import detect_divisions
from driftloom.operators.flow import cheapest_trees, check_prices
from driftloom.operators.graph import components_by_dataset, with_components
from driftloom.operators.numbering import row_numbers
from driftloom.operators.spatial import frame_forest, knn_candidates, near_pairs, prefixed, range_join
from driftloom.plans.lineage import cut


def nn_link(detections: DataFrame, gate: float, voxel: tuple[float, float, float]) -> DataFrame:
    """(dataset, source_id, target_id, dist): assign all of consecutive frames first, then drop what is beyond ``gate``."""
    rows = detections.select("dataset", "t", F.col("det_id").alias("id"), "z", "y", "x")
    later = rows.withColumn("t", F.col("t") - 1)
    return assign_frames(rows, later, ["dataset", "t"], voxel, gate).drop("t")


def two_passes(i: np.ndarray, j: np.ndarray, raw: np.ndarray, cost: np.ndarray, config: TrackingConfig) -> np.ndarray:
    """Indices of the chosen ones among pairs (i, j): as many as possible within the tight gate at the least cost, then of what is left within the loose gate.

    Both passes gate on the raw distance.
    """
    left, chosen = np.ones(len(i), bool), []
    for gate in (min(config.tight_gate, config.loose_gate), config.loose_gate):
        open_ = np.flatnonzero((raw <= gate) & left)
        took = open_[assign_sparse(i[open_], j[open_], cost[open_])]
        chosen.append(took)
        left &= ~(np.isin(i, i[took]) | np.isin(j, j[took]))
    return np.concatenate(chosen)


class Linker:
    """Two-pass linking, frame by frame, of what may hang together.

    The state is the velocity of each node that the frame before was linked to, in micrometres a frame; others have none.
    """

    def __init__(self, config: TrackingConfig):
        self.config = config
        self.reset()

    def reset(self) -> None:
        self.t, self.velocity = None, {}

    def step(self, t: int, source: np.ndarray, target: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indices of the links among the pairs from frame ``t`` to the next, whose ends lie at ``a`` and ``b`` in micrometres."""
        if self.t is None or t != self.t + 1:
            self.velocity = {}
        none = np.zeros(3)
        own, at = np.unique(source, return_inverse=True)
        speed = np.stack([self.velocity.get(s, none) for s in own.tolist()])[at]
        raw = np.sqrt(((a - b) ** 2).sum(axis=1))
        cost = np.sqrt(((a + self.config.velocity_blend * speed - b) ** 2).sum(axis=1))
        took = two_passes(source, target, raw, cost, self.config)
        self.t, self.velocity = t, {int(target[k]): b[k] - a[k] for k in took}
        return took


def twopass_link(detections: DataFrame, config: TrackingConfig) -> DataFrame:
    """(dataset, source_id, target_id) by two-pass assignment with constant-velocity prediction.

    Both passes gate on the raw distance and minimise the predicted one.  Velocities follow links and links stay
    within the loose gate, so what the pairs within that gate don't connect, over all frames, can't
    influence each other: each such component in space and time is decided by itself, frame after frame.  A task
    goes through components in turn and holds the points of two frames of one and their pairs, which it finds itself: only points
    are shuffled.  A movie is as many tasks as Spark makes of its components.
    """
    um = [(F.col(c) * s).cast("double").alias(c) for c, s in zip("zyx", config.voxel, strict=True)]
    points = detections.select("dataset", F.col("det_id").cast("long").alias("node_id"), "t", *um).dropna()
    # a little wider, so that no rounding parts what a gate joins
    forest = cut(frame_forest(detections, config.loose_gate * (1 + 1e-6), config.voxel))
    ends = forest.select("dataset", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    rows = points.join(components_by_dataset(ends, forest), ["dataset", "node_id"]).select("dataset", "component", "t", "node_id", *"zyx")
    ordered = rows.repartition("dataset", "component").sortWithinPartitions("dataset", "component", "t", "node_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, part, before, rest = Linker(config), None, None, None

        def linked(table: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal part, before
            keys = np.stack([table.column(k).to_numpy() for k in (0, 1, 2)])
            bounds = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
            ids = table.column(3).to_numpy()
            at = np.stack([table.column(k).to_numpy() for k in (4, 5, 6)], axis=1)
            out = []
            for low, high in zip(bounds[:-1], bounds[1:], strict=True):
                dataset, component, t = keys[:, low].tolist()
                if (dataset, component) != part:
                    part, before = (dataset, component), None
                    linker.reset()
                now = t, ids[low:high], at[low:high]
                if before and before[0] + 1 == t:
                    i, j, _ = near_pairs(before[2], now[2], config.loose_gate)
                    if len(i):
                        took = linker.step(before[0], before[1][i], now[1][j], before[2][i], now[2][j])
                        out.append((np.full(len(took), dataset), before[1][i[took]], now[1][j[took]]))
                before = now
            if out:
                columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([columns[0].cast(table.schema.field(0).type), *columns[1:]], names=["dataset", "source_id", "target_id"])

        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not whole.num_rows:
                continue
            # the last frame of a batch may go on in the next
            last = np.stack([whole.column(k).to_numpy() for k in (0, 1, 2)])
            cut_at = int(np.flatnonzero((last != last[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if cut_at:
                yield from linked(whole.slice(0, cut_at))
            rest = whole.slice(cut_at)
        if rest is not None and rest.num_rows:
            yield from linked(rest)

    return ordered.mapInArrow(run, f"dataset {dict(points.dtypes)['dataset']}, source_id long, target_id long")


def ends_and_starts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without an outgoing edge, and nodes without an incoming one."""
    out = edges.select("dataset", F.col("source_id").alias("node_id"))
    into = edges.select("dataset", F.col("target_id").alias("node_id"))
    return nodes.join(out, ["dataset", "node_id"], "left_anti"), nodes.join(into, ["dataset", "node_id"], "left_anti")


def gap_candidates(nodes: DataFrame, edges: DataFrame, gap: int, config: TrackingConfig) -> DataFrame:
    """(dataset, t, end_id, start_id, dist): ends and the starts ``gap + 1`` frames later within the gap's gate."""
    ends, starts = ends_and_starts(nodes, edges)
    a = prefixed(ends.select("dataset", "t", F.col("node_id").alias("end_id"), "z", "y", "x"), "a_").withColumn("t2", F.col("t") + gap + 1)
    b = prefixed(starts.select("dataset", F.col("t").alias("t2"), F.col("node_id").alias("start_id"), "z", "y", "x"), "b_")
    return range_join(a, b, ["dataset", "t2"], config.gap_distance * (gap + 1), config.voxel)


def interpolated(links: DataFrame, gap: int) -> DataFrame:
    """A row (k, z, y, x) for each missing frame of a gap link with its ends' coordinates."""
    part = F.col("k") / F.lit(float(gap + 1))
    return links.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(gap)))).withColumns({c: F.col("a_" + c) + (F.col("b_" + c) - F.col("a_" + c)) * part for c in "zyx"})


def bridge(nodes: DataFrame, edges: DataFrame, links: DataFrame, gap: int) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with each of ``links(dataset, t, end_id, start_id)`` bridged by ``gap`` interpolated nodes; ``t`` is the frame of the end.

    New ids follow the largest id of the movie, by frame and end.
    """
    top = nodes.groupBy("dataset").agg(F.max("node_id").alias("top"))
    a = prefixed(nodes.select("dataset", F.col("node_id").alias("end_id"), "z", "y", "x"), "a_")
    b = prefixed(nodes.select("dataset", F.col("node_id").alias("start_id"), "z", "y", "x"), "b_")
    whole = links.select("dataset", "t", "end_id", "start_id").join(a, ["dataset", "end_id"]).join(b, ["dataset", "start_id"]).join(top, "dataset")
    whole = row_numbers(whole, ["dataset"], ["t", "end_id"], "place").withColumn("first", F.col("top") + 1 + (F.col("place") - 1) * gap)
    new = interpolated(whole, gap).select("dataset", (F.col("first") + F.col("k") - 1).cast("long").alias("node_id"), (F.col("t") + F.col("k")).cast("int").alias("t"), "z", "y", "x")
    steps = whole.select("dataset", F.explode(F.array(
        *[F.struct((F.col("end_id") if k == 0 else F.col("first") + k - 1).cast("long").alias("source_id"), (F.col("start_id") if k == gap else F.col("first") + k).cast("long").alias("target_id")) for k in range(gap + 1)]
    )).alias("e")).select("dataset", "e.source_id", "e.target_id")
    return cut(nodes.select("dataset", "node_id", "t", "z", "y", "x").unionByName(new)), cut(edges.select("dataset", "source_id", "target_id").unionByName(steps))


def close_gaps(nodes: DataFrame, edges: DataFrame, config: TrackingConfig) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges with the gaps of up to ``max_gap`` frames bridged by interpolated nodes, the short ones first.

    Ends and starts are assigned per frame, as many as possible and then the nearest.
    """
    for gap in range(1, config.max_gap + 1):
        gate = config.gap_distance * (gap + 1)
        near = gap_candidates(nodes, edges, gap, config)
        links = cut(assign_candidates(near, ["dataset", "t"], "end_id", "start_id", "dist", gate * 1000 + 1))
        nodes, edges = bridge(nodes, edges, links, gap)
    return nodes, edges


def filter_short_tracks(nodes: DataFrame, edges: DataFrame, min_nodes: int) -> tuple[DataFrame, DataFrame]:
    """Only tracks, that is components, of at least ``min_nodes`` nodes; all of it where there are no edges or ``min_nodes`` is 1."""
    if min_nodes <= 1 or edges.isEmpty():
        return nodes, edges
    member = cut(components_by_dataset(nodes, edges))
    long = member.groupBy("dataset", "component").count().where(F.col("count") >= min_nodes)
    keep = member.join(long, ["dataset", "component"], "left_semi").select("dataset", "node_id")
    ends = edges.join(keep.withColumnRenamed("node_id", "source_id"), ["dataset", "source_id"], "left_semi").join(keep.withColumnRenamed("node_id", "target_id"), ["dataset", "target_id"], "left_semi")
    return nodes.join(keep, ["dataset", "node_id"], "left_semi"), ends


def prune_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with an edge; all of them where there are no edges."""
    if edges.isEmpty():
        return nodes
    used = edges.select("dataset", F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct()
    return nodes.join(used, ["dataset", "node_id"], "left_semi")


def solver_edges(solution: DataFrame, ids: DataFrame) -> DataFrame:
    """(dataset, source_id, target_id): a solver's edges (dataset, source, target) under the node ids of
    ``ids(dataset, solver_id, node_id)``; edges with an end that has no node id go."""
    end = lambda name, to: ids.select("dataset", F.col("solver_id").alias(name), F.col("node_id").alias(to))
    return solution.join(end("source", "source_id"), ["dataset", "source"]).join(end("target", "target_id"), ["dataset", "target"]).select("dataset", "source_id", "target_id")


def track(detections: DataFrame, config: TrackingConfig, gaps: bool = True, prune: bool = True, short: bool = True, divisions: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a whole run: two-pass linking, then, each if wanted, gap closing, isolated nodes out, short tracks out, divisions."""
    nodes = cut(detections.select("dataset", F.col("det_id").alias("node_id"), "t", "z", "y", "x"))
    edges = cut(twopass_link(detections, config))
    if gaps:
        nodes, edges = close_gaps(nodes, edges, config)
    if prune:
        nodes = prune_isolated(nodes, edges)
    if short:
        nodes, edges = filter_short_tracks(nodes, edges, config.min_track_nodes)
    nodes, edges = cut(nodes), cut(edges)
    return nodes, cut(detect_divisions(nodes, edges, config)) if divisions else edges


def min_cost_flow_link(detections: DataFrame, config: TrackingConfig, optional: bool = False) -> DataFrame:
    """(dataset, source_id, target_id, w): links that together cost least, with weights ``dist - bias`` over the k nearest.

    Every track pays for appearing and disappearing, and every node with two children for the division; a node has one
    parent and two children at most.

    - By default all nodes are part of the solution, linked or not.  Then a link saves an end and a start, links of different frames
      don't compete, and each pair of frames is decided by itself.  With the division price out of reach a solution is a set of disjoint paths.
    - With ``optional`` a node may stay out at no cost, and only tracks pay.  Then a track is worth having as a whole or not at
      all, so a component in space and time is decided at once, in one task.
    """
    check_prices(config.ilp_appear, config.ilp_disappear, config.ilp_division, optional)
    saved = config.ilp_appear + config.ilp_disappear
    weighted = knn_candidates(detections, config.ilp_k, config.loose_gate, config.voxel).withColumn("w", F.col("dist") - config.ilp_bias)
    useful = weighted.where(F.col("w") < saved).select("dataset", "t", F.col("source_id").cast("long"), F.col("target_id").cast("long"), "w")
    prices = config.ilp_appear, config.ilp_disappear, config.ilp_division

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("source_id", "ascending"), ("target_id", "ascending")])
        return table.take(pa.array(cheapest_trees(*(table.column(c).to_numpy() for c in ("source_id", "target_id", "w")), *prices, optional)))

    if optional:
        useful = with_components(useful)
    by = ["component"] if optional else ["dataset", "t"]
    return useful.groupBy(*by).applyInArrow(run, useful.schema).select("dataset", "source_id", "target_id", "w")
