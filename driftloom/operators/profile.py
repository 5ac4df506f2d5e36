"""Describing a dataset, and choosing samples from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.scalar import clipped_angle, distance, scaled_between
from driftloom.operators.numbering import row_numbers, running_total
from driftloom.operators.spatial import prefixed


def frame_density(points: DataFrame) -> DataFrame:
    """(dataset, frames, low, high, mean): points per frame."""
    per = points.groupBy("dataset", "t").agg(F.count("*").alias("n"))
    return per.groupBy("dataset").agg(F.count("*").alias("frames"), F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"))


def edge_geometry(nodes: DataFrame, edges: DataFrame, voxel: tuple[float, float, float]) -> DataFrame:
    """Edges with both ends known, and the displacement ``dist`` in micrometres."""
    a = prefixed(nodes.select("dataset", F.col("node_id").alias("source_id"), "t", "z", "y", "x"), "a_")
    b = prefixed(nodes.select("dataset", F.col("node_id").alias("target_id"), "z", "y", "x"), "b_")
    return edges.join(a, ["dataset", "source_id"]).join(b, ["dataset", "target_id"]).withColumn("dist", distance("a_", "b_", voxel))


def head(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows in an order that is stated, for reports on the head of a table."""
    return df.orderBy(*order).limit(n)


def division_geometry(nodes: DataFrame, edges: DataFrame, voxel: tuple[float, float, float]) -> DataFrame:
    """(dataset, mother, n1, n2, inter, angle): the two first daughters of each division, by id; ``angle`` is null for a daughter on the spot."""
    rank = Window.partitionBy("dataset", "source_id").orderBy("target_id")
    kids = edge_geometry(nodes, edges, voxel).withColumn("r", F.row_number().over(rank)).where("r <= 2")
    v = {c: (F.col("b_" + c) - F.col("a_" + c)) * s for c, s in zip("zyx", voxel, strict=True)}
    kids = kids.select("dataset", F.col("source_id").alias("mother"), "r", "dist", F.struct(*[v[c].alias(c) for c in "zyx"]).alias("v"))
    pair = kids.groupBy("dataset", "mother").agg(
        *[F.max(F.when(F.col("r") == k, F.col(c))).alias(f"{n}{k}") for k in (1, 2) for c, n in (("dist", "n"), ("v", "v"))]
    ).where("n2 IS NOT NULL")
    dot = F.col("v1.z") * F.col("v2.z") + F.col("v1.y") * F.col("v2.y") + F.col("v1.x") * F.col("v2.x")
    gap = [F.col(f"v1.{c}") - F.col(f"v2.{c}") for c in "zyx"]
    return pair.select(
        "dataset", "mother", "n1", "n2",
        F.sqrt(gap[0] * gap[0] + gap[1] * gap[1] + gap[2] * gap[2]).alias("inter"),
        F.when((F.col("n1") > 1e-6) & (F.col("n2") > 1e-6), clipped_angle(dot, F.col("n1") * F.col("n2"))).alias("angle"),
    )


def percentile_normalize(values: DataFrame, by: list[str], column: str, low: float = 0.5, high: float = 0.998) -> DataFrame:
    """``values`` with ``normalized``: clipped to 0..1 between two exact percentiles of its group."""
    bounds = values.groupBy(*by).agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("p"))
    return values.join(bounds, by).withColumn("normalized", scaled_between(F.col(column), F.col("p")[0], F.col("p")[1])).drop("p")


def stratified_interleave(items: DataFrame, stratum: Column, order: str) -> DataFrame:
    """``items`` with ``place``: one of each stratum in turn, strata in the order of their first item."""
    ranked = row_numbers(items.withColumn("stratum", stratum), ["stratum"], [order], "round")
    firsts = ranked.where("round = 1").select("stratum", F.col(order).alias("first"))
    # the place counts the items of earlier rounds, then the strata before in this round, so no task holds all rows
    before = running_total(ranked.groupBy("round").agg(F.count("*").alias("n")), "round", "n", "before").drop("n")
    inside = F.row_number().over(Window.partitionBy("round").orderBy("first"))
    return ranked.join(firsts, "stratum").join(before, "round").withColumn("place", F.col("before") + inside - 1).drop("before", "first")


def tail_split(items: DataFrame, order: str, holdout: int) -> DataFrame:
    """``items`` with ``split``: the last ``holdout`` by ``order`` are val, the others train."""
    last = items.orderBy(F.desc(order)).limit(holdout).agg(F.min(order).alias("cut"))
    marked = items.join(F.broadcast(last), F.col(order) >= F.col("cut"), "left")  # one row
    return marked.withColumn("split", F.when(F.col("cut").isNull(), "train").otherwise("val")).drop("cut")


def pick(items: DataFrame, order: str, usable: Column, n_train: int, n_val: int) -> DataFrame:
    """The first ``n_train`` usable items as train and the next ``n_val`` as val; unusable ones are passed over."""
    head = items.where(usable).orderBy(order).limit(n_train + n_val)
    ranked = head.withColumn("k", F.row_number().over(Window.orderBy(order)))
    return ranked.withColumn("split", F.when(F.col("k") <= n_train, "train").otherwise("val")).drop("k")


def pick_with_reasons(items: DataFrame, order: str, size: str, least: int, n_train: int, n_val: int) -> DataFrame:
    """``items`` up to the last one that is picked, with ``split``: train, val, or why an item was passed over.

    Items are taken in order until both splits are full; one whose ``size`` is null is 'skip: unreadable', one under ``least`` 'skip: n < least'.
    """
    kept = pick(items, order, F.coalesce(F.col(size) >= least, F.lit(False)), n_train, n_val).select(order, "split")
    last = kept.agg(F.when(F.count("*") == n_train + n_val, F.max(order))).scalar()
    seen = items.join(kept, order, "left").where(F.coalesce(F.col(order) <= last, F.lit(True)))
    reason = F.when(F.col(size).isNull(), "skip: unreadable").otherwise(F.concat(F.lit("skip: "), F.col(size).cast("string"), F.lit(f" < {least}")))
    return seen.withColumn("split", F.coalesce("split", reason))


def split_by_any(items: DataFrame, by: str, marked: DataFrame, key: str) -> DataFrame:
    """(by, split, n): groups with any item whose ``key`` is in ``marked`` are train, all others test; a null group is one of its own."""
    hit = marked.select(key).distinct().withColumn("hit", F.lit(True))
    groups = items.join(hit, key, "left").groupBy(by).agg(F.count("*").alias("n"), F.max(F.coalesce("hit", F.lit(False))).alias("any"))
    return groups.select(by, F.when(F.col("any"), "train").otherwise("test").alias("split"), "n")


def training_trace(history: DataFrame, patience: int, budget: float) -> DataFrame:
    """``history(run, epoch, val, sec)`` with the running best, epochs since it, and whether early stop or the time budget end the run.

    An epoch is over budget if the time so far and one more mean epoch exceed ``budget``.
    """
    w = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    best = F.min("val").over(w)
    traced = history.withColumn("best", best)
    last = F.max(F.when(F.col("val") == F.col("best"), F.col("epoch"))).over(w)
    return traced.withColumn("since", F.col("epoch") - last).withColumns(
        {"stop": F.col("since") >= patience, "over_budget": F.sum("sec").over(w) + F.avg("sec").over(w) > budget}
    )
