"""Tracking tables derived from ``events``: a user is a cell, a day is a frame, ``user_id % 4`` is the movie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.sources.tables import table


def _point(u, t, shift: int):
    return [
        (u % 4).cast("int").alias("dataset"),
        t.cast("int").alias("t"),
        (u * 37 % 64).cast("int").alias("z"),
        ((u * 101 + shift + t) % 256).cast("int").alias("y"),
        ((u * 53 + t) % 256).cast("int").alias("x"),
    ]


def gt_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, node_id, t, z, y, x): a node a user and active day, and second daughters from day 16 on for some."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), (F.day("ts") - 1).alias("t"))
    seen = events.distinct()
    first = seen.select((F.col("u") * 1000 + F.col("t")).cast("long").alias("node_id"), *_point(F.col("u"), F.col("t"), 0))
    mothers = seen.where("t = 14 AND u % 5 = 0").select("u")
    days = seen.where("t >= 15").select("t").distinct()
    second = mothers.select("u", F.explode(F.sequence(F.lit(15), F.lit(30))).alias("t")).join(days, "t", "left_semi")
    daughters = second.select((F.col("u") * 1000 + 500 + F.col("t")).cast("long").alias("node_id"), *_point(F.col("u"), F.col("t"), 244))
    return first.unionByName(daughters).select("dataset", "node_id", "t", "z", "y", "x")


def gt_edges(nodes: DataFrame) -> DataFrame:
    """(dataset, source_id, target_id): consecutive days of a cell, and mother to second daughter."""
    a = nodes.select("dataset", F.col("node_id").alias("source_id"), "t")
    b = nodes.select("dataset", F.col("node_id").alias("target_id"))
    steps = a.withColumn("target_id", F.col("source_id") + 1).join(b, ["dataset", "target_id"])
    divisions = a.where("t = 14 AND source_id % 1000 = 14").withColumn("target_id", F.col("source_id") + 501).join(b, ["dataset", "target_id"])
    return steps.select("dataset", "source_id", "target_id").unionByName(divisions.select("dataset", "source_id", "target_id"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, det_id, t, z, y, x, score): jittered nodes with misses, and distractors."""
    n = F.col("node_id")
    found = gt_nodes(spark, sf_dir).where("(node_id * 7) % 11 <> 0").select(
        "dataset",
        n.alias("det_id"),
        "t",
        (F.col("z") + 0.25 * (n % 3 - 1)).alias("z"),
        (F.col("y") + 0.5 * (n % 5 - 2)).alias("y"),
        (F.col("x") + 0.5 * (n % 7 - 3) + n / F.lit(1.0e9)).alias("x"),
        ((30 + n * 17 % 70) / F.lit(100.0)).alias("score"),
    )
    e = F.col("event_id")
    noise = table(spark, sf_dir, "events").where("event_id % 3 = 0").select(
        (e % 4).cast("int").alias("dataset"),
        (1_000_000_000 + e).cast("long").alias("det_id"),
        (F.day("ts") - 1).cast("int").alias("t"),
        (e * 7919 % 64 + F.lit(0.5)).alias("z"),
        (e * 104729 % 251 + F.lit(0.25)).alias("y"),
        (e * 1299709 % 241 + e / F.lit(1.0e6)).alias("x"),
        ((10 + e * 31 % 60) / F.lit(100.0)).alias("score"),
    )
    return found.unionByName(noise)


#: The same tables in DuckDB SQL, for the oracles.
FIXTURE_SQL = """
fx_gt_nodes AS (
  SELECT CAST(u % 4 AS INTEGER) AS dataset, CAST(u * 1000 + t AS BIGINT) AS node_id, t, CAST((u * 37) % 64 AS INTEGER) AS z,
         CAST((u * 101 + t) % 256 AS INTEGER) AS y, CAST((u * 53 + t) % 256 AS INTEGER) AS x
  FROM (SELECT DISTINCT user_id AS u, CAST(day(ts) - 1 AS INTEGER) AS t FROM events) e
  UNION ALL
  SELECT CAST(m.u % 4 AS INTEGER), CAST(m.u * 1000 + 500 + d.t AS BIGINT), d.t, CAST((m.u * 37) % 64 AS INTEGER),
         CAST((m.u * 101 + 244 + d.t) % 256 AS INTEGER), CAST((m.u * 53 + d.t) % 256 AS INTEGER)
  FROM (SELECT DISTINCT user_id AS u FROM events WHERE day(ts) = 15 AND user_id % 5 = 0) m,
       (SELECT DISTINCT CAST(day(ts) - 1 AS INTEGER) AS t FROM events WHERE day(ts) >= 16) d),
fx_gt_edges AS (
  SELECT a.dataset, a.node_id AS source_id, b.node_id AS target_id FROM fx_gt_nodes a JOIN fx_gt_nodes b ON b.dataset = a.dataset AND b.node_id = a.node_id + 1
  UNION ALL
  SELECT a.dataset, a.node_id, b.node_id FROM fx_gt_nodes a JOIN fx_gt_nodes b ON b.dataset = a.dataset AND a.t = 14 AND b.node_id = a.node_id + 501
  WHERE a.node_id % 1000 = 14),
fx_detections AS (
  SELECT dataset, node_id AS det_id, t, CAST(z + 0.25e0 * (node_id % 3 - 1) AS DOUBLE) AS z, CAST(y + 0.5e0 * (node_id % 5 - 2) AS DOUBLE) AS y,
         CAST(x + 0.5e0 * (node_id % 7 - 3) + node_id / 1.0e9 AS DOUBLE) AS x, CAST((30 + (node_id * 17) % 70) / 100.0e0 AS DOUBLE) AS score
  FROM fx_gt_nodes WHERE (node_id * 7) % 11 <> 0
  UNION ALL
  SELECT CAST(event_id % 4 AS INTEGER), CAST(1000000000 + event_id AS BIGINT), CAST(day(ts) - 1 AS INTEGER), CAST((event_id * 7919) % 64 + 0.5e0 AS DOUBLE),
         CAST((event_id * 104729) % 251 + 0.25e0 AS DOUBLE), CAST((event_id * 1299709) % 241 + event_id / 1.0e6 AS DOUBLE),
         CAST((10 + (event_id * 31) % 60) / 100.0e0 AS DOUBLE)
  FROM events WHERE event_id % 3 = 0)"""
