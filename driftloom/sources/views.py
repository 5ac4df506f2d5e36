"""The tracking tables as views, so that Spark SQL can query them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftloom.sources import fixtures


def register(**tables: DataFrame) -> None:
    """A temporary view for each name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def register_fixtures(spark: SparkSession, sf_dir: str) -> None:
    """``gt_nodes``, ``gt_edges`` and ``detections`` of the fixture tables."""
    nodes = fixtures.gt_nodes(spark, sf_dir)
    register(gt_nodes=nodes, gt_edges=fixtures.gt_edges(nodes), detections=fixtures.detections(spark, sf_dir))
