"""Tables that leave the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.functions.scalar import half_even
from driftloom.operators.lineage import lineage_tracks
from driftloom.operators.numbering import row_numbers
from driftloom.plans.lineage import cut


def submission_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node rows, then edge rows of each dataset under one running id from 0; -1 where a column doesn't apply.

    The id counts the rows of earlier (dataset, kind) blocks and numbers each block by ranges, so that only
    sizes meet in one task.
    """
    none = lambda c, kind="long": F.lit(-1).cast(kind).alias(c)
    rows = nodes.select(
        "dataset", F.lit(0).alias("k"), F.col("node_id").alias("a"), F.lit(0).cast("long").alias("b"), "node_id", F.col("t").cast("int").alias("t"),
        *[half_even(F.col(c)).alias(c) for c in "zyx"], none("source_id"), none("target_id"),
    ).unionByName(edges.select("dataset", F.lit(1).alias("k"), F.col("source_id").alias("a"), F.col("target_id").alias("b"), none("node_id"), none("t", "int"), none("z", "int"), none("y", "int"), none("x", "int"), "source_id", "target_id"))
    sizes = rows.groupBy("dataset", "k").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("dataset", "k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    numbered = row_numbers(rows, ["dataset", "k"], ["a", "b"], "place").join(before, ["dataset", "k"])
    return numbered.select(
        (F.col("before") + F.col("place") - 1).alias("id"), F.col("dataset").cast("string").alias("dataset"), F.when(F.col("k") == 0, "node").otherwise("edge").alias("row_type"), "node_id", "t", "z", "y", "x", "source_id", "target_id"
    )


def write_submission(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    submission_table(nodes, edges).write.mode("overwrite").csv(path, header=True)


def write_tracks(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Label, begin, end and parent by label, separated by blanks, a folder a dataset."""
    lineage_tracks(nodes, edges).repartition("dataset").sortWithinPartitions("dataset", "label").write.mode("overwrite").partitionBy("dataset").csv(path, sep=" ")


def write_history(history: DataFrame, path: str) -> None:
    history.write.mode("overwrite").csv(path, header=True)


def write_split(samples: DataFrame, path: str) -> None:
    """The names in each split, one JSON object a split."""
    samples.groupBy("split").agg(F.sort_array(F.collect_list("dataset")).alias("datasets")).write.mode("overwrite").json(path)


def read_split(spark: SparkSession, path: str) -> DataFrame:
    """(split, dataset) of what ``write_split`` wrote."""
    return spark.read.schema("split string, datasets array<string>").json(path).select("split", F.explode("datasets").alias("dataset"))


def sample_list(images: DataFrame, graphs: DataFrame, stem: str) -> DataFrame:
    """The stems that have both, with their place ``ord`` in order."""
    both = images.join(graphs, stem, "left_semi").select(stem)
    # the place counts the rows of earlier ranges, so that no task holds all rows
    ranged = both.repartitionByRange(stem).sortWithinPartitions(stem).withColumn("part", F.spark_partition_id())
    return _numbered(ranged, stem)


def lookup_with_fallback(wanted: DataFrame, listing: DataFrame, stem: str) -> DataFrame:
    """``wanted`` with the first ``path`` that ``listing`` has for its stem, else the first of all; null if nothing is listed."""
    own = listing.groupBy(stem).agg(F.min("path").alias("_own"))
    return wanted.join(own, stem, "left").withColumn("path", F.coalesce("_own", listing.agg(F.min("path")).scalar())).drop("_own")


def _numbered(ranged: DataFrame, order: str) -> DataFrame:
    own = cut(ranged)
    sizes = own.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("part").orderBy(order))
    return own.withColumn("place", place).join(before, "part").select(order, (F.col("before") + F.col("place") - 1).alias("ord"))
