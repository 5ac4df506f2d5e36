"""Running numbers without a task that holds all rows of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.plans.lineage import cut


def _ranged(rows: DataFrame, keys: list[str]) -> DataFrame:
    return cut(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))


def _before(column: str, by: list[str]):
    """The sum of ``column`` over the earlier parts of ``by``; there is one row a part."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def row_numbers(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``, their number from 1 within ``by`` in the order of ``order``.

    Rows are dealt by ranges of both; a number adds the rows of earlier ranges to the place within its own, so
    that a large group is many tasks.
    """
    ranged = _ranged(rows, [*by, *order])
    sizes = ranged.groupBy(*by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", _before("_n", by)).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    return ranged.withColumn(name, place).join(sizes, [*by, "_part"]).withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def running_total(rows: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """``rows``, unique by ``order``, with ``name``, the sum of ``value`` over all rows before."""
    ranged = _ranged(rows, [order])
    # one row a partition
    sizes = ranged.groupBy("_part").agg(F.sum(value).alias("_n")).withColumn("_before", _before("_n", [])).drop("_n")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn(name, F.coalesce(inside, F.lit(0))).join(sizes, "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")
