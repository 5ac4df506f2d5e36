"""Movies as tables: one row a frame, partitioned so that a scan reads only the frames it needs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.scalar import stem_of

#: (dataset, t, shape, data): ``data`` holds the voxels as little-endian unsigned 16-bit integers in z, y, x order.
FRAMES = T.StructType([T.StructField("dataset", T.StringType()), T.StructField("t", T.IntegerType()), T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.BinaryType())])


def write_frames(frames: DataFrame, path: str) -> None:
    frames.write.mode("overwrite").partitionBy("dataset", "t").parquet(path)


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """The frames under ``path``; filters on dataset and t prune folders before any data is read."""
    return spark.read.schema("shape array<int>, data binary, dataset string, t int").parquet(path).select("dataset", "t", "shape", "data")


def read_graph(spark: SparkSession, nodes_path: str, edges_path: str | None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a ground-truth graph; without an edge table the edges are empty."""
    nodes = spark.read.parquet(nodes_path).select("dataset", F.col("node_id").cast("long").alias("node_id"), *[F.col(c).cast("int").alias(c) for c in "tzyx"])
    if edges_path is None:
        return nodes, spark.createDataFrame([], "dataset int, source_id long, target_id long")
    return nodes, spark.read.parquet(edges_path).select("dataset", F.col("source_id").cast("long").alias("source_id"), F.col("target_id").cast("long").alias("target_id"))


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if there is no such folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in store.listStatus(path)) if store.exists(path) else []


def read_graph_raw(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(nodes, edges) of a graph stored as a folder of columns: ``nodes/ids`` (ord, node_id), a property a folder
    of ``nodes/props``, with its rows (ord, value) in ``values`` or else in the property's folder itself, and ``edges/ids``.

    Which properties there are follows from the folder; nodes without a value have null.  A property that can't be read and edges that aren't
    there are left out, the edges as None.
    """
    nodes = spark.read.parquet(f"{path}/nodes/ids")
    for name in names_in(spark, f"{path}/nodes/props"):
        own = f"{path}/nodes/props/{name}"
        inside = names_in(spark, own)
        at = f"{own}/values" if "values" in inside else own
        if any(x.endswith(".parquet") for x in names_in(spark, at)):
            nodes = nodes.join(spark.read.parquet(at).select("ord", F.col("value").alias(name)), "ord", "left")
    edges = spark.read.parquet(f"{path}/edges/ids") if names_in(spark, f"{path}/edges/ids") else None
    return nodes.drop("ord"), edges


def find_folder(files: DataFrame, patterns: list[str]) -> DataFrame:
    """(folder): of ``files(path)``, the folder of the smallest path that fits the first of the regular expressions to fit any;
    if none does, the folder with the most files, the smallest of several.  No row without files."""
    rank = F.coalesce(*[F.when(F.col("path").rlike(p), i) for i, p in enumerate(patterns)], F.lit(len(patterns)))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    sums = files.where("path IS NOT NULL").select(rank.alias("rank"), "path", folder.alias("folder")).groupBy("folder").agg(F.min(F.struct("rank", "path")).alias("best"), F.count("*").alias("n"))
    missed = F.col("best.rank") == len(patterns)
    return sums.orderBy("best.rank", F.when(missed, -F.col("n")), F.when(missed, F.col("folder")).otherwise(F.col("best.path"))).limit(1).select("folder")


def points_by_frame(nodes: DataFrame) -> DataFrame:
    """(dataset, t, points): the integer points of each frame, in order."""
    return nodes.groupBy("dataset", "t").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in "zyx"]))).alias("points"))


def listing(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, parent, name, stem, length) of the files under ``path`` whose names fit ``pattern``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("parent"), name.alias("name"), stem_of(F.col("path")).alias("stem"), "length")


def voxels(frames: DataFrame, zeros: bool = False) -> DataFrame:
    """(dataset, t, z, y, x, value): the non-zero voxels of each frame, or all with ``zeros``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dataset, t, shape, data in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                volume = np.frombuffer(data, dtype="<u2").reshape(shape)
                at = np.nonzero(np.ones_like(volume) if zeros else volume)
                n = len(at[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dataset] * n, pa.string()), pa.array(np.full(n, t, np.int32)), *[pa.array(a.astype(np.int32)) for a in at], pa.array(volume[at].astype(np.float64))],
                    names=["dataset", "t", "z", "y", "x", "value"],
                )

    return frames.select("dataset", "t", "shape", "data").mapInArrow(run, "dataset string, t int, z int, y int, x int, value double")


def to_frames(voxels: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """(dataset, t, shape, data): the sparse voxels of each frame as one dense volume of unsigned 16-bit integers, clipped to their range.

    Voxels outside ``shape`` are left out, of several values of a voxel the largest counts, and fractions are cut.
    """
    kinds = dict(voxels.dtypes)

    def run(table: pa.Table) -> pa.Table:
        at = tuple(table.column(c).to_numpy() for c in "zyx")
        inside = np.all([(a >= 0) & (a < n) for a, n in zip(at, shape, strict=True)], axis=0)
        volume = np.zeros(shape, dtype="<u2")
        np.maximum.at(volume, tuple(a[inside] for a in at), np.clip(table.column("value").to_numpy()[inside], 0, 65_535).astype("<u2"))
        frame = [table.column(c).slice(0, 1).combine_chunks() for c in ("dataset", "t")]
        return pa.table([*frame, pa.array([list(shape)], pa.list_(pa.int32())), pa.array([volume.tobytes()], pa.binary())], names=["dataset", "t", "shape", "data"])

    rows = voxels.select("dataset", F.col("t").cast("int").alias("t"), *[F.col(c).cast("int").alias(c) for c in "zyx"], F.col("value").cast("double").alias("value"))
    return rows.groupBy("dataset", "t").applyInArrow(run, f"dataset {kinds['dataset']}, t int, shape array<int>, data binary")
