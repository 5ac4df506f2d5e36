"""Detectors: from frames to points, a frame a row, the model pluggable."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.config import TrackingConfig
from driftloom.operators import imaging, profile, spatial

KEY = ["dataset", "t"]


def heatmaps(frames: DataFrame, infer: Callable[[np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """(dataset, t, z, y, x, value): where ``infer``, a model from a volume to a heat map of its shape, exceeds ``threshold``.

    The model runs in the tasks, one volume at a time; it is shipped with the function.
    """
    kind = frames.schema["dataset"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (t, shape, data) in enumerate(zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True)):
                heat = infer(np.frombuffer(data, dtype="<u2").reshape(shape).astype(np.float32))
                at = np.nonzero(heat > threshold)
                n = len(at[0])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(np.full(n, i))), pa.array(np.full(n, t, np.int32)), *[pa.array(a.astype(np.int32)) for a in at], pa.array(heat[at].astype(np.float64))],
                    names=["dataset", "t", "z", "y", "x", "value"],
                )

    return frames.select("dataset", "t", "shape", "data").mapInArrow(run, f"dataset {kind.simpleString()}, t int, z int, y int, x int, value double")


def peaks_to_points(peaks: DataFrame) -> DataFrame:
    """(dataset, t, det_id, z, y, x, score): ids by rank within the frame, unique in a movie for up to 2**32 peaks a frame."""
    return peaks.select(*KEY, (F.shiftleft(F.col("t").cast("long"), 32) + F.col("rank")).alias("det_id"), *[F.col(c).cast("double").alias(c) for c in "zyx"], F.col("value").alias("score"))


def detect(heat: DataFrame, raw: DataFrame, config: TrackingConfig, shape: tuple[int, int, int], most: int, pool: int = 1, refine: bool = True) -> DataFrame:
    """Peaks of heat maps, mapped back to the full grid, refined on the raw voxels, thinned by suppression."""
    points = peaks_to_points(imaging.local_maxima(heat, config.threshold, config.min_distance, most))
    if pool > 1:
        points = imaging.unpool_coordinates(points, pool)
    if refine:
        score = points.select(*KEY, "det_id", "score")
        points = imaging.refine_centroids(points, raw, config.refine_window, shape).join(score, [*KEY, "det_id"])
    return spatial.greedy_nms(points, config.nms_radius, config.voxel)


def detect_classical(voxels: DataFrame, config: TrackingConfig, shape: tuple[int, int, int], most: int, sigma: tuple[float, float, float] = (0.7, 2.0, 2.0)) -> DataFrame:
    """Without a model: percentile normalisation, Gaussian smoothing, local maxima.

    ``voxels`` are all voxels of each frame, zeros too, as the percentiles are over the whole volume.
    """
    norm = profile.percentile_normalize(voxels, KEY, "value").select(*KEY, "z", "y", "x", F.col("normalized").alias("value"))
    smooth = imaging.gaussian_blur(norm, sigma, shape)
    return peaks_to_points(imaging.local_maxima(smooth, config.threshold, config.min_distance, most))
