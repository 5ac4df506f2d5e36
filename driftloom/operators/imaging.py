"""Voxel operators over sparse rows (dataset, t, z, y, x, value)."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.scalar import half_even, normal, sigmoid, uniform

KEY = ["dataset", "t", "z", "y", "x"]


def _box(points: DataFrame, radius: tuple[int, int, int], shape: tuple[int, int, int], prefix: str = "") -> DataFrame:
    """A row (vz, vy, vx) for each voxel of a box around the integer coordinates, clipped to the volume."""
    for c, r, n in zip("zyx", radius, shape, strict=True):
        at = F.col(prefix + c)
        points = points.withColumn("v" + c, F.explode(F.sequence(F.greatest(at - r, F.lit(0)), F.least(at + r, F.lit(n - 1)))))
    return points


def xy_pool(voxels: DataFrame, size: int, shape: tuple[int, int, int], how: str = "max") -> DataFrame:
    """Blocks of ``size`` x ``size`` in y and x pooled by ``max`` or ``avg``; what doesn't fill a block is cropped."""
    whole = voxels.where((F.col("y") < shape[1] // size * size) & (F.col("x") < shape[2] // size * size))
    block = [F.floor(F.col(c) / size).cast("int").alias(c) for c in "yx"]
    return whole.groupBy("dataset", "t", "z", *block).agg((F.max if how == "max" else F.avg)("value").alias("value"))


def unpool_coordinates(points: DataFrame, size: int) -> DataFrame:
    """Pooled y and x coordinates on the full grid."""
    return points.withColumns({c: F.col(c) * size for c in "yx"})


def refine_centroids(points: DataFrame, voxels: DataFrame, window: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """``points(dataset, t, det_id, z, y, x)`` moved to the intensity-weighted centre of the window around their
    half-even rounded place; a window without intensity leaves a point as it is."""
    rounded = points.select("dataset", "t", "det_id", *[half_even(F.col(c)).alias(c) for c in "zyx"])
    box = _box(rounded, window, shape).select("dataset", "t", "det_id", *[F.col("v" + c).alias(c) for c in "zyx"])
    patch = box.join(voxels, KEY)
    total = F.sum("value")
    centre = patch.groupBy("dataset", "t", "det_id").agg(total.alias("s"), *[(F.sum(F.col("value") * F.col(c)) / total).alias("c" + c) for c in "zyx"]).where("s > 0")
    moved = points.join(centre, ["dataset", "t", "det_id"], "left")
    return moved.select("dataset", "t", "det_id", *[F.coalesce(F.col("c" + c), F.col(c).cast("double")).alias(c) for c in "zyx"])


def stamp_radius(sigma: tuple[float, float, float]) -> tuple[int, int, int]:
    return tuple(max(1, round(3 * s)) for s in sigma)


def _by_frame(rows: DataFrame, run: Callable[[pa.Table], list], schema: str) -> DataFrame:
    """A task a frame: ``run`` gets the rows of one and returns columns for ``schema``, which dataset and t come before."""
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def work(table: pa.Table) -> pa.Table:
        columns = run(table)
        frame = [table.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(columns[0]), np.int64))) for c in ("dataset", "t")]
        return pa.table([*frame, *columns], names=["dataset", "t", *names])

    return rows.groupBy("dataset", "t").applyInArrow(work, f"dataset {kinds['dataset']}, t {kinds['t']}, {schema}")


def _places(table: pa.Table) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in "zyx"], axis=1).astype(np.int64)


def _stamped(points: np.ndarray, sigma: tuple[float, float, float], shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The largest bell at each voxel of a dense volume, and which voxels any bell reaches."""
    heat, touched, reach = np.zeros(shape), np.zeros(shape, bool), stamp_radius(sigma)
    for p in points:
        low = [max(int(c) - r, 0) for c, r in zip(p, reach, strict=True)]
        high = [min(int(c) + r, n - 1) + 1 for c, r, n in zip(p, reach, shape, strict=True)]
        if any(a >= b for a, b in zip(low, high, strict=True)):
            continue
        d = [(np.arange(a, b) - c) ** 2 / (2.0 * s * s) for a, b, c, s in zip(low, high, p, sigma, strict=True)]
        box = tuple(slice(a, b) for a, b in zip(low, high, strict=True))
        np.maximum(heat[box], np.exp(-(d[0][:, None, None] + d[1][:, None] + d[2])), out=heat[box])
        touched[box] = True
    return heat, touched


def gaussian_stamp(points: DataFrame, sigma: tuple[float, float, float], shape: tuple[int, int, int]) -> DataFrame:
    """(dataset, t, z, y, x, heat): the largest of the points' Gaussian bells at each voxel that one reaches; a task stamps one frame in a dense volume."""

    def run(table: pa.Table) -> list:
        heat, touched = _stamped(_places(table), sigma, shape)
        at = np.nonzero(touched)
        return [*(pa.array(c.astype(np.int32)) for c in at), pa.array(heat[at])]

    return _by_frame(points.select(*KEY), run, "z int, y int, x int, heat double")


def dilate(voxels: DataFrame, rounds: int, shape: tuple[int, int, int]) -> DataFrame:
    """The voxels within ``rounds`` steps along the axes of a set of voxels."""
    steps = [(dz, dy, dx) for dz in range(-rounds, rounds + 1) for dy in range(-rounds, rounds + 1) for dx in range(-rounds, rounds + 1) if abs(dz) + abs(dy) + abs(dx) <= rounds]
    moves = F.explode(F.array(*[F.struct(*[F.lit(v).alias("d" + c) for c, v in zip("zyx", s, strict=True)]) for s in steps]))
    moved = voxels.select(*KEY).withColumn("d", moves).select("dataset", "t", *[(F.col(c) + F.col("d.d" + c)).alias(c) for c in "zyx"])
    return moved.where(" AND ".join(f"{c} BETWEEN 0 AND {n - 1}" for c, n in zip("zyx", shape, strict=True))).distinct()


def training_targets(points: DataFrame, voxels: DataFrame, sigma: tuple[float, float, float], shape: tuple[int, int, int], foreground: float, weight: float, near_eps: float, rounds: int) -> DataFrame:
    """(dataset, t, z, y, x, target, weight) for normalised ``voxels``: near a point the weight is ``weight``,
    bright voxels away from all points are ignored, all others weigh 1.

    A task stamps one frame in a dense volume of ``shape``, rather than make a row of each voxel of each bell.
    """
    none = F.lit(None).cast("double")
    rows = voxels.select(*KEY, F.col("value").cast("double").alias("value"), F.lit(False).alias("point"))
    rows = rows.unionByName(points.select(*KEY, none.alias("value"), F.lit(True).alias("point")))

    def run(table: pa.Table) -> pa.Table:
        point = table.column("point").to_numpy()
        at = np.stack([table.column(c).to_numpy() for c in "zyx"], axis=1).astype(int)
        heat, _ = _stamped(at[point], sigma, shape)
        near = heat > near_eps
        wide = near.copy()
        for _ in range(rounds):
            grown = wide.copy()
            for axis in range(3):
                ahead, behind = (tuple(s if k == axis else slice(None) for k in range(3)) for s in (slice(1, None), slice(None, -1)))
                grown[ahead] |= wide[behind]
                grown[behind] |= wide[ahead]
            wide = grown
        own = table.filter(pa.array(~point))
        z, y, x = at[~point].T
        value = own.column("value").to_numpy()
        w = np.where(near[z, y, x], weight, np.where((value > foreground) & ~wide[z, y, x], 0.0, 1.0))
        return own.select(KEY).append_column("target", pa.array(heat[z, y, x])).append_column("weight", pa.array(w))

    kinds = dict(rows.dtypes)
    return rows.groupBy("dataset", "t").applyInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", target double, weight double")


def masked_mse(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by..., loss) of rows (logit, target, weight): the weighted mean squared error of the sigmoid."""
    e = sigmoid(F.col("logit")) - F.col("target")
    return rows.groupBy(*by).agg((F.sum(e * e * F.col("weight")) / (F.sum("weight") + 1e-6)).alias("loss"))


def local_maxima(voxels: DataFrame, threshold: float, distance: int, most: int) -> DataFrame:
    """(dataset, t, z, y, x, value, rank): voxels above ``threshold`` that no voxel within ``distance`` along each
    axis beats, the ``most`` largest of a frame.  Equal neighbours give way to the first by z, y, x.

    A task takes one frame and lays out the box that its bright voxels lie in.
    """
    bright = voxels.where(F.col("value") > threshold).select(*KEY, F.col("value").cast("double").alias("value"))

    def run(table: pa.Table) -> list:
        at, value = _places(table), table.column("value").to_numpy()
        low = at.min(axis=0) - distance
        volume = np.full(tuple(at.max(axis=0) - low + 1 + distance), -np.inf)
        np.maximum.at(volume, tuple((at - low).T), value)
        top = volume.copy()
        for axis in range(3):
            before = top.copy()
            for k in range(1, distance + 1):
                ahead, behind = (tuple(s if c == axis else slice(None) for c in range(3)) for s in (slice(k, None), slice(None, -k)))
                np.maximum(top[ahead], before[behind], out=top[ahead])
                np.maximum(top[behind], before[ahead], out=top[behind])
        best = np.argwhere((volume == top) & (volume > -np.inf))  # in the order of z, y, x
        # of equal ones the first: any equal voxel at an earlier offset
        span = np.arange(-distance, distance + 1)
        offsets = np.stack(np.meshgrid(span, span, span, indexing="ij"), axis=-1).reshape(-1, 3)[: len(span) ** 3 // 2]
        own, first = volume[tuple(best.T)], np.ones(len(best), bool)
        for o in offsets:
            first &= volume[tuple((best + o).T)] != own
        best, own = best[first], own[first]
        order = np.argsort(-own, kind="stable")[:most]
        found = best[order] + low
        return [*(pa.array(c.astype(np.int32)) for c in found.T), pa.array(own[order]), pa.array(np.arange(1, len(order) + 1, dtype=np.int32))]

    return _by_frame(bright, run, "z int, y int, x int, value double, rank int")


def paint(nodes: DataFrame, radius: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """(dataset, t, z, y, x, label): a box around each of ``nodes(dataset, t, label, z, y, x, ord)``, the first by ``ord`` wins a
    voxel, but a centre belongs to its own node, the last of several."""
    box = _box(nodes, radius, shape)
    first = box.groupBy("dataset", "t", *[F.col("v" + c).alias(c) for c in "zyx"]).agg(F.min_by("label", "ord").alias("painted"))
    centres = nodes.groupBy(*KEY).agg(F.max_by("label", "ord").alias("centre"))
    return first.join(centres, KEY, "left").select(*KEY, F.coalesce("centre", "painted").alias("label"))


def _blur_matrix(sigma: float, n: int, truncate: float) -> np.ndarray:
    """What each voxel along an axis of ``n`` gives to each other: itself and its mirror images at both ends."""
    reach = int(truncate * sigma + 0.5)
    taps = np.array([math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)])
    taps /= taps.sum()
    out, p = np.zeros((n, n)), np.arange(n)
    for image in (p, -1 - p, 2 * n - 1 - p):
        for k, w in zip(range(-reach, reach + 1), taps, strict=True):
            q = image - k
            inside = (q >= 0) & (q < n)
            np.add.at(out, (q[inside], p[inside]), w)
    return out


def gaussian_blur(voxels: DataFrame, sigma: tuple[float, float, float], shape: tuple[int, int, int], truncate: float = 4.0) -> DataFrame:
    """Separable Gaussian smoothing of non-zero voxels, reflected at the borders (the border voxel repeats): a row for each voxel that any voxel reaches.

    A task smooths one frame as a dense volume of ``shape``, an axis after the other.
    """

    def run(table: pa.Table) -> list:
        volume, reached = np.zeros(shape), np.zeros(shape)
        at = tuple(_places(table).T)
        np.add.at(volume, at, table.column("value").to_numpy())
        reached[at] = 1
        for axis, (s, n) in enumerate(zip(sigma, shape, strict=True)):
            taps = _blur_matrix(s, n, truncate)
            volume = np.moveaxis(np.tensordot(taps, volume, axes=(1, axis)), 0, axis)
            reached = np.moveaxis(np.tensordot((taps > 0).astype(float), reached, axes=(1, axis)), 0, axis)
        at = np.nonzero(reached)
        return [*(pa.array(c.astype(np.int32)) for c in at), pa.array(volume[at])]

    return _by_frame(voxels.select(*KEY, F.col("value").cast("double").alias("value")), run, "z int, y int, x int, value double")


def flip_rotate(voxels: DataFrame, shape: tuple[int, int, int], flips: str = "", swap: bool = False) -> DataFrame:
    """Mirror images along the axes in ``flips``, and x and y exchanged with ``swap``."""
    done = {c: (F.lit(n - 1) - F.col(c) if c in flips else F.col(c)) for c, n in zip("zyx", shape, strict=True)}
    return voxels.withColumns({"z": done["z"], "y": done["x"] if swap else done["y"], "x": done["y"] if swap else done["x"]})


def random_flips(voxels: DataFrame, shape: tuple[int, int, int], seed: int) -> DataFrame:
    """Each frame mirrored along each axis, and its x and y exchanged, with a chance of one half each.

    Frames must be square in y and x, as exchanging the axes keeps the shape.
    """
    coin = lambda name: uniform(seed, F.lit(name), F.col("dataset"), F.col("t")) < 0.5
    done = {c: F.when(coin("flip " + c), F.lit(n - 1) - F.col(c)).otherwise(F.col(c)) for c, n in zip("zyx", shape, strict=True)}
    swap = coin("swap")
    return voxels.withColumns({"z": done["z"], "y": F.when(swap, done["x"]).otherwise(done["y"]), "x": F.when(swap, done["y"]).otherwise(done["x"])})


def random_intensity(
    voxels: DataFrame, seed: int, gamma: tuple[float, float] = (0.8, 1.2), contrast: tuple[float, float] = (0.8, 1.2), brightness: float = 0.05, noise: float = 0.02
) -> DataFrame:
    """Values from 0 to 1 after a gamma, a contrast with brightness, and noise, each with a chance of one half a frame and clipped to 0..1.

    The seed and the frame fix all draws, those of the noise also the voxel; so no order of rows and no lost task changes them.
    """
    frame = [F.col("dataset"), F.col("t")]
    drawn = lambda name, low, high: low + (high - low) * uniform(seed, F.lit(name), *frame)
    steps = {
        "gamma": lambda v: F.pow(v, drawn("gamma", *gamma)),
        "contrast": lambda v: v * drawn("contrast", *contrast) + drawn("brightness", -brightness, brightness),
        "noise": lambda v: v + noise * normal(seed, *[F.col(c) for c in KEY]),
    }
    value = F.col("value")
    for name, step in steps.items():
        value = F.when(uniform(seed, F.lit("use " + name), *frame) < 0.5, F.least(F.greatest(step(value), F.lit(0.0)), F.lit(1.0))).otherwise(value)
    return voxels.withColumn("value", value)


def patch_centres(
    frames: DataFrame, points: DataFrame, draws: int, size: tuple[int, int, int], shape: tuple[int, int, int], seed: int, positive: float = 0.7, jitter: float = 0.25
) -> DataFrame:
    """(dataset, t, draw, cz, cy, cx): centres of ``draws`` patches of each of the distinct ``frames(dataset, t)``.

    With the chance ``positive`` a centre is one of the frame's ``points``, moved by up to ``jitter`` of the size; else, or without
    points, it is any voxel.  Centres are moved so that patches lie inside the volume.  The seed fixes all draws.
    """
    order = Window.partitionBy("dataset", "t").orderBy("z", "y", "x")
    placed = points.select("dataset", "t", *[F.col(c).cast("int").alias(c) for c in "zyx"]).withColumn("place", F.row_number().over(order) - 1)
    sizes = placed.groupBy("dataset", "t").agg(F.count("*").alias("n"))
    drawn = frames.select("dataset", "t").join(sizes, ["dataset", "t"], "left").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    u = lambda name: uniform(seed, F.lit(name), F.col("dataset"), F.col("t"), F.col("draw"))
    drawn = drawn.withColumn("place", F.when(u("positive") < positive, F.floor(u("point") * F.col("n")).cast("int")))
    found = drawn.join(placed, ["dataset", "t", "place"], "left")
    centre = {}
    for c, s, n in zip("zyx", size, shape, strict=True):
        moved = F.col(c) + ((2 * u("jitter " + c) - 1) * jitter * s).cast("int")
        somewhere = F.floor(u("voxel " + c) * n).cast("int")
        half = s // 2
        centre["c" + c] = F.least(F.greatest(F.coalesce(moved, somewhere), F.lit(half)), F.lit(max(half, n - (s - half))))
    return found.withColumns(centre).select("dataset", "t", "draw", *centre)


def crop(voxels: DataFrame, centre: DataFrame, size: tuple[int, int, int], shape: tuple[int, int, int]) -> DataFrame:
    """The box of ``size`` around each ``centre(dataset, t[, draw], cz, cy, cx)``, moved inside the volume; coordinates from 0.

    A frame may have several centres, each with a ``draw`` of its own, which then tells their boxes apart.
    """
    draw = ["draw"] if "draw" in centre.columns else []
    for c, s, n in zip("zyx", size, shape, strict=True):
        centre = centre.withColumn("o" + c, F.greatest(F.lit(0), F.least(F.col("c" + c) - s // 2, F.lit(max(n - s, 0)))))
    inside = voxels.join(centre.select("dataset", "t", *draw, "oz", "oy", "ox"), ["dataset", "t"])
    for c, s in zip("zyx", size, strict=True):
        inside = inside.where(F.col(c).between(F.col("o" + c), F.col("o" + c) + s - 1)).withColumn(c, F.col(c) - F.col("o" + c))
    return inside.drop("oz", "oy", "ox")
