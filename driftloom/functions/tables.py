"""Functions for SQL texts: ``register`` makes them known to a session.

Table functions stand in FROM, after LATERAL where they take columns of the tables before them.  They are called a row at a time,
so a text over many rows takes ``gap_points``, a function in SQL whose list goes through ``inline``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf


class InterpolateGap:
    """interpolate_gap(z0, y0, x0, z1, y1, x1, gap): (k, z, y, x) for each of the missing frames 1 to gap, on the line between the two ends.

    A null argument or a gap under 1 gives no row.
    """

    def eval(self, z0: float, y0: float, x0: float, z1: float, y1: float, x1: float, gap: int) -> Iterator[tuple[int, float, float, float]]:
        ends = (z0, y0, x0, z1, y1, x1)
        if gap is None or any(v is None for v in ends):
            return
        for k in range(1, gap + 1):
            part = k / (gap + 1)
            yield k, *(a + (b - a) * part for a, b in zip(ends[:3], ends[3:], strict=True))


class Ancestors:
    """ancestors(path): (depth, folder) for each folder that a path lies in, the outermost at depth 0; no row for null or a path of one step."""

    def eval(self, path: str) -> Iterator[tuple[int, str]]:
        steps = path.split("/") if path is not None else []
        for k in range(1, len(steps)):
            yield k - 1, "/".join(steps[:k])


#: gap_points(z0, y0, x0, z1, y1, x1, gap): what interpolate_gap gives, as a list; null where that gives no row.
GAP_POINTS = """CREATE OR REPLACE TEMPORARY FUNCTION gap_points(z0 DOUBLE, y0 DOUBLE, x0 DOUBLE, z1 DOUBLE, y1 DOUBLE, x1 DOUBLE, gap INT)
RETURNS ARRAY<STRUCT<k: INT, z: DOUBLE, y: DOUBLE, x: DOUBLE>>
RETURN transform(CASE WHEN gap >= 1 AND z0 + y0 + x0 + z1 + y1 + x1 IS NOT NULL THEN sequence(1, gap) END,
  k -> named_struct('k', k, 'z', z0 + (z1 - z0) * (k / (gap + 1)), 'y', y0 + (y1 - y0) * (k / (gap + 1)), 'x', x0 + (x1 - x0) * (k / (gap + 1))))"""


def _half_even(values: pa.Array) -> pa.Array:
    return pc.cast(pc.round(values, round_mode="half_to_even"), pa.int64())


def register(spark: SparkSession) -> None:
    """Makes interpolate_gap, gap_points, ancestors and half_even known to ``spark.sql``."""
    spark.sql(GAP_POINTS)
    spark.udtf.register("interpolate_gap", udtf(InterpolateGap, returnType="k int, z double, y double, x double", useArrow=True))
    spark.udtf.register("ancestors", udtf(Ancestors, returnType="depth int, folder string", useArrow=True))
    spark.udf.register("half_even", arrow_udf(_half_even, "long"))
