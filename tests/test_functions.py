import math

from pyspark.sql import functions as F

from driftloom.functions import scalar
from driftloom.sources import views


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_scalars(spark):
    r = one(
        spark,
        even=scalar.half_even(F.lit(2.5)), up=scalar.half_even(F.lit(3.5)), down=scalar.toward_zero(F.lit(-1.9)),
        wide=scalar.wider_than(F.lit(math.cos(math.radians(76))), 75.0), narrow=scalar.wider_than(F.lit(math.cos(math.radians(74))), 75.0),
        none=scalar.safe_ratio(F.lit(1), F.lit(0), None), zero=scalar.safe_ratio(F.lit(1), F.lit(0)), half=scalar.safe_ratio(F.lit(1), F.lit(2)),
        ahead=scalar.predicted(F.lit(1.0), F.lit(2.0), 0.5), still=scalar.predicted(F.lit(1.0), F.lit(None).cast("double"), 0.5),
        clip=scalar.scaled_between(F.lit(9.0), F.lit(0.0), F.lit(1.0)), angle=scalar.clipped_angle(F.lit(-1.0), F.lit(1.0)), rate=scalar.cosine_rate(F.lit(0), 60, 1e-3, 1e-5),
        stem=scalar.stem_of(F.lit("/a/b.c/x.y.zarr")), mid=scalar.sigmoid(F.lit(0.0)), jitter=scalar.intensity_jitter(F.lit(0.25), 0.5, 2.0, 0.25, F.lit(0.0)),
    )
    assert (r["even"], r["up"], r["down"], r["wide"], r["narrow"], r["none"], r["zero"], r["half"]) == (2, 4, -1, True, False, None, 0.0, 0.5)
    assert (r["ahead"], r["still"], r["clip"], r["rate"], r["stem"], r["mid"], r["jitter"]) == (2.0, 1.0, 1.0, 1e-3, "x.y", 0.5, 1.0) and abs(r["angle"] - 180) < 0.01


def test_views(spark, sf):
    views.register_fixtures(spark, sf)
    assert spark.sql("SELECT count(*) AS n FROM gt_edges e JOIN gt_nodes n ON n.node_id = e.source_id").first()["n"] == spark.table("gt_edges").count() > 0
