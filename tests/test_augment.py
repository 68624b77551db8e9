"""Disabled augmentation groups, draws without a safe centre, draws under other partitions."""

import pytest
from pyspark.sql import functions as F

from layerframe.iterate import cut
from layerframe.operators import augment as A
from layerframe.operators import pixels as P


@pytest.fixture(scope="module")
def ramp(spark):
    """Two 12 × 10 images with values in 0..1."""
    g = spark.range(2).select(F.col("id").alias("image_id")).withColumn("y", F.explode(F.expr("sequence(0, 9)"))).withColumn("x", F.explode(F.expr("sequence(0, 11)")))
    return g.withColumn("v", (F.col("x") + 12 * F.col("y")) / 119.0)


def test_everything_off_is_a_plain_resize(spark, ramp):
    draws = A.draw_table(ramp.select("image_id").distinct(), ["image_id"], 1, 3, disable=("all",))
    out = A.stem_pipeline(ramp, ramp.withColumn("v", F.lit(1.0)), draws, ["image_id"], out_size=6, seed=1)
    size = ramp.select("image_id").distinct().select("image_id", F.lit(12).alias("w"), F.lit(10).alias("h"))
    want = P.resize(ramp, 6, 6, "bilinear", ["image_id"], size).select("image_id", "x", "y", (F.col("v") * 2 - 1).alias("want"))
    rows = out.join(want, ["image_id", "x", "y"]).collect()
    assert len(rows) == 2 * 36 and all(r.v == pytest.approx(r.want, abs=1e-6) and r.reason is None for r in rows)


def test_a_draw_without_a_safe_centre_keeps_a_row(spark, ramp):
    draws = A.draw_table(ramp.select("image_id").distinct(), ["image_id"], 1, 3, {"crop": {"side": 6.0, "safe_radius": 1.0}}, disable=("noise", "perspective", "rotate"))
    mask = ramp.withColumn("v", F.when(F.col("image_id") == 0, 1.0).otherwise(0.0))
    out = A.stem_pipeline(ramp, mask, draws, ["image_id"], out_size=4, seed=1).groupBy("image_id").agg(F.count("v").alias("n"), F.max("reason").alias("reason"), F.count("*").alias("rows"))
    got = {r.image_id: (r.n, r.reason, r.rows) for r in out.collect()}
    assert got == {0: (16, None, 16), 1: (0, "no_safe_center", 1)}


def test_disabled_groups_keep_their_values(spark, ramp):
    im = ramp.select("image_id").distinct()
    on, off = (A.draw_table(im, ["image_id"], 2, 3, disable=d).orderBy("image_id", "draw").collect() for d in ((), ("noise", "display")))
    assert [r.noise_dwell_time_s for r in on] == [r.noise_dwell_time_s for r in off]
    assert all(not r.noise_enabled and not r.display_enabled and r.display_gain == 1.0 and r.crop_enabled for r in off)


def test_geometry_does_not_depend_on_partitions(spark, ramp):
    plan = ramp.select("image_id").distinct().selectExpr("image_id", "12 AS w", "10 AS h", "1.5 AS sigma_px", "1e-3 AS row_time", "60.0 AS freq", "0.4 AS phase_x", "1.0 AS phase_y")

    def every(n):
        px, size = ramp.repartition(n, "x", "y"), plan.select("image_id", "w", "h").repartition(n)
        parts = [P.scan_jitter(px, plan.repartition(n), 5, ["image_id"]), P.edge_mask(px, size, 0.8, 0.0, 0.05, 7, ["image_id"]), P.gaussian_noise(px, 0.1, 9, ["image_id"]),
                 P.random_crop_plan(size, 4, 8, 11, ["image_id"])]
        # the sum of the bilinear taps may differ in its last digit
        return [sorted(tuple(round(v, 9) for v in r) for r in p.collect()) for p in parts]

    a, b = every(1), every(5)
    assert a == b and len(a[0]) == 240


def test_stored_pixels_are_never_broadcast(spark, ramp):
    """Pixels are far smaller as files than as rows: joined with tables of images they go by merge."""
    px, size = cut(ramp), cut(P.image_size(ramp))
    made = [P.gaussian_noise(px, 0.1, 1), P.poisson_noise(px, F.lit(9.0), 1), P.flip(px, size, F.lit(True), F.lit(False)), P.edge_mask(px, size, 0.5, 0.0, 0.1, 1)]
    for df in made:
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 240
