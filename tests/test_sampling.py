"""Sampling at fractional places: against a plain loop, and how many rows meet the pixels."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.operators import pixels as P


def place(c, n, border):
    if border == "edge":
        return min(max(c, 0), n - 1)
    if border == "reflect101":
        m = c % max(1, 2 * (n - 1))
        return min(m, max(1, 2 * (n - 1)) - m)
    return c


def plain(targets, pixels, method, border):
    out = {}
    for x, y, sx, sy, w, h in targets:
        fx, fy = (math.floor(sx + 0.5), math.floor(sy + 0.5)) if method == "nearest" else (math.floor(sx), math.floor(sy))
        ax, ay = (0.0, 0.0) if method == "nearest" else (sx - fx, sy - fy)
        taps = [(fx + i, fy + j, (ax if i else 1 - ax) * (ay if j else 1 - ay)) for i in (0, 1) for j in (0, 1)]
        met = [(wt, pixels[p]) for tx, ty, wt in taps if wt > 0 and (p := (place(tx, w, border), place(ty, h, border))) in pixels]
        if met or border == "constant":
            out[x, y] = sum(wt * (v or 0.0) for wt, v in met)
    return out


@pytest.mark.parametrize("method", ["bilinear", "nearest"])
@pytest.mark.parametrize("border", ["edge", "reflect101", "constant"])
@pytest.mark.parametrize("w,h", [(21, 18), (1, 2)])
def test_places_equal_a_plain_loop(spark, method, border, w, h):
    """Blocks of several sides, places outside the frame, missing and null pixels."""
    rng = np.random.default_rng(3)
    pixels = {(x, y): None if (x, y) == (3, 3) else float(rng.normal()) for x in range(w) for y in range(h) if w == 1 or (x * 7 + y) % 11}
    targets = [(i, 0, float(a), float(b), w, h) for i, (a, b) in enumerate(np.r_[rng.uniform(-30, 50, (300, 2)), rng.integers(-9, 30, (80, 2)), rng.uniform(6, 10, (80, 2))])]
    px = spark.createDataFrame([(1, x, y, v) for (x, y), v in pixels.items()], "image_id int, x int, y int, v double")
    t = spark.createDataFrame([(1, *r) for r in targets], "image_id int, x int, y int, sx double, sy double, w int, h int")
    got = {(r.x, r.y): r.v for r in P.sample_at(t, px, method, border).collect()}
    want = plain(targets, pixels, method, border)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_repeated_pixels_add_up(spark):
    px = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 0, 2.0), (1, 1, 0, 5.0)], "image_id int, x int, y int, v double")
    t = spark.createDataFrame([(1, 0, 0, 0.5, 0.0, 2, 1)], "image_id int, x int, y int, sx double, sy double, w int, h int")
    assert [r.v for r in P.sample_at(t, px).collect()] == [4.0]


def test_a_place_is_one_row(spark):
    """No row per tap is joined or aggregated: 400 places and one image make one exchange of 400 rows and of few blocks."""
    px = spark.range(64).select(F.lit(1).alias("image_id"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") / 8).cast("int").alias("y"), F.col("id").cast("double").alias("v"))
    t = spark.range(400).select(F.lit(1).alias("image_id"), F.col("id").alias("x"), F.lit(0).alias("y"), (F.col("id") / 60.0).alias("sx"), F.lit(2.5).alias("sy"), F.lit(8).alias("w"), F.lit(8).alias("h"))
    plan = P.sample_at(t, px)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("SortMergeJoin", plan)) == 1 and not re.search(r"sum\(", plan) and "BroadcastExchange" not in plan


def test_layout_is_dealt_out(spark):
    """The frames of many images are laid out by all tasks, not by the one that holds their sizes."""
    size = spark.range(400).select(F.col("id").alias("image_id"), F.lit(8).alias("w"), F.lit(8).alias("h")).coalesce(1)
    rows = P.grid_of(size, F.col("w"), F.col("h")).groupBy(F.spark_partition_id()).count().collect()
    assert len(rows) > 1 and sum(r["count"] for r in rows) == 25600


def test_jitter_is_laid_out_by_all_tasks(spark):
    """The rows of all images come from one small table of sizes, which is dealt out before they are made."""
    px = spark.range(640).select(F.floor(F.col("id") / 64).alias("image_id"), (F.col("id") % 8).cast("int").alias("x"), F.floor(F.col("id") % 64 / 8).cast("int").alias("y"), F.lit(1.0).alias("v"))
    plan = P.image_size(px).withColumns({"sigma_px": F.lit(0.8), "row_time": F.lit(8e-4), "freq": F.lit(60.0), "phase_x": F.lit(0.0), "phase_y": F.lit(1.0)})
    out = P.scan_jitter(px, plan, 5)
    assert "RoundRobinPartitioning" in out._jdf.queryExecution().executedPlan().toString() and out.count() == 640
