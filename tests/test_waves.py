"""Thinning as a wave over blocks, and distance maps, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerframe.operators import augment as A
from layerframe.operators import blobs as B
from layerframe.operators import distance, wavefront


def serial(points, d):
    """Kept ids of (id, x, y) in the given order."""
    kept, grid = [], {}
    for i, x, y in points:
        c = math.floor(x / d), math.floor(y / d)
        if all((x - u) ** 2 + (y - v) ** 2 >= d * d for p in (-1, 0, 1) for q in (-1, 0, 1) for u, v in grid.get((c[0] + p, c[1] + q), ())):
            kept.append(i)
            grid.setdefault(c, []).append((x, y))
    return kept


@pytest.mark.parametrize("side", [8.0, 256.0])
def test_wave_equals_the_serial_loop(spark, monkeypatch, side):
    """Ranks in raster order and at random, negative coordinates, coincident points, several groups."""
    monkeypatch.setattr(wavefront, "SIDE", side)
    monkeypatch.setattr(wavefront, "REACHES", 2.0)
    rng = np.random.default_rng(1)
    rows = []
    for g, n in (("a", 900), ("b", 60), (None, 5)):
        xy = np.round(rng.uniform(-40, 40, (n, 2)), 1)
        xy[: n // 3] = np.round(xy[: n // 3] / 20, 1)
        order = rng.permutation(n)
        rows += [(g, i, float(x), float(y), int(order[i])) for i, (x, y) in enumerate(xy)]
    df = spark.createDataFrame(rows, "g string, pt_id int, x double, y double, at int")
    for rank, order in (("at", lambda r: r[4]), ("rk", lambda r: (r[3], r[2], r[1]))):
        got = wavefront.settle(df.withColumn("rk", F.struct("y", "x", "pt_id")), ["g"], 4.0, rank).collect()
        for g in ("a", "b", None):
            want = serial([r[1:4] for r in sorted((r for r in rows if r[0] == g), key=order)], 4.0)
            assert sorted(r.pt_id for r in got if r.g == g) == sorted(want)


def test_wave_over_a_solid_region(spark, monkeypatch):
    """300 × 300 pixels over blocks of 64: as many rounds as block diagonals, and the loop's points."""
    monkeypatch.setattr(wavefront, "SIDE", 64.0)
    rounds = []
    monkeypatch.setattr(wavefront, "cut", lambda df, real=wavefront.cut: rounds.append(1) or real(df))
    df = spark.range(90000).selectExpr("0 g", "id pt_id", "double(id % 300) x", "double(id div 300) y")
    got = wavefront.settle(df, ["g"], 3.0, "pt_id").select("pt_id").toPandas().pt_id
    assert sorted(got) == serial([(i, float(i % 300), float(i // 300)) for i in range(90000)], 3.0)
    assert len(rounds) - 1 <= 5 + 2 * 5


def test_wave_without_points(spark):
    df = spark.createDataFrame([], "g int, pt_id int, x double, y double")
    assert wavefront.settle(df, ["g"], 3.0, "pt_id").count() == 0


def test_leaders_take_all_points(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, int(x), int(y)) for i, (x, y) in enumerate(rng.integers(0, 60, (500, 2)))]
    got = B.leader_clusters(spark.createDataFrame(rows, "g int, pt_id int, x int, y int"), ["g"], 7.0).toPandas()
    assert got.n.sum() == 500


def far(m):
    zero = np.argwhere(~m)
    yy, xx = np.mgrid[: m.shape[0], : m.shape[1]]
    return np.sqrt(((yy[..., None] - zero[:, 0]) ** 2 + (xx[..., None] - zero[:, 1]) ** 2).min(-1)) if len(zero) else np.full(m.shape, np.inf)


def test_distance_map(spark, monkeypatch):
    monkeypatch.setattr(distance, "CELLS", 500)
    rng = np.random.default_rng(4)
    masks = {"sparse zeros": rng.random((40, 53)) > 0.004, "no zeros": np.ones((9, 12), bool), "all zeros": np.zeros((5, 6), bool), "corner": np.ones((30, 41), bool), "noise": rng.random((21, 20)) > 0.5}
    masks["corner"][29, 0] = False
    rows = [(k, x, y, float(m[y, x])) for k, m in masks.items() for y in range(m.shape[0]) for x in range(m.shape[1])]
    got = {k: np.full(m.shape, np.nan) for k, m in masks.items()}
    for r in distance.distance_map(spark.createDataFrame(rows, "image_id string, x int, y int, v double"), ["image_id"]).collect():
        got[r.image_id][r.y, r.x] = r.d
    for k, m in masks.items():
        assert np.array_equal(got[k], far(m)), k


def test_centres_are_safe_and_draws_without_one_say_so(spark):
    m = np.ones((40, 40), bool)
    m[:, :3] = False
    rows = [(k, x, y, float(m[y, x])) for k in range(2) for y in range(40) for x in range(40)]
    mask = spark.createDataFrame(rows, "image_id int, x int, y int, v double")
    draws = spark.createDataFrame([(k, d, side, radius) for k in range(2) for d, (side, radius) in enumerate([(10, 8.0), (10, 8.0), (36, 30.0), (39, 5.0), (10, 100.0)])], "image_id int, draw int, side int, safe_radius double")
    d = far(m)
    got = A.safe_centers(mask, draws, ["image_id"], 5).collect()
    assert len(got) == 10
    for r in got:
        side, radius = [(10, 8.0), (10, 8.0), (36, 30.0), (39, 5.0), (10, 100.0)][r.draw]
        half = side // 2
        allowed = [d[half:40 - half, half:40 - half] > t for t in (radius, side / 2)]
        if not any(a.any() for a in allowed):
            assert r.cx is None and r.reason == "no_safe_center"
        else:
            t = radius if allowed[0].any() else side / 2
            assert d[r.cy, r.cx] > t and half <= r.cx < 40 - half and half <= r.cy < 40 - half and r.reason is None
    assert len({(r.cx, r.cy) for r in got if r.draw < 2}) > 1


def test_conflicts_count_in_either_direction(spark):
    """A pair whose later node is named first is a conflict too."""
    from layerframe.iterate import first_independent_set

    nodes = spark.createDataFrame([(0, n, -n) for n in range(6)], "g int, node int, at int")
    pairs = spark.createDataFrame([(0, n, n + 1) for n in range(5)], "g int, a int, b int")
    turned = pairs.selectExpr("g", "b a", "a b")
    for df in (pairs, turned, pairs.union(turned)):
        assert sorted(r.node for r in first_independent_set(nodes, df, ["g"], "at").collect()) == [1, 3, 5]
