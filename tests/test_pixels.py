"""Pixel operators against numpy, with blocks smaller than the images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from layerframe.iterate import cut
from layerframe.operators import blobs as B
from layerframe.operators import pixels as P


@pytest.fixture(scope="module")
def images(spark):
    rng = np.random.default_rng(2)
    arr = {0: rng.uniform(0, 255, (19, 33)), 1: rng.uniform(0, 255, (40, 12)), 2: np.full((7, 9), 5.0)}
    pdf = pd.DataFrame([(k, x, y, float(a[y, x])) for k, a in arr.items() for y in range(a.shape[0]) for x in range(a.shape[1])], columns=["image_id", "x", "y", "v"])
    return arr, cut(spark.createDataFrame(pdf).selectExpr("int(image_id) image_id", "int(x) x", "int(y) y", "v"))


def back(df, arr, col="v"):
    out = {k: np.full(a.shape, np.nan) for k, a in arr.items()}
    for r in df.select("image_id", "x", "y", col).toPandas().itertuples(index=False):
        out[r[0]][r[2], r[1]] = r[3]
    return out


def test_box_mean_edge(images):
    arr, px = images
    got = back(P.box_mean(px, block=8), arr)
    for k, a in arr.items():
        p = np.pad(a, 2, mode="edge")
        want = sum(p[i:i + a.shape[0], j:j + a.shape[1]] for i in range(5) for j in range(5)) / 25
        assert np.allclose(got[k], want)


def test_gaussian_reflect(images):
    arr, px = images
    w = np.array(P.gaussian_weights(2.0))
    got = back(P.convolve_separable(px, list(w), block=16), arr, "conv")
    r = len(w) // 2
    for k, a in arr.items():
        p = np.pad(a, r, mode="symmetric")
        h = np.array([np.convolve(row, w, "valid") for row in p])
        want = np.array([np.convolve(c, w, "valid") for c in h.T]).T
        assert np.allclose(got[k], want)


def test_constant_image_and_ranges(images):
    arr, px = images
    assert np.all(back(P.min_max(px), arr)[2] == 0)
    v = F.lit(0.25)
    row = px.limit(1).select(P.inverse_logit(P.logit(v)).alias("a"), P.signed_to_unit(P.unit_to_signed(v)).alias("b"), P.signed_to_byte(P.byte_to_signed(F.lit(200.0))).alias("c")).first()
    assert row.a == pytest.approx(0.25) and row.b == 0.25 and row.c in (199, 200)


def test_tiles_round_trip(images):
    arr, px = images
    size = P.image_size(px)
    t = cut(P.cut_tiles(px.filter("image_id < 2"), size, 8))
    keep = {k: arr[k] for k in (0, 1)}
    for df in (P.stitch_first(t), P.blend_tiles(t, 8, ["v"])):
        got = back(df, keep)
        for k, a in keep.items():
            m = ~np.isnan(got[k])
            assert np.allclose(got[k][m], a[m]) and m.sum() >= 0.6 * a.size


def test_bicubic_keeps_constants_and_rotation(images):
    arr, px = images
    c = P.resize(px.filter("image_id = 2"), 4, 20, "bicubic").toPandas()
    assert len(c) == 80 and np.allclose(c.v, 5.0)
    sq = px.filter("image_id = 0 and x < 19").withColumn("image_id", F.lit(0))
    plan = P.image_size(sq).withColumn("angle", F.lit(180.0))
    r = P.rotate(sq, plan).toPandas()
    a = arr[0][:, :19]
    for row in r.itertuples():
        if row.x >= 1 and row.y >= 1:
            assert row.v == pytest.approx(a[19 - row.y, 19 - row.x], abs=1e-6)


def test_components_numpy(spark):
    rng = np.random.default_rng(4)
    m = rng.random((24, 30)) < 0.45
    px = spark.createDataFrame([(0, x, y) for y in range(24) for x in range(30) if m[y, x]], "image_id int, x int, y int")
    got = B.component_stats(B.components(px)).toPandas()
    lab, n = -np.ones(m.shape, int), 0
    for y in range(24):
        for x in range(30):
            if m[y, x] and lab[y, x] < 0:
                todo = [(y, x)]
                lab[y, x] = n
                while todo:
                    a, b = todo.pop()
                    for i in range(max(0, a - 1), min(24, a + 2)):
                        for j in range(max(0, b - 1), min(30, b + 2)):
                            if m[i, j] and lab[i, j] < 0:
                                lab[i, j] = n
                                todo.append((i, j))
                n += 1
    assert len(got) == n and sorted(got.area) == sorted(np.bincount(lab[lab >= 0]))


def test_leader_clusters_serial(spark):
    rng = np.random.default_rng(5)
    pts = sorted({(int(a), int(b)) for a, b in rng.integers(0, 40, (120, 2))})
    df = spark.createDataFrame([(0, i, x, y) for i, (y, x) in enumerate(pts)], "image_id int, pt_id int, x int, y int")
    got = B.leader_clusters(df, ["image_id"], 6.0).toPandas()
    rest, want = list(pts), []
    while rest:
        y, x = rest[0]
        near = [(a, b) for a, b in rest if (a - y) ** 2 + (b - x) ** 2 < 36]
        rest = [p for p in rest if p not in near]
        want.append((len(near), round(np.mean([p[0] for p in near])), round(np.mean([p[1] for p in near]))))
    assert sorted(map(tuple, got[["n", "row", "col"]].to_numpy())) == sorted(want)


def test_detects_planted_discs(spark):
    a = np.full((64, 64), 20.0)
    centres = [(12, 15), (30, 44), (50, 20)]
    yy, xx = np.mgrid[:64, :64]
    for y, x in centres:
        a[(yy - y) ** 2 + (xx - x) ** 2 <= 16] = 230.0
    px = spark.createDataFrame(pd.DataFrame([(0, x, y, float(a[y, x])) for y in range(64) for x in range(64)], columns=["image_id", "x", "y", "v"]))
    got = B.detect_atoms(px, sigma=6.0).toPandas()
    assert sorted((round(r.y), round(r.x)) for r in got.itertuples()) == centres


def test_poisson_noise_does_not_depend_on_partitions(spark):
    px = spark.range(4000).selectExpr("'a' image_id", "int(id % 80) x", "int(id / 80) y", "double(id % 100) v")
    key = ["image_id"]
    one = P.poisson_noise(px.repartition(1), F.lit(900.0), 3, key).toPandas().sort_values(["y", "x"]).v.to_numpy()
    many = P.poisson_noise(px.repartition(7, "x"), F.lit(900.0), 3, key).toPandas().sort_values(["y", "x"]).v.to_numpy()
    assert (one == many).all()
    rate = np.arange(4000) % 100 / 99.0 * 900
    counts = one / 99.0 * 900
    z = (counts - rate)[rate > 50] / np.sqrt(rate[rate > 50])
    assert abs(z.mean()) < 0.08 and abs(z.std() - 1) < 0.06 and (counts[rate == 0] == 0).all()


def test_holes_are_filled(spark):
    from layerframe.operators.blobs import component_stats, components, contour_area, fill_holes

    ring = {(x, y) for x in range(7) for y in range(7)} - {(x, y) for x in range(1, 6) for y in range(1, 6)}
    bay = {(x, y) for x in range(20, 25) for y in range(5)} - {(22, 0), (22, 1), (22, 2)}  # open to the top
    eight = {(x, y) for x in range(40, 45) for y in range(3)} - {(41, 1), (43, 1)}
    # the hole is closed by a diagonal contact only
    loose = {(60, 1), (61, 0), (62, 1), (61, 2)}
    pixels = ring | {(3, 3)} | bay | eight | loose
    mask = spark.createDataFrame([(0, x, y) for x, y in pixels], "image_id int, x int, y int")
    lab = components(mask)
    filled, nested = fill_holes(lab)
    area = {r.left: (r.area, r.poly_area) for r in component_stats(filled).join(contour_area(filled), ["image_id", "label"]).collect()}
    assert area == {0: (49, 36.0), 3: (1, 0.0), 20: (22, area[20][1]), 40: (15, 8.0), 60: (5, 2.0)}
    assert [(r.label.y, r.label.x) for r in nested.collect()] == [(3, 3)]
    plain = spark.createDataFrame([(0, x, y) for x, y in bay], "image_id int, x int, y int")
    filled, nested = fill_holes(components(plain))
    assert filled.count() == len(bay) and nested.count() == 0
