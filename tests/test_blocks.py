"""Blocks of pixels as arrays: components, filters and borders against plain numpy, with blocks smaller than the images."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from layerframe.operators import blobs as B
from layerframe.operators import pixels as P
from layerframe.operators.blocks import gather, least_labels


def flood(m):
    """First pixel (y, x) in raster order of the 8-connected component of every pixel."""
    lab = {}
    for y, x in zip(*np.nonzero(m), strict=True):
        if (y, x) in lab:
            continue
        todo = [(y, x)]
        lab[y, x] = (y, x)
        while todo:
            a, b = todo.pop()
            for i in range(max(0, a - 1), min(m.shape[0], a + 2)):
                for j in range(max(0, b - 1), min(m.shape[1], b + 2)):
                    if m[i, j] and (i, j) not in lab:
                        lab[i, j] = (y, x)
                        todo.append((i, j))
    return lab


def spiral(n):
    m, y, x, dy, dx = np.zeros((n, n), bool), 0, 0, 0, 1
    m[0, 0] = True
    for _ in range(4 * n):
        ny, nx, ty, tx = y + dy, x + dx, y + 2 * dy, x + 2 * dx
        if not (0 <= ny < n and 0 <= nx < n) or (0 <= ty < n and 0 <= tx < n and m[ty, tx]):
            dy, dx = dx, -dy
            continue
        while 0 <= y + dy < n and 0 <= x + dx < n and not (0 <= y + 2 * dy < n and 0 <= x + 2 * dx < n and m[y + 2 * dy, x + 2 * dx]):
            y, x = y + dy, x + dx
            m[y, x] = True
        dy, dx = dx, -dy
    return m


@pytest.mark.parametrize("block", [4, 7, 64])
def test_components_across_blocks(spark, block):
    rng = np.random.default_rng(block)
    masks = {"noise": rng.random((33, 41)) < 0.42, "spiral": spiral(27), "full": np.ones((17, 9), bool), "diagonal": np.eye(30, dtype=bool), "anti": np.eye(30, dtype=bool)[:, ::-1], "one": np.pad(np.ones((1, 1), bool), 6)}
    rows = [(k, int(x), int(y)) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    got = {(r.image_id, r.y, r.x): (r.label.y, r.label.x) for r in B.components(spark.createDataFrame([*rows, rows[0]], "image_id string, x int, y int"), block=block).collect()}
    assert got == {(k, y, x): v for k, m in masks.items() for (y, x), v in flood(m).items()}


def test_components_of_nothing(spark):
    assert B.components(spark.createDataFrame([], "image_id string, x int, y int")).count() == 0


def test_least_labels_of_a_long_chain():
    n = 5000
    order = np.random.default_rng(1).permutation(n)
    assert (least_labels(n + 1, order[:-1], order[1:])[:n] == 0).all() and least_labels(n + 1, order[:-1], order[1:])[n] == n


def frame_of(spark, a, missing=()):
    rows = [(0, x, y, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1]) if (y, x) not in missing]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["image_id", "x", "y", "v"]))


def array_of(df, shape, col="v"):
    out = np.full(shape, np.nan)
    for r in df.select("x", "y", col).collect():
        out[r[1], r[0]] = r[2]
    return out


@pytest.mark.parametrize(("mode", "pad"), [("edge", "edge"), ("reflect", "symmetric"), ("zero", "constant")])
@pytest.mark.parametrize("block", [8, 9, 40])
def test_borders_of_all_kinds(spark, mode, pad, block):
    a = np.random.default_rng(7).uniform(0, 9, (19, 26))
    p = np.pad(a, 3, mode=pad)
    want = sum(p[i:i + 19, j:j + 26] for i in range(7) for j in range(7)) / 49
    assert np.allclose(array_of(P.box_mean(frame_of(spark, a), r=3, mode=mode, block=block), a.shape), want)


def test_halo_wider_than_the_image_and_than_a_block(spark):
    a = np.random.default_rng(8).uniform(0, 9, (7, 21))
    w = np.array(P.gaussian_weights(3.0))
    r = len(w) // 2
    p = np.pad(a, r, mode="symmetric")
    want = np.array([np.convolve(c, w, "valid") for c in np.array([np.convolve(x, w, "valid") for x in p]).T]).T
    for block in (5, 16):
        assert np.allclose(array_of(P.convolve_separable(frame_of(spark, a), list(w), block=block), a.shape, "conv"), want)


def test_missing_pixels_weigh_nothing(spark):
    a = np.full((12, 12), 4.0)
    gone = {(3, 3), (3, 4), (8, 0)}
    px = frame_of(spark, a, gone).withColumn("v", F.when((F.col("x") == 9) & (F.col("y") == 9), None).otherwise(F.col("v")))
    got = array_of(P.convolve_separable(px, P.gaussian_weights(1.0), block=5), a.shape, "conv")
    assert np.allclose(got[~np.isnan(got)], 4.0) and {tuple(map(int, i)) for i in np.argwhere(np.isnan(got))} == gone


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_mask_rounds_in_one_exchange(spark, rounds):
    a = (np.random.default_rng(9).random((23, 17)) < 0.55).astype(float)
    want = a
    for _ in range(rounds):
        p = np.pad(want, 1)
        want = (sum(p[i:i + 23, j:j + 17] for i in range(3) for j in range(3)) / 9.0 >= 0.5).astype(float)
    assert (array_of(P.smooth_mask(frame_of(spark, a), rounds, block=6), a.shape) == want).all()


def test_only_halos_are_copied(spark):
    px = spark.range(64 * 64).selectExpr("0 image_id", "int(id % 64) x", "int(id div 64) y", "1.0D v")
    n = gather(px, ["image_id"], ["v"], 16, 2).selectExpr("sum(size(cells)) n").first().n
    # 4 × 4 blocks of 16; the pixels next to the frame's far sides are also sent one block too far
    assert n <= (64 + 2 * 2 * 4) ** 2 and gather(px, ["image_id"], ["v"], 16, 0).selectExpr("sum(size(cells)) n").first().n == 64 * 64
