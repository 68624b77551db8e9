"""4-cycles are found inside blocks of points: one exchange, no join, the same cycles as brute force."""

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from layerframe.operators import cycles as C


def brute(xy, r):
    d2 = ((xy[:, None] - xy[None]) ** 2).sum(-1)
    near = d2 <= r * r
    out = {}
    for i, j in itertools.combinations(range(len(xy)), 2):
        if near[i, j]:
            ks = [k for k in range(len(xy)) if k not in (i, j) and near[i, k] and near[j, k]]
            for k, m in itertools.combinations(ks, 2):
                out.setdefault(tuple(sorted((i, j, k, m))), (k, i, m, j))
    return set(out.values())


def test_blocks_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    clouds = {0: rng.uniform(-150, 150, (150, 2)), 1: rng.uniform(-12, 12, (24, 2)), 2: np.array([[56.0 * i, 14.0 * j] for i in range(-3, 4) for j in range(-3, 4)])}
    rows = pd.DataFrame([(s, i, float(x), float(y), 40.0 if s == 0 else 14.0) for s, c in clouds.items() for i, (x, y) in enumerate(c)], columns=["sample", "pt_id", "x", "y", "lim"])
    got = C.enumerate_cycles(spark.createDataFrame(rows), ["sample"], F.col("lim"))
    assert got.columns == ["sample", *C.VERTS, *C.COORDS]
    pdf = got.toPandas()
    for s, c in clouds.items():
        mine = pdf[pdf["sample"] == s]
        want = brute(c, 40.0 if s == 0 else 14.0)
        assert len(mine) == len(want) and {tuple(r) for r in mine[C.VERTS].to_numpy()} == want
        for i in range(4):
            assert (mine[[f"x{i}", f"y{i}"]].to_numpy() == c[mine[f"p{i}"].to_numpy()]).all()


def test_points_cross_once(spark):
    pts = spark.range(100).selectExpr("id % 3 as sample", "id as pt_id", "id * 1D as x", "id * 2D as y")
    plan = C.enumerate_cycles(pts, ["sample"], 14.0)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") == 1
