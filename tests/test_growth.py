"""Layers worked on inside tasks: the same as by the set operators and stored rounds."""

import os

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from layerframe.iterate import checkpoint_dir, cut
from layerframe.operators import growth
from layerframe.operators import lattice as L
from layerframe.operators import points as P
from tests.test_lattice import frame, patch


def clouds():
    rng = np.random.default_rng(7)
    two = np.concatenate([patch(3.0, jitter=0.6, n=3, seed=2), patch(31.0, (70, 60), n=3, jitter=0.6, seed=3)])
    return {0: patch(4.0, jitter=1.0), 1: two, 2: np.concatenate([patch(0.0, jitter=0.8, n=3, seed=4), rng.uniform(0, 128, (25, 2))]), 3: rng.uniform(0, 70, (60, 2)),
            4: patch()[:6], 5: np.array([[13.0 * i * i, 29.0 * i] for i in range(14)]), 6: np.ones((12, 2)), 7: patch(jitter=0.0), 8: patch(2.0)}


def images(spark):
    return spark.createDataFrame([(i, None if i == 8 else 128, 128, 27.9) for i in range(10)], "sample long, w int, h int, side_angstrom double")


def stored(spark):
    return len(os.listdir(f"{checkpoint_dir(spark).removeprefix('file:')}/layerframe"))


def test_no_round_is_stored(spark):
    pts = frame(spark, clouds())
    before = stored(spark)
    got = L.layer_lattice(pts, images(spark), ["sample"]).toPandas().set_index("sample")
    assert stored(spark) - before <= 8
    assert got.reason.to_dict() == got.reason.to_dict() | {0: "", 4: "too_few_atoms", 6: "bad_nn", 7: "", 8: "missing_image", 9: "too_few_atoms"}
    assert got.n_cycles[0] > 9 and got.n_cycles[7] == 16


def test_patches_in_tasks_are_those_of_the_rounds(spark):
    """Every cycle with its order (RUN_SLOW=1: of two components, else of one), the edges and the stage of each group."""
    parts = 2 if os.environ.get("RUN_SLOW") else 1
    pts = frame(spark, {i: c for i, c in clouds().items() if i in (1, 2, 5)})
    per_px = images(spark).filter("w is not null").select("sample", (F.col("w") / F.col("side_angstrom")).alias("px_per_angstrom"))
    how = 1.15, False, False, 25.0, 6.4, 6.6, 3, parts, 10
    a, b = ([t.toPandas() for t in f(pts, per_px, ["sample"], *how)] for f in (L._in_tasks, L._by_rounds))
    for x, y, at in zip(a, b, (["sample", "component", "seq"], ["sample", "a", "b"], ["sample"]), strict=True):
        x, y = (t.sort_values(at).reset_index(drop=True) for t in (x, y))
        lists = [c for c in y if c == "h"]
        pd.testing.assert_frame_equal(x[y.columns].drop(columns=lists), y.drop(columns=lists), check_dtype=False)
        for c in lists:
            assert [None if h is None else list(h) for h in x[c]] == [None if h is None else list(h) for h in y[c]]
    assert a[0].component.max() == parts - 1 and len(a[0]) > 6


def test_neighbours_in_tasks(spark):
    rng = np.random.default_rng(3)
    made = {0: rng.uniform(0, 50, (70, 2)), 1: np.concatenate([rng.normal(0, 1e-4, (40, 2)), rng.uniform(0, 1e5, (30, 2))]), 2: rng.integers(0, 4, (30, 2)).astype(float), 3: rng.uniform(0, 9, (3, 2))}
    g = np.repeat(np.arange(4), [len(c) for c in made.values()])
    x, y = np.concatenate(list(made.values())).T
    q, p, rank, d2 = growth.knn(g, x, y, 6)
    first = np.searchsorted(g, g)
    got = sorted(zip(g[q].tolist(), (q - first[q]).tolist(), (rank + 1).tolist(), (p - first[p]).tolist(), np.sqrt(d2).tolist(), strict=True))
    want = sorted(tuple(r) for r in P.knn(cut(frame(spark, made)), 6, ["sample"]).select("sample", "i", "rank", "j", "d").collect())
    assert got == want
