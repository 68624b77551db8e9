"""Cycles, growth, lattice vectors, shift and twist on planted data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from layerframe.iterate import cut
from layerframe.operators import cycles as C
from layerframe.operators import interlayer as IL
from layerframe.operators import lattice as L

DA, DB = np.array([25.43, -14.68]), np.array([0.0, 30.28])
CORNERS = np.array([[0, 0], [10.9, -6.3], [10.9, 6.3], [0, 12.6]])


def patch(angle=0.0, shift=(0, 0), n=4, jitter=0.1, seed=0):
    rng = np.random.default_rng(seed)
    p = np.array([np.array([20.0, 54.0]) + i * DA + j * DB + c for i in range(n) for j in range(n) for c in CORNERS])
    a = math.radians(angle)
    rot = np.array([[math.cos(a), -math.sin(a)], [math.sin(a), math.cos(a)]])
    return (p - 64) @ rot.T + 64 + np.array(shift) + rng.normal(0, jitter, p.shape)


def frame(spark, clouds):
    return cut(spark.createDataFrame(pd.DataFrame([(s, i, float(x), float(y)) for s, c in clouds.items() for i, (x, y) in enumerate(c)], columns=["sample", "pt_id", "x", "y"])))


def crosses(a, b):
    def seg(p, q, r, s):
        cr = lambda u, v: u[0] * v[1] - u[1] * v[0]
        d = cr(q - p, s - r)
        if abs(d) < 1e-12:
            return False
        t, u = cr(r - p, s - r) / d, cr(r - p, q - p) / d
        return 1e-9 < t < 1 - 1e-9 and 1e-9 < u < 1 - 1e-9

    return any(seg(a[i], a[(i + 1) % 4], b[j], b[(j + 1) % 4]) for i in range(4) for j in range(4))


def test_disjoint_selection_is_the_serial_one(spark):
    rng = np.random.default_rng(3)
    pts = frame(spark, {0: rng.uniform(0, 60, (40, 2))})
    cyc = cut(C.with_score(C.with_shape(C.enumerate_cycles(pts, ["sample"], 14.0))))
    cyc = cyc.withColumn("score", F.when(F.col("score") < 0, 0.0).otherwise(F.col("score")))
    got = {tuple(r) for r in C.select_disjoint(cyc, ["sample"]).select(*C.VERTS).toPandas().to_numpy()}
    pdf = cyc.toPandas()
    xs, ys = pdf[[f"x{i}" for i in range(4)]], pdf[[f"y{i}" for i in range(4)]]
    cx, cy = (xs.min().min() + xs.max().max()) / 2, (ys.min().min() + ys.max().max()) / 2
    order = sorted(range(len(pdf)), key=lambda i: (-pdf.score[i], (pdf.cx[i] - cx) ** 2 + (pdf.cy[i] - cy) ** 2, pdf.cv[i], tuple(pdf.loc[i, C.VERTS])))
    used, polys, want = set(), [], set()
    for i in order:
        v = tuple(pdf.loc[i, C.VERTS])
        q = [np.array([pdf.loc[i, f"x{k}"], pdf.loc[i, f"y{k}"]]) for k in range(4)]
        if used & set(v) or any(crosses(q, o) for o in polys):
            continue
        used |= set(v)
        polys.append(q)
        want.add(v)
    assert got == want and len(want) >= 2
    # pairs that cross, against brute force
    ident = cyc.withColumn("id", F.struct(*C.VERTS)).withColumn("cell", F.lit(9.0))
    n = C.crossing_pairs(ident, ident, ["sample"], "id", "id").count()
    qs = [(set(pdf.loc[i, C.VERTS]), [np.array([pdf.loc[i, f"x{k}"], pdf.loc[i, f"y{k}"]]) for k in range(4)]) for i in range(len(pdf))]
    assert n == sum(1 for i, (a, p) in enumerate(qs) for j, (b, q) in enumerate(qs) if i != j and not a & b and crosses(p, q))


def test_layer_lattice_recovers_planted_vectors(spark):
    pts = frame(spark, {0: patch(0), 1: patch(7.0, seed=1), 2: patch(0)[:6]})
    im = spark.createDataFrame([(0, 128, 128, 27.9), (1, 128, 128, 27.9), (2, 128, 128, 27.9), (3, None, None, 27.9)], "sample long, w int, h int, side_angstrom double")
    r = L.layer_lattice(pts, im, ["sample"], max_components=1).toPandas().set_index("sample")
    assert list(r.reason[[0, 1, 2, 3]]) == ["", "", "too_few_atoms", "missing_image"]
    for s in (0, 1):
        assert r.n_cycles[s] == 16
        lens = sorted([math.hypot(*r.da[s]), math.hypot(*r.db[s])])
        assert lens[0] == pytest.approx(np.hypot(*DA), abs=0.3) and lens[1] == pytest.approx(np.hypot(*DB), abs=0.3)
        assert r.angle_db_da[s] == pytest.approx(120, abs=1.5)


def test_two_means(spark):
    x = np.concatenate([np.random.default_rng(1).normal(5, 1, 80), np.random.default_rng(2).normal(20, 2, 40)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 2.0)] * 3, "g string, v double")
    c = L.two_means(df, ["g"], "v").toPandas().set_index("g")
    c0, c1 = np.quantile(x, 0.2), np.quantile(x, 0.8)
    for _ in range(25):
        hi = np.abs(x - c1) < np.abs(x - c0)
        c0, c1 = x[~hi].mean(), x[hi].mean()
    assert c.converged.all()
    c = c[["c0", "c1"]]
    assert np.allclose(c.loc["a"], [c0, c1]) and np.allclose(c.loc["b"], [2.0, 2.0])


def test_axis_picking(spark):
    h = np.zeros(180, int)
    h[[30, 31, 92, 150]] = [50, 50, 40, 45]
    h[35], h[100] = 44, 39
    df = spark.createDataFrame([(0, [int(v) for v in h])], "sample int, h array<bigint>")
    axes = L.pick_axes(cut(df), ["sample"]).select(F.explode("axes").alias("e")).select("e.*").toPandas()
    assert list(axes.a[:3]) == [30.5, 150.5, 92.5] and list(axes.w[:3]) == [50, 45, 40]
    picked = cut(L.pick_axes(cut(df), ["sample"])).withColumn("e0", F.expr("struct(cos(radians(30D)) as x, sin(radians(30D)) as y)")).withColumn("e1", F.expr("struct(cos(radians(150D)) as x, sin(radians(150D)) as y)"))
    m = L.main_axes(picked, ["sample"]).first()
    assert (m.a0, m.a1) == (30.5, 150.5)  # 92.5 is least parallel to the seed edges


def test_shift_and_class(spark):
    base = patch(n=4, jitter=0.05) * 4
    pts0, pts1 = frame(spark, {0: base}), frame(spark, {0: base + [11.0, -6.0]})
    s = IL.search_shift(pts0, pts1, ["sample"], max_shift=24, coarse=8, min_keep=20).first()
    assert (s.dx, s.dy) == (-11, 6) and s.score < 0.01
    row = "1 as sample, true as ok, '' as reason, struct(0D as x, 0D as y) as origin, "
    a = spark.sql("select " + row + "struct(30D as x, 0D as y) as da, struct(-15D as x, 26D as y) as db")
    b = spark.sql("select " + row + "struct(-30D as x, 1D as y) as da, struct(-15D as x, 26D as y) as db")
    r = IL.stacking_class(a, b, ["sample"]).first()
    assert r["class"] == "flip_slip" or r["class"] == "flip_twist"
    same = IL.stacking_class(a, a, ["sample"]).first()
    assert same["class"] == "slip" and same.da_mean.x == 30.0 and same.theta_deg == pytest.approx(0, abs=1e-4)


def test_twist_recovered(spark):
    ref = patch(0, jitter=0.02, seed=5) * 4
    mov = (patch(0, jitter=0.02, seed=6) * 4 - 256) @ np.array([[math.cos(math.radians(-12)), -math.sin(math.radians(-12))], [math.sin(math.radians(-12)), math.cos(math.radians(-12))]]).T + 256
    from layerframe.operators.points import displacement_vectors

    v0 = displacement_vectors(frame(spark, {0: ref}), ["sample"])
    v1 = displacement_vectors(frame(spark, {0: mov}), ["sample"])
    cen = spark.createDataFrame([(0, 11.0)], "sample long, center double")
    r = IL.search_twist(v0, v1, cen, ["sample"], radius=4.0, refine=((0.2, 2.0), (0.02, 0.4))).first()
    assert r.twist_fine_deg == pytest.approx(12.0, abs=0.1)


def test_layer_lattice_without_any_seed(spark):
    far = [[13.0 * i * i, 29.0 * i] for i in range(14)]
    im = spark.createDataFrame([(0, 2600, 400, 27.9)], "sample long, w int, h int, side_angstrom double")
    r = L.layer_lattice(frame(spark, {0: np.array(far)}), im, ["sample"]).collect()
    assert len(r) == 1 and r[0].reason and r[0].da is None
