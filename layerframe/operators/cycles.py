"""Rhombic 4-cycles of a point cloud: enumeration, scores, filters, disjoint selection and lattice growth.

A cycle row carries the group keys, vertex ids p0..p3 in order around the quadrilateral and their
coordinates x0, y0 … x3, y3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..iterate import cut, first_independent_set

VERTS = ["p0", "p1", "p2", "p3"]
COORDS = [f"{a}{i}" for i in range(4) for a in "xy"]


def _p(i: int) -> G.Vec:
    return F.col(f"x{i % 4}"), F.col(f"y{i % 4}")


#: Side of a block of points, in edge lengths, and the halo that surely holds every neighbour within one.
BLOCK, HALO = 4.0, 1.0 + 1e-6


def enumerate_cycles(points: DataFrame, keys: list[str], limit: Column | float) -> DataFrame:
    """4-cycles (k, i, l, j) from edges (i, j) ≤ limit with two common neighbours k < l.

    One cycle per vertex set; of several diagonals the least (i, j) is taken. ``limit`` may be a column
    of ``points``. All vertices lie within the limit of i, so points go to their block and, within the halo, to
    the adjoining ones, and each block finds the cycles of its own points i: one exchange, of points only.
    """
    r = limit if isinstance(limit, Column) else F.lit(float(limit))
    p = points.select(*keys, "pt_id", "x", "y", r.cast("double").alias("_r")).withColumns({"_s": BLOCK * F.col("_r"), "_h": HALO * F.col("_r")})
    for a in "xy":
        p = p.withColumn(f"_o{a}", F.floor(F.col(a) / F.col("_s")))
    for a in "xy":
        p = p.withColumn(f"_b{a}", F.explode(F.sequence(F.floor((F.col(a) - F.col("_h")) / F.col("_s")), F.floor((F.col(a) + F.col("_h")) / F.col("_s")))))
    own = (F.col("_bx") == F.col("_ox")) & (F.col("_by") == F.col("_oy"))
    g = p.groupBy(*keys, "_bx", "_by").agg(F.collect_list(F.struct(F.col("pt_id").alias("p"), "x", "y", own.alias("own"))).alias("_all"), F.max("_r").alias("_r"))

    def linked(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        return dx * dx + dy * dy <= F.col("_r") * F.col("_r")

    def neighbours(cell: str, of: str) -> Column:
        return F.filter(cell, lambda q: (q["p"] != F.col(of)["p"]) & linked(F.col(of), q))

    d = g.select(*keys, "_r", "_all", F.explode(F.filter("_all", lambda q: q["own"])).alias("_i"))
    d = d.select(*keys, "_r", "_i", F.array_sort(neighbours("_all", "_i")).alias("_near"))
    d = d.select(*keys, "_r", "_i", "_near", F.explode(F.filter("_near", lambda q: q["p"] > F.col("_i")["p"])).alias("_j"))
    # an edge has few common neighbours, so the pairs k < l stay close to the output
    d = d.select(*keys, "_r", "_i", "_j", neighbours("_near", "_j").alias("_ks"))
    d = d.select(*keys, "_r", "_i", "_j", "_ks", F.posexplode("_ks").alias("_n", "_k"))
    d = d.select(*keys, "_r", "_i", "_j", "_k", F.explode(F.expr("slice(_ks, _n + 2, size(_ks))")).alias("_l"))
    # a vertex set has another diagonal only when k and l are linked too; all six edges are there then
    d = d.filter(~linked(F.col("_k"), F.col("_l")) | (F.col("_j")["p"] < F.col("_k")["p"]))
    order = ["_k", "_i", "_l", "_j"]
    return d.select(*keys, *[F.col(v)["p"].alias(f"p{i}") for i, v in enumerate(order)], *[F.col(v)[a].alias(f"{a}{i}") for i, v in enumerate(order) for a in "xy"])


def rank_of() -> Column:
    """Enumeration order of a cycle: its diagonal, then the two other vertices."""
    return F.struct(F.col("p1"), F.col("p3"), F.col("p0"), F.col("p2"))


def with_shape(cycles: DataFrame) -> DataFrame:
    """Mean side, coefficient of variation, centre, and the long diagonal (unit vector, both lengths)."""
    lens = [G.norm(G.sub(_p(i + 1), _p(i))) for i in range(4)]
    d = cycles.withColumn("_l", F.array(*lens))
    m = sum((F.col("_l")[i] for i in range(1, 4)), F.col("_l")[0]) / 4.0
    d = d.withColumn("side", m)
    var = sum(((F.col("_l")[i] - F.col("side")) * (F.col("_l")[i] - F.col("side")) for i in range(1, 4)), (F.col("_l")[0] - F.col("side")) * (F.col("_l")[0] - F.col("side"))) / 4.0
    d = d.withColumn("cv", F.when(F.col("side") > 1e-9, F.sqrt(var) / F.col("side")).otherwise(1e9))
    d = d.withColumn("cx", (F.col("x0") + F.col("x1") + F.col("x2") + F.col("x3")) / 4.0).withColumn("cy", (F.col("y0") + F.col("y1") + F.col("y2") + F.col("y3")) / 4.0)
    a, b = G.sub(_p(2), _p(0)), G.sub(_p(3), _p(1))
    swap = G.norm(b) > G.norm(a)
    u = G.unit(G.choose(swap, b, a))
    return d.withColumn("ux", u[0]).withColumn("uy", u[1]).withColumn("diag_long", F.greatest(G.norm(a), G.norm(b))).withColumn("diag_short", F.least(G.norm(a), G.norm(b))).drop("_l")


def with_score(cycles: DataFrame) -> DataFrame:
    """Rhombus score 1/(1+penalty) and its parts; −1e9 for degenerate, one-direction and one-colour cycles.

    Needs the columns of :func:`with_shape`.
    """
    # every intermediate is a column of its own, so no expression is repeated inside another
    edges = {f"_v{a}{i}": F.col(f"{a}{(i + 1) % 4}") - F.col(f"{a}{i}") for i in range(4) for a in "xy"}
    d = cycles.withColumns(edges)
    v = [G.vec(f"_vx{i}", f"_vy{i}") for i in range(4)]
    d = d.withColumns({f"_n{i}": G.norm(v[i]) for i in range(4)})
    d = d.withColumns({f"_u{a}{i}": F.when(F.col(f"_n{i}") >= 1e-12, F.col(f"_v{a}{i}") / F.col(f"_n{i}")).otherwise(0.0) for i in range(4) for a in "xy"})
    u = [G.vec(f"_ux{i}", f"_uy{i}") for i in range(4)]

    def between(a: G.Vec, b: G.Vec) -> Column:
        # axial angle of unit vectors; a vanishing edge counts as perpendicular
        return F.degrees(F.acos(F.least(F.lit(1.0), F.abs(G.dot(a, b)))))

    d = d.withColumns({"_par0": between(u[0], u[2]), "_par1": between(u[1], u[3]), "_acute": between(u[0], u[1]),
                       "_angs": F.array(F.lit(0.0), *[between(u[0], u[i]) for i in (1, 2, 3)])})
    d = d.withColumns({"_sep": F.array_max("_angs")})
    d = d.withColumns({"_i1": F.array_position("_angs", F.col("_sep")) - 1})
    d = d.withColumns({f"_f{a}": F.when(F.col("_i1") == 1, F.col(f"_u{a}1")).when(F.col("_i1") == 2, F.col(f"_u{a}2")).when(F.col("_i1") == 3, F.col(f"_u{a}3")).otherwise(F.col(f"_u{a}0")) for a in "xy"})
    far = G.vec("_fx", "_fy")
    d = d.withColumns({"_g": F.array(*[F.when(F.col("_angs")[i] <= between(u[i], far), 0).otherwise(1) for i in range(4)])})
    g = F.col("_g")
    d = d.withColumns({"_n1": g[0] + g[1] + g[2] + g[3], "_opp": (g[0] == g[2]).cast("int") + (g[1] == g[3]).cast("int")})

    def sq(c: Column) -> Column:
        return c * c

    pen = (
        sq(F.col("cv") / 0.12) + sq(F.col("_par0") / 8.0) + sq(F.col("_par1") / 8.0) + sq((F.col("_acute") - 60.0) / 15.0)
        + sq((F.col("_sep") - 60.0) / 20.0) + sq(F.abs(2 - F.col("_n1")).cast("double")) + sq((2 - F.col("_opp")).cast("double"))
    )
    bad = (F.col("side") < 1e-6) | (F.col("_sep") < 25.0) | (F.col("_n1") == 0) | (F.col("_n1") == 4)
    d = d.withColumn("score", F.when(bad, -1e9).otherwise(1.0 / (1.0 + pen)))
    strict = (
        (F.col("score") > 0) & (F.col("_par0") <= 6.0) & (F.col("_par1") <= 6.0) & F.col("_acute").between(45.0, 75.0) & (F.col("_sep") >= 35.0)
        & (F.col("_n1") == 2) & (F.col("_opp") == 2)
    )
    return d.withColumn("strict", strict).select(*cycles.columns, "score", "strict")


# ---------------------------------------------------------------- dominant direction

def axial_counts(vectors: DataFrame, keys: list[str], ident: list[str], tol: float, bins_per_degree: int = 16) -> DataFrame:
    """Number of vectors within ``tol`` degrees (axial, itself included) of each vector.

    Counted as a difference of ranks on the half circle: cumulative counts per fine angle bin, and a
    running count inside the two border bins only. No pairs are formed.
    """
    ang = F.pmod(F.degrees(F.atan2("uy", "ux")), F.lit(180.0))
    a = vectors.select(*keys, *ident, F.when(ang >= 180.0, 0.0).otherwise(ang).alias("_a"))
    # values repeated one turn on, so that every interval [a−tol, a+tol] + 180 is contiguous
    vals = a.select(*keys, F.explode(F.array(F.col("_a"), F.col("_a") + 180.0, F.col("_a") + 360.0)).alias("_t"))
    binned = vals.withColumn("_b", F.floor(F.col("_t") * bins_per_degree).cast("int"))
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cum = binned.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    # a border bin may be empty of values: give every query bin a row as well
    ends = a.select(*keys, *ident, F.explode(F.array(F.struct((F.col("_a") + 180.0 - tol).alias("t"), F.lit(-1).alias("s")), F.struct((F.col("_a") + 180.0 + tol).alias("t"), F.lit(1).alias("s")))).alias("e"))
    ends = ends.select(*keys, *ident, F.col("e.t").alias("_t"), F.col("e.s").alias("_s")).withColumn("_b", F.floor(F.col("_t") * bins_per_degree).cast("int"))
    cum = cum.unionByName(ends.select(*keys, "_b").distinct().withColumn("_c", F.lit(0).cast("bigint"))).groupBy(*keys, "_b").agg(F.sum("_c").alias("_c"))
    cum = cum.withColumn("_before", F.coalesce(F.sum("_c").over(w), F.lit(0))).select(*keys, "_b", "_before")
    # inside a bin: lower ends come before equal values, upper ends after them
    none = [F.lit(None).cast(vectors.schema[c].dataType).alias(c) for c in ident]
    ev = binned.select(*keys, *none, "_t", F.lit(0).alias("_s"), "_b").unionByName(ends)
    wi = Window.partitionBy(*keys, "_b").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = ev.withColumn("_r", F.sum((F.col("_s") == 0).cast("int")).over(wi)).filter("_s <> 0")
    r = run.join(cum, [*keys, "_b"])
    return r.groupBy(*keys, *ident).agg(F.sum(F.col("_s") * (F.col("_r") + F.col("_before"))).cast("bigint").alias("cnt"))


def dominant_direction_filter(cycles: DataFrame, keys: list[str], tol: float = 25.0, min_cluster: int = 4) -> DataFrame:
    """Keep cycles whose long diagonal is within ``tol`` of the group's dominant axis.

    The axis is the vector with most neighbours within ``tol`` (first in enumeration order), refined to the
    sign-aligned mean of those neighbours; ``cnt`` holds the neighbour count. Groups with fewer than ``min_cluster`` cycles, or without a
    cluster, pass unfiltered.
    """
    tol = max(1.0, tol)
    cnt = axial_counts(cycles, keys, VERTS, tol)
    c = cycles.join(cnt, [*keys, *VERTS])
    best = c.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.max("cnt").alias("_best"),
        F.min_by(F.struct(F.col("ux").alias("x"), F.col("uy").alias("y")), F.struct((-F.col("cnt")).alias("c"), rank_of().alias("r"))).alias("_ref"))
    j = c.join(best, keys)
    ref, u = G.field("_ref"), G.vec("ux", "uy")
    near = G.axial_angle(ref, u) <= tol
    al = G.align_sign(u, ref)
    acc = j.filter(near).groupBy(*keys).agg(F.sum(al[0]).alias("_ax"), F.sum(al[1]).alias("_ay"))
    j = j.join(acc, keys)
    m = G.vec("_ax", "_ay")
    axis = G.choose(G.norm(m) > 1e-9, G.unit(m), ref)
    free = (F.col("_n") < max(1, min_cluster)) | (F.col("_best") < max(2, min_cluster // 2))
    return j.filter(free | (G.axial_angle(u, axis) <= tol)).drop("_n", "_best", "_ref", "_ax", "_ay")


# ---------------------------------------------------------------- conflicts and selection

def _bbox_cells(q: DataFrame, cell: str) -> DataFrame:
    """One row per grid cell the bounding box of the quadrilateral meets."""
    for a, c in (("x", "gx"), ("y", "gy")):
        vs = [F.col(f"{a}{i}") for i in range(4)]
        q = q.withColumn(c, F.explode(F.sequence(F.floor(F.least(*vs) / F.col(cell)), F.floor(F.greatest(*vs) / F.col(cell)))))
    return q


def crossing_pairs(a: DataFrame, b: DataFrame, keys: list[str], ident_a: str, ident_b: str, cell: str = "cell") -> DataFrame:
    """Pairs of quadrilaterals with properly crossing edges; candidates share a grid cell of both bounding boxes."""
    def laid(q: DataFrame, ident: str, n: str) -> DataFrame:
        box = [(F.least if m == "lo" else F.greatest)(*[F.col(f"{a}{i}") for i in range(4)]).alias(f"{n}{m}{a}") for m in ("lo", "hi") for a in "xy"]
        c = _bbox_cells(q.select(*keys, F.col(ident).alias(n), *[F.col(v).alias(f"{n}{v}") for v in VERTS if v in q.columns], *COORDS, cell), cell)
        return c.select(*keys, "gx", "gy", n, *box, G.quad_edges([_p(i) for i in range(4)]).alias(f"{n}e"), *[f"{n}{v}" for v in VERTS if v in q.columns])

    j = laid(a, ident_a, "a").join(laid(b, ident_b, "b"), [*keys, "gx", "gy"]).filter(F.col("a") != F.col("b"))
    # boxes first; sharing an atom is a conflict of its own
    j = j.filter("alox < bhix and blox < ahix and aloy < bhiy and bloy < ahiy")
    if "ap0" in j.columns and "bp0" in j.columns:
        j = j.filter(~F.arrays_overlap(F.array(*[f"a{v}" for v in VERTS]), F.array(*[f"b{v}" for v in VERTS])))
    return j.filter(G.edges_cross(F.col("ae"), F.col("be"))).select(*keys, "a", "b").distinct()


def shared_atoms(a: DataFrame, keys: list[str], ident: str) -> DataFrame:
    e = a.select(*keys, F.col(ident).alias("a"), F.explode(F.array(*VERTS)).alias("pt"))
    return e.join(e.withColumnRenamed("a", "b"), [*keys, "pt"]).filter(F.col("a") != F.col("b")).select(*keys, "a", "b").distinct()


def select_disjoint(cycles: DataFrame, keys: list[str], no_intersect: bool = True) -> DataFrame:
    """Greedy disjoint set in the order (−score, distance² to the box centre, cv, ids) of scored cycles.

    Equal to the serial accept loop: a cycle stays unless an earlier kept one shares an atom or crosses it.
    """
    box = cycles.groupBy(*keys).agg(*[((F.min(F.least(*[F.col(f"{a}{i}") for i in range(4)])) + F.max(F.greatest(*[F.col(f"{a}{i}") for i in range(4)]))) / 2.0).alias(f"_b{a}") for a in "xy"],
                                    F.greatest(F.max("side"), F.lit(1e-6)).alias("cell"))
    d = cycles.join(box, keys)
    dx, dy = F.col("cx") - F.col("_bx"), F.col("cy") - F.col("_by")
    d = d.withColumn("node", F.struct(*VERTS)).withColumn("rk", F.struct((-F.col("score")).alias("s"), (dx * dx + dy * dy).alias("d"), F.col("cv"), F.col("node")))
    d = cut(d.drop("_bx", "_by"))
    conf = shared_atoms(d, keys, "node")
    if no_intersect:
        conf = conf.unionByName(crossing_pairs(d, d, keys, "node", "node"))
    kept = first_independent_set(d.select(*keys, "node", "rk"), conf, keys, "rk")
    return d.join(kept.select(*keys, "node"), [*keys, "node"], "left_semi").drop("node", "rk", "cell")


# ---------------------------------------------------------------- growth

def _directions(max_hop: int) -> Column:
    """±a, ±b, ±c times 1..max_hop; c is the sum or the difference of a and b, whichever is the shorter diagonal's."""
    a, b = G.vec("ax", "ay"), G.vec("bx", "by")
    c = G.choose(G.axial_angle(a, b) < 90.0, G.add(a, b), G.sub(b, a))
    out = []
    for v in (a, G.neg(a), b, G.neg(b), c, G.neg(c)):
        for n in range(1, max_hop + 1):
            out.append(F.struct((v[0] * float(n)).alias("dx"), (v[1] * float(n)).alias("dy"), F.lit(len(out)).alias("dir")))
    return F.array(*out)


def grow(points: DataFrame, seeds: DataFrame, keys: list[str], max_hop: int, no_intersect: bool, accepted: DataFrame | None = None,
         min_score: float = 0.20, snap_mul: float = 0.35, snap_min: float = 2.0, merge_tol: float = 2.0, match_k: int = 8, max_rounds: int = 200) -> DataFrame:
    """Grow a lattice of cycles from one seed per group, round by round.

    ``seeds``: keys, p0..p3, x0..y3, steps ax, ay, bx, by and nn_med. Per round all open predictions are
    matched to free atoms at once; of conflicting matches the earliest (source cycle, direction) is accepted
    and the losers are tried again against the reduced set of free atoms. ``accepted`` holds cycles of
    earlier components, whose atoms are taken and whose edges may not be crossed.
    Returns the new cycles with their acceptance order ``seq``.
    """
    offs: list[Column] = []
    sd = seeds.withColumn("cx", (F.col("x0") + F.col("x1") + F.col("x2") + F.col("x3")) / 4.0).withColumn("cy", (F.col("y0") + F.col("y1") + F.col("y2") + F.col("y3")) / 4.0)
    for i in range(4):
        offs += [(F.col(f"x{i}") - F.col("cx")).alias(f"ox{i}"), (F.col(f"y{i}") - F.col("cy")).alias(f"oy{i}")]
    tmpl = cut(sd.select(*keys, *offs, "ax", "ay", "bx", "by", F.greatest(F.lit(snap_min), snap_mul * F.col("nn_med")).alias("snap"), (1.5 * F.col("nn_med")).alias("cell")))
    cols = [*keys, *VERTS, *COORDS, "cx", "cy", "seq"]
    start = sd.withColumn("seq", F.lit(0)).select(*cols)
    atoms = cut(points.join(tmpl.select(*keys, "snap"), keys).select(*keys, "pt_id", "x", "y", F.floor(F.col("x") / F.col("snap")).alias("gx"), F.floor(F.col("y") / F.col("snap")).alias("gy")))
    done = cut(start)
    old = None if accepted is None else cut(accepted.join(tmpl.select(*keys, "cell"), keys).select(*keys, *VERTS, *COORDS, "cell", F.struct(*VERTS).alias("ob")))

    def children(new: DataFrame) -> DataFrame:
        j = new.join(tmpl, keys).withColumn("d", F.explode(_directions(max_hop)))
        return j.select(*keys, F.col("seq").alias("src"), F.col("d.dir").alias("dir"), (F.col("cx") + F.col("d.dx")).alias("px"), (F.col("cy") + F.col("d.dy")).alias("py"))

    open_preds = children(done)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    for rnd in range(1, max_rounds + 1):
        # predictions close to an accepted centre are settled
        c = done.select(*keys, F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.explode(near).alias("n"))
        c = c.select(*[F.col(k).alias(f"_q_{k}") for k in keys], "qx", "qy",
                     (F.floor(F.col("qx") / merge_tol) + F.col("n.i")).alias("_qgx"), (F.floor(F.col("qy") / merge_tol) + F.col("n.j")).alias("_qgy"))
        pr = open_preds.withColumn("gx", F.floor(F.col("px") / merge_tol)).withColumn("gy", F.floor(F.col("py") / merge_tol))
        dx, dy = F.col("px") - F.col("qx"), F.col("py") - F.col("qy")
        cond = (dx * dx + dy * dy <= merge_tol * merge_tol) & (F.col("gx") == F.col("_qgx")) & (F.col("gy") == F.col("_qgy"))
        for k in keys:
            cond = cond & (F.col(k) == F.col(f"_q_{k}"))
        pr = pr.join(c, cond, "left_anti").drop("gx", "gy")
        # four predicted vertices, snapped to free atoms
        taken = done.select(*keys, F.explode(F.array(*VERTS)).alias("pt_id"))
        if old is not None:
            taken = taken.unionByName(old.select(*keys, F.explode(F.array(*VERTS)).alias("pt_id")))
        free = atoms.join(taken, [*keys, "pt_id"], "left_anti")
        vx = F.array(*[F.struct(F.lit(i).alias("v"), (F.col("px") + F.col(f"ox{i}")).alias("vx"), (F.col("py") + F.col(f"oy{i}")).alias("vy")) for i in range(4)])
        v = pr.join(tmpl, keys).select(*keys, "src", "dir", "snap", F.explode(vx).alias("e"))
        v = v.select(*keys, "src", "dir", "snap", "e.v", "e.vx", "e.vy", F.explode(near).alias("n"))
        v = v.withColumn("gx", F.floor(F.col("vx") / F.col("snap")) + F.col("n.i")).withColumn("gy", F.floor(F.col("vy") / F.col("snap")) + F.col("n.j")).drop("n")
        ddx, ddy = F.col("x") - F.col("vx"), F.col("y") - F.col("vy")
        m = v.join(free, [*keys, "gx", "gy"]).withColumn("d2", ddx * ddx + ddy * ddy).filter(F.col("d2") <= F.col("snap") * F.col("snap"))
        w = Window.partitionBy(*keys, "src", "dir", "v").orderBy("d2", "pt_id")
        m = m.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= match_k)
        opts = [F.collect_list(F.when(F.col("v") == i, F.struct(F.sqrt("d2").alias("d"), F.col("pt_id").alias("p"), "x", "y"))).alias(f"o{i}") for i in range(4)]
        g = m.groupBy(*keys, "src", "dir").agg(*opts)
        for i in range(4):
            g = g.withColumn(f"m{i}", F.explode(f"o{i}")).drop(f"o{i}")
            for k in range(i):
                g = g.filter(F.col(f"m{i}.p") != F.col(f"m{k}.p"))
        cost = F.col("m0.d") + F.col("m1.d") + F.col("m2.d") + F.col("m3.d")
        best = g.groupBy(*keys, "src", "dir").agg(F.min(F.struct(cost.alias("cost"), "m0", "m1", "m2", "m3")).alias("b"))
        named = [F.col(f"b.m{i}.p").alias(f"p{i}") for i in range(4)] + [F.col(f"b.m{i}.{a}").alias(f"{a}{i}") for i in range(4) for a in "xy"]
        # stored before any filter: a predicate on the score must not be rewritten in terms of the coordinates
        scored = cut(with_score(with_shape(best.select(*keys, "src", "dir", *named))).join(tmpl.select(*keys, "cell"), keys)
                     .select(*keys, *VERTS, *COORDS, "cx", "cy", "src", "dir", "score", "cell"))
        # one candidate per vertex set: the earliest prediction
        first = Window.partitionBy(*keys, "vs").orderBy("src", "dir")
        cand = scored.filter(F.col("score") >= min_score).withColumn("vs", F.array_sort(F.array(*VERTS)))
        cand = cand.withColumn("r", F.row_number().over(first)).filter("r = 1").drop("r", "vs", "score")
        cand = cand.withColumn("rk", F.col("src").cast("bigint") * 64 + F.col("dir"))
        if no_intersect:
            prior = done.join(tmpl.select(*keys, "cell"), keys).select(*keys, *COORDS, "cell", (-F.col("seq").cast("bigint") - 1).alias("ob"))
            if old is not None:
                prior = prior.unionByName(old.select(*keys, *COORDS, "cell", F.xxhash64("ob").alias("ob")))
            hit = crossing_pairs(cand, prior, keys, "rk", "ob").select(*keys, F.col("a").alias("rk")).distinct()
            cand = cand.join(hit, [*keys, "rk"], "left_anti")
            conf = shared_atoms(cand, keys, "rk").unionByName(crossing_pairs(cand, cand, keys, "rk", "rk"))
        else:
            conf = shared_atoms(cand, keys, "rk")
        later = conf.filter("b < a").select(*keys, F.col("a").alias("rk")).distinct()
        flag = later.withColumn("late", F.lit(True))
        cand = cut(cand.join(flag, [*keys, "rk"], "left").withColumn("late", F.coalesce("late", F.lit(False))))
        if cand.isEmpty():
            return done
        base = done.groupBy(*keys).agg((F.max("seq") + 1).alias("base"))
        order = Window.partitionBy(*keys).orderBy("rk")
        new = cand.filter("not late").withColumn("n", F.row_number().over(order)).join(base, keys)
        new = new.withColumn("seq", (F.col("n") + F.col("base") - 1).cast("int")).select(*cols)
        done = cut(done.unionByName(new))
        fresh = done.join(base, keys).filter(F.col("seq") >= F.col("base")).select(*cols)
        retry = cand.filter("late").select(*keys, "src", "dir").join(pr, [*keys, "src", "dir"]).select(*keys, "src", "dir", "px", "py")
        open_preds = cut(children(fresh).unionByName(retry))
    raise RuntimeError("growth did not settle")
