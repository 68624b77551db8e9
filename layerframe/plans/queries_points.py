"""Queries on point clouds (E) and the stacking pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..iterate import cut
from ..operators import cycles as C
from ..operators import interlayer as I
from ..operators import keys as K
from ..operators import lattice as L
from ..operators import points as P
from . import standins as T
from .queries_tables import rounded
from .registry import query


@query("e01_radius_pairs", f"WITH {T.PTS} SELECT a.sample, a.pt_id AS i, b.pt_id AS j, round(sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)),6) AS d FROM pts a JOIN pts b ON a.sample=b.sample AND a.pt_id<b.pt_id WHERE power(a.x-b.x,2)+power(a.y-b.y,2) <= 900")
def radius_pairs(spark, d):
    return rounded(P.radius_pairs(T.pts(spark, d), 30.0, ["sample"]))


NN = """nb AS (SELECT sample, i, j, dx, dy, sqrt(d2) AS d, row_number() OVER (PARTITION BY sample, i ORDER BY d2, j) AS rank FROM (
  SELECT a.sample, a.pt_id AS i, b.pt_id AS j, b.x-a.x AS dx, b.y-a.y AS dy, (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y) AS d2 FROM pts a JOIN pts b ON a.sample=b.sample AND a.pt_id<>b.pt_id))"""


@query("e02_k_nearest", f"WITH {T.PTS}, {NN} SELECT sample, i, j, rank, round(d,6) AS d, round(dx,6)+0.0 AS dx, round(dy,6)+0.0 AS dy FROM nb WHERE rank <= 6")
def k_nearest(spark, d):
    return rounded(P.knn(T.pts(spark, d), 6, ["sample"]))


@query("e02_k_nearest_bounded", f"WITH {T.PTS}, {NN} SELECT sample, i, j, rank, round(d,6) AS d FROM nb WHERE rank <= 8 AND d <= 25")
def k_nearest_bounded(spark, d):
    return rounded(P.knn(T.pts(spark, d), 8, ["sample"], bound=25.0).drop("dx", "dy"))


@query("e03_nn_summary", f"WITH {T.PTS}, {NN} SELECT sample, round(min(d),6) AS nn_min, count(*) AS n, round(quantile_cont(d,0.5),6) AS nn_med FROM nb WHERE rank=1 GROUP BY sample")
def nn_summary(spark, d):
    return rounded(P.nn_summary(T.pts(spark, d), ["sample"]))


@query("e04_displacement_vectors", f"""WITH {T.PTS}, {NN}, g AS (SELECT sample FROM pts GROUP BY sample HAVING count(*) >= 13), v AS (SELECT sample, i, j, dx, dy FROM nb WHERE rank <= 12 AND d BETWEEN 8 AND 160 AND sample IN (SELECT sample FROM g))
SELECT sample, i, j, round(dx,6)+0.0 AS dx, round(dy,6)+0.0 AS dy FROM v UNION ALL SELECT sample, j, i, round(-dx,6)+0.0, round(-dy,6)+0.0 FROM v""")
def displacement_vectors(spark, d):
    return rounded(P.displacement_vectors(T.pts(spark, d), ["sample"], augment=True))


@query("b12_legacy_rescale", f"WITH {T.PTS}, m AS (SELECT sample, layer, max(greatest(x,y)) AS m FROM pts GROUP BY ALL) SELECT p.sample, p.layer, pt_id, round(x * CASE WHEN m <= 140 THEN 4 ELSE 1 END, 6)+0.0 AS x, round(y * CASE WHEN m <= 140 THEN 4 ELSE 1 END, 6)+0.0 AS y FROM pts p JOIN m ON p.sample=m.sample AND p.layer=m.layer")
def legacy_rescale(spark, d):
    return rounded(P.legacy_rescale(T.pts(spark, d), ["sample", "layer"]).select("sample", "layer", "pt_id", "x", "y"))


# ---------------------------------------------------------------- cycles

def _lim(spark, d):
    a = T.lattice_atoms(spark, d)
    return a.withColumn("lim", F.lit(14.2))


def cycles(spark, d):
    return cut(C.with_score(C.with_shape(C.enumerate_cycles(_lim(spark, d), ["sample"], F.col("lim")))))


def _ax(ux, uy, vx, vy):
    return f"degrees(acos(least(1.0, abs(({ux})*({vx})+({uy})*({vy})) / (sqrt(({ux})*({ux})+({uy})*({uy}))*sqrt(({vx})*({vx})+({vy})*({vy}))))))"


CYC = f"""{T.LATTICE_ATOMS}, ed AS (SELECT a.sample, a.pt_id AS i, b.pt_id AS j FROM atoms a JOIN atoms b ON a.sample=b.sample AND a.pt_id<b.pt_id WHERE power(a.x-b.x,2)+power(a.y-b.y,2) <= 14.2*14.2),
ad AS (SELECT sample, i AS a, j AS b FROM ed UNION ALL SELECT sample, j, i FROM ed),
cn AS (SELECT e.sample, e.i, e.j, p.b AS k FROM ed e JOIN ad p ON e.sample=p.sample AND e.i=p.a JOIN ad q ON e.sample=q.sample AND e.j=q.a AND p.b=q.b),
cy0 AS (SELECT u.sample, u.i, u.j, u.k, v.k AS l, list_sort([u.i, u.j, u.k, v.k]) AS vs FROM cn u JOIN cn v ON u.sample=v.sample AND u.i=v.i AND u.j=v.j AND u.k<v.k),
cy1 AS (SELECT *, row_number() OVER (PARTITION BY sample, vs ORDER BY i, j, k, l) AS r FROM cy0),
cy AS (SELECT c.sample, c.k AS p0, c.i AS p1, c.l AS p2, c.j AS p3, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1, e.x AS x2, e.y AS y2, f.x AS x3, f.y AS y3 FROM cy1 c
 JOIN atoms a ON a.sample=c.sample AND a.pt_id=c.k JOIN atoms b ON b.sample=c.sample AND b.pt_id=c.i JOIN atoms e ON e.sample=c.sample AND e.pt_id=c.l JOIN atoms f ON f.sample=c.sample AND f.pt_id=c.j WHERE r=1),
sh0 AS (SELECT *, sqrt(power(x1-x0,2)+power(y1-y0,2)) AS l0, sqrt(power(x2-x1,2)+power(y2-y1,2)) AS l1, sqrt(power(x3-x2,2)+power(y3-y2,2)) AS l2, sqrt(power(x0-x3,2)+power(y0-y3,2)) AS l3,
 sqrt(power(x2-x0,2)+power(y2-y0,2)) AS g0, sqrt(power(x3-x1,2)+power(y3-y1,2)) AS g1 FROM cy),
sh AS (SELECT *, (l0+l1+l2+l3)/4 AS side, sqrt((power(l0-(l0+l1+l2+l3)/4,2)+power(l1-(l0+l1+l2+l3)/4,2)+power(l2-(l0+l1+l2+l3)/4,2)+power(l3-(l0+l1+l2+l3)/4,2))/4)/((l0+l1+l2+l3)/4) AS cv,
 (x0+x1+x2+x3)/4 AS cx, (y0+y1+y2+y3)/4 AS cy, CASE WHEN g1>g0 THEN (x3-x1)/g1 ELSE (x2-x0)/g0 END AS ux, CASE WHEN g1>g0 THEN (y3-y1)/g1 ELSE (y2-y0)/g0 END AS uy FROM sh0),
an AS (SELECT *, {_ax('x1-x0','y1-y0','x2-x3','y2-y3')} AS par0, {_ax('x2-x1','y2-y1','x3-x0','y3-y0')} AS par1, {_ax('x1-x0','y1-y0','x2-x1','y2-y1')} AS s1, {_ax('x1-x0','y1-y0','x3-x2','y3-y2')} AS s2, {_ax('x1-x0','y1-y0','x0-x3','y0-y3')} AS s3 FROM sh),
fr AS (SELECT *, greatest(0, s1, s2, s3) AS sep, CASE WHEN s1 >= s2 AND s1 >= s3 THEN x2-x1 WHEN s2 >= s3 THEN x3-x2 ELSE x0-x3 END AS fx, CASE WHEN s1 >= s2 AND s1 >= s3 THEN y2-y1 WHEN s2 >= s3 THEN y3-y2 ELSE y0-y3 END AS fy FROM an),
gr AS (SELECT *, CASE WHEN s1 <= {_ax('x2-x1','y2-y1','fx','fy')} THEN 0 ELSE 1 END AS q1, CASE WHEN s2 <= {_ax('x3-x2','y3-y2','fx','fy')} THEN 0 ELSE 1 END AS q2, CASE WHEN s3 <= {_ax('x0-x3','y0-y3','fx','fy')} THEN 0 ELSE 1 END AS q3 FROM fr),
sc AS (SELECT *, CASE WHEN side < 1e-6 OR sep < 25 OR q1+q2+q3 = 0 THEN -1e9 ELSE 1/(1+power(cv/0.12,2)+power(par0/8,2)+power(par1/8,2)+power((s1-60)/15,2)+power((sep-60)/20,2)+power(2-q1-q2-q3,2)+power(2-(CASE WHEN q2=0 THEN 1 ELSE 0 END)-(CASE WHEN q1=q3 THEN 1 ELSE 0 END),2)) END AS score FROM gr)"""


@query("e05_four_cycles", f"WITH {CYC} SELECT sample, p0, p1, p2, p3 FROM cy")
def four_cycles(spark, d):
    return cycles(spark, d).select("sample", *C.VERTS)


@query("e06_cycle_shape", f"WITH {CYC} SELECT sample, p0, p1, p2, p3, round(side,6) AS side, round(cx,6) AS cx, round(cy,6) AS cy, round(ux,6)+0.0 AS ux, round(uy,6)+0.0 AS uy, round(greatest(g0,g1),6) AS diag_long, round(least(g0,g1),6) AS diag_short FROM sh")
def cycle_shape(spark, d):
    return rounded(cycles(spark, d).select("sample", *C.VERTS, "side", "cx", "cy", "ux", "uy", "diag_long", "diag_short"))


@query("e07_cycle_score", f"WITH {CYC} SELECT sample, p0, p1, p2, p3, round(score,5) AS score FROM sc")
def cycle_score(spark, d):
    return rounded(cycles(spark, d).select("sample", *C.VERTS, "score"), 5)


@query("e08_strict_colour", f"WITH {CYC} SELECT sample, p0, p1, p2, p3, (score > 0 AND par0 <= 6 AND par1 <= 6 AND s1 BETWEEN 45 AND 75 AND sep >= 35 AND q1+q2+q3 = 2 AND q2 = 0 AND q1 = q3) AS strict FROM sc")
def strict_colour(spark, d):
    return cycles(spark, d).select("sample", *C.VERTS, "strict")


@query("e09_dominant_direction", f"""WITH {CYC}, k AS (SELECT * FROM sc WHERE score > 0.2), c AS (SELECT a.sample, a.p0, a.p1, a.p2, a.p3, a.ux, a.uy, sum(CASE WHEN degrees(acos(least(1.0, abs(a.ux*b.ux+a.uy*b.uy)))) <= 25 THEN 1 ELSE 0 END) AS cnt FROM k a JOIN k b ON a.sample=b.sample GROUP BY ALL),
r AS (SELECT sample, arg_min(ux, o) AS rx, arg_min(uy, o) AS ry, max(cnt) AS best, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY cnt DESC, p1, p3, p0, p2) AS o FROM c) GROUP BY sample),
a AS (SELECT c.sample, sum(CASE WHEN ux*rx+uy*ry < 0 THEN -ux ELSE ux END) AS ax, sum(CASE WHEN ux*rx+uy*ry < 0 THEN -uy ELSE uy END) AS ay FROM c JOIN r ON c.sample=r.sample WHERE degrees(acos(least(1.0, abs(ux*rx+uy*ry)))) <= 25 GROUP BY c.sample)
SELECT c.sample, p0, p1, p2, p3, cnt FROM c JOIN r ON c.sample=r.sample JOIN a ON a.sample=c.sample WHERE n < 4 OR best < 2 OR degrees(acos(least(1.0, abs(ux*ax+uy*ay)/sqrt(ax*ax+ay*ay)))) <= 25""")
def dominant_direction(spark, d):
    return rounded(C.dominant_direction_filter(cycles(spark, d).filter("score > 0.2"), ["sample"]).select("sample", *C.VERTS, "cnt"))


@query("e10_crossing_cycles", f"""WITH {CYC}, e AS (SELECT sample, p0, p1, p2, p3, x0, y0, x1, y1, x2, y2, x3, y3, cx, cy FROM sh),
eg AS (SELECT sample, p0, p1, p2, p3, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by FROM e UNION ALL SELECT sample, p0, p1, p2, p3, x1, y1, x2, y2 FROM e UNION ALL SELECT sample, p0, p1, p2, p3, x2, y2, x3, y3 FROM e UNION ALL SELECT sample, p0, p1, p2, p3, x3, y3, x0, y0 FROM e),
eh AS (SELECT sample, p0+1000000 AS p0, p1+1000000 AS p1, p2+1000000 AS p2, p3+1000000 AS p3, ax+3.1::DOUBLE AS ax, ay+2.3::DOUBLE AS ay, bx+3.1::DOUBLE AS bx, eg.by+2.3::DOUBLE AS by FROM eg),
pr AS (SELECT a.sample, a.p0, a.p1, a.p2, a.p3, b.p0 AS o0, b.p1 AS o1, b.p2 AS o2, b.p3 AS o3, ((a.bx-a.ax)*(b.by-b.ay)-(a.by-a.ay)*(b.bx-b.ax)) AS den, ((b.ax-a.ax)*(b.by-b.ay)-(b.ay-a.ay)*(b.bx-b.ax)) AS tn, ((b.ax-a.ax)*(a.by-a.ay)-(b.ay-a.ay)*(a.bx-a.ax)) AS un
 FROM eg a JOIN eh b ON a.sample=b.sample)
SELECT DISTINCT sample, p0, p1, p2, p3, o0, o1, o2, o3 FROM pr WHERE abs(den) >= 1e-12 AND tn/den > 1e-9 AND tn/den < 1-1e-9 AND un/den > 1e-9 AND un/den < 1-1e-9""")
def crossing_cycles(spark, d):
    # cycles of one layer seldom cross: the layer against its copy moved by a fixed step
    c = cycles(spark, d).withColumn("cell", F.lit(20.0))
    moved = c.withColumns({f"{n}{i}": F.col(f"{n}{i}") + step for n, step in (("p", 1000000), ("x", 3.1), ("y", 2.3)) for i in range(4)})
    p = C.crossing_pairs(*[t.withColumn("id", F.struct(*C.VERTS)) for t in (c, moved)], ["sample"], "id", "id")
    return p.select("sample", *[F.col(f"a.p{i}").alias(f"p{i}") for i in range(4)], *[F.col(f"b.p{i}").alias(f"o{i}") for i in range(4)])


@query("e11_disjoint_cycles")
def disjoint_cycles(spark, d):
    return rounded(C.select_disjoint(cycles(spark, d).filter("score > 0.2"), ["sample"]).select("sample", *C.VERTS, "score"), 5)


@query("e13_seed_cycle", f"WITH {CYC}, k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(score, 9) DESC, p1, p3, p0, p2) AS r FROM sc WHERE score > 0.2) SELECT sample, round(score,5) AS score FROM k WHERE r = 1")
def seed_cycle(spark, d):
    k = cycles(spark, d).filter("score > 0.2")
    best = k.groupBy("sample").agg(F.max_by(F.struct(*C.VERTS, "score"), F.struct(F.col("score"), *[(-F.col(f"p{i}")).alias(f"r{i}") for i in (1, 3, 0, 2)])).alias("s"))
    return rounded(best.select("sample", "s.score"), 5)


# ---------------------------------------------------------------- directions and axes on the table points

@query("e14_two_means")
def two_means(spark, d):
    v = T.table(spark, d, "events").select(F.col("event_type").alias("grp"), "value")
    return rounded(L.two_means(v, ["grp"], "value"))


HIST = f"""{T.PTS}, {NN}, hh AS (SELECT sample, least(179, CAST(floor(CASE WHEN degrees(atan2(dy,dx)) < 0 THEN degrees(atan2(dy,dx))+180 WHEN degrees(atan2(dy,dx)) >= 180 THEN 0 ELSE degrees(atan2(dy,dx)) END) AS INT)) AS b FROM nb WHERE rank <= 6)"""


@query("e15_direction_histogram", f"WITH {HIST} SELECT sample, b AS deg, count(*) AS n FROM hh GROUP BY ALL")
def direction_histogram(spark, d):
    h = L.direction_histogram(P.knn(T.pts(spark, d), 6, ["sample"]), ["sample"])
    return rounded(h.select("sample", F.posexplode("h").alias("deg", "n")).filter("n > 0"))


def _picked(spark, d):
    h = cut(L.direction_histogram(P.knn(T.pts(spark, d), 6, ["sample"]), ["sample"]))
    return cut(L.pick_axes(h, ["sample"]))


@query("e15_candidate_axes")
def candidate_axes(spark, d):
    return rounded(_picked(spark, d).select("sample", F.posexplode("axes").alias("rank", "e")).select("sample", "rank", "e.a", "e.w"))


@query("e16_main_axes")
def main_axes(spark, d):
    p = _picked(spark, d)
    e = p.withColumn("e0", F.struct(F.lit(1.0).alias("x"), F.lit(0.2).alias("y"))).withColumn("e1", F.struct(F.lit(-0.4).alias("x"), F.lit(1.0).alias("y")))
    return rounded(L.main_axes(e, ["sample"]))


AXE = f"""{T.PTS}, {NN}, nm AS (SELECT sample, quantile_cont(d,0.5) AS m, min(d) AS mn FROM nb WHERE rank=1 GROUP BY sample), eu AS (SELECT DISTINCT n.sample, least(i,j) AS a, greatest(i,j) AS b FROM nb n WHERE rank <= 6),
el AS (SELECT e.sample, e.a, e.b, q.x-p.x AS dx, q.y-p.y AS dy, sqrt(power(q.x-p.x,2)+power(q.y-p.y,2)) AS d FROM eu e JOIN pts p ON p.sample=e.sample AND p.pt_id=e.a JOIN pts q ON q.sample=e.sample AND q.pt_id=e.b),
ea AS (SELECT el.*, m, mn, {_ax('dx','dy','cos(radians(30.0))','sin(radians(30.0))')} AS t0, {_ax('dx','dy','cos(radians(95.0))','sin(radians(95.0))')} AS t1 FROM el JOIN nm ON nm.sample=el.sample)"""


@query("e17_axis_edges", f"""WITH {AXE}, x AS (SELECT sample, a, b, d, CASE WHEN t0 <= t1 THEN 0 ELSE 1 END AS axis, m, mn FROM ea WHERE least(t0, t1) <= 18)
SELECT sample, axis, 'nn_med' AS rule, count(*) AS n, round(avg(d),6) AS mean_d FROM x WHERE d BETWEEN 0.6*m AND 2.2*m GROUP BY ALL UNION ALL SELECT sample, axis, 'nn_min', count(*), round(avg(d),6) FROM x WHERE d >= mn AND d <= 1.2*mn GROUP BY ALL""")
def axis_edges(spark, d):
    p = cut(T.pts(spark, d))
    ax = p.select("sample").distinct().withColumn("a0", F.lit(30.0)).withColumn("a1", F.lit(95.0))
    e = L.axis_edges(p, ax, ["sample"])
    return rounded(e.groupBy("sample", "axis", "rule").agg(F.count("*").alias("n"), F.avg("d").alias("mean_d")))


@query("e18_lattice_vectors")
def lattice_vectors(spark, d):
    p = cut(T.pts(spark, d))
    ax = p.select("sample").distinct().withColumn("a0", F.lit(30.0)).withColumn("a1", F.lit(95.0))
    v = L.lattice_vectors(L.axis_lengths(L.axis_edges(p, ax, ["sample"]), ["sample"]))
    return rounded(v.select("sample", "best", F.col("da.x").alias("da_x"), F.col("da.y").alias("da_y"), F.col("db.x").alias("db_x"), F.col("db.y").alias("db_y")))


@query("e19_origin", f"""WITH {CYC}, s AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY power(cx-63.5,2)+power(cy-63.5,2), p0, p1, p2, p3) AS r FROM sc WHERE score > 0.2) SELECT sample, round(sqrt(power(cx-63.5,2)+power(cy-63.5,2)),5) AS dist FROM s WHERE r = 1""")
def origin_cycle(spark, d):
    k = cycles(spark, d).filter("score > 0.2").withColumn("seq", F.struct(*C.VERTS))
    o = L.pick_origin(k, ["sample"], F.lit(128), F.lit(128))
    near = k.groupBy("sample").agg(F.min(F.sqrt((F.col("cx") - 63.5) * (F.col("cx") - 63.5) + (F.col("cy") - 63.5) * (F.col("cy") - 63.5))).alias("dist"))
    return rounded(o.join(near, "sample").select("sample", "dist"), 5)


@query("e12_e20_layer_lattice")
def layer_lattice(spark, d):
    r = layer_table(spark, d)
    return rounded(r.select("sample", "ok", "reason", "n_atoms", "n_cycles", *[F.col(f"{v}.{a}").alias(f"{v}_{a}") for v in ("origin", "da", "db") for a in "xy"], "angle_db_da"), 4)


def layer_table(spark, d):
    a = T.lattice_atoms(spark, d)
    im = a.select("sample").distinct().select("sample", F.lit(128).alias("w"), F.lit(128).alias("h"), F.lit(27.9).alias("side_angstrom"))
    return L.layer_lattice(a, im, ["sample"])


# ---------------------------------------------------------------- vectors and classes

def vectors(spark, d):
    """Two lattice vector pairs per embedding row: components 1..4 and 5..8 as da0, db0, da1, db1."""
    e = T.table(spark, d, "embeddings")
    x = [F.col("embedding")[i].cast("double") for i in range(8)]
    s = lambda i: F.struct(x[i].alias("x"), x[i + 1].alias("y"))
    return e.select("vec_id", s(0).alias("da0"), s(2).alias("db0"), s(4).alias("da1"), s(6).alias("db1"))


VEC = "ve AS (SELECT vec_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(["ax0", "ay0", "bx0", "by0", "ax1", "ay1", "bx1", "by1"])) + " FROM embeddings)"


@query("e21_vector_relations", f"""WITH {VEC} SELECT vec_id, CASE WHEN abs(ax0*by0-ay0*bx0) <= greatest(1e-6*sqrt(ax0*ax0+ay0*ay0)*sqrt(bx0*bx0+by0*by0), 1e-9) THEN 0 WHEN ax0*by0-ay0*bx0 > 0 THEN 1 ELSE -1 END AS hand,
 round({_ax('ax0','ay0','bx0','by0')}, 6) AS axial, round(2*(ax0*bx0+ay0*by0)*bx0/(bx0*bx0+by0*by0)-ax0, 6)+0.0 AS rx, round(2*(ax0*bx0+ay0*by0)*by0/(bx0*bx0+by0*by0)-ay0, 6)+0.0 AS ry,
 round(CASE WHEN ax0*bx0+ay0*by0 < 0 THEN -ax0 ELSE ax0 END, 6)+0.0 AS sx FROM ve""")
def vector_relations(spark, d):
    v = vectors(spark, d)
    a, b = G.field("da0"), G.field("db0")
    r = G.reflect(a, b)
    return rounded(v.select("vec_id", G.handedness(a, b).alias("hand"), G.axial_angle(a, b).alias("axial"), r[0].alias("rx"), r[1].alias("ry"), G.align_sign(a, b)[0].alias("sx")))


@query("e22_stacking_class", f"""WITH {VEC}, h AS (SELECT *, sign(ax0*by0-ay0*bx0) <> sign(ax1*by1-ay1*bx1) AS flip FROM ve), t AS (SELECT *, {_ax('bx0','by0','bx1','by1')} AS th FROM h),
u AS (SELECT *, CASE WHEN flip AND th <= 30 THEN 'flip_slip' WHEN flip THEN 'flip_twist' WHEN th <= 30 THEN 'slip' ELSE 'twist' END AS class,
 CASE WHEN flip THEN -2*(ax0*bx0+ay0*by0)*bx0/(bx0*bx0+by0*by0)+ax0 ELSE ax0 END AS rax, CASE WHEN flip THEN -2*(ax0*bx0+ay0*by0)*by0/(bx0*bx0+by0*by0)+ay0 ELSE ay0 END AS ray,
 CASE WHEN flip THEN -bx0 ELSE bx0 END AS rbx, CASE WHEN flip THEN -by0 ELSE by0 END AS rby FROM t)
SELECT vec_id, class, flip AS is_flip, round(th,6) AS theta_deg, CASE WHEN class LIKE '%slip' THEN round(0.5*(rax + CASE WHEN ax1*rax+ay1*ray < 0 THEN -ax1 ELSE ax1 END),6)+0.0 END AS da_mean_x,
 CASE WHEN class LIKE '%slip' THEN round(0.5*(rby + CASE WHEN bx1*rbx+by1*rby < 0 THEN -by1 ELSE by1 END),6)+0.0 END AS db_mean_y FROM u""")
def stacking_class(spark, d):
    v = vectors(spark, d)
    o = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    half = lambda i: v.select("vec_id", F.lit(True).alias("ok"), F.lit("").alias("reason"), o.alias("origin"), F.col(f"da{i}").alias("da"), F.col(f"db{i}").alias("db"))
    s = I.stacking_class(half(0), half(1), ["vec_id"], slip_deg=30.0)
    return rounded(s.select("vec_id", "class", "is_flip", "theta_deg", F.col("da_mean.x").alias("da_mean_x"), F.col("db_mean.y").alias("db_mean_y")))


@query("e23_trimmed_mean", """WITH v AS (SELECT o_custkey % 50 AS grp, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_custkey % 50) AS n FROM orders)
SELECT grp, n, round(avg(v), 6) AS score FROM v WHERE r <= least(n, greatest(120, floor(n * 0.8::DOUBLE))) GROUP BY grp, n""")
def trimmed_mean(spark, d):
    o = T.table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("grp"), F.col("o_totalprice").alias("v"))
    return rounded(P.trimmed_mean(o, ["grp"], "v", 0.2, 120))


@query("e24_shift_search", f"""WITH {T.PTS}, s1 AS (SELECT dx, dy FROM (SELECT unnest(generate_series(-16, 16, 8)) AS dx), (SELECT unnest(generate_series(-16, 16, 8)) AS dy)),
n1 AS (SELECT m.sample, dx, dy, m.pt_id, min(sqrt(power(m.x+dx-r.x,2)+power(m.y+dy-r.y,2))) AS d FROM pts m, s1, pts r WHERE m.layer=1 AND r.layer=0 AND r.sample=m.sample GROUP BY ALL),
k1 AS (SELECT *, row_number() OVER (PARTITION BY sample,dx,dy ORDER BY d) AS r, count(*) OVER (PARTITION BY sample,dx,dy) AS n FROM n1), c1 AS (SELECT sample, dx, dy, avg(d) AS s FROM k1 WHERE r <= least(n, greatest(10, floor(n*0.8::DOUBLE))) GROUP BY ALL),
b1 AS (SELECT sample, dx AS ox, dy AS oy FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY s, dx, dy) AS q FROM c1) WHERE q=1),
s2 AS (SELECT sample, ox+a AS dx, oy+b AS dy FROM b1, (SELECT unnest(generate_series(-8, 8)) AS a), (SELECT unnest(generate_series(-8, 8)) AS b)),
n2 AS (SELECT m.sample, dx, dy, m.pt_id, min(sqrt(power(m.x+dx-r.x,2)+power(m.y+dy-r.y,2))) AS d FROM pts m JOIN s2 ON s2.sample=m.sample JOIN pts r ON r.sample=m.sample AND r.layer=0 WHERE m.layer=1 GROUP BY ALL),
k2 AS (SELECT *, row_number() OVER (PARTITION BY sample,dx,dy ORDER BY d) AS r, count(*) OVER (PARTITION BY sample,dx,dy) AS n FROM n2), c2 AS (SELECT sample, dx, dy, avg(d) AS s FROM k2 WHERE r <= least(n, greatest(10, floor(n*0.8::DOUBLE))) GROUP BY ALL)
SELECT sample, dx, dy, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY s, dx, dy) AS q FROM c2) WHERE q=1""")
def shift_search(spark, d):
    p = cut(T.pts(spark, d))
    return rounded(I.search_shift(p.filter("layer = 0"), p.filter("layer = 1"), ["sample"], max_shift=16, coarse=8, min_keep=10))


@query("e25_shift_projection", f"""WITH {VEC}, g AS (SELECT *, CASE WHEN bx1*bx0+by1*by0 < 0 THEN -1 ELSE 1 END AS f FROM ve), s AS (SELECT g.*, sg, 0.31::DOUBLE*sg AS vx, -0.17::DOUBLE*sg AS vy FROM g, (SELECT unnest([1,-1]) AS sg)),
c AS (SELECT *, (vx*by0-vy*bx0)/(ax0*by0-ay0*bx0) AS a0, (ax0*vy-ay0*vx)/(ax0*by0-ay0*bx0) AS b0, (vx*by1*f-vy*bx1*f)/(ax1*by1-ay1*bx1) AS a1r, (ax1*f*vy-ay1*f*vx)/(ax1*by1-ay1*bx1) AS b1r FROM s),
m AS (SELECT *, 0.5*(a0 + a1r - round_even(a1r-a0, 0)) AS am, 0.5*(b0 + b1r - round_even(b1r-b0, 0)) AS bm FROM c), q AS (SELECT *, am-floor(am) AS fa, bm-floor(bm) AS fb FROM m),
r AS (SELECT *, CASE WHEN fa+fb>1 THEN 1-fa ELSE fa END AS ar, CASE WHEN fa+fb>1 THEN 1-fb ELSE fb END AS br FROM q), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(ar*ar+br*br, 9), sg DESC) AS k FROM r)
SELECT vec_id, round(ar*ar+br*br, 4) AS norm2 FROM o WHERE k=1""")
def shift_projection(spark, d):
    v = vectors(spark, d).withColumn("sx", F.lit(0.31)).withColumn("sy", F.lit(-0.17))
    p = I.project_shift(v)
    return rounded(p.select("vec_id", (F.col("ab_mean_reduced_a") * F.col("ab_mean_reduced_a") + F.col("ab_mean_reduced_b") * F.col("ab_mean_reduced_b")).alias("norm2")), 4)


@query("e26_twist_search")
def twist_search(spark, d):
    p = cut(T.pts(spark, d))
    v0 = P.displacement_vectors(p.filter("layer = 0"), ["sample"], k=6)
    v1 = P.displacement_vectors(p.filter("layer = 1"), ["sample"], k=6)
    cen = p.select("sample").distinct().withColumn("center", F.lit(20.0))
    return rounded(I.search_twist(v0, v1, cen, ["sample"], radius=6.0, refine=((0.2, 2.0), (0.02, 0.4))))


@query("e27_reflected_points", f"""WITH {T.PTS} SELECT sample, pt_id, round(10+2*((x-10)*0.6::DOUBLE+(y-20)*0.8::DOUBLE)*0.6::DOUBLE-(x-10),6)+0.0 AS rx, round(20+2*((x-10)*0.6::DOUBLE+(y-20)*0.8::DOUBLE)*0.8::DOUBLE-(y-20),6)+0.0 AS ry FROM pts""")
def reflected_points(spark, d):
    r = G.reflect_about(G.vec("x", "y"), (F.lit(10.0), F.lit(20.0)), (F.lit(3.0), F.lit(4.0)))
    return rounded(T.pts(spark, d).select("sample", "pt_id", r[0].alias("rx"), r[1].alias("ry")))


def _bilayer(spark, d):
    """Stacking table and points of label pairs: vectors of the label's first row, points of the table."""
    p = cut(T.pts(spark, d))
    v = vectors(spark, d).join(T.table(spark, d, "embeddings").select("vec_id", "label"), "vec_id")
    w = v.groupBy(F.col("label").alias("sample")).agg(*[F.min_by(c, "vec_id").alias(c) for c in ("da0", "db0", "da1", "db1")])
    o = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    big = lambda c: F.struct((F.col(c)["x"] * 400).alias("x"), (F.col(c)["y"] * 400).alias("y"))
    half = lambda i: w.select("sample", F.lit(True).alias("ok"), F.lit("").alias("reason"), o.alias("origin"), big(f"da{i}").alias("da"), big(f"db{i}").alias("db"))
    return p, I.stacking_class(half(0), half(1), ["sample"], slip_deg=45.0)


@query("e28_interlayer_table")
def interlayer_table(spark, d):
    p, s = _bilayer(spark, d)
    out = I.analyse(s, p, ["sample"], K.side_angstrom(K.size_tag(F.concat(F.lit("s_"), F.col("sample").cast("string"), F.lit("x3"), F.lit("")), "folder")))
    return rounded(out.select("sample", "class", "reason", "n0", "n1", "sideA_A", "shift_px_x", "shift_px_y", "shift_A_x", "ab_mean_reduced_a", "ab_mean_reduced_b", "twist_fine_deg", "twist_score"), 4)


@query("e29_class_tally", f"""WITH {VEC}, t AS (SELECT sign(ax0*by0-ay0*bx0) <> sign(ax1*by1-ay1*bx1) AS flip, {_ax('bx0','by0','bx1','by1')} AS th FROM ve) SELECT CASE WHEN flip AND th <= 30 THEN 'flip_slip' WHEN flip THEN 'flip_twist' WHEN th <= 30 THEN 'slip' ELSE 'twist' END AS class, count(*) AS n FROM t GROUP BY ALL""")
def class_tally(spark, d):
    return I.class_tally(stacking_class(spark, d))


@query("e30_alignment_check", f"""WITH {T.PTS}, n AS (SELECT sample, count(CASE WHEN layer=0 THEN 1 END) AS n0, count(CASE WHEN layer=1 THEN 1 END) AS n1 FROM pts GROUP BY sample),
m AS (SELECT a.sample, a.pt_id, min(sqrt(power(a.x-5-b.x,2)+power(a.y+3-b.y,2))) AS d FROM pts a JOIN pts b ON a.sample=b.sample AND b.layer=0 WHERE a.layer=1 GROUP BY ALL)
SELECT n.sample, n0, n1, round(avg(d),6) AS mean_d, count(d) > 0 AS has_alignment FROM n LEFT JOIN m ON m.sample=n.sample GROUP BY n.sample, n0, n1""")
def alignment_check(spark, d):
    p = T.pts(spark, d)
    sh = p.select("sample").distinct().withColumn("shift_px_x", F.lit(5.0)).withColumn("shift_px_y", F.lit(-3.0))
    return rounded(I.alignment_check(p, sh, ["sample"]))


