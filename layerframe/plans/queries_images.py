"""Queries on pixel tables (C) and blobs (D)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.numeric import r6
from ..iterate import cut
from ..operators import augment as A
from ..operators import blobs as B
from ..operators import pixels as P
from ..operators import plans_px as Q
from . import standins as T
from .queries_tables import rounded
from .registry import query


@query("c01_center_crop", f"WITH {T.GRAY} SELECT image_id, x-1 AS x, y-2 AS y, round(v,6) AS v FROM gray WHERE x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 5")
def center_crop(spark, d):
    return rounded(P.center_crop(T.gray(spark, d), 6, 4))


@query("c01_pad_then_crop", f"WITH {T.GRAY}, g AS (SELECT vec_id AS image_id, a AS x, b AS y, a - 1 AS px, b + 1 AS py FROM embeddings, (SELECT unnest(generate_series(0, 10)) AS a), (SELECT unnest(generate_series(0, 5)) AS b)) SELECT g.image_id, g.x, g.y, round(coalesce(v, 0),6) AS v FROM g LEFT JOIN gray p ON p.image_id=g.image_id AND p.x=g.px AND p.y=g.py")
def pad_crop(spark, d):
    return rounded(P.pad_center_crop(T.gray(spark, d), 11, 6))


@query("c02_box_crop", f"WITH {T.GRAY} SELECT image_id, x-2 AS x, y-3 AS y, round(v,6) AS v FROM gray WHERE x BETWEEN 2 AND 6 AND y BETWEEN 3 AND 5")
def box_crop(spark, d):
    return rounded(P.crop(T.gray(spark, d), F.lit(2), F.lit(3), 5, 3))


@query("c03_random_crop", f"""WITH {T.GRAY}, s AS (SELECT vec_id AS image_id, floor({T.uniform(7, "vec_id")} * 7)::INT + 4 AS side, {T.uniform(8, "vec_id")} AS ux, {T.uniform(9, "vec_id")} AS uy FROM embeddings),
p AS (SELECT image_id, side, floor(ux * (greatest(0, 8 - side) + 1))::INT - greatest(0, side - 8) // 2 AS l, floor(uy * (greatest(0, 8 - side) + 1))::INT - greatest(0, side - 8) // 2 AS t FROM s)
SELECT p.image_id, any_value(side * side)::BIGINT AS n, any_value(side - 1)::BIGINT AS mx, round(max(v), 6) AS mv FROM p JOIN gray g ON g.image_id = p.image_id AND x >= l AND x < l + side AND y >= t AND y < t + side GROUP BY p.image_id""")
def random_crop(spark, d):
    g = T.gray(spark, d)
    out = P.apply_crop_plan(g, P.random_crop_plan(P.image_size(g), 4, 10, 7))
    return rounded(out.groupBy("image_id").agg(F.count("*").alias("n"), F.max("x").alias("mx"), F.max("v").alias("mv")))


def _sizes(spark, d):
    """Image sizes from parts: pixels and nanometres."""
    p = T.table(spark, d, "part")
    return p.select("p_partkey", (3.0 + F.col("p_size") / 4.0).alias("w_nm"), (2.0 + F.col("p_partkey") % 17 / 2.0).alias("h_nm"), (F.col("p_partkey") % 900 + 400).cast("int").alias("w_px"), (F.col("p_size") * 20 + 300).cast("int").alias("h_px"))


SIZES = """sz AS (SELECT p_partkey, 3.0::DOUBLE + p_size / 4.0::DOUBLE AS w_nm, 2.0::DOUBLE + p_partkey % 17 / 2.0::DOUBLE AS h_nm, p_partkey % 900 + 400 AS w_px, p_size * 20 + 300 AS h_px FROM part),
al AS (SELECT *, abs(w_px/h_px - w_nm/h_nm) > abs(w_px/h_px - 1.0::DOUBLE/(w_nm/h_nm)) AS swapped FROM sz),
im AS (SELECT p_partkey, w_px, h_px, swapped, CASE WHEN swapped THEN w_nm ELSE h_nm END AS height_nm, CASE WHEN swapped THEN h_nm ELSE w_nm END AS width_nm FROM al),
cd AS (SELECT im.*, r AS row, c AS col, least(height_nm / r, width_nm / c) AS feas FROM im, (SELECT unnest(generate_series(1, 12)) AS r), (SELECT unnest(generate_series(1, 12)) AS c)
 WHERE r <= greatest(1, floor(height_nm / 2.4::DOUBLE)) AND c <= greatest(1, floor(width_nm / 2.4::DOUBLE))),
un AS (SELECT *, least(feas, 4.8::DOUBLE) AS unit_nm FROM cd), ls AS (SELECT *, greatest(0.0::DOUBLE, height_nm*width_nm - (row*unit_nm)*(col*unit_nm)) AS loss, NOT (unit_nm >= 2.4::DOUBLE - 1e-3 AND unit_nm <= 4.8::DOUBLE + 1e-3) AS outside FROM un),
bs AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY outside, loss, abs(unit_nm - (2.4::DOUBLE+4.8::DOUBLE)*0.5::DOUBLE), abs(row-col), row, col) AS k FROM ls)"""


def _grid(spark, d):
    s = _sizes(spark, d)
    h, w, sw = Q.align_axes(F.col("w_nm"), F.col("h_nm"), F.col("w_px"), F.col("h_px"))
    im = s.select("p_partkey", "w_px", "h_px", sw.alias("swapped"), h.alias("height_nm"), w.alias("width_nm"))
    return Q.optimal_grid(im, ["p_partkey", "w_px", "h_px", "swapped"], 2.4, 4.8)


@query("c04_c05_optimal_grid", f"WITH {SIZES} SELECT p_partkey, swapped, round(height_nm,6) AS height_nm, round(width_nm,6) AS width_nm, row, col, round(unit_nm,6) AS unit_nm, round(loss,6) AS loss_nm2, (outside OR feas > 4.8::DOUBLE + 1e-3) AS adjusted FROM bs WHERE k=1")
def optimal_grid(spark, d):
    return rounded(_grid(spark, d).select("p_partkey", "swapped", "height_nm", "width_nm", "row", "col", "unit_nm", "loss_nm2", "adjusted"))


@query("c06_crop_plan", f"""WITH {SIZES}, p AS (SELECT *, least(w_px, greatest(1, CAST(round_even(col*unit_nm*(w_px/width_nm), 0) AS BIGINT))) AS cw, least(h_px, greatest(1, CAST(round_even(row*unit_nm*(h_px/height_nm), 0) AS BIGINT))) AS ch FROM bs WHERE k=1)
SELECT p_partkey, (w_px-cw)//2 AS left, (h_px-ch)//2 AS top, (w_px-cw)//2+cw AS right, (h_px-ch)//2+ch AS bottom, col*128 AS target_w, row*128 AS target_h FROM p""")
def crop_plan(spark, d):
    return rounded(Q.crop_plan(_grid(spark, d)).select("p_partkey", "left", "top", "right", "bottom", "target_w", "target_h"))


@query("c07_tile_windows", """WITH s AS (SELECT p_partkey AS image_id, p_partkey % 900 + 400 AS w, p_size * 20 + 300 AS h FROM part), n AS (SELECT *, greatest(1, floor(greatest(0, h-128)/64)+1)::INT AS nr, greatest(1, floor(greatest(0, w-128)/64)+1)::INT AS nc FROM s),
t AS (SELECT *, unnest(generate_series(0, nr-1)) AS tr FROM n), u AS (SELECT *, unnest(generate_series(0, nc-1)) AS tc FROM t) SELECT image_id, count(*) AS tiles, sum(least(tr*64, greatest(0,h-128))) AS sy, sum(least(tc*64, greatest(0,w-128))) AS sx, max(tr*nc+tc) AS last_rank FROM u GROUP BY image_id""")
def tile_windows(spark, d):
    s = _sizes(spark, d).select(F.col("p_partkey").alias("image_id"), F.col("w_px").alias("w"), F.col("h_px").alias("h"))
    return rounded(P.tile_windows(s).groupBy("image_id").agg(F.count("*").alias("tiles"), F.sum("y0").alias("sy"), F.sum("x0").alias("sx"), F.max("tile_rank").alias("last_rank")))


TL = """tl AS (SELECT least(2*tr, 4) AS y0, least(2*tc, 4) AS x0, tr*3+tc AS tile_rank FROM (SELECT unnest(generate_series(0, 2)) AS tr), (SELECT unnest(generate_series(0, 2)) AS tc)),
tp AS (SELECT image_id, x, y, x0, y0, tile_rank, v + tile_rank AS v FROM gray JOIN tl ON x >= x0 AND x < x0+4 AND y >= y0 AND y < y0+4)"""


def _tiles(spark, d):
    g = T.gray(spark, d)
    return P.cut_tiles(g, P.image_size(g), 4).withColumn("v", F.col("v") + F.col("tile_rank"))


@query("c08_stitch_first", f"WITH {T.GRAY}, {TL} SELECT image_id, x, y, round(arg_min(v, tile_rank),6) AS v FROM tp GROUP BY ALL")
def stitch(spark, d):
    return rounded(P.stitch_first(_tiles(spark, d)))


@query("c09_blend_tiles", f"WITH {T.GRAY}, {TL}, w AS (SELECT *, greatest(1e-3, exp(-((x-x0-1.5)*(x-x0-1.5)+(y-y0-1.5)*(y-y0-1.5))/(2*0.5*0.5))) AS w FROM tp) SELECT image_id, x, y, round(sum(w*v)/sum(w),6) AS v FROM w GROUP BY image_id, x, y")
def blend(spark, d):
    return rounded(P.blend_tiles(_tiles(spark, d), 4, ["v"]))


@query("c10_resize_nearest", f"WITH {T.GRAY}, g AS (SELECT vec_id AS image_id, a AS x, b AS y, a * 8 // 5 AS px, b * 8 // 12 AS py FROM embeddings, (SELECT unnest(generate_series(0, 4)) AS a), (SELECT unnest(generate_series(0, 11)) AS b)) SELECT g.image_id, g.x, g.y, round(v,6) AS v FROM g JOIN gray p ON p.image_id=g.image_id AND p.x=g.px AND p.y=g.py")
def resize_nearest(spark, d):
    return rounded(P.resize(T.gray(spark, d), 5, 12, "nearest"))


@query("c10_resize_bilinear", f"""WITH {T.GRAY}, g AS (SELECT DISTINCT image_id, a AS x, b AS y, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (a+0.5)*1.6-0.5))::DOUBLE AS sx, greatest(0.0::DOUBLE, least(7.0::DOUBLE, (b+0.5)*0.5-0.5))::DOUBLE AS sy FROM gray, (SELECT unnest(generate_series(0, 4)) AS a), (SELECT unnest(generate_series(0, 15)) AS b))
SELECT g.image_id, g.x, g.y, round(sum((CASE WHEN p.x=floor(sx) THEN 1-(sx-floor(sx)) ELSE sx-floor(sx) END)*(CASE WHEN p.y=floor(sy) THEN 1-(sy-floor(sy)) ELSE sy-floor(sy) END)*v),5) AS v FROM g JOIN gray p ON p.image_id=g.image_id AND p.x IN (floor(sx), floor(sx)+1) AND p.y IN (floor(sy), floor(sy)+1) GROUP BY g.image_id, g.x, g.y""")
def resize_bilinear(spark, d):
    return rounded(P.resize(T.gray(spark, d), 5, 16, "bilinear"), 5)


def _cubic_sql(name: str, n: int, t: int) -> str:
    """Taps (o, s, k) of one axis: output place, source place, weight over the sum of weights."""
    r, fs = n / t, max(1.0, n / t)
    d = f"abs((s - (o + 0.5) * {r}::DOUBLE + 0.5) / {fs}::DOUBLE)"
    k = f"CASE WHEN {d} < 1 THEN (1.5 * {d} - 2.5) * {d} * {d} + 1 WHEN {d} < 2 THEN -0.5 * ((({d} - 5) * {d} + 8) * {d} - 4) ELSE 0 END"
    inside = f"s >= floor((o + 0.5) * {r}::DOUBLE - 2 * {fs}::DOUBLE + 0.5) AND s < floor((o + 0.5) * {r}::DOUBLE + 2 * {fs}::DOUBLE + 0.5)"
    return f"{name} AS (SELECT o, s, k / sum(k) OVER (PARTITION BY o) AS k FROM (SELECT o, s, {k} AS k FROM (SELECT unnest(generate_series(0, {t - 1})) AS o), (SELECT unnest(generate_series(0, {n - 1})) AS s) WHERE {inside}))"


@query("c10_resize_bicubic", f"""WITH {T.GRAY}, {_cubic_sql("tx", 8, 5)}, {_cubic_sql("ty", 8, 16)}, h AS (SELECT image_id, o AS x, y, sum(k * v) AS v FROM gray JOIN tx ON x = s GROUP BY image_id, o, y)
SELECT image_id, x, o AS y, round(sum(k * v), 5) AS v FROM h JOIN ty ON y = s GROUP BY image_id, x, o""")
def resize_bicubic(spark, d):
    return rounded(P.resize(T.gray(spark, d), 5, 16, "bicubic"), 5)


@query("c10_box_halve", f"WITH {T.GRAY} SELECT image_id, x//2 AS x, y//2 AS y, round(avg(v),6) AS v FROM gray GROUP BY ALL")
def box_halve(spark, d):
    return rounded(P.box_halve(T.gray(spark, d)))


@query("c10_repeat_upsample", f"WITH {T.GRAY} SELECT image_id, x*2+i AS x, y*2+j AS y, round(v,6) AS v FROM gray, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j)")
def repeat_upsample(spark, d):
    return rounded(P.repeat_upsample(T.gray(spark, d), 2))


def box_sql(r: int, edge: bool) -> str:
    off = f"(SELECT unnest(generate_series(-{r},{r})) AS dx), (SELECT unnest(generate_series(-{r},{r})) AS dy)"
    on = "b.x=least(7,greatest(0,a.x+dx)) AND b.y=least(7,greatest(0,a.y+dy))" if edge else "b.x=a.x+dx AND b.y=a.y+dy"
    return f"SELECT a.image_id, a.x, a.y, sum(b.v)/{(2 * r + 1) ** 2}.0 AS v FROM (SELECT * FROM {{t}}, {off}) a JOIN {{t}} b ON a.image_id=b.image_id AND {on} GROUP BY a.image_id, a.x, a.y"


@query("c11_box_mean_5x5", f"WITH {T.GRAY}, m AS ({box_sql(2, True).format(t='gray')}) SELECT image_id, x, y, round(v,6) AS v FROM m")
def box_mean(spark, d):
    return rounded(P.box_mean(T.gray(spark, d)))


GK = """kr AS (SELECT k, exp(-0.5*k*k/36.0)/sum(exp(-0.5*k*k/36.0)) OVER () AS w FROM (SELECT unnest(generate_series(-24,24))::DOUBLE AS k)), rf AS (SELECT x, CASE WHEN m < 8 THEN m ELSE 15-m END AS s, w FROM (SELECT x, w, (((x+k)::BIGINT % 16)+16)%16 AS m FROM (SELECT unnest(generate_series(0,7)) AS x), kr)),
gx AS (SELECT image_id, r.x, g.y, sum(w*v) AS v FROM g JOIN rf r ON g.x=r.s GROUP BY ALL), gb AS (SELECT image_id, gx.x, r.x AS y, sum(w*v) AS bg FROM gx JOIN rf r ON gx.y=r.s GROUP BY ALL)"""


@query("c12_high_pass", f"WITH {T.GRAY}, g AS (SELECT image_id, x, y, v FROM gray), {GK}, h AS (SELECT g.image_id, g.x, g.y, v-bg AS h FROM g JOIN gb ON g.image_id=gb.image_id AND g.x=gb.x AND g.y=gb.y) SELECT image_id, x, y, round((h-min(h) OVER (PARTITION BY image_id))/(max(h) OVER (PARTITION BY image_id)-min(h) OVER (PARTITION BY image_id)),6) AS v FROM h")
def high_pass(spark, d):
    return rounded(P.high_pass(T.gray(spark, d)))


@query("c13_min_max", f"WITH {T.GRAY} SELECT image_id, x, y, round((v-min(v) OVER w)/(max(v) OVER w-min(v) OVER w),6) AS v FROM gray WINDOW w AS (PARTITION BY image_id)")
def min_max(spark, d):
    return rounded(P.min_max(T.gray(spark, d)))


@query("c14_threshold", f"WITH {T.GRAY} SELECT image_id, x, y, v > 1.3*avg(v) OVER (PARTITION BY image_id) AS fg, CASE WHEN v > 127 THEN 1 ELSE 0 END AS bin FROM gray")
def threshold(spark, d):
    g = T.gray(spark, d)
    return rounded(P.threshold_mean(g, 1.3).select("image_id", "x", "y", "fg").join(P.binarise(g).select("image_id", "x", "y", F.col("v").alias("bin")), ["image_id", "x", "y"]))


@query("c15_smooth_mask", f"WITH {T.GRAY}, a AS (SELECT image_id, x, y, CASE WHEN (v-min(v) OVER w)/(max(v) OVER w-min(v) OVER w) >= 0.5 THEN 1.0 ELSE 0.0 END AS v FROM gray WINDOW w AS (PARTITION BY image_id)), m1 AS ({box_sql(1, False).format(t='a')}), b AS (SELECT image_id, x, y, CASE WHEN v >= 0.5 THEN 1.0 ELSE 0.0 END AS v FROM m1), m2 AS ({box_sql(1, False).format(t='b')}) SELECT image_id, x, y, CASE WHEN v >= 0.5 THEN 1 ELSE 0 END AS v FROM m2")
def smooth_mask(spark, d):
    return rounded(P.smooth_mask(T.gray(spark, d), 2))


@query("c16_range_maps", f"""WITH {T.GRAY} SELECT image_id, x, y, round(v/255,6) AS unit, round(2*v/255-1,6)+0.0 AS signed, floor(least(255, greatest(0, (v/127.5-1+1)*127.5))) AS byte, round((v/255-0.485::DOUBLE)/0.229::DOUBLE,6)+0.0 AS std,
 round(ln((1e-6+(1-2e-6)*v/255)/(1-(1e-6+(1-2e-6)*v/255))),4)+0.0 AS logit FROM gray WHERE true""")
def range_maps(spark, d):
    g = T.gray(spark, d)
    u = F.col("v") / 255.0
    return g.select("image_id", "x", "y", r6(u).alias("unit"), r6(P.unit_to_signed(u)).alias("signed"), P.signed_to_byte(P.byte_to_signed(F.col("v"))).alias("byte"),
                    r6(P.standardise(F.col("v"), 0.485, 0.229)).alias("std"), r6(P.logit(u), 4).alias("logit"))


@query("c17_display_adjust", f"WITH {T.GRAY} SELECT image_id, x, y, round(power(greatest(1e-7, least(1.0, greatest(0.0, v/255*1.07::DOUBLE-0.02::DOUBLE))), 0.97::DOUBLE),6) AS v FROM gray")
def display_adjust(spark, d):
    g = T.gray(spark, d)
    return g.select("image_id", "x", "y", r6(P.display_adjust(F.col("v") / 255.0, 1.07, -0.02, 0.97)).alias("v"))


@query("c18_noise")
def noise(spark, d):
    g = T.gray(spark, d).withColumn("v", F.col("v") / 255.0)
    n = P.gaussian_noise(P.poisson_noise(g, F.lit(500.0), 3), 0.02, 4)
    return n.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.stddev("v").alias("std_v"))


def _bilinear_sql(place: str) -> str:
    """Sampling of gray at g(image_id, x, y, sx, sy), borders mirrored without repeating the edge."""
    fold = lambda c: f"least((({c}) % 14 + 14) % 14, 14 - (({c}) % 14 + 14) % 14)"
    return f"""{place}, t AS (SELECT image_id, x, y, {fold("floor(sx)::BIGINT + i")} AS px, {fold("floor(sy)::BIGINT + j")} AS py, (CASE i WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE j WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS k
  FROM g, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j)), s AS (SELECT t.image_id, t.x, t.y, sum(k * v) AS v FROM t JOIN gray p ON p.image_id = t.image_id AND p.x = px AND p.y = py GROUP BY t.image_id, t.x, t.y)"""


_SHAKEN = f"""g AS (SELECT image_id, x, y, x - {T.normal(6, "image_id", "y")} * 0.8::DOUBLE * sin(2 * pi() * 60 * y * 8e-4::DOUBLE + 1.5707963::DOUBLE) AS sx, y - {T.normal(5, "image_id", "y")} * 0.8::DOUBLE * sin(2 * pi() * 60 * y * 8e-4::DOUBLE) AS sy FROM gray)"""


@query("c19_scan_jitter", f"WITH {T.GRAY}, {_bilinear_sql(_SHAKEN)} SELECT image_id, count(*) AS n, round(avg(v), 5) AS mean_v FROM s GROUP BY image_id")
def scan_jitter(spark, d):
    g = T.gray(spark, d)
    plan = P.image_size(g).withColumns({"sigma_px": F.lit(0.8), "row_time": F.lit(8e-4), "freq": F.lit(60.0), "phase_x": F.lit(0.0), "phase_y": F.lit(1.5707963)})
    return rounded(P.scan_jitter(g, plan, 5).groupBy("image_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean_v")), 5)


@query("c20_flip_and_turn", f"WITH {T.GRAY} SELECT image_id, CASE image_id % 4 WHEN 1 THEN y WHEN 2 THEN x WHEN 3 THEN 7-y ELSE 7-x END AS x, CASE image_id % 4 WHEN 1 THEN x WHEN 2 THEN 7-y WHEN 3 THEN 7-x ELSE y END AS y, round(v,6) AS v FROM gray")
def flip_and_turn(spark, d):
    g = T.gray(spark, d)
    s = P.image_size(g)
    f = P.flip(g, s, F.lit(True), F.lit(False))
    return rounded(P.rot90(f.withColumn("t", F.col("image_id") % 4), s, F.col("t")).select("image_id", "x", "y", "v"))


# a quarter turn about (4, 4) moves pixels to the turned place one row lower; row 0 mirrors the frame's inside
@query("c20_rotate_90_equals_turn", f"WITH {T.GRAY} SELECT image_id, y AS x, CASE WHEN x = 6 AND k = 1 THEN 0 ELSE 8 - x END AS y, round(v, 4) AS v FROM gray, (SELECT unnest([0, 1]) AS k) WHERE (k = 0 AND x > 0) OR (k = 1 AND x = 6)")
def rotate_quarter(spark, d):
    g = T.gray(spark, d)
    return rounded(P.rotate(g, P.image_size(g).withColumn("angle", F.lit(90.0))), 4)


_TILTED = """g AS (SELECT image_id, x, y, cos(radians(30.0)) * (x - 4) - sin(radians(30.0)) * (y - 4) + 4 AS sx, sin(radians(30.0)) * (x - 4) + cos(radians(30.0)) * (y - 4) + 4 AS sy FROM gray)"""


@query("c20_rotate_30", f"WITH {T.GRAY}, {_bilinear_sql(_TILTED)} SELECT image_id, x, y, round(v, 4) AS v FROM s")
def rotate_30(spark, d):
    g = T.gray(spark, d)
    return rounded(P.rotate(g, P.image_size(g).withColumn("angle", F.lit(30.0))), 4)


QUAD = ((0.6, -0.4), (7.3, 0.5), (6.2, 7.4), (-0.5, 6.1))


def _quad_sql() -> str:
    """Source places of the warp that moves the corners to QUAD: the inverse of the map solved from four point pairs."""
    corners = ((0, 0), (7, 0), (7, 7), (0, 7))
    rows = [r for (u, v), (x, y) in zip(corners, QUAD, strict=True) for r in ([u, v, 1, 0, 0, 0, -u * x, -v * x], [0, 0, 0, u, v, 1, -u * y, -v * y])]
    m = np.linalg.inv(np.r_[np.linalg.solve(np.array(rows), np.array(QUAD).ravel()), 1.0].reshape(3, 3))
    line = lambda k: f"({m[k, 0]!r}::DOUBLE * x + {m[k, 1]!r}::DOUBLE * y + {m[k, 2]!r}::DOUBLE)".replace("np.float64(", "").replace(")::", "::")
    return f"g AS (SELECT image_id, x, y, {line(0)} / {line(2)} AS sx, {line(1)} / {line(2)} AS sy FROM gray)"


@query("c20_perspective_quad", f"WITH {T.GRAY}, {_bilinear_sql(_quad_sql())} SELECT image_id, x, y, round(v, 4) AS v FROM s")
def perspective_quad(spark, d):
    g = T.gray(spark, d)
    q = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in QUAD])
    return rounded(P.perspective(g, P.image_size(g).withColumn("q", q)), 4)


def _edge_sql(seed: int) -> str:
    """Pixels outside the four cubics of an 8 × 8 frame."""
    nodes = [0.1 + i * (0.8 / 3.0) for i in range(4)]

    def curve(s: int, t: str) -> str:
        terms = []
        for i in range(4):
            factors = " * ".join(f"({t} / 8.0::DOUBLE - {nodes[j]!r}::DOUBLE) / {nodes[i] - nodes[j]!r}::DOUBLE" for j in range(4) if j != i)
            terms.append(f"({T.uniform(seed + 10 * s + 1 + i, 'image_id')} * 0.15::DOUBLE + 0.15::DOUBLE) * 8 * {factors}")
        return f"({' + '.join(terms)})"

    on = [f"{T.uniform(seed + 10 * s, 'image_id')} < 0.5::DOUBLE" for s in range(4)]
    sides = (f"x < {curve(0, 'y')}", f"x > 8 - {curve(1, 'y')}", f"y < {curve(2, 'x')}", f"y > 8 - {curve(3, 'x')}")
    return " OR ".join(f"({o} AND {s})" for o, s in zip(on, sides, strict=True))


@query("c21_edge_mask", f"WITH {T.GRAY}, e AS (SELECT image_id, CASE WHEN {_edge_sql(11)} THEN {T.uniform(110, 'image_id', 'x', 'y')} * 0.05::DOUBLE ELSE v / 255.0 END AS v FROM gray) SELECT image_id, count(*) AS n, count(*) FILTER (v <= 0.05::DOUBLE) AS dark, round(avg(v), 6) AS mean_v FROM e GROUP BY image_id")
def edge_mask(spark, d):
    g = T.gray(spark, d).withColumn("v", F.col("v") / 255.0)
    e = P.edge_mask(g, P.image_size(g), 0.5, 0.0, 0.05, 11)
    return rounded(e.groupBy("image_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("v") <= 0.05, 1)).alias("dark"), F.avg("v").alias("mean_v")))


def _drawn(group: str, name: str) -> str:
    """SQL of one parameter of the draw table with seed 5."""
    at = 1 + [(g, n) for g, p in A.DEFAULTS.items() for n in p].index((group, name))
    lo, hi = A.DEFAULTS[group][name]
    return f"{lo!r}::DOUBLE + {T.uniform(5 + at, 'vec_id', 'draw')} * {hi - lo!r}::DOUBLE"


@query("c22_draw_table", f"""WITH d AS (SELECT vec_id, draw, round_even({_drawn("crop", "side")}, 0)::BIGINT AS side, {_drawn("rotate", "range")} AS angle, {_drawn("noise", "dwell_time_s")} AS dwell, {_drawn("perspective", "max_ratio")} AS warp, {T.uniform(1006, "vec_id", "draw")} < 0.01::DOUBLE AS carbon
  FROM embeddings, (SELECT unnest(generate_series(0, 2)) AS draw))
SELECT vec_id, draw, greatest(2, side + side % 2) AS side, round(angle, 6) AS angle, round(dwell * 1e6, 6) AS dwell_us, round(warp, 6) AS warp, carbon, 0.0::DOUBLE AS bias, 1.0::DOUBLE AS gamma FROM d""")
def draw_table(spark, d):
    im = T.table(spark, d, "embeddings").select("vec_id")
    t = A.draw_table(im, ["vec_id"], 3, 5, disable=("display",))
    return rounded(t.select("vec_id", "draw", F.col("crop_side").alias("side"), F.col("rotate_range").alias("angle"), (F.col("noise_dwell_time_s") * 1e6).alias("dwell_us"), F.col("perspective_max_ratio").alias("warp"),
                            F.col("carbon_enabled").alias("carbon"), F.col("display_bias").alias("bias"), F.col("display_gamma").alias("gamma")))


@query("c23_safe_centers", f"""WITH {T.GRAY}, m AS (SELECT image_id, x, y, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) > 0.1 AS safe FROM gray WINDOW w AS (PARTITION BY image_id)),
f AS (SELECT a.image_id, a.x, a.y, coalesce(min(sqrt((a.x - z.x) * (a.x - z.x) + (a.y - z.y) * (a.y - z.y))), 1e300::DOUBLE) AS d FROM m a LEFT JOIN (SELECT * FROM m WHERE NOT safe) z ON z.image_id = a.image_id GROUP BY a.image_id, a.x, a.y),
c AS (SELECT image_id, x, y, row_number() OVER (PARTITION BY image_id ORDER BY d <= 1.5, md5(concat_ws('/', 3, image_id, 0, x, y))) AS k FROM f WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 AND (d > 1.5 OR d > 2.0))
SELECT e.vec_id AS image_id, 0::BIGINT AS draw, c.x AS cx, c.y AS cy, CASE WHEN c.x IS NULL THEN 'no_safe_center' END AS reason FROM embeddings e LEFT JOIN c ON c.image_id = e.vec_id AND k = 1""")
def safe_centers(spark, d):
    g = P.min_max(T.gray(spark, d)).withColumn("v", F.when(F.col("v") > 0.1, 1.0).otherwise(0.0))
    draws = g.select("image_id").distinct().withColumns({"draw": F.lit(0), "side": F.lit(4), "safe_radius": F.lit(1.5)})
    return rounded(A.safe_centers(g, draws, ["image_id"], 3))


@query("c24_processing_size", """WITH s AS (SELECT p_partkey, 3.0::DOUBLE + p_size / 4.0::DOUBLE AS w_nm, 2.0::DOUBLE + p_partkey % 17 / 2.0::DOUBLE AS h_nm, p_partkey % 900 + 400 AS w_px, p_size * 20 + 300 AS h_px FROM part),
p AS (SELECT *, round_even(w_nm*(256/4.5::DOUBLE),0) AS pw, round_even(h_nm*(256/4.5::DOUBLE),0) AS ph FROM s), q AS (SELECT *, greatest(ph/h_px, pw/w_px) AS sc FROM p)
SELECT p_partkey, ph::BIGINT AS proc_h, pw::BIGINT AS proc_w, round(sc,6) AS scale, round_even(h_px*sc,0)::BIGINT AS out_h, round_even(w_px*sc,0)::BIGINT AS out_w FROM q""")
def processing_size(spark, d):
    s = _sizes(spark, d)
    c = Q.processing_size(F.col("w_nm"), F.col("h_nm"), F.col("w_px"), F.col("h_px"))
    return rounded(s.select("p_partkey", *[v.alias(k) for k, v in c.items()]))


@query("c25_sample_pairs", f"""WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, count(*) OVER () AS n FROM embeddings), d AS (SELECT range AS draw, floor({T.uniform(9, "range")} * (SELECT count(*) FROM embeddings))::BIGINT AS ordinal FROM range((SELECT count(*) FROM embeddings)))
SELECT draw, vec_id FROM d JOIN o USING (ordinal)""")
def sample_pairs(spark, d):
    e = T.table(spark, d, "embeddings").select("vec_id")
    n = e.count()
    return A.sample_pairs(e, ["vec_id"], n, 9).select("draw", "vec_id")


@query("c26_augmentation_pipeline")
def augmentation_pipeline(spark, d):
    g = T.gray(spark, d).withColumn("v", F.col("v") / 255.0)
    big = P.repeat_upsample(g, 2)
    m = big.withColumn("v", F.lit(1.0))
    cfg = {"crop": {"side": [8.0, 12.0], "safe_radius": 2.0}, "noise": {"sigma_jitter_A": 0.1}, "edge_mask": {"prob": 0.1}}
    dr = A.draw_table(g.select("image_id").distinct(), ["image_id"], 1, 17, cfg)
    out = A.stem_pipeline(big, m, dr, ["image_id"], out_size=8, seed=23)
    return out.groupBy("image_id", "draw").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("reason").alias("reason"))


@query("c26_segmentation_pipeline")
def segmentation_pipeline(spark, d):
    g = T.gray(spark, d).withColumn("v", F.col("v") / 255.0)
    m = P.threshold_mean(g, 1.05).select("image_id", "x", "y", F.col("fg").cast("double").alias("v"))
    out = A.segmentation_pipeline(g, m, ["image_id"], 8, 29, True, pre=10, side=(5, 8))
    return out.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean_v"), F.max("m").alias("max_m"))


@query("c26_segmentation_validation", f"WITH {T.GRAY} SELECT image_id, count(*) AS n, round(avg(v/255), 6) AS mean_v FROM gray WHERE x BETWEEN 1 AND 6 AND y BETWEEN 1 AND 6 GROUP BY image_id")
def segmentation_validation(spark, d):
    g = T.gray(spark, d).withColumn("v", F.col("v") / 255.0)
    m = P.threshold_mean(g, 1.05).select("image_id", "x", "y", F.col("fg").cast("double").alias("v"))
    out = A.segmentation_pipeline(g, m, ["image_id"], 6, 29, False, val=6)
    return rounded(out.groupBy("image_id").agg(F.count("*").alias("n"), F.avg("v").alias("mean_v")))


# ---------------------------------------------------------------- D: blobs

CC = f"""RECURSIVE {T.MASK}, ix AS (SELECT image_id, x, y, y*8+x AS id FROM mask), nbr AS (SELECT a.image_id, a.id AS a, b.id AS b FROM ix a JOIN ix b ON a.image_id=b.image_id AND abs(a.x-b.x) <= 1 AND abs(a.y-b.y) <= 1),
rc(image_id, id, root) AS (SELECT image_id, id, id FROM ix UNION SELECT n.image_id, n.b, rc.root FROM rc JOIN nbr n ON n.image_id=rc.image_id AND n.a=rc.id WHERE rc.root < n.b),
lb AS (SELECT image_id, id, min(root) AS root FROM rc GROUP BY image_id, id), lab AS (SELECT lb.image_id, x, y, root FROM lb JOIN ix ON ix.image_id=lb.image_id AND ix.id=lb.id),
st AS (SELECT image_id, root, count(*) AS area, avg(x) AS cx, avg(y) AS cy, min(x) AS left_, min(y) AS top_, max(x)-min(x)+1 AS width, max(y)-min(y)+1 AS height FROM lab GROUP BY ALL)"""


def _lab(spark, d):
    return cut(B.components(T.mask(spark, d)))


@query("d01_components", f"WITH {CC} SELECT image_id, x, y, root AS label FROM lab")
def components(spark, d):
    return rounded(_lab(spark, d).select("image_id", "x", "y", (F.col("label.y") * 8 + F.col("label.x")).alias("label")))


@query("d02_component_stats", f"WITH {CC} SELECT image_id, area, round(cx,6) AS cx, round(cy,6) AS cy, round_even(cy,0)::BIGINT AS row, round_even(cx,0)::BIGINT AS col, left_ AS bx, top_ AS by, width, height FROM st")
def component_stats(spark, d):
    return rounded(B.component_stats(_lab(spark, d)).withColumnsRenamed({"left": "bx", "top": "by"}).drop("label"))


@query("d03_area_filter", f"WITH {CC} SELECT lab.image_id, x, y FROM lab JOIN st ON st.image_id=lab.image_id AND st.root=lab.root WHERE area >= 4")
def drop_small(spark, d):
    return rounded(B.drop_small(_lab(spark, d), 4))


@query("d04_detect_atoms")
def detect_atoms(spark, d):
    return rounded(B.detect_atoms(T.gray(spark, d), factor=1.2, min_area=2000.0, min_distance=2.0), 5)


def _serial_sql(source: str, group: str, order: str, radius: str) -> str:
    """Recursive form of the serial loop: one point of every group a step, with the list of points kept so far."""
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS k FROM {source}),
walk AS (SELECT {group} AS grp, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE, id BIGINT)[] AS kept FROM (SELECT DISTINCT {group} FROM o)
 UNION ALL SELECT grp, w.k + 1, CASE WHEN len(list_filter(kept, lambda p: (p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y) < {radius} * {radius})) = 0 THEN list_append(kept, {{'x': o.x, 'y': o.y, 'id': o.k}}) ELSE kept END FROM walk w JOIN o ON o.{group} = w.grp AND o.k = w.k + 1),
leads AS (SELECT grp, unnest(arg_max(kept, k), recursive := true) FROM walk GROUP BY grp)"""


@query("d05_thin_points", f"""WITH RECURSIVE {T.PTS}, {_serial_sql("pts", "sample", "y, x, pt_id", "25.0::DOUBLE")}
SELECT o.sample, layer, pt_id, round(o.x, 6) AS x, round(o.y, 6) AS y FROM leads l JOIN o ON o.sample = l.grp AND o.k = l.id""")
def thin_points(spark, d):
    p = T.pts(spark, d).withColumn("rk", F.struct("y", "x", "pt_id"))
    return rounded(B.thin_points(p, ["sample"], 25.0, "rk").drop("rk"))


_LED = """b AS (SELECT o.image_id, o.x, o.y, min(l.id) AS lead FROM o JOIN leads l ON l.grp = o.image_id AND (l.x - o.x) * (l.x - o.x) + (l.y - o.y) * (l.y - o.y) < 9 GROUP BY o.image_id, o.x, o.y),
led AS (SELECT image_id, count(*) AS n, round_even(avg(y), 0)::BIGINT AS row, round_even(avg(x), 0)::BIGINT AS col FROM b GROUP BY image_id, lead)"""


@query("d06_leader_clusters", f"WITH RECURSIVE {T.MASK}, {_serial_sql('mask', 'image_id', 'y, x', '3.0::DOUBLE')}, {_LED} SELECT image_id, n, row, col FROM led")
def leader_clusters(spark, d):
    m = T.mask(spark, d).select("image_id", F.struct("y", "x").alias("pt_id"), "x", "y")
    return rounded(B.leader_clusters(m, ["image_id"], 3.0).drop("leader"))


@query("d07_instances_connected", f"WITH {CC} SELECT image_id, round_even(cy,0)::BIGINT AS row, round_even(cx,0)::BIGINT AS col, area FROM st WHERE area BETWEEN 2 AND 30")
def instances_connected(spark, d):
    g = P.threshold_mean(T.gray(spark, d), 1.05).select("image_id", "x", "y", F.col("fg").cast("int").alias("v"))
    return rounded(B.instances(g, min_pixels=2, max_pixels=30))


_SMOOTHED = f"""a AS (SELECT image_id, x, y, CASE WHEN v > 1.05 * avg(v) OVER (PARTITION BY image_id) THEN 1.0 ELSE 0.0 END AS v FROM gray), m1 AS ({box_sql(1, False).format(t='a')}),
sm AS (SELECT image_id, x, y FROM m1 WHERE v >= 0.5)"""


@query("d07_instances_convolution", f"WITH RECURSIVE {T.GRAY}, {_SMOOTHED}, {_serial_sql('sm', 'image_id', 'y, x', '3.0::DOUBLE')}, {_LED} SELECT image_id, row, col, n AS area FROM led")
def instances_convolution(spark, d):
    g = P.threshold_mean(T.gray(spark, d), 1.05).select("image_id", "x", "y", F.col("fg").cast("int").alias("v"))
    return rounded(B.instances(g, mode="convolution", radius=3.0))


@query("d08_scaled_centers", f"WITH {CC} SELECT image_id, least(19, greatest(0, round_even(round_even(cy,0)*2.5,0)))::BIGINT AS row, least(11, greatest(0, round_even(round_even(cx,0)*1.5,0)))::BIGINT AS col, area FROM st")
def scaled_centers(spark, d):
    s = B.component_stats(_lab(spark, d)).select("image_id", "row", "col", "area")
    return rounded(B.scale_centers(s, (F.lit(8), F.lit(8)), (F.lit(20), F.lit(12))))


@query("d09_area_distribution", f"""WITH {CC}, b AS (SELECT image_id % 5 AS grp, area FROM st), s AS (SELECT grp, count(*) AS n, min(area) AS lo, max(area) AS hi, avg(area) AS mean FROM b GROUP BY grp)
SELECT b.grp, least(least(50, n)-1, floor((area-lo)/(hi-lo)*least(50, n)))::BIGINT AS bin, count(*) AS n, lo AS min_area, hi AS max_area, round(mean,6) AS mean_area FROM b JOIN s ON b.grp=s.grp GROUP BY ALL""")
def area_distribution(spark, d):
    s = B.component_stats(_lab(spark, d)).withColumn("grp", F.col("image_id") % 5).withColumn("label", F.struct("image_id", "label"))
    summary, hist = B.area_distribution(s, ["grp"])
    return rounded(hist.join(summary.select("grp", "min_area", "max_area", "mean_area"), "grp"))


@query("d10_merged_layers", f"WITH {CC} SELECT image_id//2 AS pair, count(*) FILTER (image_id%2=0) AS mask0_instances, count(*) FILTER (image_id%2=1) AS mask1_instances FROM st GROUP BY ALL")
def merged_layers(spark, d):
    s = B.component_stats(_lab(spark, d)).withColumn("pair", F.floor(F.col("image_id") / 2))
    _, c = B.merge_layers(s.filter("image_id % 2 = 0"), s.filter("image_id % 2 = 1"), ["pair"])
    return rounded(c)


#: Second masks of a pair are cropped to 6 × 6 and brought back to the frame of the first.
TWO = CC.replace("ix AS (SELECT image_id, x, y, y*8+x AS id FROM mask)", """two AS (SELECT * FROM mask WHERE image_id % 2 = 0 UNION ALL SELECT image_id, a.x, b.y FROM mask m JOIN (SELECT unnest(generate_series(0, 7)) AS x) a ON m.x = a.x * 6 // 8 + 1
 JOIN (SELECT unnest(generate_series(0, 7)) AS y) b ON m.y = b.y * 6 // 8 + 1 WHERE image_id % 2 = 1), ix AS (SELECT image_id, x, y, y*8+x AS id FROM two)""")


@query("d10_merged_masks", f"WITH {TWO} SELECT image_id // 2 AS pair, (image_id % 2)::BIGINT AS layer, round_even(cy, 0)::BIGINT AS row, round_even(cx, 0)::BIGINT AS col FROM st WHERE area >= 2")
def merged_masks(spark, d):
    g = P.threshold_mean(T.gray(spark, d), 1.05).select(F.floor(F.col("image_id") / 2).alias("pair"), "image_id", "x", "y", F.col("fg").cast("int").alias("v"))
    small = P.crop(g.filter("image_id % 2 = 1"), F.lit(1), F.lit(1), 6, 6)
    m, _ = B.merge_masks(g.filter("image_id % 2 = 0").drop("image_id"), small.drop("image_id"), ["pair"], min_pixels=2)
    return rounded(m.select("pair", "layer", "row", "col"))


@query("d10_marker_raster", f"WITH {CC}, o AS (SELECT i, j FROM (SELECT unnest(generate_series(-1,1)) AS i), (SELECT unnest(generate_series(-1,1)) AS j) WHERE i*i+j*j <= 1), m AS (SELECT DISTINCT image_id//2 AS pair, (image_id%2)::INT AS layer, round_even(cx,0)::BIGINT+i AS x, round_even(cy,0)::BIGINT+j AS y FROM st, o) SELECT pair, layer, count(*) AS n FROM m WHERE x BETWEEN 0 AND 7 AND y BETWEEN 0 AND 7 GROUP BY ALL")
def marker_raster(spark, d):
    s = B.component_stats(_lab(spark, d)).withColumn("pair", F.floor(F.col("image_id") / 2))
    m, _ = B.merge_layers(s.filter("image_id % 2 = 0"), s.filter("image_id % 2 = 1"), ["pair"])
    return rounded(B.marker_raster(m, ["pair"], 1, 8, 8).groupBy("pair", "layer").agg(F.count("*").alias("n")))


@query("d11_batch_summary", f"WITH {CC}, i AS (SELECT e.vec_id, count(st.root) AS c FROM embeddings e LEFT JOIN st ON st.image_id=e.vec_id GROUP BY e.vec_id) SELECT count(*) AS images, sum(c)::BIGINT AS instances, count(*) FILTER (c = 0) AS failed, count(DISTINCT vec_id//2) AS merged_pairs FROM i")
def batch_summary(spark, d):
    s = B.component_stats(_lab(spark, d)).groupBy("image_id").agg(F.count("*").alias("instance_count"))
    e = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"))
    i = e.join(s, "image_id", "left").withColumn("reason", F.when(F.col("instance_count").isNull(), "no_instances").otherwise(""))
    return rounded(B.batch_summary(i, e.select(F.floor(F.col("image_id") / 2).alias("pair")).distinct()))
