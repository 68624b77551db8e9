"""Two layers against each other: stacking class, shift search, twist search, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..iterate import cut
from .points import displacement_vectors, nearest, nearest_of_few, trimmed_mean


# ---------------------------------------------------------------- stacking class

def stacking_class(layer0: DataFrame, layer1: DataFrame, keys: list[str], slip_deg: float = 5.0) -> DataFrame:
    """Class per pair of layer results (columns ok, reason, da, db, origin).

    Flip = opposite handedness; the flipped db0 is mirrored in the axis normal to db0 before the axial
    angle is taken; up to ``slip_deg`` it is a slip, above a twist. Slips also get mean vectors.
    """
    cols = ["ok", "reason", "origin", "da", "db"]
    a = layer0.select(*keys, *[F.col(c).alias(f"{c}0") for c in cols])
    b = layer1.select(*keys, *[F.col(c).alias(f"{c}1") for c in cols])
    d = a.join(b, keys, "full")
    da0, db0, da1, db1 = (G.field(c) for c in ("da0", "db0", "da1", "db1"))
    d = d.withColumn("handedness_0", G.handedness(da0, db0)).withColumn("handedness_1", G.handedness(da1, db1))
    missing = F.col("ok0").isNull() | F.col("ok1").isNull()
    failed = ~F.col("ok0") | ~F.col("ok1")
    flat = (F.col("handedness_0") == 0) | (F.col("handedness_1") == 0)
    reason = (
        F.when(missing, "missing__0_or__1")
        .when(failed, F.concat(F.lit("dadb_failed:0="), F.col("reason0"), F.lit(" 1="), F.col("reason1")))
        .when(flat, "degenerate_cross").otherwise("")
    )
    d = d.withColumn("reason", reason).withColumn("ok", F.col("reason") == "")
    d = d.withColumn("is_flip", F.when(F.col("ok"), F.col("handedness_0") != F.col("handedness_1")))
    axis = G.perpendicular(db0)
    m = G.reflect(db0, axis)
    cmp = G.choose(F.col("is_flip"), m, db0)
    d = d.withColumn("theta_deg", F.when(F.col("ok"), G.axial_angle(cmp, db1, float("nan"), 1e-9)))
    d = d.withColumn("theta_method", F.when(F.col("is_flip"), "flip_reflect_db0_then_mod180").when(F.col("ok"), "noflip_mod180"))
    slip = F.col("theta_deg") <= slip_deg
    d = d.withColumn("class", F.when(~F.col("ok"), "unknown").when(F.col("is_flip") & slip, "flip_slip").when(F.col("is_flip"), "flip_twist").when(slip, "slip").otherwise("twist"))
    ra, rb = G.choose(F.col("is_flip"), G.reflect(da0, axis), da0), G.choose(F.col("is_flip"), m, db0)
    is_slip = F.col("class").isin("slip", "flip_slip")

    def mean(ref: G.Vec, v: G.Vec) -> Column:
        return F.when(is_slip, G.as_struct(G.scale(G.add(ref, G.align_sign(v, ref)), 0.5)))

    return d.withColumn("da_mean", mean(ra, da1)).withColumn("db_mean", mean(rb, db1)).drop("ok0", "ok1", "reason0", "reason1")


# ---------------------------------------------------------------- shift search


def search_shift(ref: DataFrame, moving: DataFrame, keys: list[str], max_shift: int = 48, coarse: int = 8, trim: float = 0.20, min_keep: int = 120) -> DataFrame:
    """Integer translation of ``moving`` that best fits ``ref``: coarse grid, then ±max(2, coarse) by one pixel.

    Score: trimmed mean of nearest distances; the first shift in (dx, dy) order wins ties.
    ``(keys, dx, dy, score)``.
    """
    def pass_(centres: DataFrame, radius: int, step: int) -> DataFrame:
        o = F.sequence(F.lit(-radius), F.lit(radius), F.lit(step))
        s = centres.withColumn("dx", F.explode(o)).withColumn("dy", F.explode(o))
        s = s.select(*keys, (F.col("dx") + F.col("ox")).alias("dx"), (F.col("dy") + F.col("oy")).alias("dy"))
        q = moving.join(s, keys).select(*keys, "dx", "dy", "pt_id", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
        near = cut(nearest_of_few(q, ref, [*keys, "dx", "dy"], keys, ["pt_id"]).select(*keys, "dx", "dy", "d"))
        sc = trimmed_mean(near, [*keys, "dx", "dy"], "d", trim, min_keep)
        best = sc.groupBy(*keys).agg(F.min(F.struct("score", "dx", "dy")).alias("b"))
        return best.select(*keys, F.col("b.dx").alias("ox"), F.col("b.dy").alias("oy"), F.col("b.score").alias("score"))

    start = moving.select(*keys).distinct().join(ref.select(*keys).distinct(), keys).withColumn("ox", F.lit(0)).withColumn("oy", F.lit(0))
    first = cut(pass_(start, max_shift, coarse))
    second = pass_(first.drop("score"), max(2, coarse), 1)
    return second.select(*keys, F.col("ox").alias("dx"), F.col("oy").alias("dy"), "score")


def align_mod1(ref: Column, other: Column) -> Column:
    """Move ``other`` by whole numbers (half-even) next to ``ref``."""
    return other - F.bround(other - ref, 0)


def reduce_cell(a: Column, b: Column) -> tuple[Column, Column]:
    """Fractional part, folded into the half cell a+b ≤ 1, clipped to 0..1."""
    fa, fb = a - F.floor(a), b - F.floor(b)
    over = fa + fb > 1.0
    one, zero = F.lit(1.0), F.lit(0.0)
    return (F.greatest(zero, F.least(one, F.when(over, 1.0 - fa).otherwise(fa))), F.greatest(zero, F.least(one, F.when(over, 1.0 - fb).otherwise(fb))))


def project_shift(shifts: DataFrame) -> DataFrame:
    """Shift (sx, sy) on both layers' bases, of ±shift the one with the smaller reduced norm.

    Needs da0, db0 (already mirrored for flips), da1, db1. Null coefficients for a singular basis.
    """
    s = shifts.withColumn("_sg", F.explode(F.array(F.lit(1), F.lit(-1))))
    db0, db1 = G.field("db0"), G.field("db1")
    against = G.dot(db1, db0) < 0.0
    da1, db1 = G.choose(against, G.neg(G.field("da1")), G.field("da1")), G.choose(against, G.neg(db1), db1)
    v = (F.col("sx") * F.col("_sg"), F.col("sy") * F.col("_sg"))
    a0, b0 = G.solve2(G.field("da0"), db0, v)
    a1, b1 = G.solve2(da1, db1, v)
    s = s.withColumns({"_vx": v[0], "_vy": v[1], "a0": a0, "b0": b0, "a1r": a1, "b1r": b1})
    s = s.withColumns({"a1": align_mod1(F.col("a0"), F.col("a1r")), "b1": align_mod1(F.col("b0"), F.col("b1r"))})
    s = s.withColumns({"am": (F.col("a0") + F.col("a1")) * 0.5, "bm": (F.col("b0") + F.col("b1")) * 0.5})
    ra, rb = reduce_cell(F.col("am"), F.col("bm"))
    s = s.withColumns({"ar": ra, "br": rb})
    keep = [c for c in shifts.columns if c not in ("sx", "sy")]
    fields = F.struct(F.col("_vx").alias("shift_px_x"), F.col("_vy").alias("shift_px_y"), F.col("a0").alias("ab0_raw_a"), F.col("b0").alias("ab0_raw_b"), F.col("a1").alias("ab1_raw_a"), F.col("b1").alias("ab1_raw_b"),
                      F.col("am").alias("ab_mean_raw_a"), F.col("bm").alias("ab_mean_raw_b"), F.col("ar").alias("ab_mean_reduced_a"), F.col("br").alias("ab_mean_reduced_b"))
    norm = F.coalesce(F.col("ar") * F.col("ar") + F.col("br") * F.col("br"), F.lit(float("inf")))
    return s.groupBy(*keep).agg(F.min_by(fields, F.struct(norm.alias("n"), (-F.col("_sg")).alias("o"))).alias("p")).select(*keep, "p.*")


# ---------------------------------------------------------------- twist search

def canonical(da: G.Vec, db: G.Vec) -> tuple[G.Vec, G.Vec]:
    """Both vectors turned so that db points into the right half plane (up on the border)."""
    left = (db[0] < 0.0) | ((F.abs(db[0]) <= 1e-12) & (db[1] < 0.0))
    return G.choose(left, G.neg(da), da), G.choose(left, G.neg(db), db)


def twist_center(db0: G.Vec, db1: G.Vec) -> Column:
    """Directed angle between the canonical db vectors; NaN when one vanishes."""
    return G.directed_angle(canonical(db0, db0)[1], canonical(db1, db1)[1], float("nan"), 1e-9)


def search_twist(ref: DataFrame, moving: DataFrame, centres: DataFrame, keys: list[str], radius: float = 30.0, coarse: float = 1.0, trim: float = 0.20, min_keep: int = 200, min_vectors: int = 80,
                 refine: tuple[tuple[float, float], ...] = ((0.2, 2.0), (0.02, 0.4), (0.005, 0.1))) -> DataFrame:
    """Rotation of the moving displacement vectors that best fits the reference ones.

    ``centres``: keys, center (degrees or NaN/null for a full 0..180 scan). Each pass scores start + i·step
    around the best angle so far and replaces it only by a strictly better score.
    """
    count = lambda v, n: v.groupBy(*keys).agg(F.count("*").alias(n))
    ok = count(ref, "_a").join(count(moving, "_b"), keys).filter((F.col("_a") >= min_vectors) & (F.col("_b") >= min_vectors)).select(*keys)
    r = cut(ref.join(ok, keys, "left_semi").select(*keys, F.monotonically_increasing_id().alias("pt_id"), F.col("dx").alias("x"), F.col("dy").alias("y")))
    m = cut(moving.join(ok, keys, "left_semi").select(*keys, F.monotonically_increasing_id().alias("pt_id"), "dx", "dy"))
    c = F.nanvl(F.col("center"), F.lit(None).cast("double"))
    rad = max(0.0, min(90.0, radius))
    around = F.transform(F.sequence(F.lit(0), F.lit(int(2 * rad / coarse + 1e-9))), lambda i: F.struct(i.alias("i"), F.pmod(F.pmod(c, F.lit(180.0)) - rad + i * coarse, F.lit(180.0)).alias("deg")))
    full = F.transform(F.sequence(F.lit(0), F.lit(int(180.0 / coarse - 1e-9))), lambda i: F.struct(i.alias("i"), (i * coarse).cast("double").alias("deg")))
    start = centres.join(ok, keys, "left_semi").withColumn("e", F.explode(F.when(c.isNull() | F.lit(rad <= 0), full).otherwise(around))).select(*keys, "e.i", "e.deg")

    def score(angles: DataFrame) -> DataFrame:
        a = F.radians("deg")
        q = m.join(angles, keys).select(*keys, "i", "deg", "pt_id", (F.cos(a) * F.col("dx") - F.sin(a) * F.col("dy")).alias("x"), (F.sin(a) * F.col("dx") + F.cos(a) * F.col("dy")).alias("y"))
        near = cut(nearest(q, r, [*keys, "i", "deg"], keys, ["pt_id"]).select(*keys, "i", "deg", "d"))
        sc = trimmed_mean(near, [*keys, "i", "deg"], "d", trim, min_keep)
        best = sc.groupBy(*keys).agg(F.min(F.struct("score", "i", "deg")).alias("b"))
        return best.select(*keys, F.col("b.deg").alias("deg"), F.col("b.score").alias("score"))

    best = cut(score(start))
    for step, width in refine:
        n = int(2 * width / step + 1e-9)
        tries = best.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
        nxt = score(tries.select(*keys, "i", F.pmod(F.col("deg") - width + F.col("i") * step, F.lit(180.0)).alias("deg")))
        j = best.join(nxt.withColumnsRenamed({"deg": "deg2", "score": "score2"}), keys)
        better = F.col("score2") < F.col("score")
        best = cut(j.select(*keys, F.when(better, F.col("deg2")).otherwise(F.col("deg")).alias("deg"), F.least("score", "score2").alias("score")))
    return best.select(*keys, F.pmod(F.col("deg"), F.lit(180.0)).alias("twist_fine_deg"), F.col("score").alias("twist_score"))


# ---------------------------------------------------------------- assembly

def analyse(stacking: DataFrame, points: DataFrame, keys: list[str], side: Column, radius: float = 30.0, k: int = 12, r_min: float = 8.0, r_max: float = 160.0, augment: bool = False) -> DataFrame:
    """Interlayer table: stacking rows joined with point counts; slips get a shift on the lattice basis, twists a fine angle.

    ``points``: keys, layer (0/1), pt_id, x, y in 512-px coordinates; ``side`` is the field of view in Å.
    """
    n = points.groupBy(*keys).agg(F.count(F.when(F.col("layer") == 0, 1)).alias("n0"), F.count(F.when(F.col("layer") == 1, 1)).alias("n1"))
    base = stacking.join(n, keys, "left").withColumn("sideA_A", side)
    vecs = ["origin0", "origin1", "da0", "db0", "da1", "db1"]
    ready = (F.coalesce("n0", F.lit(0)) >= 10) & (F.coalesce("n1", F.lit(0)) >= 10)
    for v in vecs:
        ready = ready & F.col(v).isNotNull()
    base = cut(base.withColumn("ready", ready))
    slips = base.filter("ready and class in ('slip', 'flip_slip')")
    axis = G.perpendicular(G.choose(F.col("db_mean").isNotNull(), G.field("db_mean"), G.field("db0")))
    flip = F.col("class") == "flip_slip"
    mir = slips.select(*keys, "class", "origin0", G.as_struct(axis).alias("axis"), G.as_struct(G.choose(flip, G.reflect(G.field("da0"), axis), G.field("da0"))).alias("da0"),
                       G.as_struct(G.choose(flip, G.reflect(G.field("db0"), axis), G.field("db0"))).alias("db0"), "da1", "db1")
    p0 = points.filter("layer = 0").join(mir.select(*keys, "class", "origin0", "axis"), keys)
    moved = G.choose(flip, G.reflect_about(G.vec("x", "y"), G.field("origin0"), G.field("axis")), G.vec("x", "y"))
    ref = cut(p0.select(*keys, "pt_id", moved[0].alias("x"), moved[1].alias("y")))
    mov = cut(points.filter("layer = 1").join(mir.select(*keys), keys, "left_semi").select(*keys, "pt_id", "x", "y"))
    sh = search_shift(ref, mov, keys)
    proj = project_shift(mir.join(sh, keys).select(*keys, "da0", "db0", "da1", "db1", F.col("score").alias("shift_align_score"), (-F.col("dx")).cast("double").alias("sx"), (-F.col("dy")).cast("double").alias("sy")))
    proj = proj.drop("da0", "db0", "da1", "db1")
    tw = base.filter("ready and class = 'twist'")
    cen = tw.select(*keys, twist_center(G.field("db0"), G.field("db1")).alias("center"))
    tp = points.join(tw.select(*keys), keys, "left_semi")
    v0 = displacement_vectors(tp.filter("layer = 0"), keys, k, r_min, r_max, augment)
    v1 = displacement_vectors(tp.filter("layer = 1"), keys, k, r_min, r_max, augment)
    twist = search_twist(v0, v1, cen, keys, radius)
    out = base.join(proj, keys, "left").join(twist, keys, "left")
    per = F.col("sideA_A") / 512.0
    failed_twist = F.col("ready") & (F.col("class") == "twist") & F.col("twist_fine_deg").isNull()
    failed_proj = F.col("ready") & F.col("class").isin("slip", "flip_slip") & F.col("ab0_raw_a").isNull()
    reason = F.when(failed_twist, "twist_failed").when(failed_proj & F.col("shift_align_score").isNull(), "shift_failed").when(failed_proj, "project_failed").otherwise(F.col("reason"))
    out = out.withColumn("reason", reason).withColumn("class", F.when(failed_twist | failed_proj, "unknown").otherwise(F.col("class")))
    out = out.withColumn("shift_A_x", F.col("shift_px_x") * per).withColumn("shift_A_y", F.col("shift_px_y") * per)
    for v in ("da0", "db0", "da1", "db1"):
        out = out.withColumn(f"{v}_x", F.col(v)["x"]).withColumn(f"{v}_y", F.col(v)["y"])
    return out.withColumnRenamed("theta_deg", "stacking_theta_deg").withColumnRenamed("theta_method", "stacking_theta_method").drop("ready", *vecs, "da_mean", "db_mean")


def class_tally(table: DataFrame) -> DataFrame:
    """Rows per final class."""
    return table.groupBy("class").agg(F.count("*").alias("n"))


def alignment_check(points: DataFrame, shifts: DataFrame, keys: list[str]) -> DataFrame:
    """Layer 1 minus the shift beside layer 0: atom counts and mean nearest distance after alignment."""
    n = points.groupBy(*keys).agg(F.count(F.when(F.col("layer") == 0, 1)).alias("n0"), F.count(F.when(F.col("layer") == 1, 1)).alias("n1"))
    m = points.filter("layer = 1").join(shifts, keys).select(*keys, "pt_id", (F.col("x") - F.col("shift_px_x")).alias("x"), (F.col("y") - F.col("shift_px_y")).alias("y"))
    d = nearest(m, points.filter("layer = 0").select(*keys, "pt_id", "x", "y"), keys, keys, ["pt_id"]).groupBy(*keys).agg(F.avg("d").alias("mean_d"))
    return n.join(d, keys, "left").withColumn("has_alignment", F.col("mean_d").isNotNull())
