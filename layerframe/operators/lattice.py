"""Lattice vectors of one layer from its cycles: directions, axes, lengths, origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..iterate import cut, grouped_quantiles
from . import cycles as C
from .growth import CYCLE, EDGE, GROUP, layers
from .points import knn, nn_summary

# Reason codes of a failed layer, in the order they are tested.
REASONS = ["missing_image", "too_few_atoms", "bad_nn", "no_candidates", "no_candidates_after_filter", "no_candidates_after_flip_filter", "no_seed", "too_few_centroids", "dadb_failed"]


# ---------------------------------------------------------------- one-dimensional two-means

def two_means(values: DataFrame, keys: list[str], value: str, max_rounds: int = 25) -> DataFrame:
    """Lloyd's two-means per group, started at the 20 % and 80 % quantiles: ``(keys, c0, c1, converged)``.

    A round is one aggregate over the rows against a one-row-per-group centre table; it ends when no
    centre moves, at the latest after ``max_rounds``; ``converged`` tells which.
    """
    v = cut(values.select(*keys, F.col(value).cast("double").alias("v")))
    q = grouped_quantiles(v, keys, "v", [0.2, 0.8])
    top = v.groupBy(*keys).agg(F.max("v").alias("_m"))
    c = q.join(top, keys).select(*keys, F.col("q0").alias("c0"), F.when(F.abs(F.col("q1") - F.col("q0")) < 1e-9, F.col("_m")).otherwise(F.col("q1")).alias("c1"))
    c = cut(c.withColumn("moved", F.lit(True)))
    for _ in range(max_rounds):
        if c.filter("moved").isEmpty():
            break
        high = F.abs(F.col("v") - F.col("c1")) < F.abs(F.col("v") - F.col("c0"))
        live = v.join(c.filter("moved").drop("moved"), keys)
        n = live.groupBy(*keys, "c0", "c1").agg(F.avg(F.when(~high, F.col("v"))).alias("n0"), F.avg(F.when(high, F.col("v"))).alias("n1"))
        n = n.select(*keys, F.coalesce("n0", "c0").alias("a0"), F.coalesce("n1", "c1").alias("a1"), "c0", "c1")
        n = n.select(*keys, F.col("a0").alias("c0"), F.col("a1").alias("c1"), ((F.col("a0") != F.col("c0")) | (F.col("a1") != F.col("c1"))).alias("moved"))
        c = cut(c.filter("not moved").unionByName(n))
    return c.withColumn("converged", ~F.col("moved")).drop("moved")


def two_means_labels(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows with the label of the nearer centre (1 only when strictly nearer to the second)."""
    c = two_means(values, keys, value).drop("converged")
    v = F.col(value)
    return values.join(c, keys).withColumn("label", (F.abs(v - F.col("c1")) < F.abs(v - F.col("c0"))).cast("int"))


# ---------------------------------------------------------------- direction histogram

def direction_vectors(centroids: DataFrame, keys: list[str], k: int = 6) -> DataFrame:
    """Vectors to the k nearest centroids; with fewer than four centroids every pair once. Adds the group size ``n``."""
    n = centroids.groupBy(*keys).agg(F.count("*").alias("n"))
    v = knn(centroids, k, keys).filter(F.col("d") >= 1e-9).join(n, keys)
    return v.filter((F.col("n") >= 4) | (F.col("i") < F.col("j"))).select(*keys, "n", "i", "j", "dx", "dy", "d")


def short_vectors(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """The shorter of two length clusters, or all vectors when that cluster is too small or n < 4."""
    big = vectors.filter("n >= 4")
    lab = two_means_labels(big, keys, "d")
    low = (F.col("label") == 0) == (F.col("c0") <= F.col("c1"))
    cnt = lab.groupBy(*keys).agg(F.count("*").alias("_a"), F.sum(low.cast("int")).alias("_s"))
    few = F.col("_s") < F.greatest(F.lit(8), F.floor(F.col("_a") * 0.25))
    kept = lab.join(cnt, keys).filter(few | low).select(*keys, "n", "i", "j", "dx", "dy", "d")
    return kept.unionByName(vectors.filter("n < 4").select(*keys, "n", "i", "j", "dx", "dy", "d"))


def direction_histogram(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per degree of the direction modulo 180, as a dense array ``h`` of 180 per group."""
    a = F.pmod(F.degrees(F.atan2("dy", "dx")), F.lit(180.0))
    b = F.least(F.lit(179), F.floor(a)).cast("int")
    c = vectors.groupBy(*keys, b.alias("b")).agg(F.count("*").alias("c"))
    m = c.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("b", "c"))).alias("m"))  # at most 180 entries
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(179)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("h"))


def _sep(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, 180.0 - d)


def pick_axes(hist: DataFrame, keys: list[str], max_candidates: int = 6, min_sep: float = 10.0) -> DataFrame:
    """Candidate axes per group, strongest first: ``axes`` = array of (a, w).

    Histogram peaks with prominence ≥ max(2, 5 % of the top) and the fullest bins, thinned to ``min_sep``
    degrees. Works on the 180-entry array of each group.
    """
    h = F.col("h")
    n_top = max(12, 2 * max_candidates)
    at = lambda i: F.element_at(h, i + 1)
    idx = F.sequence(F.lit(1), F.lit(178))

    def right_end(i: Column) -> Column:
        # last index of the plateau that starts at i
        higher = F.filter(F.sequence(i, F.lit(179)), lambda j: at(j) != at(i))
        return F.coalesce(F.try_element_at(higher, F.lit(1)), F.lit(180)) - 1

    starts = F.filter(idx, lambda i: at(i - 1) < at(i))
    tops = F.filter(F.transform(starts, lambda i: F.struct(i.alias("l"), right_end(i).alias("r"))), lambda p: (p["r"] < 179) & (at(F.least(p["r"] + 1, F.lit(179))) < at(p["l"])))
    mid = F.transform(tops, lambda p: F.floor((p["l"] + p["r"]) / 2).cast("int"))

    def prominence(p: Column) -> Column:
        lb = F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), p), lambda j: at(j) > at(p))), F.lit(-1))
        rb = F.coalesce(F.array_min(F.filter(F.sequence(p, F.lit(179)), lambda j: at(j) > at(p))), F.lit(180))
        left = F.array_min(F.slice(h, lb + 2, p - lb))
        right = F.array_min(F.slice(h, p + 1, rb - p))
        return at(p) - F.greatest(left, right)

    d = hist.withColumn("_pk", F.filter(mid, lambda p: prominence(p) >= F.greatest(F.lit(2.0), 0.05 * F.array_max(h))))
    # count descending; among equals peaks before plain bins, peaks from the left, bins from the right
    peaks = F.transform("_pk", lambda p: F.struct((-at(p)).alias("c"), F.lit(0).alias("k"), p.alias("o"), p.alias("b")))
    bins = F.transform(F.sequence(F.lit(0), F.lit(179)), lambda b: F.struct((-at(b)).alias("c"), F.lit(1).alias("k"), (-b).alias("o"), b.alias("b")))
    order = F.array_sort(F.concat(peaks, F.slice(F.array_sort(bins), 1, n_top)))
    empty = F.array().cast("array<struct<a:double,w:bigint>>")

    def take(acc: Column, e: Column) -> Column:
        a = e["b"] + 0.5
        free = ~F.exists(acc, lambda p: _sep(p["a"], a) < min_sep) & (F.size(acc) < max_candidates)
        return F.when(free, F.array_append(acc, F.struct(a.alias("a"), (-e["c"]).alias("w")))).otherwise(acc)

    return d.select(*keys, F.aggregate(order, empty, take).alias("axes"))


def choose_two(axes: Column) -> Column:
    """Strongest axis and the one whose separation (≥ 20°) is closest to 60°; else the first two."""
    first = axes[0]
    rest = F.slice(axes, F.lit(2), F.greatest(F.size(axes) - 1, F.lit(0)))
    ok = F.filter(rest, lambda p: _sep(p["a"], first["a"]) >= 20.0)
    keyed = F.array_sort(F.transform(ok, lambda p: F.struct(F.abs(_sep(p["a"], first["a"]) - 60.0).alias("k"), (-p["w"]).alias("w"), p["a"].alias("a"))))
    second = F.coalesce(F.try_element_at(keyed, F.lit(1))["a"], F.try_element_at(axes, F.lit(2))["a"])
    return F.array_compact(F.array(first["a"], second))


def main_axes(picked: DataFrame, keys: list[str]) -> DataFrame:
    """Two main axes (a0, a1 in degrees; a1 null when there is only one).

    ``picked``: axes plus the seed edge vectors e0, e1 (structs or null). Of the three strongest, the one
    least parallel to both seed edges is dropped.
    """
    top = F.slice("axes", 1, 3)
    d = picked.withColumn("_t", top)
    e0, e1 = G.field("e0"), G.field("e1")
    usable = F.col("e0").isNotNull() & F.col("e1").isNotNull() & (G.norm(e0) >= 1e-9) & (G.norm(e1) >= 1e-9)

    def off(p: Column) -> Column:
        v = (F.cos(F.radians(p["a"])), F.sin(F.radians(p["a"])))
        return F.least(G.axial_angle(v, e0), G.axial_angle(v, e1))

    d = d.withColumn("_off", F.transform("_t", off))
    worst = F.array_position("_off", F.array_max("_off"))
    kept = F.transform(F.filter(F.transform("_t", lambda p, i: F.struct(p["a"].alias("a"), (i + 1).alias("i"))), lambda p: p["i"] != worst), lambda p: p["a"])
    main = F.when((F.size("_t") >= 3) & usable, kept).when(F.size("_t") == 2, F.transform("_t", lambda p: p["a"])).otherwise(choose_two(F.col("axes")))
    d = d.filter(F.size("axes") > 0).withColumn("_m", main)
    return d.select(*keys, F.col("_m")[0].alias("a0"), F.try_element_at("_m", F.lit(2)).alias("a1"))


# ---------------------------------------------------------------- lengths and vectors

def axis_edges(centroids: DataFrame, axes: DataFrame, keys: list[str], k: int = 6, tol: float = 18.0) -> DataFrame:
    """Neighbour edges near one of two axes (a0, a1), per length rule.

    Rule ``nn_min``: lengths in [nn_min, 1.2·nn_min]; rule ``nn_med``: 0.6..2.2·nn_med.
    """
    return edges_near(once(knn(centroids, k, keys), keys), nn_summary(centroids, keys).select(*keys, "nn_med", "nn_min"), axes, keys, tol)


def once(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Edges a < b: an edge found from either end counts once; (dx, dy) follows the lower id."""
    return vectors.select(*keys, F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.when(F.col("i") < F.col("j"), F.col("dx")).otherwise(-F.col("dx")).alias("dx"),
                          F.when(F.col("i") < F.col("j"), F.col("dy")).otherwise(-F.col("dy")).alias("dy"), "d").dropDuplicates([*keys, "a", "b"])


def edges_near(edges: DataFrame, nn: DataFrame, axes: DataFrame, keys: list[str], tol: float = 18.0) -> DataFrame:
    """:func:`axis_edges` of known edges and neighbour distances (nn_med, nn_min)."""
    j = edges.join(nn.filter("nn_min > 0"), keys).join(axes.filter("a1 is not null"), keys)
    v = G.vec("dx", "dy")
    to = [G.axial_angle(v, (F.cos(F.radians(a)), F.sin(F.radians(a)))) for a in ("a0", "a1")]
    j = j.withColumn("t0", to[0]).withColumn("t1", to[1]).filter(F.least("t0", "t1") <= max(1.0, tol))
    j = j.withColumn("axis", F.when(F.col("t0") <= F.col("t1"), 0).otherwise(1))
    d = F.col("d")
    rules = F.array(
        F.when((d >= F.col("nn_min")) & (d <= 1.2 * F.col("nn_min")), F.lit("nn_min")),
        F.when((d >= 0.6 * F.col("nn_med")) & (d <= 2.2 * F.col("nn_med")), F.lit("nn_med")))
    return j.select(*keys, "a0", "a1", "axis", "a", "b", "d", F.explode(F.array_compact(rules)).alias("rule"))


def axis_lengths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Mean edge length per axis and the chain axis (the shorter one); the loose rule only where the strict one lacks an axis."""
    g = edges.groupBy(*keys, "a0", "a1", "rule").agg(
        F.avg(F.when(F.col("axis") == 0, F.col("d"))).alias("m0"), F.avg(F.when(F.col("axis") == 1, F.col("d"))).alias("m1"),
        F.count(F.when(F.col("axis") == 0, 1)).alias("n0"), F.count(F.when(F.col("axis") == 1, 1)).alias("n1"))
    g = g.filter("n0 >= 1 and n1 >= 1")
    pick = g.groupBy(*keys, "a0", "a1").agg(F.max_by(F.struct("m0", "m1", "n0", "n1", "rule"), F.col("rule") == "nn_min").alias("p"))
    pick = pick.select(*keys, "a0", "a1", "p.*")
    best = F.when((F.col("rule") == "nn_min") & (F.col("m0") >= F.col("m1")), F.col("a1")).otherwise(F.col("a0"))
    return pick.withColumn("best", best)


def lattice_vectors(lengths: DataFrame) -> DataFrame:
    """da and db: db along the chain axis, da along the other one with the sign that is closest to 120° from db."""
    is0 = _sep(F.col("best"), F.col("a0")) <= _sep(F.col("best"), F.col("a1"))
    d = lengths.withColumn("_is0", is0)
    ang_da = F.when(F.col("_is0"), F.col("a1")).otherwise(F.col("a0"))
    len_db = F.when(F.col("_is0"), F.col("m0")).otherwise(F.col("m1"))
    len_da = F.when(F.col("_is0"), F.col("m1")).otherwise(F.col("m0"))
    d = d.withColumn("chx", F.cos(F.radians("best"))).withColumn("chy", F.sin(F.radians("best")))
    d = d.withColumn("_ux", F.cos(F.radians(ang_da))).withColumn("_uy", F.sin(F.radians(ang_da)))
    ch, u = G.vec("chx", "chy"), G.vec("_ux", "_uy")
    u = G.choose(F.abs(G.directed_angle(ch, u) - 120.0) <= F.abs(G.directed_angle(ch, G.neg(u)) - 120.0), u, G.neg(u))
    return (
        d.withColumn("da", G.as_struct(G.scale(u, len_da))).withColumn("db", G.as_struct(G.scale(ch, len_db)))
        .drop("_is0", "_ux", "_uy")
    )


def pick_origin(cycles: DataFrame, keys: list[str], width: Column, height: Column) -> DataFrame:
    """Cycle nearest the image centre and its obtuse vertex nearest the centre, with the two edges there.

    ``cycles`` has cx, cy, seq. Output: origin, e1 (towards the next vertex of index order), e2.
    """
    mx, my = (width - 1) * 0.5, (height - 1) * 0.5
    d = cycles.withColumn("_mx", mx).withColumn("_my", my)
    dx, dy = F.col("cx") - F.col("_mx"), F.col("cy") - F.col("_my")
    best = d.groupBy(*keys).agg(F.min_by(F.struct(*C.COORDS, "_mx", "_my"), F.struct((dx * dx + dy * dy).alias("d"), F.col("seq"))).alias("b")).select(*keys, "b.*")
    p = [(F.col(f"x{i}"), F.col(f"y{i}")) for i in range(4)]
    corner = []
    for i in range(4):
        j, k = sorted(((i + 1) % 4, (i + 3) % 4))
        e1, e2 = G.sub(p[j], p[i]), G.sub(p[k], p[i])
        ex, ey = p[i][0] - F.col("_mx"), p[i][1] - F.col("_my")
        corner.append(F.struct(G.directed_angle(e1, e2).alias("ang"), (ex * ex + ey * ey).alias("d2"), F.lit(i).alias("i"), G.as_struct(p[i]).alias("o"), G.as_struct(e1).alias("e1"), G.as_struct(e2).alias("e2")))
    d = best.withColumn("_c", F.array(*corner))
    obtuse = F.filter("_c", lambda c: c["ang"] > 90.0 + 1e-6)
    widest = F.array_sort(F.transform("_c", lambda c: F.struct((-c["ang"]).alias("k"), c["i"].alias("i"), c.alias("c"))))[0]["c"]
    nearest = F.array_sort(F.transform(obtuse, lambda c: F.struct(c["d2"].alias("k"), c["i"].alias("i"), c.alias("c"))))
    d = d.withColumn("_v", F.when(F.size(obtuse) > 0, F.try_element_at(nearest, F.lit(1))["c"]).otherwise(widest))
    return d.select(*keys, F.col("_v.o").alias("origin"), F.col("_v.e1").alias("e1"), F.col("_v.e2").alias("e2"))


def align_to_corner(vectors: DataFrame, origin: DataFrame, keys: list[str]) -> DataFrame:
    """Signs of da, db along the corner edges: the edge nearer the chain direction serves db."""
    d = vectors.join(origin, keys)
    u1, u2 = G.unit(G.field("e1")), G.unit(G.field("e2"))
    ch = G.unit(G.vec("chx", "chy"))
    first = F.abs(G.dot(u1, ch)) >= F.abs(G.dot(u2, ch))
    db_edge, da_edge = G.choose(first, u1, u2), G.choose(first, u2, u1)
    da, db = G.align_sign(G.field("da"), da_edge), G.align_sign(G.field("db"), db_edge)
    return d.withColumn("_da", G.as_struct(da)).withColumn("_db", G.as_struct(db)).drop("da", "db", "e1", "e2").withColumnsRenamed({"_da": "da", "_db": "db"})


# ---------------------------------------------------------------- the per-layer pipeline

def _steps(seeds: DataFrame, da_px: Column, db_px: Column) -> DataFrame:
    """Both assignments of the two lattice lengths to the seed's edge directions, as variants 0 and 1."""
    u0 = G.unit((F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    u1 = G.unit((F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    d = seeds.withColumn("_la", da_px).withColumn("_lb", db_px).withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
    la = F.when(F.col("variant") == 0, F.col("_la")).otherwise(F.col("_lb"))
    lb = F.when(F.col("variant") == 0, F.col("_lb")).otherwise(F.col("_la"))
    return d.withColumn("ax", u0[0] * la).withColumn("ay", u0[1] * la).withColumn("bx", u1[0] * lb).withColumn("by", u1[1] * lb).drop("_la", "_lb")


def grow_components(points: DataFrame, candidates: DataFrame, nn: DataFrame, keys: list[str], da_angstrom: float, db_angstrom: float,
                    max_hop: int = 3, max_components: int = 3, no_intersect: bool = True) -> DataFrame:
    """Up to ``max_components`` grown patches per group, each from the best unused candidate cycle.

    ``nn``: keys, nn_med, px_per_angstrom. For each seed both axis assignments are tried on two hops without a crossing check (as two variants
    of one growth) and the one with more cycles is grown in full.
    """
    total = None
    for comp in range(max_components):
        free = candidates
        if total is not None:
            used = total.select(*keys, F.explode(F.array(*C.VERTS)).alias("pt_id"))
            hit = candidates.select(*keys, *C.VERTS, F.explode(F.array(*C.VERTS)).alias("pt_id")).join(used, [*keys, "pt_id"], "left_semi").select(*keys, *C.VERTS).distinct()
            free = candidates.join(hit, [*keys, *C.VERTS], "left_anti")
        best = free.groupBy(*keys).agg(F.max_by(F.struct(*C.VERTS, *C.COORDS), F.struct(F.col("score"), *[(-F.col(f"p{i}")).alias(f"r{i}") for i in (1, 3, 0, 2)])).alias("s"))
        seeds = cut(best.select(*keys, "s.*").join(nn.select(*keys, "nn_med", "px_per_angstrom"), keys))
        if seeds.isEmpty():
            break
        both = cut(_steps(seeds, da_angstrom * F.col("px_per_angstrom"), db_angstrom * F.col("px_per_angstrom")))
        vk = [*keys, "variant"]
        trial_pts = points.join(seeds.select(*keys), keys, "left_semi").withColumn("variant", F.explode(F.array(F.lit(0), F.lit(1))))
        size = C.grow(trial_pts, both, vk, 2, False).groupBy(*vk).agg(F.count("*").alias("n"))
        pick = size.groupBy(*keys).agg(F.max_by("variant", F.struct(F.col("n"), (-F.col("variant")).alias("v"))).alias("variant"))
        chosen = both.join(pick, vk).drop("variant")
        # a later seed that crosses an accepted patch starts nothing
        if total is not None and no_intersect:
            cell = chosen.withColumn("cell", 1.5 * F.col("nn_med")).withColumn("ia", F.lit(1).cast("bigint"))
            old = total.join(nn.select(*keys, (1.5 * F.col("nn_med")).alias("cell")), keys).withColumn("ib", F.lit(-1).cast("bigint"))
            chosen = chosen.join(C.crossing_pairs(cell, old, keys, "ia", "ib").select(*keys).distinct(), keys, "left_anti")
        chosen = cut(chosen)
        if chosen.isEmpty():
            break
        new = C.grow(points.join(chosen.select(*keys), keys, "left_semi"), chosen, keys, max_hop, no_intersect, total)
        new = new.withColumn("component", F.lit(comp))
        total = cut(new if total is None else total.unionByName(new))
    if total is None:  # no group has a seed
        total = candidates.filter(F.lit(False)).select(*keys, *C.VERTS, *C.COORDS, *[F.lit(0.0).alias(c) for c in ("cx", "cy")], *[F.lit(0).alias(c) for c in ("seq", "component")])
    return total


#: Points of a group that are worked on inside one task; groups with more take the set operators and stored rounds.
IN_TASK = 1 << 16


def _by_rounds(points: DataFrame, per_px: DataFrame, keys: list[str], dist_factor: float, strict: bool, reject_flip: bool, flip_tol: float,
               da_angstrom: float, db_angstrom: float, max_hop: int, max_components: int, min_atoms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cycles, edges, groups) as `_in_tasks` has them, by the set operators."""
    ok = points.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= min_atoms).select(*keys)
    pts = cut(points.select(*keys, "pt_id", "x", "y").join(ok, keys, "left_semi").join(per_px.select(*keys), keys, "left_semi"))
    nn = cut(nn_summary(pts, keys).filter("nn_med > 0"))
    lim = pts.join(nn.select(*keys, (F.col("nn_med") * dist_factor).alias("lim")), keys)
    cand = cut(C.with_score(C.with_shape(C.enumerate_cycles(lim, keys, F.col("lim")))))
    keep = cand.filter(F.col("score") > 0.20)
    if strict:
        keep = keep.filter("strict")
    keep = cut(keep)
    flat = cut(C.dominant_direction_filter(keep, keys, flip_tol)) if reject_flip else keep
    grown = grow_components(pts, flat, nn.join(per_px, keys), keys, da_angstrom, db_angstrom, max_hop, max_components)
    cents = cut(grown.select(*keys, *C.VERTS, *C.COORDS, "cx", "cy", "component", "seq"))
    many = cents.groupBy(*keys).agg(F.count("*").alias("n_cycles"))
    pos = cents.join(many.filter("n_cycles >= 2").select(*keys), keys, "left_semi")
    # one number per cycle: the least vertex id is unique, cycles are disjoint
    pc = cut(pos.select(*keys, F.least(*C.VERTS).alias("pt_id"), F.col("cx").alias("x"), F.col("cy").alias("y")))
    hist = cut(direction_histogram(short_vectors(cut(direction_vectors(pc, keys)), keys), keys))
    state = nn.select(*keys).withColumn("stage", F.lit(1))
    for df in (cand, keep, flat):
        state = state.join(df.select(*keys).distinct().withColumn("_more", F.lit(1)), keys, "left").withColumn("stage", F.col("stage") + F.coalesce("_more", F.lit(0))).drop("_more")
    state = state.join(many, keys, "left").join(nn_summary(pc, keys).select(*keys, "nn_med", "nn_min"), keys, "left").join(hist, keys, "left")
    return cents, once(knn(pc, 6, keys), keys), state.select(*keys, "stage", "n_cycles", "nn_med", "nn_min", "h")


def _in_tasks(points: DataFrame, per_px: DataFrame, keys: list[str], *how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cycles of the patches; edges a < b between centroids; stage, n_cycles, nn_med and nn_min of the centroids and histogram ``h`` per group)."""
    made = cut(layers(points, per_px, keys, *how))
    cents = made.filter(F.col("kind") == CYCLE).select(*keys, *C.VERTS, *C.COORDS, "cx", "cy", "component", "seq")
    edges = made.filter(F.col("kind") == EDGE).select(*keys, F.col("p0").alias("a"), F.col("p1").alias("b"), F.col("x0").alias("dx"), F.col("y0").alias("dy"), F.col("cx").alias("d"))
    cycles = F.when(F.col("component") > 0, F.col("component").cast("bigint"))
    nn = [F.when(cycles >= 2, F.col(c)).alias(name) for c, name in (("cx", "nn_med"), ("cy", "nn_min"))]
    return cents, edges, made.filter(F.col("kind") == GROUP).select(*keys, F.col("seq").alias("stage"), cycles.alias("n_cycles"), *nn, "h")


def layer_lattice(points: DataFrame, images: DataFrame, keys: list[str], dist_factor: float = 1.15, strict: bool = False, reject_flip: bool = True, flip_tol: float = 25.0,
                  da_angstrom: float = 6.4, db_angstrom: float = 6.6, out_scale: float = 4.0, max_hop: int = 3, max_components: int = 3, min_atoms: int = 10, in_task: int = IN_TASK) -> DataFrame:
    """Origin and lattice vectors per layer, with the first failing reason.

    ``images``: keys, w, h (null when the image is missing) and side_angstrom. ``points``: keys, pt_id, x, y.
    Layers of at most ``in_task`` points are worked on inside tasks (:func:`growth.layers`), larger ones by the set operators, with the same result.
    """
    n = cut(points.groupBy(*keys).agg(F.count("*").alias("n_atoms")))
    per_px = images.filter("w is not null").select(*keys, (F.col("w") / F.col("side_angstrom")).alias("px_per_angstrom"))
    how = dist_factor, strict, reject_flip, flip_tol, da_angstrom, db_angstrom, max_hop, max_components, min_atoms
    big = n.filter(F.col("n_atoms") > in_task).select(*keys)
    if big.isEmpty():
        cents, edges, state = _in_tasks(points, per_px, keys, *how)
    else:
        parts = _in_tasks(points.join(big, keys, "left_anti"), per_px.join(big, keys, "left_anti"), keys, *how), _by_rounds(points.join(big, keys, "left_semi"), per_px.join(big, keys, "left_semi"), keys, *how)
        cents, edges, state = (cut(a.unionByName(b)) for a, b in zip(*parts, strict=True))
    seed = cents.filter("component = 0 and seq = 0").select(
        *keys, F.struct((F.col("x1") - F.col("x0")).alias("x"), (F.col("y1") - F.col("y0")).alias("y")).alias("e0"),
        F.struct((F.col("x3") - F.col("x0")).alias("x"), (F.col("y3") - F.col("y0")).alias("y")).alias("e1"))
    # few bytes and much work a row: dealt by number, since a scan or an exchange by size would be one task
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picked = cut(pick_axes(state.filter("h is not null").select(*keys, "h").repartition(parts, *keys), keys))
    axes = cut(main_axes(picked.join(seed, keys, "left"), keys))
    vectors = lattice_vectors(axis_lengths(edges_near(edges, state.select(*keys, "nn_med", "nn_min"), axes, keys), keys))
    size = images.select(*keys, "w", "h")
    first = cents.withColumn("seq", F.struct("component", "seq"))
    origin = pick_origin(first.join(size, keys), keys, F.col("w"), F.col("h"))
    done = align_to_corner(vectors, origin, keys).select(*keys, "origin", "da", "db")
    out = images.join(n, keys, "left").join(state.select(*keys, "stage", "n_cycles"), keys, "left").join(done, keys, "left")
    stage = F.coalesce("stage", F.lit(0))
    tests = [F.col("w").isNull(), F.coalesce("n_atoms", F.lit(0)) < min_atoms, stage < 1, stage < 2, stage < 3, stage < 4,
             F.col("n_cycles").isNull(), F.col("n_cycles") < 2, F.col("da").isNull()]
    reason = F.lit("")
    for t, r in reversed(list(zip(tests, REASONS))):
        reason = F.when(t, r).otherwise(reason)
    big = lambda c: G.as_struct(G.scale(G.field(c), out_scale))
    return out.withColumn("reason", reason).withColumn("ok", F.col("reason") == "").select(
        *keys, "ok", "reason", F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"), "n_cycles", "origin", "da", "db",
        big("origin").alias("origin_512"), big("da").alias("da_512"), big("db").alias("db_512"),
        G.directed_angle(G.field("db"), G.field("da")).alias("angle_db_da"))
