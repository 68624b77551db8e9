"""Blobs of binary masks: components, statistics, centres, markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import half_even
from ..iterate import connected_labels, cut
from .blocks import BLOCK, gather, label_blocks, map_blocks
from .pixels import high_pass, image_size, resize, min_max, smooth_mask, threshold_mean
from .wavefront import settle

KEY = ["image_id"]


def components(mask: DataFrame, key: list[str] = KEY, block: int = BLOCK) -> DataFrame:
    """8-connected components of foreground pixels: adds ``label``, the (y, x) of the first pixel in raster order.

    Blocks are labelled in one array operation each; rounds run only over the contacts between pieces of
    different blocks, so their number depends on the blocks a component crosses and images of one block need none.
    """
    pieces = cut(map_blocks(gather(mask, key, [], block), key, label_blocks(block), [("x", "int"), ("y", "int"), ("rx", "int"), ("ry", "int")]))
    node = F.struct(*key, F.col("ry").alias("y"), F.col("rx").alias("x"))

    def steps(*ij: tuple[int, int]) -> Column:
        return F.array(*[F.struct((F.col("x") + i).alias("x"), (F.col("y") + j).alias("y")) for i, j in ij])

    right, low = F.pmod(F.col("x") + 1, F.lit(block)) == 0, F.pmod(F.col("y") + 1, F.lit(block)) == 0
    none = F.array().cast("array<struct<x:int,y:int>>")
    ahead = F.concat(F.when(right, steps((1, -1), (1, 0), (1, 1))).otherwise(none),
                     F.when(low, steps((-1, 1), (0, 1), (1, 1))).otherwise(none))
    sides = pieces.filter(right | low).select(*key, node.alias("a"), F.inline(ahead))
    first = pieces.filter((F.col("x") % block == 0) | (F.col("y") % block == 0)).select(*key, "x", "y", node.alias("b"))
    contacts = cut(sides.join(first, [*key, "x", "y"]).filter("a <> b").select("a", "b").distinct())
    if contacts.isEmpty():
        return pieces.select(*key, "x", "y", F.struct(F.col("ry").alias("y"), F.col("rx").alias("x")).alias("label"))
    met = contacts.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    lab = connected_labels(met, contacts).select("node", F.struct("label.y", "label.x").alias("label"))
    own = F.struct(F.col("node.y").alias("y"), F.col("node.x").alias("x"))
    return pieces.withColumn("node", node).join(lab, "node", "left").select(*key, "x", "y", F.coalesce("label", own).alias("label"))


def component_stats(labelled: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Area, centroid, half-even centre (row, col) and bounding box per component."""
    s = labelled.groupBy(*key, "label").agg(
        F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("left"), F.min("y").alias("top"),
        (F.max("x") - F.min("x") + 1).alias("width"), (F.max("y") - F.min("y") + 1).alias("height"))
    return s.withColumn("row", half_even(F.col("cy"))).withColumn("col", half_even(F.col("cx")))


def area_filter(stats: DataFrame, min_pixels: int = 1, max_pixels: int | None = None) -> DataFrame:
    d = stats.filter(F.col("area") >= min_pixels)
    return d if max_pixels is None else d.filter(F.col("area") <= max_pixels)


def drop_small(labelled: DataFrame, min_pixels: int = 20, key: list[str] = KEY) -> DataFrame:
    """Mask pixels of components with at least ``min_pixels``."""
    big = labelled.groupBy(*key, "label").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pixels)
    return labelled.join(big, [*key, "label"], "left_semi").select(*key, "x", "y")


def thin_points(points: DataFrame, keys: list[str], distance: float, rank: str, max_points: int | None = None) -> DataFrame:
    """Keep a point unless a kept earlier one (by unique ``rank``) is closer than ``distance``; first ``max_points`` per group."""
    kept = settle(points, keys, distance, rank)
    if max_points is None:
        return kept
    w = Window.partitionBy(*keys).orderBy(rank)
    return kept.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= max_points).drop("_r")


def fill_holes(labelled: DataFrame, key: list[str] = KEY) -> tuple[DataFrame, DataFrame]:
    """Blobs with their holes filled, ``key, label, x, y``, and the labels that lie in a hole of another blob.

    A blob has a hole if its Euler number, from counts of 2 × 2 squares, is below 1; only such blobs are
    searched. Candidates are the gaps between the pixels of a row; gaps that touch along columns form
    regions, and a region next to blob pixels only is a hole.
    """
    one = [*key, "label"]
    here = labelled.select(*one, "x", "y")
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    squares = here.withColumn("c", F.explode(corners)).groupBy(*one, (F.col("x") + F.col("c.i")).alias("sx"), (F.col("y") + F.col("c.j")).alias("sy")).agg(
        F.count("*").alias("n"), F.sum((F.col("c.i") == F.col("c.j")).cast("int")).alias("same"))
    part = F.when(F.col("n") == 1, 1).when(F.col("n") == 3, -1).when((F.col("n") == 2) & (F.col("same") != 1), -2).otherwise(0)
    holed = cut(squares.groupBy(*one).agg(F.sum(part).alias("e")).filter("e < 4").select(*one))
    if holed.isEmpty():
        return here, here.select(*one).filter(F.lit(False))
    blob = here.join(holed, one, "left_semi")
    before = F.lag("x").over(Window.partitionBy(*one, "y").orderBy("x"))
    gap = blob.withColumn("x0", before + 1).filter("x > x0").withColumn("node", F.struct(*one, "y", "x0"))
    gap = cut(gap.select(*one, F.explode(F.sequence("x0", F.col("x") - 1)).alias("x"), "y", "node"))
    near = gap.select(*one, "x", F.explode(F.array(F.col("y") - 1, F.col("y") + 1)).alias("y"), F.col("node").alias("a"))
    inside = blob.select(*one, "x", "y").unionByName(gap.withColumnRenamed("node", "b"), allowMissingColumns=True).withColumn("inside", F.lit(True))
    touch = cut(near.join(inside, [*one, "x", "y"], "left").select("a", "b", "inside").distinct())
    region = cut(connected_labels(gap.select("node").distinct(), touch.filter("b is not null").select("a", "b")).withColumnRenamed("label", "region"))
    leaks = region.join(touch.filter("inside is null").select(F.col("a").alias("node")).distinct(), "node").select("region").distinct()
    holes = cut(gap.join(region.join(leaks, "region", "left_anti"), "node").select(*one, "x", "y"))
    nested = here.withColumnRenamed("label", "inner").join(holes, [*key, "x", "y"]).select(*key, F.col("inner").alias("label")).distinct()
    return here.unionByName(holes), nested


def contour_area(labelled: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Area inside the polygon through the border pixels, by Pick's theorem: n − b/2 − 1 of a hole-free blob.

    A border pixel lacks one of its four neighbours in the same blob.
    """
    here = labelled.select(*key, "label", "x", "y")
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    touch = here.withColumn("n", F.explode(steps)).select(*key, "label", (F.col("x") + F.col("n.i")).alias("x"), (F.col("y") + F.col("n.j")).alias("y"))
    # one aggregate: a pixel row marks itself, touches count its neighbours
    both = here.withColumn("own", F.lit(1)).withColumn("t", F.lit(0)).unionByName(touch.withColumn("own", F.lit(0)).withColumn("t", F.lit(1)))
    per = both.groupBy(*key, "label", "x", "y").agg(F.max("own").alias("own"), F.sum("t").alias("t")).filter("own = 1")
    g = per.groupBy(*key, "label").agg(F.count("*").alias("n"), F.count(F.when(F.col("t") < 4, 1)).alias("b"))
    return g.withColumn("poly_area", F.greatest(F.lit(0.0), F.col("n") - F.col("b") / 2.0 - 1.0))


def detect_atoms(px: DataFrame, key: list[str] = KEY, use_highpass: bool = True, sigma: float = 6.0, factor: float = 1.8, min_area: float = 100.0, area_ref: int = 512,
                 min_distance: float = 5.0, max_points: int | None = None) -> DataFrame:
    """Atom centres of gray images: stretch, high-pass, mean threshold, components, area filter, thinning.

    Blobs count with their holes filled; a blob in a hole of another one is none of its own.
    The area limit is scaled by (min(h, w)/area_ref)². ``(key, pt_id, x, y, area)``. All atoms are kept unless ``max_points`` is given.
    """
    g = min_max(px.select(*key, "x", "y", "v"), key)
    if use_highpass:
        g = high_pass(cut(g), sigma, key)
    fg = threshold_mean(g, factor, key).filter("fg")
    lab = cut(components(fg.select(*key, "x", "y"), key))
    size = image_size(px, key).withColumn("lim", min_area * F.pow(F.least("w", "h") / float(area_ref), F.lit(2.0))).select(*key, "lim")
    filled, nested = fill_holes(lab, key)
    lab = cut(filled.join(nested, [*key, "label"], "left_anti"))
    s = component_stats(lab, key).join(contour_area(lab, key).select(*key, "label", "poly_area"), [*key, "label"]).join(size, key).filter(F.col("poly_area") > F.col("lim"))
    pts = s.select(*key, F.col("label").alias("pt_id"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area")
    out = thin_points(cut(pts.withColumn("rk", F.col("pt_id"))), key, min_distance, "rk", max_points)
    return out.withColumn("pt_id", F.xxhash64("pt_id")).drop("rk")


def leader_clusters(points: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Leader clustering in (row, col) order: a leader takes all later points closer than ``radius`` not taken before.

    Leaders are the serial thinning of the points; every other point belongs to its earliest leader in
    reach. Centres are rounded means. ``points``: keys, pt_id, x, y (integers).
    """
    p = points.withColumn("rk", F.struct("y", "x", "pt_id"))
    lead = cut(thin_points(p, keys, radius, "rk"))
    # leaders are a radius apart, so a point meets a few of them only; points are small as files, so no join is a broadcast by file size
    cell = lambda c: F.floor(F.col(c) / radius)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    reach = lead.select(*keys, "rk", F.col("x").alias("lx"), F.col("y").alias("ly"), F.explode(steps).alias("s"))
    reach = reach.select(*keys, "rk", "lx", "ly", (F.floor(F.col("lx") / radius) + F.col("s.i")).alias("cx"), (F.floor(F.col("ly") / radius) + F.col("s.j")).alias("cy"))
    dx, dy = F.col("x") - F.col("lx"), F.col("y") - F.col("ly")
    near = points.select(*keys, "pt_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy")).join(reach.hint("merge"), [*keys, "cx", "cy"]).filter(dx * dx + dy * dy < radius * radius)
    own = near.groupBy(*keys, "pt_id").agg(F.min("rk").alias("lead"))
    member = p.join(own.hint("merge"), [*keys, "pt_id"], "left").join(lead.select(*keys, "pt_id", F.lit(True).alias("_l")).hint("merge"), [*keys, "pt_id"], "left")
    member = member.withColumn("lead", F.when(F.col("_l"), F.col("rk")).otherwise(F.col("lead")))
    g = member.groupBy(*keys, "lead").agg(F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("x").alias("mx"))
    return g.select(*keys, "n", half_even(F.col("my")).alias("row"), half_even(F.col("mx")).alias("col"), F.col("lead.pt_id").alias("leader"))


def instances(mask: DataFrame, key: list[str] = KEY, mode: str = "connected", min_pixels: int = 1, max_pixels: int | None = None, rounds: int = 1, thresh: float = 0.5, radius: float = 20.0) -> DataFrame:
    """Instance centres (row, col, area) of dense 0/1 masks, by components or by smoothing and leader clustering."""
    if mode == "connected":
        s = component_stats(components(mask.filter("v > 0").select(*key, "x", "y"), key), key)
        return area_filter(s, min_pixels, max_pixels).select(*key, "row", "col", "area")
    if mode == "convolution":
        sm = smooth_mask(mask, rounds, thresh, key).filter("v = 1")
        pts = cut(sm.select(*key, F.struct("y", "x").alias("pt_id"), "x", "y"))
        return leader_clusters(pts, key, radius).select(*key, "row", "col", F.col("n").alias("area"))
    raise ValueError(f"unknown extraction mode {mode}")


def scale_centers(c: DataFrame, from_hw: tuple[Column, Column], to_hw: tuple[Column, Column]) -> DataFrame:
    """Centres carried to another frame size: half-even rounding, clamped to the frame."""
    def s(v: str, f: Column, t: Column) -> Column:
        return F.greatest(F.lit(0), F.least(t - 1, half_even(F.col(v) * (t / f)))).cast("long")

    return c.withColumn("row", s("row", from_hw[0], to_hw[0])).withColumn("col", s("col", from_hw[1], to_hw[1]))


def area_distribution(stats: DataFrame, keys: list[str], smallest: int = 20, max_bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Summary (count, min, max, mean, smallest areas) and a fixed-width histogram with min(max_bins, n) bins."""
    w = Window.partitionBy(*keys).orderBy("area", "label")
    small = stats.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= smallest)
    small = small.groupBy(*keys).agg(F.sort_array(F.collect_list("area")).alias("smallest"))  # at most `smallest` entries
    s = stats.groupBy(*keys).agg(F.count("*").alias("n"), F.min("area").alias("min_area"), F.max("area").alias("max_area"), F.avg("area").alias("mean_area"))
    bins = F.least(F.lit(max_bins), F.col("n")).cast("int")
    span = F.col("max_area") - F.col("min_area")
    j = stats.join(s, keys).withColumn("bin", F.when(span > 0, F.least(bins - 1, F.floor((F.col("area") - F.col("min_area")) / span * bins))).otherwise(F.floor(bins / 2)).cast("int"))
    return s.join(small, keys), j.groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def merge_layers(inst0: DataFrame, inst1: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Markers of both layers in one table, and counts per layer."""
    m = inst0.select(*keys, "row", "col", F.lit(0).alias("layer")).unionByName(inst1.select(*keys, "row", "col", F.lit(1).alias("layer")))
    c = m.groupBy(*keys).agg(F.count(F.when(F.col("layer") == 0, 1)).alias("mask0_instances"), F.count(F.when(F.col("layer") == 1, 1)).alias("mask1_instances"))
    return m, c


def merge_masks(mask0: DataFrame, mask1: DataFrame, keys: list[str], **how) -> tuple[DataFrame, DataFrame]:
    """`merge_layers` of the instances of two dense 0/1 masks; the second one is brought to the frame of the first by nearest pixels.

    ``how`` goes to `instances`. Images that have one mask only give the markers of that one.
    """
    frame = image_size(mask0, keys).withColumnsRenamed({"w": "w0", "h": "h0"})
    own = image_size(mask1, keys).join(frame, keys, "left").withColumns({"w0": F.coalesce("w0", "w"), "h0": F.coalesce("h0", "h")})
    moved = resize(mask1, F.col("w0"), F.col("h0"), "nearest", keys, own)
    return merge_layers(instances(mask0, keys, **how), instances(moved, keys, **how), keys)


def disc_offsets(radius: int) -> Column:
    """Array of the (i, j) inside a disc."""
    r = range(-radius, radius + 1)
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in r for j in r if i * i + j * j <= radius * radius])


def marker_raster(markers: DataFrame, keys: list[str], radius: int, width: int, height: int) -> DataFrame:
    """Pixels covered by a disc around each marker, per layer."""
    d = markers.withColumn("o", F.explode(disc_offsets(radius)))
    d = d.select(*keys, "layer", (F.col("col") + F.col("o.i")).alias("x"), (F.col("row") + F.col("o.j")).alias("y"))
    return d.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).distinct()


def batch_summary(images: DataFrame, merged: DataFrame) -> DataFrame:
    """Totals over a batch; a failed image carries its reason and stops nothing. ``images``: path, instance_count, reason."""
    a = images.agg(F.count("*").alias("images"), F.sum(F.coalesce("instance_count", F.lit(0))).alias("instances"), F.count(F.when(F.col("reason") != "", 1)).alias("failed"))
    return a.crossJoin(F.broadcast(merged.agg(F.count("*").alias("merged_pairs"))))  # two one-row tables
