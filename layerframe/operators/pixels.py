"""Pixel-table operators. A pixel table has an image key, integer x, y and a double v.

Neighbourhood filters work on halo blocks: every pixel goes to its block and, near a block border, also
to the adjoining ones, so the largest unit of work is one block and not one image. Per-image constants
(range, mean, size) are aggregated and joined back instead of using a window over the whole image.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip, hash_normal, hash_uniform
from ..iterate import cut
from .blocks import BLOCK, frames, gather, joined, map_blocks

KEY = ["image_id"]


# ---------------------------------------------------------------- sizes and per-image constants

def image_size(px: DataFrame, key: list[str] = KEY) -> DataFrame:
    return px.groupBy(*key).agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def _with(px: DataFrame, key: list[str], *aggs: Column) -> DataFrame:
    """Attach per-image aggregates (partial aggregation first, one row per image is joined back).

    By merge: stored pixels are far smaller as files than as rows and must not be the side that is broadcast.
    """
    return px.hint("merge").join(px.groupBy(*key).agg(*aggs), key)


def luma(r: Column, g: Column, b: Column) -> Column:
    """Gray value of an RGB triple."""
    return 0.299 * r + 0.587 * g + 0.114 * b


def min_max(px: DataFrame, key: list[str] = KEY, eps: float = 1e-9) -> DataFrame:
    """Stretch every image to 0..1; a constant image becomes 0."""
    d = _with(px, key, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    return d.withColumn("v", F.when(span < eps, 0.0).otherwise((F.col("v") - F.col("_lo")) / span)).drop("_lo", "_hi")


def threshold_mean(px: DataFrame, factor: float = 1.8, key: list[str] = KEY) -> DataFrame:
    """Add ``thr`` = mean·factor and the strict comparison ``fg``."""
    d = _with(px, key, (F.avg("v") * factor).alias("thr"))
    return d.withColumn("fg", F.col("v") > F.col("thr"))


def binarise(px: DataFrame, key: list[str] = KEY) -> DataFrame:
    """0/1 mask: above 127 for images whose maximum exceeds 1, above 0 otherwise."""
    d = _with(px, key, F.max("v").alias("_hi"))
    return d.withColumn("v", F.when(F.col("_hi") > 1, F.col("v") > 127).otherwise(F.col("v") > 0).cast("int")).drop("_hi")


# ---------------------------------------------------------------- value range maps

def to_unit(px: DataFrame, key: list[str] = KEY, is_byte: bool = False) -> DataFrame:
    """To 0..1: bytes by 255; float images as they are when their maximum is at most 1.5, else by 255; clipped."""
    if is_byte:
        return px.withColumn("v", F.col("v") / 255.0)
    d = _with(px, key, F.max("v").alias("_hi"))
    return d.withColumn("v", clip(F.when(F.col("_hi") <= 1.5, F.col("v")).otherwise(F.col("v") / 255.0), 0.0, 1.0)).drop("_hi")


def unit_to_signed(v: Column) -> Column:
    return 2.0 * v - 1.0


def signed_to_unit(v: Column, clamp: bool = True) -> Column:
    u = (v + 1.0) / 2.0
    return clip(u, 0.0, 1.0) if clamp else u


def byte_to_signed(v: Column) -> Column:
    return v / 127.5 - 1.0


def signed_to_byte(v: Column) -> Column:
    """Back to 0..255 integers, truncated like a byte cast."""
    return F.floor(clip((v + 1.0) * 127.5, 0.0, 255.0)).cast("int")


def standardise(v: Column, mean: float, std: float, top: float = 255.0) -> Column:
    return (v / top - mean) / std


def logit(v: Column, lam: float = 1e-6) -> Column:
    x = lam + (1.0 - 2.0 * lam) * v
    return F.log(x) - F.log1p(-x)


def inverse_logit(v: Column, lam: float = 1e-6) -> Column:
    return (1.0 / (1.0 + F.exp(-v)) - lam) / (1.0 - 2.0 * lam)


def dequantise(v: Column, seed: int) -> Column:
    """Uniform dequantisation noise on 0..1 values of byte images."""
    return v / 256.0 * 255.0 + F.rand(seed) / 256.0


def display_adjust(v: Column, gain: Column | float = 1.0, bias: Column | float = 0.0, gamma: Column | float = 1.0) -> Column:
    """clip(v·gain + bias), then power; the base is kept at least 1e-7."""
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    x = clip(v * gain + bias, 0.0, 1.0)
    return clip(F.pow(clip(x, 1e-7, 1.0), g), 0.0, 1.0)


# ---------------------------------------------------------------- crops

def crop(px: DataFrame, left: Column, top: Column, width: Column | int, height: Column | int) -> DataFrame:
    """Keep a box and move it to the origin (columns used may be constants of the image)."""
    return (
        px.filter((F.col("x") >= left) & (F.col("x") < left + width) & (F.col("y") >= top) & (F.col("y") < top + height))
        .withColumn("x", (F.col("x") - left).cast("int")).withColumn("y", (F.col("y") - top).cast("int"))
    )


def center_crop(px: DataFrame, width: int, height: int, key: list[str] = KEY, size: DataFrame | None = None) -> DataFrame:
    """Crop about the centre; left = w//2 − width//2, images of the wanted size pass unchanged."""
    d = px.join(size if size is not None else image_size(px, key), key)
    left = F.floor(F.col("w") / 2) - width // 2
    top = F.floor(F.col("h") / 2) - height // 2
    return crop(d, left, top, width, height).drop("w", "h")


def pad_center_crop(px: DataFrame, width: int, height: int, key: list[str] = KEY, size: DataFrame | None = None) -> DataFrame:
    """Zero-pad up to the wanted size (half of the padding, rounded down, on the top/left), then crop (w−width)//2."""
    size = size if size is not None else image_size(px, key)
    off = [
        (F.floor(F.greatest(F.lit(0), want - F.col(s)) / 2) - F.floor(F.greatest(F.lit(0), F.col(s) - want) / 2)).cast("int").alias(o)
        for want, s, o in ((F.lit(width), "w", "ox"), (F.lit(height), "h", "oy"))
    ]
    moved = px.join(size.select(*key, *off), key).withColumn("x", F.col("x") + F.col("ox")).withColumn("y", F.col("y") + F.col("oy"))
    moved = moved.filter((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).select(*key, "x", "y", "v")
    grid = grid_of(size.select(*key), F.lit(width), F.lit(height))
    return grid.join(moved.hint("merge"), [*key, "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def grid_of(images: DataFrame, width: Column, height: Column) -> DataFrame:
    """All pixels (x, y) of a width × height frame per image row; images are few bytes, so they are dealt to all tasks before that."""
    parts = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = images.repartition(parts).withColumn("y", F.explode(F.sequence(F.lit(0), (height - 1).cast("int"))))
    return d.withColumn("x", F.explode(F.sequence(F.lit(0), (width - 1).cast("int"))))


def random_crop_plan(size: DataFrame, side_min: int, side_max: int, seed: int, key: list[str] = KEY) -> DataFrame:
    """One square window per image: side uniform in [min, max], frame padded to the side when smaller, offset uniform."""
    d = size.withColumn("side", (F.floor(hash_uniform(seed, *key) * (side_max - side_min + 1)) + side_min).cast("int"))
    for s, o, k in (("w", "left", 1), ("h", "top", 2)):
        slack = F.greatest(F.lit(0), F.col(s) - F.col("side"))
        padding = F.floor(F.greatest(F.lit(0), F.col("side") - F.col(s)) / 2)
        d = d.withColumn(o, (F.floor(hash_uniform(seed + k, *key) * (slack + 1)) - padding).cast("int"))
    return d


def random_fraction_plan(size: DataFrame, target: int, lo: float, hi: float, seed: int, key: list[str] = KEY) -> DataFrame:
    """Shorter side scaled to U(target/hi, target/lo) pixels, then a random target × target window."""
    small = F.floor(hash_uniform(seed, *key) * (math.ceil(target / lo) - math.ceil(target / hi) + 1)) + math.ceil(target / hi)
    d = size.withColumn("short", small.cast("int"))
    k = F.col("short") / F.least("w", "h")
    d = d.withColumn("rw", F.bround(F.col("w") * k).cast("int")).withColumn("rh", F.bround(F.col("h") * k).cast("int"))
    d = d.withColumn("left", F.floor(hash_uniform(seed + 1, *key) * (F.col("rw") - target + 1)).cast("int"))
    return d.withColumn("top", F.floor(hash_uniform(seed + 2, *key) * (F.col("rh") - target + 1)).cast("int"))


def apply_crop_plan(px: DataFrame, plan: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Cut the planned window out of every image; parts outside the frame read 0."""
    p = plan.select(*key, "left", "top", "side")
    moved = crop(px.join(p, key), F.col("left"), F.col("top"), F.col("side"), F.col("side")).select(*key, "x", "y", "v")
    grid = grid_of(p.select(*key, "side"), F.col("side"), F.col("side")).drop("side")
    return grid.join(moved.hint("merge"), [*key, "x", "y"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


# ---------------------------------------------------------------- neighbourhood filters

def _windowed(a: np.ndarray, weights: list[float]) -> np.ndarray:
    """Valid part of a separable filter: one array operation per tap and axis."""
    n = len(weights) - 1
    h = sum(w * a[:, k:a.shape[1] - n + k] for k, w in enumerate(weights))
    return sum(w * h[k:h.shape[0] - n + k] for k, w in enumerate(weights))


def box_mean(px: DataFrame, values: list[str] | None = None, r: int = 2, mode: str = "edge", key: list[str] = KEY, block: int = BLOCK) -> DataFrame:
    """(2r+1)² mean of each value column; borders ``edge``, ``reflect`` or ``zero``; a missing pixel or value counts as 0.

    One exchange: pixels go to blocks with their halo, borders are made inside the arrays.
    """
    values = values or ["v"]
    n = float((2 * r + 1) ** 2)

    def task(bx, by, offsets, x, y, *vs):
        parts = []
        for k, f, v in frames(bx, by, offsets, block, r, x, y, *vs):
            means = [_windowed(f.padded(f.fill(c), mode), [1.0] * (2 * r + 1))[f.at] / n for c in v]
            parts.append((k, f.x[f.own] + f.x0, f.y[f.own] + f.y0, *means))
        return joined(parts, 3 + len(values))

    known = px.select(*key, "x", "y", *[F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(v) for v in values])
    return map_blocks(gather(known, key, values, block, r), key, task, [("x", "int"), ("y", "int"), *((v, "double") for v in values)])


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    t = sum(w)
    return [v / t for v in w]


def _convolved(px: DataFrame, weights: list[float], mode: str, key: list[str], block: int) -> DataFrame:
    """``key, x, y, v, conv`` in one exchange."""
    w, r = [float(c) for c in weights], len(weights) // 2

    def task(bx, by, offsets, x, y, v):
        parts = []
        for k, f, (c,) in frames(bx, by, offsets, block, r, x, y, v):
            there = np.isfinite(c)
            g = _windowed(f.padded(f.fill(np.where(there, c, 0.0)), mode), w)
            if not there.all() or len(c) < f.shape[0] * f.shape[1]:  # missing pixels weigh nothing
                g = g / np.maximum(_windowed(f.padded(f.fill(there.astype(float)), mode), w), 1e-300)
            parts.append((k, f.x[f.own] + f.x0, f.y[f.own] + f.y0, c[f.own], g[f.at]))
        return joined(parts, 5)

    return map_blocks(gather(px, key, ["v"], block, r), key, task, [("x", "int"), ("y", "int"), ("v", "double"), ("conv", "double")])


def convolve_separable(px: DataFrame, weights: list[float], mode: str = "reflect", key: list[str] = KEY, block: int = BLOCK) -> DataFrame:
    """Separable convolution with an odd kernel: ``key, x, y, conv`` at the pixels there are.

    Spark lays the pixels out on halo blocks of at most (block + 2r)² pixels, whatever the image size. Missing
    pixels and values that are no numbers weigh nothing: the other weights are scaled up to the same sum.
    """
    return _convolved(px, weights, mode, key, block).drop("v")


def high_pass(px: DataFrame, sigma: float = 6.0, key: list[str] = KEY, block: int = BLOCK) -> DataFrame:
    """Subtract a Gaussian background, shift the minimum to 0 and divide by the maximum: ``key, x, y, v``."""
    d = cut(_convolved(px, gaussian_weights(sigma), "reflect", key, block).select(*key, "x", "y", (F.col("v") - F.col("conv")).alias("v")))
    d = _with(d, key, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    top = F.col("_hi") - F.col("_lo")
    v = F.col("v") - F.col("_lo")
    return d.withColumn("v", F.when(top > 1e-9, v / top).otherwise(v)).drop("_lo", "_hi")


def smooth_mask(px: DataFrame, rounds: int = 1, thresh: float = 0.5, key: list[str] = KEY, block: int = BLOCK) -> DataFrame:
    """Min-max, threshold (≥), then ``rounds`` times a zero-padded 3×3 mean with re-threshold; missing pixels count as 0.

    All rounds run inside one block, with a halo as wide as there are rounds.
    """
    d = min_max(px, key, eps=1e-300).select(*key, "x", "y", (F.col("v") >= thresh).cast("double").alias("v"))

    def task(bx, by, offsets, x, y, v):
        parts = []
        for k, f, (c,) in frames(bx, by, offsets, block, rounds, x, y, v):
            a, there = (f.padded(f.fill(s), "zero") for s in (c, np.ones(len(c))))
            for i in range(1, rounds + 1):
                a = (_windowed(a, [1.0] * 3) / 9.0 >= thresh) * there[i:there.shape[0] - i, i:there.shape[1] - i]
            parts.append((k, f.x[f.own] + f.x0, f.y[f.own] + f.y0, a[f.at].astype(np.int32)))
        return joined(parts, 4)

    return map_blocks(gather(d, key, ["v"], block, rounds), key, task, [("x", "int"), ("y", "int"), ("v", "int")])


# ---------------------------------------------------------------- tiles

def tile_count(length: Column, tile: int, stride: int) -> Column:
    return F.greatest(F.lit(1), F.floor(F.greatest(F.lit(0), length - tile) / stride) + 1).cast("int")


def tile_windows(size: DataFrame, tile: int = 128, sliding: bool = True, key: list[str] = KEY) -> DataFrame:
    """All tile origins of an image, in raster order: ``tr, tc, y0, x0, tile_rank``; stride is half a tile when sliding."""
    stride = max(1, tile // 2) if sliding else tile
    d = size.withColumn("nr", tile_count(F.col("h"), tile, stride)).withColumn("nc", tile_count(F.col("w"), tile, stride))
    d = d.withColumn("tr", F.explode(F.sequence(F.lit(0), F.col("nr") - 1))).withColumn("tc", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    y0 = F.least(F.col("tr") * stride, F.greatest(F.lit(0), F.col("h") - tile)).cast("int")
    x0 = F.least(F.col("tc") * stride, F.greatest(F.lit(0), F.col("w") - tile)).cast("int")
    return d.select(*key, "tr", "tc", y0.alias("y0"), x0.alias("x0"), (F.col("tr") * F.col("nc") + F.col("tc")).cast("int").alias("tile_rank"),
                    F.lit((tile - stride) / tile).alias("overlap"))


def cut_tiles(px: DataFrame, size: DataFrame, tile: int = 128, sliding: bool = True, key: list[str] = KEY) -> DataFrame:
    """Pixels per tile: joins on the stride cell, so each pixel meets only the tiles that cover it."""
    stride = max(1, tile // 2) if sliding else tile
    t = tile_windows(size, tile, sliding, key)
    span = F.sequence(F.floor(F.col("x0") / stride), F.floor((F.col("x0") + tile - 1) / stride))
    spay = F.sequence(F.floor(F.col("y0") / stride), F.floor((F.col("y0") + tile - 1) / stride))
    t = t.withColumn("gx", F.explode(span)).withColumn("gy", F.explode(spay))
    p = px.withColumn("gx", F.floor(F.col("x") / stride)).withColumn("gy", F.floor(F.col("y") / stride))
    j = p.hint("merge").join(t, [*key, "gx", "gy"])
    return j.filter((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x0") + tile) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y0") + tile)).drop("gx", "gy")


def stitch_first(tiles: DataFrame, key: list[str] = KEY) -> DataFrame:
    """One value per pixel: where tiles overlap the earlier tile in raster order stays."""
    return tiles.groupBy(*key, "x", "y").agg(F.min_by("v", "tile_rank").alias("v"))


def gaussian_importance(dx: Column, dy: Column, roi: int, sigma_scale: float = 0.125) -> Column:
    """Weight of a tile pixel: Gaussian about the tile centre, sigma = sigma_scale · roi."""
    c, s = (roi - 1) / 2.0, sigma_scale * roi
    return F.exp(-((dx - c) * (dx - c) + (dy - c) * (dy - c)) / (2.0 * s * s))


def blend_tiles(tiles: DataFrame, roi: int, values: list[str], key: list[str] = KEY, floor: float = 1e-3) -> DataFrame:
    """Importance-weighted mean of overlapping tiles for every value column."""
    w = F.greatest(gaussian_importance(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"), roi), F.lit(floor))
    d = tiles.withColumn("_w", w)
    return d.groupBy(*key, "x", "y").agg(*[(F.sum(F.col("_w") * F.col(v)) / F.sum("_w")).alias(v) for v in values])


# ---------------------------------------------------------------- resampling

def _border(c: Column, n: Column, mode: str) -> Column:
    if mode == "edge":
        return clip(c, F.lit(0), n - 1)
    if mode == "reflect101":
        period = F.greatest(F.lit(1), 2 * (n - 1))
        m = F.pmod(c, period)
        return F.least(m, period - m)
    return c  # constant: taps outside find no pixel and add nothing


#: Side of the blocks of source pixels that places are read from.
READ = 8


def _read_blocks(px: DataFrame, key: list[str], outside: bool) -> DataFrame:
    """``key, bx, by, cells``: the pixels of each block and of the column and row after it, as a map from y · (READ + 1) + x.

    With ``outside`` also for the blocks before the frame, whose last places lie next to its first pixels. Repeated pixels add up.
    """
    def reach(a: str) -> Column:
        own = F.floor(F.col(a) / READ)
        edge = F.pmod(F.col(a), F.lit(READ)) == 0
        return F.explode(F.sequence(F.when(edge if outside else edge & (F.col(a) > 0), own - 1).otherwise(own), own))

    d = px.select(*key, "x", "y", F.coalesce(F.col("v").cast("double"), F.lit(0.0)).alias("v"), reach("x").alias("bx")).select("*", reach("y").alias("by"))
    at = ((F.col("y") - F.col("by") * READ) * (READ + 1) + F.col("x") - F.col("bx") * READ).cast("int")
    # dealt first: no task collects what it reads, only whole blocks
    d = d.select(*key, "bx", "by", F.struct(at.alias("i"), "v").alias("c")).repartition(*key, "bx", "by")
    d = d.groupBy(*key, "bx", "by").agg(F.collect_list("c").alias("c"))
    places = F.array_distinct("c.i")
    total = F.transform(places, lambda i: F.aggregate(F.filter("c", lambda c: c["i"] == i), F.lit(0.0), lambda s, c: s + c["v"]))
    found = F.map_from_arrays(places, F.when(F.size(places) == F.size("c"), F.col("c.v")).otherwise(total))
    return d.select(*key, "bx", "by", found.alias("cells"))


def sample_at(targets: DataFrame, px: DataFrame, method: str = "bilinear", border: str = "edge", key: list[str] = KEY) -> DataFrame:
    """Read ``px`` at fractional source coordinates: targets ``key, x, y, sx, sy, w, h`` -> ``key, x, y, v``.

    A place and its taps are one row, which meets the block of source pixels that holds all of them: adjoining
    taps stay adjoining at a border. Taps without a pixel weigh nothing; a place without any is left out, or 0 with a constant border.
    """
    taps = {}
    for a, n in (("x", "w"), ("y", "h")):
        s = F.col(f"s{a}")
        lo = F.floor(s + 0.5) if method == "nearest" else F.floor(s)
        taps |= {f"_{a}0": _border(lo, F.col(n), border), f"_{a}1": _border(lo if method == "nearest" else lo + 1, F.col(n), border), f"_f{a}": F.lit(0.0) if method == "nearest" else s - lo}
    # a generator is not merged with what reads it, so a place is computed once and not in every expression
    place = F.struct(*[c.cast("double" if n.startswith("_f") else "bigint").alias(n) for n, c in taps.items()])
    t = targets.select(*key, "x", "y", "w", "h", "sx", "sy").select(*key, "x", "y", F.inline(F.array(place)))
    t = t.filter(" and ".join(f"{n} is not null" for n in taps))
    t = t.withColumns({f"b{a}": F.floor(F.least(f"_{a}0", f"_{a}1") / READ) for a in "xy"})
    t = t.select(*key, "x", "y", "bx", "by", *[(F.col(f"_{a}{i}") - F.col(f"b{a}") * READ).cast("int").alias(f"_{a}{i}") for a in "xy" for i in (0, 1)], "_fx", "_fy")
    # pixels are laid out from rows that are small as files: never a broadcast by file size
    d = t.join(_read_blocks(px, key, border == "constant").hint("merge"), [*key, "bx", "by"], "left" if border == "constant" else "inner")
    total, some = F.lit(0.0), F.lit(border == "constant")
    for i, j in ((0, 0),) if method == "nearest" else ((0, 0), (0, 1), (1, 0), (1, 1)):
        wt = (F.col("_fx") if i else 1.0 - F.col("_fx")) * (F.col("_fy") if j else 1.0 - F.col("_fy"))
        tap = F.when(wt > 0, F.try_element_at("cells", F.col(f"_y{j}") * (READ + 1) + F.col(f"_x{i}")))
        total, some = total + F.coalesce(wt * tap, F.lit(0.0)), some | tap.isNotNull()
    return d.filter(some).select(*key, "x", "y", total.alias("v"))


def resize(px: DataFrame, width: Column | int, height: Column | int, method: str = "bilinear", key: list[str] = KEY, size: DataFrame | None = None) -> DataFrame:
    """Resize to width × height (constants or columns of ``size``): nearest, bilinear (half-pixel centres) or bicubic."""
    size = size if size is not None else image_size(px, key)
    width = width if isinstance(width, Column) else F.lit(width)
    height = height if isinstance(height, Column) else F.lit(height)
    if method == "bicubic":
        return _bicubic(px, size.withColumn("_tw", width).withColumn("_th", height), key)
    s = size.withColumn("_tw", width).withColumn("_th", height)
    g = grid_of(s, F.col("_tw"), F.col("_th"))
    kx, ky = F.col("w") / F.col("_tw"), F.col("h") / F.col("_th")
    if method == "nearest":
        g = g.withColumn("sx", F.floor(F.col("x") * kx).cast("double")).withColumn("sy", F.floor(F.col("y") * ky).cast("double"))
    else:
        g = g.withColumn("sx", clip((F.col("x") + 0.5) * kx - 0.5, 0.0, F.col("w") - 1.0))
        g = g.withColumn("sy", clip((F.col("y") + 0.5) * ky - 0.5, 0.0, F.col("h") - 1.0))
    return sample_at(g, px, method, "edge", key)


def _cubic(t: Column, a: float = -0.5) -> Column:
    t = F.abs(t)
    return (
        F.when(t < 1, ((a + 2.0) * t - (a + 3.0)) * t * t + 1.0)
        .when(t < 2, (((t - 5.0) * t + 8.0) * t - 4.0) * a).otherwise(0.0)
    )


def _bicubic(px: DataFrame, size: DataFrame, key: list[str]) -> DataFrame:
    """Cubic resampling one axis at a time; the kernel widens when shrinking."""
    d = px
    for a, other, n, t in (("x", "y", "w", "_tw"), ("y", "x", "h", "_th")):
        k = F.col(n) / F.col(t)
        fs = F.greatest(F.lit(1.0), k)
        c = (F.col("_o") + 0.5) * k
        lo = F.greatest(F.lit(0), F.floor(c - 2.0 * fs + 0.5)).cast("int")
        hi = F.least(F.col(n), F.floor(c + 2.0 * fs + 0.5)).cast("int") - 1
        taps = size.withColumn("_o", F.explode(F.sequence(F.lit(0), (F.col(t) - 1).cast("int"))))
        taps = taps.withColumn(a, F.explode(F.sequence(lo, hi))).withColumn("_k", _cubic((F.col(a) - c + 0.5) / fs)).select(*key, "_o", a, "_k")
        d = d.join(taps.hint("merge"), [*key, a]).groupBy(*key, "_o", other).agg((F.sum(F.col("_k") * F.col("v")) / F.sum("_k")).alias("v")).withColumnRenamed("_o", a)
    return d


def box_halve(px: DataFrame, key: list[str] = KEY) -> DataFrame:
    """2× reduction by the mean of 2×2 boxes."""
    hx, hy = F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")
    return px.groupBy(*key, hx, hy).agg(F.avg("v").alias("v"))


def repeat_upsample(px: DataFrame, k: int) -> DataFrame:
    """Every pixel becomes a k × k block."""
    off = F.sequence(F.lit(0), F.lit(k - 1))
    d = px.withColumn("_i", F.explode(off)).withColumn("_j", F.explode(off))
    return d.withColumn("x", F.col("x") * k + F.col("_i")).withColumn("y", F.col("y") * k + F.col("_j")).drop("_i", "_j")


# ---------------------------------------------------------------- geometry

def flip(px: DataFrame, size: DataFrame, horizontal: Column, vertical: Column, key: list[str] = KEY) -> DataFrame:
    d = px.hint("merge").join(size, key)
    return (
        d.withColumn("x", F.when(horizontal, F.col("w") - 1 - F.col("x")).otherwise(F.col("x")).cast("int"))
        .withColumn("y", F.when(vertical, F.col("h") - 1 - F.col("y")).otherwise(F.col("y")).cast("int")).drop("w", "h")
    )


def rot90(px: DataFrame, size: DataFrame, turns: Column, key: list[str] = KEY) -> DataFrame:
    """Counter-clockwise quarter turns (0..3)."""
    d = px.join(size, key).withColumn("_t", F.pmod(turns, F.lit(4)))
    x, y, w, h = F.col("x"), F.col("y"), F.col("w"), F.col("h")
    nx = F.when(F.col("_t") == 1, y).when(F.col("_t") == 2, w - 1 - x).when(F.col("_t") == 3, h - 1 - y).otherwise(x)
    ny = F.when(F.col("_t") == 1, w - 1 - x).when(F.col("_t") == 2, h - 1 - y).when(F.col("_t") == 3, x).otherwise(y)
    return d.withColumn("_nx", nx.cast("int")).withColumn("_ny", ny.cast("int")).drop("x", "y", "w", "h", "_t").withColumnsRenamed({"_nx": "x", "_ny": "y"})


def rotate(px: DataFrame, plan: DataFrame, method: str = "bilinear", border: str = "reflect101", integer_center: bool = False, key: list[str] = KEY) -> DataFrame:
    """Rotate counter-clockwise by ``plan.angle`` degrees about the frame centre; plan has w, h."""
    g = grid_of(plan, F.col("w"), F.col("h"))
    cx = F.floor(F.col("w") / 2) if integer_center else F.col("w") / 2.0
    cy = F.floor(F.col("h") / 2) if integer_center else F.col("h") / 2.0
    a = F.radians("angle")
    dx, dy = F.col("x") - cx, F.col("y") - cy
    g = g.withColumn("sx", F.cos(a) * dx - F.sin(a) * dy + cx).withColumn("sy", F.sin(a) * dx + F.cos(a) * dy + cy)
    return sample_at(g, px, method, border, key)


def square_to_quad(q: list[tuple[Column, Column]]) -> list[Column]:
    """Homography of the unit square onto a quadrilateral (corner order 00, 10, 11, 01); Heckbert 1989."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = q
    sx, sy = x0 - x1 + x2 - x3, y0 - y1 + y2 - y3
    dx1, dx2, dy1, dy2 = x1 - x2, x3 - x2, y1 - y2, y3 - y2
    den = dx1 * dy2 - dx2 * dy1
    g, h = (sx * dy2 - dx2 * sy) / den, (dx1 * sy - sx * dy1) / den
    return [x1 - x0 + g * x1, x3 - x0 + h * x3, x0, y1 - y0 + g * y1, y3 - y0 + h * y3, y0, g, h, F.lit(1.0)]


def adjugate(m: list[Column]) -> list[Column]:
    a, b, c, d, e, f, g, h, i = m
    return [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]


def perspective(px: DataFrame, plan: DataFrame, method: str = "bilinear", border: str = "reflect101", key: list[str] = KEY) -> DataFrame:
    """Warp the frame so its corners move to ``plan.q`` = array of four (x, y) structs (order TL, TR, BR, BL)."""
    w1, h1 = F.col("w") - 1.0, F.col("h") - 1.0
    quad = [(F.col("q")[i]["x"], F.col("q")[i]["y"]) for i in range(4)]
    inv = adjugate(square_to_quad(quad))
    p = plan.withColumn("_m", F.array(*inv))
    g = grid_of(p, F.col("w"), F.col("h"))
    m = [F.col("_m")[i] for i in range(9)]
    x, y = F.col("x"), F.col("y")
    den = m[6] * x + m[7] * y + m[8]
    g = g.withColumn("sx", (m[0] * x + m[1] * y + m[2]) / den * w1).withColumn("sy", (m[3] * x + m[4] * y + m[5]) / den * h1)
    return sample_at(g, px, method, border, key)


def scan_jitter(px: DataFrame, plan: DataFrame, seed: int, key: list[str] = KEY) -> DataFrame:
    """Scan-line jitter: per row two normal offsets modulated by the mains phase, bilinear, mirrored border.

    ``plan``: w, h, sigma_px, row_time, freq, phase_x, phase_y per image.
    """
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = plan.repartition(parts).withColumn("y", F.explode(F.sequence(F.lit(0), (F.col("h") - 1).cast("int"))))
    t = 2.0 * math.pi * F.col("freq") * F.col("y") * F.col("row_time")
    rows = rows.withColumn("ox", hash_normal(seed, *key, "y") * F.col("sigma_px") * F.sin(t + F.col("phase_x")))
    rows = rows.withColumn("oy", hash_normal(seed + 1, *key, "y") * F.col("sigma_px") * F.sin(t + F.col("phase_y")))
    g = rows.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("w") - 1).cast("int"))))
    g = g.withColumn("sx", F.col("x") - F.col("oy")).withColumn("sy", F.col("y") - F.col("ox"))
    return sample_at(g, px, "bilinear", "reflect101", key)


# ---------------------------------------------------------------- noise and masks

def gaussian_noise(px: DataFrame, sigma: Column | float, seed: int, key: list[str] = KEY) -> DataFrame:
    """Normal noise scaled by the image range and clipped to it."""
    d = _with(px, key, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    return d.withColumn("v", clip(F.col("v") + hash_normal(seed, *key, "x", "y") * sigma * span, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def poisson_noise(px: DataFrame, dose: Column, seed: int, key: list[str] = KEY) -> DataFrame:
    """Shot noise: counts ~ Poisson(rel·dose) of the range-scaled value, scaled back.

    Only the draw is Python, by the inverse distribution function of uniforms from a hash of the row, so
    it does not depend on partitions or batches. A large rate is drawn as a sum of parts of at most 500.
    """
    @F.pandas_udf("double")
    def draw(lam: pd.Series, s: pd.Series) -> pd.Series:
        left, seeds = lam.fillna(0.0).clip(lower=0).to_numpy(copy=True), s.to_numpy().astype(np.uint64)
        out = np.zeros(len(left))
        part = 0
        while len(live := np.flatnonzero(left > 0)):
            rate = np.minimum(left[live], 500.0)
            left[live] -= rate
            part += 1
            h = seeds[live] + np.uint64(part * 0x9E3779B97F4A7C15 % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            u = ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) * 2.0 ** -53
            p = np.exp(-rate)
            upto, k = p.copy(), 0
            above = np.flatnonzero(u > upto)
            while len(above):
                k += 1
                p[above] *= rate[above] / k
                before = upto[above]
                upto[above] = before + p[above]
                out[live[above]] += 1
                # rounding may leave the last sum just below 1
                above = above[(u[above] > upto[above]) & ((upto[above] > before) | (k < rate[above]))]
        return pd.Series(out).where(lam.notna().to_numpy())

    d = _with(px, key, F.min("v").alias("_lo"), F.max("v").alias("_hi"))
    span = F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo")).otherwise(1.0)
    n = F.greatest(dose, F.lit(1e-12))
    rel = (F.col("v") - F.col("_lo")) / span
    counts = draw(rel * n, F.xxhash64(F.lit(seed), *key, "x", "y"))
    return d.withColumn("v", counts / n * span + F.col("_lo")).drop("_lo", "_hi")


def electron_dose(current_a: Column, dwell_s: Column, k: Column) -> Column:
    """Electrons per output pixel: dwell·current/e·k²."""
    return dwell_s * current_a / 1.602176634e-19 * k * k


def edge_curve(t: Column, length: Column, p: list[Column]) -> Column:
    """Cubic through (0.1, p0) … (0.9, p3) of ``length``: Lagrange form."""
    nodes = [0.1 + i * (0.8 / 3.0) for i in range(4)]
    u = t / length
    out = F.lit(0.0)
    for i in range(4):
        term = p[i]
        for j in range(4):
            if j != i:
                term = term * (u - nodes[j]) / (nodes[i] - nodes[j])
        out = out + term
    return out


def edge_mask(px: DataFrame, size: DataFrame, prob: Column | float, bg_min: Column | float, bg_max: Column | float, seed: int, key: list[str] = KEY) -> DataFrame:
    """Irregular dark edge: each side with ``prob``, bounded by a cubic through four random depths of 15..30 %."""
    plan = size
    for s, side in enumerate(("l", "r", "t", "b")):
        plan = plan.withColumn(f"on_{side}", hash_uniform(seed + 10 * s, *key) < prob)
        depth = F.array(*[hash_uniform(seed + 10 * s + 1 + i, *key) * 0.15 + 0.15 for i in range(4)])
        plan = plan.withColumn(f"p_{side}", depth)
    d = px.hint("merge").join(plan, key)
    x, y, w, h = F.col("x"), F.col("y"), F.col("w"), F.col("h")

    def curve(side: str, t: Column, along: Column, across: Column) -> Column:
        return edge_curve(t, along, [F.col(f"p_{side}")[i] * across for i in range(4)])

    hit = (
        (F.col("on_l") & (x < curve("l", y, h, w))) | (F.col("on_r") & (x > w - curve("r", y, h, w)))
        | (F.col("on_t") & (y < curve("t", x, w, h))) | (F.col("on_b") & (y > h - curve("b", x, w, h)))
    )
    return d.select(*key, "x", "y", F.when(hit, hash_uniform(seed + 99, *key, "x", "y") * (bg_max - bg_min) + bg_min).otherwise(F.col("v")).alias("v"))
