"""Augmentation draws and the two augmentation pipelines, as chained pixel-table jobs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import hash_uniform
from ..iterate import cut, global_order
from . import pixels as P
from .distance import distance_map

# Default ranges of the augmentation parameters; a pair is drawn uniformly, a number is taken as is.
DEFAULTS = {
    "elastic": {"alpha_ratio": [0.0, 0.2], "sigma_ratio": 0.05},
    "perspective": {"max_ratio": [0.0, 0.015]},
    "carbon": {"prob": 0.01, "cover": [0.3, 0.7], "alpha": [0.3, 0.5], "sigma_mask": 100.0, "sigma_field": 100.0, "coarse_down": 100.0, "focus_center_x": [0.1, 0.9], "focus_center_y": [0.1, 0.9],
               "focus_radius_ratio": [0.3, 0.7], "focus_gain": 5.0, "morph_kernel": 11.0, "morph_iter": 1.0},
    "rotate": {"range": [0.0, 360.0]},
    "crop": {"side": [372.0, 744.0], "safe_radius": 372.0},
    "flip": {"h_prob": 0.5, "v_prob": 0.5},
    "noise": {"pixel_size_A_orig": 0.12, "beam_current_A": 30e-12, "dwell_time_s": [1e-6, 3e-6], "width_orig_px": 3289.0, "sigma_jitter_A": [0.0, 0.2], "line_freq_hz": 60.0,
              "phase_x": 0.0, "phase_y": math.pi / 2, "gaussian_sigma": [0.0, 0.1]},
    "display": {"gain": [0.6, 1.1], "bias": [-0.1, 0.1], "gamma": [0.9, 1.2]},
    "edge_mask": {"prob": 0.0005, "bg_min": 0.0, "bg_max": 0.05},
}
OFF = {"display": {"gain": 1.0, "bias": 0.0, "gamma": 1.0}}


def draw_table(images: DataFrame, keys: list[str], n: int, seed: int, config: dict | None = None, disable: tuple[str, ...] = ()) -> DataFrame:
    """n concrete parameter sets per image: ``keys, draw`` and one column per parameter.

    Draws come from a hash of image, draw and parameter, so a lost task draws the same values again. A disabled
    group keeps its values and has ``<group>_enabled`` false; only the display values are then neutral.
    """
    return draw_parameters(images.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), keys, seed, config, disable)


def draw_parameters(draws: DataFrame, keys: list[str], seed: int, config: dict | None = None, disable: tuple[str, ...] = ()) -> DataFrame:
    """The parameters of :func:`draw_table` for rows that already have a ``draw`` number, as those of a stream."""
    config = config or {}
    off = set(DEFAULTS) if "all" in disable else {d.strip().lower() for d in disable}
    cols: dict[str, Column] = {}
    k = 0
    for group, params in DEFAULTS.items():
        cols[f"{group}_enabled"] = F.lit(group not in off)
        for name, default in params.items():
            k += 1
            value = {**params, **config.get(group, {})}[name]
            if group in off:
                value = OFF.get(group, {}).get(name, value)
            u = hash_uniform(seed + k, *keys, "draw")
            cols[f"{group}_{name}"] = F.lit(float(value[0])) + u * float(value[1] - value[0]) if isinstance(value, (list, tuple)) else F.lit(float(value))
    side = F.bround(cols["crop_side"]).cast("int")
    cols["crop_side"] = F.greatest(F.lit(2), side + F.pmod(side, F.lit(2)))
    cols["carbon_enabled"] = cols["carbon_enabled"] & (hash_uniform(seed + 1001, *keys, "draw") < cols["carbon_prob"])
    return draws.select("*", *[c.alias(nm) for nm, c in cols.items()])


def sample_pairs(images: DataFrame, order: list[str], n: int, seed: int) -> DataFrame:
    """n source images drawn with replacement: ``draw`` and the image row."""
    ord_ = cut(global_order(images, order, "ordinal"))
    total = ord_.agg(F.count("*").alias("total"))  # one row
    d = images.sparkSession.range(n).withColumnRenamed("id", "draw").crossJoin(F.broadcast(total))
    d = d.withColumn("ordinal", F.floor(hash_uniform(seed, "draw") * F.col("total")).cast("bigint")).drop("total")
    return d.join(ord_, "ordinal").drop("ordinal")


def safe_centers(mask: DataFrame, draws: DataFrame, key: list[str], seed: int, draw: str = "draw") -> DataFrame:
    """Crop centre per draw: mask pixels at least half a side from the border and farther than safe_radius from the mask's zeros.

    Without one, the radius falls back to half the side. ``mask``: key, x, y, v (> 0.5 is safe ground);
    ``draws``: key, draw, side, safe_radius. Distances are exact and made once per mask. A draw without any
    centre has null ``cx`` and ``cy`` and the ``reason`` no_safe_center.
    """
    return centers_by_distance(distance_map(mask, key), draws, key, seed, draw)


def centers_by_distance(distances: DataFrame, draws: DataFrame, key: list[str], seed: int, draw: str = "draw") -> DataFrame:
    """`safe_centers` from a distance map ``key, x, y, d``: a uniform pick by hash among the pixels allowed."""
    d = cut(distances)
    j = d.hint("merge").join(P.image_size(d, key), key).hint("merge").join(draws.select(*key, draw, "side", "safe_radius"), key)
    half = F.floor(F.col("side") / 2)
    j = j.filter((F.col("x") >= half) & (F.col("x") < F.col("w") - half) & (F.col("y") >= half) & (F.col("y") < F.col("h") - half))
    strict = F.col("d") > F.col("safe_radius")
    j = j.filter(strict | (F.col("d") > F.col("side") / 2.0))
    # strict candidates first; the hash is one that other engines have too
    o = F.struct((~strict).alias("s"), F.md5(F.concat_ws("/", F.lit(seed), *key, draw, "x", "y")).alias("h"))
    picked = j.groupBy(*key, draw).agg(F.min_by(F.struct("x", "y"), o).alias("c"))
    found = draws.select(*key, draw).join(picked, [*key, draw], "left")
    return found.select(*key, draw, F.col("c.x").alias("cx"), F.col("c.y").alias("cy"), F.when(F.col("c").isNull(), "no_safe_center").alias("reason"))


def corner_jitter(seed: int, ident: list[str], ratio: Column, w: Column, h: Column) -> Column:
    """Frame corners moved by up to ratio·size: array of four (x, y)."""
    base = [(F.lit(0.0), F.lit(0.0)), (w - 1.0, F.lit(0.0)), (w - 1.0, h - 1.0), (F.lit(0.0), h - 1.0)]
    u = lambda k: 2.0 * hash_uniform(seed + k, *ident) - 1.0
    return F.array(*[F.struct((x + u(2 * i) * ratio * w).alias("x"), (y + u(2 * i + 1) * ratio * h).alias("y")) for i, (x, y) in enumerate(base)])


def stem_pipeline(images: DataFrame, masks: DataFrame, draws: DataFrame, key: list[str], out_size: int = 128, seed: int = 0) -> DataFrame:
    """Perspective → rotate → safe crop → resize → flip → edge mask → scan, Poisson, Gaussian noise → display → −1..1.

    ``images`` and ``masks``: key, x, y, v in 0..1; ``draws``: table of :func:`draw_table`. A step whose
    ``_enabled`` column is false is skipped; without the crop the whole frame is resized. Output ``key, draw,
    x, y, v, reason``: a draw without a safe centre is one row without pixel and with the reason. Elastic
    warp and carbon film are not applied. Pixels meet tables of draws by merge, never by a broadcast by file size.
    """
    k2 = [*key, "draw"]
    d = cut(draws.join(P.image_size(images, key), key))
    on = lambda group, value, other: F.when(F.col(f"{group}_enabled"), F.col(value)).otherwise(F.lit(other))
    px = images.hint("merge").join(d.select(*k2), key).select(*k2, "x", "y", "v")
    # distances are made once per mask; every draw turns them with its image
    far = cut(distance_map(masks.join(d.filter("crop_enabled").select(*key).distinct(), key, "left_semi"), key))
    mk = far.hint("merge").join(d.filter("crop_enabled").select(*k2), key).select(*k2, "x", "y", F.col("d").alias("v"))
    warp = d.select(*k2, "w", "h", corner_jitter(seed, k2, on("perspective", "perspective_max_ratio", 0.0), F.col("w"), F.col("h")).alias("q"))
    px = P.perspective(px, warp, "bilinear", "reflect101", k2)
    turn = d.select(*k2, "w", "h", on("rotate", "rotate_range", 0.0).alias("angle"))
    px = cut(P.rotate(px, turn, "bilinear", "reflect101", key=k2))
    mk = P.rotate(mk, turn.join(d.filter("crop_enabled").select(*k2), k2), "nearest", "reflect101", key=k2)
    want = d.filter("crop_enabled").select(*k2, F.col("crop_side").alias("side"), F.col("crop_safe_radius").alias("safe_radius"))
    # image and draw together are the key here: every draw has its own turned distances
    c = cut(centers_by_distance(mk.withColumnRenamed("v", "d"), want.withColumn("_d", F.lit(0)), k2, seed, "_d").drop("_d"))
    lost = c.filter("reason is not null").select(*k2, "reason")
    half = F.floor(F.col("side") / 2)
    win = want.join(c.filter("reason is null"), k2).select(*k2, F.col("side").alias("cw"), F.col("side").alias("ch"), (F.col("cx") - half).cast("int").alias("left"), (F.col("cy") - half).cast("int").alias("top"))
    whole = d.filter("not crop_enabled").select(*k2, F.col("w").alias("cw"), F.col("h").alias("ch"), F.lit(0).alias("left"), F.lit(0).alias("top"))
    win = win.unionByName(whole)
    px = P.crop(px.hint("merge").join(win, k2), F.col("left"), F.col("top"), F.col("cw"), F.col("ch")).select(*k2, "x", "y", "v")
    box = win.select(*k2, F.col("cw").alias("w"), F.col("ch").alias("h"))
    px = P.resize(px, out_size, out_size, "bilinear", k2, box)
    frame = win.select(*k2, F.lit(out_size).alias("w"), F.lit(out_size).alias("h"))
    fl = d.select(*k2, (hash_uniform(seed + 31, *k2) < on("flip", "flip_h_prob", 0.0)).alias("fh"), (hash_uniform(seed + 32, *k2) < on("flip", "flip_v_prob", 0.0)).alias("fv"))
    px = P.flip(px.hint("merge").join(fl, k2), frame, F.col("fh"), F.col("fv"), k2).select(*k2, "x", "y", "v")
    em = frame.join(d.select(*k2, on("edge_mask", "edge_mask_prob", 0.0).alias("edge_prob"), "edge_mask_bg_min", "edge_mask_bg_max"), k2)
    px = cut(P.edge_mask(px, em, F.col("edge_prob"), F.col("edge_mask_bg_min"), F.col("edge_mask_bg_max"), seed + 40, k2))
    n = win.join(d.drop("w", "h"), k2).withColumns({"w": F.lit(out_size), "h": F.lit(out_size), "k": 2.0 * F.least("cw", "ch") / float(out_size)})
    n = n.withColumns({"sigma_px": F.col("noise_sigma_jitter_A") / (F.col("noise_pixel_size_A_orig") * F.col("k")), "row_time": F.col("noise_dwell_time_s") * F.col("noise_width_orig_px"),
                       "freq": F.col("noise_line_freq_hz"), "phase_x": F.col("noise_phase_x"), "phase_y": F.col("noise_phase_y")})
    noisy = n.filter("noise_enabled")
    loud = cut(P.scan_jitter(px.hint("merge").join(noisy.select(*k2), k2), noisy.select(*k2, "w", "h", "sigma_px", "row_time", "freq", "phase_x", "phase_y"), seed + 50, k2))
    par = noisy.select(*k2, P.electron_dose(F.col("noise_beam_current_A"), F.col("noise_dwell_time_s"), F.col("k")).alias("dose"), "noise_gaussian_sigma")
    loud = cut(P.poisson_noise(loud.hint("merge").join(par, k2), F.col("dose"), seed + 60, k2))
    loud = P.gaussian_noise(loud, F.col("noise_gaussian_sigma"), seed + 70, k2).select(*k2, "x", "y", "v")
    quiet = px.hint("merge").join(n.filter("not noise_enabled").select(*k2), k2).select(*k2, "x", "y", "v")
    px = loud.unionByName(quiet).hint("merge").join(d.select(*k2, "display_enabled", "display_gain", "display_bias", "display_gamma"), k2)
    shown = P.display_adjust(F.col("v"), F.col("display_gain"), F.col("display_bias"), F.col("display_gamma"))
    v = F.when(F.col("display_enabled"), shown).otherwise(F.col("v"))
    px = px.select(*k2, "x", "y", P.unit_to_signed(P.clip(v, 0.0, 1.0)).alias("v"), F.lit(None).cast("string").alias("reason"))
    return px.unionByName(lost, allowMissingColumns=True)


def segmentation_pipeline(images: DataFrame, masks: DataFrame, key: list[str], dim: int, seed: int, train: bool = True, pre: int = 750, side: tuple[int, int] = (450, 599), val: int = 550) -> DataFrame:
    """Image and mask moved together: ``key, x, y, v, m``; the mask is read with nearest taps.

    Training: rotate ±15° (p .5), centre crop, random square crop, resize, flips, quarter turns (p .5).
    Validation: centre crop, resize.
    """
    if not train:
        a = P.resize(P.pad_center_crop(images, val, val, key), dim, dim, "bilinear", key)
        b = P.resize(P.pad_center_crop(masks, val, val, key), dim, dim, "nearest", key)
        return a.join(b.withColumnRenamed("v", "m"), [*key, "x", "y"])
    u = lambda k: hash_uniform(seed + k, *key)
    plan = cut(P.image_size(images, key).withColumn("angle", F.when(u(1) <= 0.5, u(2) * 30.0 - 15.0).otherwise(0.0)))
    frame = plan.select(*key, F.lit(pre).alias("w"), F.lit(pre).alias("h"))
    win = cut(P.random_crop_plan(frame, side[0], side[1], seed + 3, key))
    box = win.select(*key, F.col("side").alias("w"), F.col("side").alias("h"))
    small = plan.select(*key, F.lit(dim).alias("w"), F.lit(dim).alias("h"))
    turns = plan.select(*key, (u(7) < 0.5).alias("fh"), (u(8) < 0.5).alias("fv"), F.when(u(9) <= 0.5, F.floor(u(10) * 3).cast("int") + 1).otherwise(0).alias("t"))

    def move(px: DataFrame, method: str) -> DataFrame:
        d = P.rotate(px, plan, method, "constant", integer_center=True, key=key)
        d = P.apply_crop_plan(P.pad_center_crop(d, pre, pre, key), win, key)
        d = P.resize(d, dim, dim, method, key, box)
        d = P.flip(d.join(turns, key), small, F.col("fh"), F.col("fv"), key)
        return P.rot90(d, small, F.col("t"), key).select(*key, "x", "y", "v")

    return move(images, "bilinear").join(move(masks, "nearest").withColumnRenamed("v", "m"), [*key, "x", "y"])
