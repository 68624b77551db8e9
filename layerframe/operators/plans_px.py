"""Crop and tile plans: one row per image in, plan columns out."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import half_even


def align_axes(w_nm: Column, h_nm: Column, w_px: Column, h_px: Column) -> tuple[Column, Column, Column]:
    """Physical (height, width) in pixel orientation and whether they were swapped: only when the inverse ratio is strictly nearer."""
    ok = (w_px > 0) & (h_px > 0) & (w_nm > 0) & (h_nm > 0)
    rp, rn = w_px / h_px, F.try_divide(w_nm, h_nm)
    swap = F.coalesce(ok & (F.abs(rp - rn) > F.abs(rp - F.try_divide(F.lit(1.0), rn))), F.lit(False))
    return F.when(swap, w_nm).otherwise(h_nm), F.when(swap, h_nm).otherwise(w_nm), swap


def _best_cells(lo: float, hi: float, tol: float):
    """Arrow function (height, width) -> best grid: the candidates of all images of a batch are tried one (row, col) at a time."""
    @F.pandas_udf("row int, col int, unit_nm double, crop_height_nm double, crop_width_nm double, loss_nm2 double, adjusted boolean")
    def best(height: pd.Series, width: pd.Series) -> pd.DataFrame:
        h, w = height.to_numpy(float), width.to_numpy(float)
        rows, cols = (np.maximum(1, np.floor(np.nan_to_num(v) / lo)).astype(np.int64) for v in (h, w))
        # outside, loss, distance of the unit from the middle, |row - col|, row, col: in the order of preference
        rank = [np.full(len(h), np.inf) for _ in range(6)]
        out = [np.zeros(len(h)) for _ in range(5)]
        for r in range(1, int(rows.max(initial=0)) + 1):
            for c in range(1, int(cols[rows >= r].max(initial=0)) + 1):
                at = np.flatnonzero((rows >= r) & (cols >= c))
                feasible = np.fmin(h[at] / r, w[at] / c)
                unit = np.fmin(feasible, hi)
                ch, cw = r * unit, c * unit
                outside = ~((unit >= lo - tol) & (unit <= hi + tol))
                new = [outside.astype(float), np.maximum(0.0, h[at] * w[at] - ch * cw), np.abs(unit - (lo + hi) * 0.5), *(np.full(len(at), float(v)) for v in (abs(r - c), r, c))]
                less, same = np.zeros(len(at), bool), np.ones(len(at), bool)
                for n, o in zip(new, rank, strict=True):
                    less |= same & (n < o[at])
                    same &= n == o[at]
                for old, v in ((rank, new), (out, [unit, ch, cw, new[1], outside | (feasible > hi + tol)])):
                    for o, n in zip(old, v, strict=True):
                        o[at[less]] = n[less]
        return pd.DataFrame({"row": rank[4].astype(np.int32), "col": rank[5].astype(np.int32), "unit_nm": out[0], "crop_height_nm": out[1], "crop_width_nm": out[2], "loss_nm2": out[3], "adjusted": out[4] > 0})

    return best


def optimal_grid(images: DataFrame, keys: list[str], unit_min: float, unit_max: float, tol: float = 1e-3) -> DataFrame:
    """Best tile grid per image (height_nm, width_nm): least lost area, then unit nearest the middle, then squarest.

    Units within the range come first; otherwise the best fallback is marked ``adjusted``. The candidates of
    an image are compared inside its batch; no row is made of them, and only images are shuffled, to be told apart.
    """
    lo, hi = float(min(unit_min, unit_max)), float(max(unit_min, unit_max))
    d = images.filter((F.col("height_nm") > 0) & (F.col("width_nm") > 0) & F.lit(hi > 0)).select(*keys, "height_nm", "width_nm").distinct()
    return d.withColumn("g", _best_cells(lo, hi, tol)("height_nm", "width_nm")).select(*keys, "height_nm", "width_nm", "g.*")


def crop_plan(grid: DataFrame, tile: int = 128) -> DataFrame:
    """Centred crop box and target size for a grid solution; needs w_px, h_px."""
    cw = half_even(F.col("crop_width_nm") * (F.col("w_px") / F.col("width_nm")))
    ch = half_even(F.col("crop_height_nm") * (F.col("h_px") / F.col("height_nm")))
    d = grid.withColumn("_cw", F.greatest(F.lit(1), F.least(F.col("w_px"), cw)).cast("int")).withColumn("_ch", F.greatest(F.lit(1), F.least(F.col("h_px"), ch)).cast("int"))
    d = d.withColumn("left", F.floor((F.col("w_px") - F.col("_cw")) / 2).cast("int")).withColumn("top", F.floor((F.col("h_px") - F.col("_ch")) / 2).cast("int"))
    d = d.withColumn("right", F.col("left") + F.col("_cw")).withColumn("bottom", F.col("top") + F.col("_ch")).drop("_cw", "_ch")
    d = d.withColumn("target_w", F.col("col") * tile).withColumn("target_h", F.col("row") * tile)
    return d.withColumn("nm_per_px_width", F.col("width_nm") / F.col("w_px")).withColumn("nm_per_px_height", F.col("height_nm") / F.col("h_px"))


def processing_size(w_nm: Column, h_nm: Column, w_px: Column, h_px: Column, per_roi: float = 4.5, roi: int = 256) -> dict[str, Column]:
    """Pixel size for the network (roi px per per_roi nm) and the output size keeping the image's aspect ratio."""
    pw, ph = half_even(w_nm * (roi / per_roi)), half_even(h_nm * (roi / per_roi))
    scale = F.greatest(ph / h_px, pw / w_px)
    return {"proc_h": ph, "proc_w": pw, "scale": scale, "out_h": half_even(h_px * scale), "out_w": half_even(w_px * scale)}
