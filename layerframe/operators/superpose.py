"""Superposition of layers: sums, scale factor k, consistency step and residual logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clip
from ..iterate import cut

KEY = ["image_id"]


def superpose(layers: DataFrame, key: list[str] = KEY, signed: bool = False) -> DataFrame:
    """Sum over layers per pixel; in the −1..1 range N−1 is added so the result is on that scale again."""
    s = F.sum("v") + (F.count("v") - 1.0) if signed else F.sum("v")
    return layers.groupBy(*key, "x", "y").agg(s.alias("s"), F.count("v").alias("n_layers"))


def spread(image: DataFrame, n: int, value: str = "y_val") -> DataFrame:
    """Back to layers: each of n layers gets value/N."""
    return image.withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("v", F.col(value) / n)


def scale_factor(pixels: DataFrame, key: list[str], fixed: float | None = None, adaptive: bool = False, s: str = "s", y: str = "t") -> DataFrame:
    """k per group: fixed, adaptive Σys/max(Σs², 1e-8), or 1; clamped to 0..1 with a safe value of at least 1e-8."""
    if fixed is not None:
        k, mode = F.lit(float(fixed)), "fixed"
    elif adaptive:
        k, mode = F.sum(F.col(y) * F.col(s)) / F.greatest(F.sum(F.col(s) * F.col(s)), F.lit(1e-8)), "adaptive"
    else:
        k, mode = F.lit(1.0), "unity"
    g = pixels.groupBy(*key).agg(F.count("*").alias("n"), clip(k, 0.0, 1.0).alias("k"))
    return g.withColumn("k_safe", F.greatest("k", F.lit(1e-8))).withColumn("k_mode", F.lit(mode))


def combined(k: Column, s: Column) -> Column:
    return clip(k * s, 0.0, 1.0)


def consistency_step(layers: DataFrame, target: DataFrame, key: list[str], lam: float, fixed: float | None = None, adaptive: bool = True) -> DataFrame:
    """L − λ·(1/N)/k·(k·ΣL − y) for every layer pixel. ``target``: key, x, y, t."""
    n = layers.groupBy(*key).agg(F.countDistinct("layer").alias("n_l"))
    s = layers.groupBy(*key, "x", "y").agg(F.sum("v").alias("s")).join(target, [*key, "x", "y"])
    k = scale_factor(s, key, fixed, adaptive).select(*key, "k", "k_safe")
    res = s.join(k, key).join(n, key).withColumn("step", lam * (1.0 / F.col("n_l")) / F.col("k_safe") * (F.col("k") * F.col("s") - F.col("t")))
    return layers.join(res.select(*key, "x", "y", "step"), [*key, "x", "y"]).withColumn("v", F.col("v") - F.col("step")).drop("step")


def residual_log(pixels: DataFrame, key: list[str], fixed: float | None = None, adaptive: bool = True) -> DataFrame:
    """Per tile (tr, tc): k, its mode, mean |k·s − y| and the raster index of the tile."""
    tile = [*key, "tr", "tc"]
    k = scale_factor(pixels, tile, fixed, adaptive)
    return _residuals(pixels.join(k.select(*tile, "k", "k_mode"), tile), key)


def _residuals(fitted: DataFrame, key: list[str]) -> DataFrame:
    """`residual_log` of pixels that have the k and k_mode of their tile."""
    r = fitted.groupBy(*key, "tr", "tc", "k", "k_mode").agg(F.avg(F.abs(F.col("k") * F.col("s") - F.col("t"))).alias("residual_abs_mean"))
    width = r.groupBy(*key).agg((F.max("tc") + 1).alias("nc"))
    return r.join(width, key).withColumn("shift_index", F.col("tr") * F.col("nc") + F.col("tc")).withColumn("adaptive", F.col("k_mode") == "adaptive").drop("nc")


def residual_series(layers: DataFrame, target: DataFrame, key: list[str], schedule: list[tuple[int, int, float]], fixed: float | None = None, adaptive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Log of every tile and step of ``schedule`` (t, t_next, lambda), and the layers after the last step.

    ``layers``: key, tr, tc, layer, x, y, v in 0..1; ``target``: key, tr, tc, x, y, t. A step logs the residual it starts
    from and then applies :func:`consistency_step` inside its tile. ``iter`` counts the records of an image: tiles in
    raster order, the steps of a tile one after the other. The layers of a pixel are one row, which has its target; a step
    sends the rows to the k of their tile once, by merge, and stores them, so that the plan of the next one stays small
    and a lost executor costs one step. The layers after the last step are computed when they are used.
    """
    tile = [*key, "tr", "tc"]
    n = layers.groupBy(*tile).agg(F.countDistinct("layer").alias("n_l"))
    rows = layers.groupBy(*tile, "x", "y").agg(F.array_sort(F.collect_list(F.struct("layer", "v"))).alias("vs"))
    state = cut(rows.join(target.select(*tile, "x", "y", "t").hint("merge"), [*tile, "x", "y"]))
    known, logs = F.filter(F.col("vs")["v"], lambda v: v.isNotNull()), []
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v))
    for i, (t, t_next, lam) in enumerate(schedule):
        sums = state.withColumn("s", total)
        k = scale_factor(sums, tile, fixed, adaptive).select(*tile, "k", "k_safe", "k_mode").join(n.hint("merge"), tile)
        fitted = cut(sums.join(k.hint("merge"), tile))
        row = _residuals(fitted, key)
        logs.append(row.withColumns({"iter": (F.col("shift_index") * len(schedule) + i).cast("bigint"), "t": F.lit(t), "t_next": F.lit(t_next), "lambda_t": F.lit(float(lam))}))
        step = lam * (1.0 / F.col("n_l")) / F.col("k_safe") * (F.col("k") * F.col("s") - F.col("t"))
        state = fitted.withColumn("_d", step).withColumn("vs", F.transform("vs", lambda e: F.struct(e["layer"].alias("layer"), (e["v"] - F.col("_d")).alias("v")))).select(*tile, "x", "y", "vs", "t")
        if not i:  # pixels without a target are gone
            n = state.groupBy(*tile).agg(F.size(F.array_distinct(F.flatten(F.collect_set(F.col("vs")["layer"])))).alias("n_l"))
    log = reduce(DataFrame.unionByName, logs)
    left = state.select(*tile, "x", "y", F.explode("vs").alias("e")).select(*tile, "e.layer", "x", "y", "e.v")
    return log.withColumnsRenamed({"tr": "shift_h", "tc": "shift_w"}), left


def series_summary(log: DataFrame, key: list[str]) -> DataFrame:
    """Per image and step: mean k and mean residual over its tiles, in the order of the steps."""
    return log.groupBy(*key, "t", "t_next").agg(F.min("iter").alias("first_iter"), F.avg("k").alias("k"), F.avg("residual_abs_mean").alias("residual_abs_mean"), F.count("*").alias("n_tiles"))


def channel_mean(px: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Gray from colour: mean of the channels (rows carry ``channel``)."""
    return px.groupBy(*key, "x", "y").agg(F.avg("v").alias("v"))


def channel_spread(v: Column) -> Column:
    """Inverse of the channel mean: three channels holding v·(1/3)/(3·(1/9)) each."""
    c = v * (1.0 / 3.0) / (3.0 * (1.0 / 9.0))
    return F.array(c, c, c)
