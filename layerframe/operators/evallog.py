"""Offline segmentation scores and training-log analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import cut


# ---------------------------------------------------------------- segmentation scores

def argmax_class(logits: Column) -> Column:
    """Class of the largest logit, the first one on ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def class_counts(scores: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """Intersection, prediction and target counts per foreground class (columns ``pred``, ``label``), absent classes included."""
    cells = F.array(*[F.struct(F.lit(c).alias("cls"), F.lit(c).alias("c")) for c in range(1, n_classes)])
    classes = scores.select(*keys).distinct().withColumn("cls", F.explode(F.transform(cells, lambda s: s["cls"])))
    # each pixel feeds at most two classes
    p = scores.select(*keys, F.col("pred").alias("cls"), F.lit(1).alias("p"), F.lit(0).alias("t"), (F.col("pred") == F.col("label")).cast("int").alias("i"))
    t = scores.select(*keys, F.col("label").alias("cls"), F.lit(0).alias("p"), F.lit(1).alias("t"), F.lit(0).alias("i"))
    g = p.unionByName(t).filter("cls > 0").groupBy(*keys, "cls").agg(F.sum("p").alias("p"), F.sum("t").alias("t"), F.sum("i").alias("i"))
    return classes.join(g, [*keys, "cls"], "left").na.fill(0, ["p", "t", "i"])


def dice_iou(scores: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """Mean Dice (2i+1)/(p+t+1) and mean IoU (i+1)/(u+1) over foreground classes; IoU skips empty unions, 0 if none is left."""
    c = class_counts(scores, keys, n_classes)
    u = F.col("p") + F.col("t") - F.col("i")
    return c.groupBy(*keys).agg(
        F.avg((2.0 * F.col("i") + 1.0) / (F.col("p") + F.col("t") + 1.0)).alias("dice"),
        F.coalesce(F.avg(F.when(u > 0, (F.col("i") + 1.0) / (u + 1.0))), F.lit(0.0)).alias("iou"))


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    lse = F.log(F.aggregate(logits, F.lit(0.0), lambda a, z: a + F.exp(z - top))) + top
    return F.transform(logits, lambda z: z - lse)


def losses(scores: DataFrame, keys: list[str], n_classes: int, gamma: float = 3.0, alpha: list[float] | None = None, weight: list[float] | None = None,
           smooth: float = 1.0, eps: float = 1e-7) -> DataFrame:
    """Soft Dice loss, focal loss, (weighted) cross-entropy and their combination per group. Columns ``logits``, ``label``."""
    d = scores.withColumn("_lp", log_softmax(F.col("logits"))).withColumn("_t", F.element_at("_lp", F.col("label") + 1))
    pt = F.exp("_t")
    focal = -F.pow(1.0 - pt, F.lit(float(gamma))) * F.col("_t")
    if alpha:
        focal = focal * F.element_at(F.array(*[F.lit(float(a)) for a in alpha]), F.col("label") + 1)
    w = F.element_at(F.array(*[F.lit(float(a)) for a in weight]), F.col("label") + 1) if weight else F.lit(1.0)
    aggs = [F.avg(focal).alias("focal"), (-F.sum(w * F.col("_t")) / F.sum(w)).alias("cross_entropy")]
    for c in range(n_classes):
        p, y = F.exp(F.element_at("_lp", c + 1)), (F.col("label") == c).cast("double")
        aggs += [F.sum(p * y).alias(f"_i{c}"), F.sum(p + y).alias(f"_c{c}")]
    g = d.groupBy(*keys).agg(*aggs)
    dice = sum(((2.0 * F.col(f"_i{c}") + smooth) / (F.col(f"_c{c}") + smooth + eps) for c in range(n_classes)), F.lit(0.0)) / n_classes
    return g.withColumn("dice_loss", 1.0 - dice).withColumn("combined", F.col("dice_loss") + F.col("focal")).select(*keys, "dice_loss", "focal", "cross_entropy", "combined")


def epoch_metrics(batches: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Unweighted mean over batches."""
    return batches.groupBy(*keys).agg(*[F.avg(v).alias(v) for v in values])


def validation_dump(scores: DataFrame, pixels_per_chunk: int = 65536) -> DataFrame:
    """Predictions per image in pixel order, in chunks of bounded length: ``image, chunk, pred, label``."""
    d = scores.withColumn("chunk", F.floor(F.col("pixel") / pixels_per_chunk))
    g = d.groupBy("image", "chunk").agg(F.sort_array(F.collect_list(F.struct("pixel", "pred", "label"))).alias("s"))
    return g.select("image", "chunk", F.transform("s", lambda s: s["pred"]).alias("pred"), F.transform("s", lambda s: s["label"]).alias("label"))


# ---------------------------------------------------------------- checkpoints and stopping

def keep_best(ck: DataFrame, keys: list[str], monitor: str, k: int = 10, mode: str = "max") -> DataFrame:
    """The k best checkpoints per run, earlier epochs first on ties; ``is_best`` marks the first."""
    o = F.desc(monitor) if mode == "max" else F.asc(monitor)
    w = Window.partitionBy(*keys).orderBy(o, F.asc("epoch"))
    return ck.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("is_best", F.col("rank") == 1)


def early_stop(scores: DataFrame, keys: list[str], value: str, patience: int = 20, mode: str = "max") -> DataFrame:
    """First epoch at which ``patience`` epochs in a row brought no new best (no minimum delta); null when never.

    Running maxima in two levels: inside range partitions of (run, epoch), then over one row per run and
    partition, so a run with most of the rows is still spread over tasks.
    """
    v = F.col(value) if mode == "max" else -F.col(value)
    d = cut(scores.select(*keys, "epoch", v.alias("_v")).repartitionByRange(*keys, "epoch").withColumn("_p", F.spark_partition_id()))
    inner = Window.partitionBy(*keys, "_p").orderBy("epoch")
    outer = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    part = d.groupBy(*keys, "_p").agg(F.max("_v").alias("_m"), F.count("*").alias("_c"))
    part = part.select(*keys, "_p", F.max("_m").over(outer).alias("_pm"), F.coalesce(F.sum("_c").over(outer), F.lit(0)).alias("_pn"))
    d = d.join(part, [*keys, "_p"])
    best = F.greatest(F.max("_v").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.col("_pm"))
    d = d.withColumn("_b", best).withColumn("_n", F.row_number().over(inner) + F.col("_pn"))
    d = d.withColumn("_i", F.when(F.col("_b").isNull() | (F.col("_v") > F.col("_b")), F.col("_n")))
    d = cut(d.withColumn("_l", F.max("_i").over(inner.rowsBetween(Window.unboundedPreceding, Window.currentRow))).select(*keys, "_p", "epoch", "_v", "_n", "_l"))
    last = d.groupBy(*keys, "_p").agg(F.max("_l").alias("_m")).select(*keys, "_p", F.max("_m").over(outer).alias("_pl"))
    d = d.join(last, [*keys, "_p"]).withColumn("_l", F.coalesce("_l", "_pl"))
    return d.groupBy(*keys).agg(F.min(F.when(F.col("_n") - F.col("_l") >= patience, F.col("epoch"))).alias("stop_epoch"), F.max("_v").alias("_m")).select(
        *keys, "stop_epoch", (F.col("_m") if mode == "max" else -F.col("_m")).alias("best"))


# ---------------------------------------------------------------- key/value logs

def dump_last(log: DataFrame, interval: int, seq: list[str] | None = None) -> DataFrame:
    """Last value of each key per dump interval.

    ``seq``: columns that order the rows of one step, the last one wins; without them the largest value of the last step.
    """
    order = F.struct("step", *(seq or ["value"]))
    return log.groupBy("run", F.floor(F.col("step") / interval).alias("dump"), "key").agg(F.max_by("value", order).alias("value"))


def dump_mean(log: DataFrame, interval: int) -> DataFrame:
    """Mean value of each key per dump interval."""
    return log.groupBy("run", F.floor(F.col("step") / interval).alias("dump"), "key").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def weighted_mean(log: DataFrame, keys: list[str]) -> DataFrame:
    """Count-weighted mean over ranks of text values; non-numeric ones are ignored, NaN makes the mean NaN.

    Null where all counts are zero.
    """
    d = log.withColumn("_v", F.col("value").try_cast("double")).filter(F.col("_v").isNotNull())
    return d.groupBy(*keys).agg(F.try_divide(F.sum(F.col("_v") * F.col("cnt")), F.sum("cnt")).alias("value"), F.sum("cnt").alias("cnt"))


def loss_quartile(t: Column, total: int) -> Column:
    return F.floor(4 * t / total).cast("int")


def linear_lr(base: float, step: Column, total: int) -> Column:
    return base * (1.0 - step / total)


def samples_seen(step: Column, resume: int, global_batch: int) -> Column:
    return (step + resume + 1) * global_batch


def timestep_weights(losses_: DataFrame, keys: list[str], total: int, history: int = 10, uniform: float = 0.001) -> DataFrame:
    """Importance weight per timestep: √mean(l²) of the last ``history`` losses, normalised, mixed with a uniform part.

    All ones until every one of the ``total`` timesteps has a full history. ``losses_``: keys, t, seq, loss.
    """
    w = Window.partitionBy(*keys, "t").orderBy(F.desc("seq"))
    last = losses_.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= history)
    g = last.groupBy(*keys, "t").agg(F.sqrt(F.avg(F.col("loss") * F.col("loss"))).alias("m"), F.count("*").alias("c"))
    s = g.groupBy(*keys).agg(F.sum("m").alias("s"), (F.count(F.when(F.col("c") >= history, 1)) == total).alias("warm"))
    frame = losses_.select(*keys).distinct().withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    j = frame.join(g, [*keys, "t"], "left").join(s, keys)
    return j.select(*keys, "t", F.when(F.col("warm"), F.col("m") / F.col("s") * (1.0 - uniform) + uniform / total).otherwise(1.0).alias("weight"))


def importance_probabilities(weights: DataFrame, keys: list[str]) -> DataFrame:
    """Draw probability p and loss weight 1/(n·p) per timestep."""
    s = weights.groupBy(*keys).agg(F.sum("weight").alias("_s"), F.count("*").alias("_n"))
    p = F.col("weight") / F.col("_s")
    return weights.join(s, keys).select(*keys, "t", "weight", p.alias("p"), (1.0 / (F.col("_n") * p)).alias("loss_weight"))
