"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket. The bucket in which a source's budget ends is found from
the running sums, only the rows of that bucket are counted again by the next bits of the hash, and
so on; rows are then filtered by hash thresholds. Thresholds are nested: a larger budget keeps all
that a smaller one keeps. No rows are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import cut

WORDS = r"[^\x20\x09-\x0D]+"


def hash_key(doc_id: Column, text: Column) -> Column:
    """60 stable bits of the id; of the text where there is no id."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), text, F.lit(""))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Target per source: its weight's share of all sizes, at most ``most`` times its own size.

    What a source cannot take goes to the others by weight until none is above: with the sources in
    order of (cap / weight) the level is the first that the rest do not exceed, in closed form.
    Windows here run over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("i", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("caps", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("rest_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # the first source that the level of those before it leaves below its cap, and that level
    free = (F.col("total") - F.col("caps")) * F.col("weight") <= F.col("cap") * F.col("rest_weight")
    level = F.min(F.when(free, F.struct("caps", "rest_weight"))).over(whole)
    per = per.withColumn("level", level)
    share = (F.col("total") - F.col("level.caps")).cast("double") * F.col("weight") / F.col("level.rest_weight")
    return per.select("source", "source_size", "weight", F.least(share, F.col("cap").cast("double")).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"), F.col("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORDS)), F.lit(0)).cast("long").alias("size"), hash_key(F.col("doc_id"), F.col("text")).alias("h"),
    )


def _copies(rows: str = "r", bounds: str = "b") -> Column:
    """How often a row is taken: the passes of its source, and once more below the threshold."""
    h, low = F.col(f"{rows}.h"), F.col(f"{bounds}.low")
    return F.col(f"{bounds}.passes") + F.when((h < low) | ((h == low) & F.col(f"{bounds}.with_unit")), 1).otherwise(0)


def thresholds(rows: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3, bits: int = 12) -> DataFrame:
    """Per source: ``source_size, target, passes, low, with_unit``; ``rows(source, size, h)`` is read once per level of ``bits``."""
    targets = source_targets(rows, weights, most)
    budget = (
        targets.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("budget", F.col("target") - (F.col("passes") * F.col("source_size")).cast("double"))
        .select("source", "source_size", "target", "passes", "budget", F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("spent"))
    )
    budget = cut(budget)
    for shift in range(60 - bits, -1, -bits):  # low: the prefix found so far; spent: the size below it
        inside = rows.alias("r").join(budget.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source")) & (F.shiftright("r.h", shift + bits) == F.col("b.low")))
        histogram = inside.groupBy(F.col("b.source").alias("source"), F.shiftright("r.h", shift).alias("bucket")).agg(F.sum("r.size").alias("in_bucket"))
        upto = Window.partitionBy("source").orderBy("bucket")
        running = histogram.withColumn("upto", F.sum("in_bucket").over(upto))
        edge = (
            running.alias("h").join(budget.alias("b"), F.col("h.source").eqNullSafe(F.col("b.source")))
            .filter(F.col("b.spent") + F.col("h.upto") > F.col("b.budget"))
            .groupBy(F.col("h.source").alias("edge_source")).agg(F.min(F.struct("h.bucket", (F.col("h.upto") - F.col("h.in_bucket")).alias("below"), "h.in_bucket")).alias("edge"))
        )
        budget = cut(
            budget.join(edge, F.col("source").eqNullSafe(F.col("edge_source")), "left")
            .select("source", "source_size", "target", "passes", "budget", F.coalesce("edge.bucket", F.lit(-1).cast("long")).alias("low"),
                    (F.col("spent") + F.coalesce("edge.below", F.lit(0))).alias("spent"), F.coalesce("edge.in_bucket", F.lit(0)).cast("long").alias("unit"))
        )
    # low is now the whole hash of the unit at the edge (-1: the budget covers all or nothing is left to take)
    nearer = (F.col("spent") + F.col("unit") - F.col("budget")) < (F.col("budget") - F.col("spent"))
    return budget.select("source", "source_size", "target", "passes", "low", nearer.alias("with_unit"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for each row of ``docs(doc_id, text, source)``.

    ``size``: words of the text, null text 0. ``taken``: words the mix takes, 0 to ``most`` times the
    size: every source gives whole passes, and the rest of its budget comes from the documents whose
    hash lies below its threshold; the unit at the threshold is taken if that comes nearer. Rows with
    the same id (or, without id, the same text) are taken together. A null source is a source of its
    own, after all others. Empty table: no rows. Other columns are not read. Targets are exact
    functions of integer sums, so reruns agree.
    """
    rows = cut(_sized(docs))
    bounds = thresholds(rows, weights, most)
    return rows.alias("r").join(bounds.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))).select(
        "r.doc_id", "r.source", "r.size", "b.source_size", "b.target", (F.col("r.size") * _copies()).alias("taken")
    )


def apply_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), most: int = 3) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as `mix_sources` takes it."""
    bounds = thresholds(cut(_sized(docs)), weights, most)
    keyed = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("source"), hash_key(F.col("doc_id"), F.col("text")).alias("h"))
    taken = keyed.alias("r").join(bounds.alias("b"), F.col("r.source").eqNullSafe(F.col("b.source"))).select("r.row", _copies().alias("copies")).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
