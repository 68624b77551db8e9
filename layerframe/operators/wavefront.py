"""Serial thinning of points by rank, settled block by block as a wave."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..iterate import cut

#: Least height of a block, and its height in distances.
SIDE, REACHES = 128.0, 4.0


def settle(points: DataFrame, keys: list[str], distance: float, rank: str) -> DataFrame:
    """The points a serial loop would keep: visit by ``rank`` (unique per group), keep one unless a kept one is closer than ``distance``.

    Every round goes through the undecided points of each block in the order of their ranks, next to the points
    of the surrounding blocks within reach: a point near a kept one goes, a point near an earlier undecided one waits,
    any other stays. So a block settles once its earlier neighbours have; no table of pairs is made. Blocks lean to
    the left by one distance per row: a pixel in raster order then depends on blocks above and to the left only,
    never back and forth across a side, and rounds are block diagonals. Other ranks and coordinates that are no whole
    numbers take as many rounds as their longest chain of blocks. A kept point is shown to the surrounding blocks in the next round only: it
    decides all that is near it then. A task holds the kept and the waiting points of one block.
    """
    height = max(SIDE, REACHES * distance)
    width = height * (1.0 + distance)
    columns = points.columns

    def blocks(df: DataFrame) -> DataFrame:
        """Rows for their own block and for every other block within reach."""
        lean = F.col("x") + distance * F.col("y")

        def near(c: Column, reach: float, size: float) -> Column:
            return F.explode(F.sequence(F.floor((c - reach) / size), F.floor((c + reach) / size)))

        d = df.withColumns({"_ox": F.floor(lean / width), "_oy": F.floor(F.col("y") / height)})
        d = d.withColumn("_bx", near(lean, distance + distance * distance, width)).withColumn("_by", near(F.col("y"), distance, height))
        return d.withColumn("_own", (F.col("_bx") == F.col("_ox")) & (F.col("_by") == F.col("_oy"))).drop("_ox", "_oy")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, kept, waiting = None, None, None
        limit = distance * distance
        for b in batches:
            rows, status = [], []
            cols = [b.column(c).to_pylist() for c in ("_at", "x", "y", "_own", "_status")]
            for i, (at, x, y, own, was) in enumerate(zip(*cols, strict=True)):
                if at != here:
                    here, kept, waiting = at, defaultdict(list), defaultdict(list)
                cx, cy = math.floor(x / distance), math.floor(y / distance)
                if was == 1:
                    kept[cx, cy].append((x, y))
                    continue
                cells = [(cx + p, cy + q) for p in (0, -1, 1) for q in (0, -1, 1)]
                if own and any((x - u) ** 2 + (y - v) ** 2 < limit for c in cells if c in kept for u, v in kept[c]):
                    continue
                if not own or any((x - u) ** 2 + (y - v) ** 2 < limit for c in cells if c in waiting for u, v in waiting[c]):
                    waiting[cx, cy].append((x, y))
                    if own:
                        rows.append(i)
                        status.append(0)
                    continue
                kept[cx, cy].append((x, y))
                rows.append(i)
                status.append(1)
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in columns), pa.array(status, pa.int32())], names=[*columns, "_status"])

    def step(state: DataFrame) -> DataFrame:
        """``state``: undecided points (0), and those kept in the last round (1), which only other blocks still need."""
        spread = blocks(state)
        shown = spread.filter("_status = 0 or not _own").withColumn("_at", F.to_json(F.struct(*keys, "_bx", "_by")))
        return shown.repartition("_at").sortWithinPartitions("_at", rank).select(*columns, "_at", "_own", "_status").mapInArrow(task, state.schema)

    if distance <= 0:
        return points
    state = cut(points.withColumn("_status", F.lit(0)))
    done = []
    while True:
        state = cut(step(state))
        done.append(state.filter("_status = 1").drop("_status"))
        if state.filter("_status = 0").isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
