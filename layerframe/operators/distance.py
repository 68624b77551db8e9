"""Exact Euclidean distance to the nearest zero of a mask, in two passes over columns and rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Cells of the arrays that a task holds at a time.
CELLS = 1 << 22


def _least_parabola(g2: np.ndarray) -> np.ndarray:
    """Per row: least (x − x')² + g2[x'] over all x'. Parabolas further away than the largest value found cannot be lower."""
    best, k = g2.copy(), 1
    while k < g2.shape[1] and k * k < best.max(initial=0.0):
        np.minimum(best[:, k:], g2[:, :-k] + k * k, out=best[:, k:])
        np.minimum(best[:, :-k], g2[:, k:] + k * k, out=best[:, :-k])
        k += 1
    return best


def distance_map(mask: DataFrame, key: list[str], level: float = 0.5) -> DataFrame:
    """``key, x, y, d``: distance of every pixel from the nearest pixel with v ≤ ``level`` of its image (infinite without one).

    First the distance along the column, from the last zero above and the first one below; then, along the
    row, the least of the parabolas that the columns give. The unit of work is a column or a row of one image. Null
    counts as zero; missing pixels are no zeros and get no distance.
    """
    y = F.when(F.coalesce("v", F.lit(0.0)) <= level, F.col("y"))
    column = Window.partitionBy(*key, "x").orderBy("y")
    above = F.last(y, ignorenulls=True).over(column.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    below = F.first(y, ignorenulls=True).over(column.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    g = mask.select(*key, "x", "y", F.least(F.col("y") - above, below - F.col("y")).cast("double").alias("g"))
    rows = g.groupBy(*key, "y").agg(F.sort_array(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.coalesce("g", F.lit(float("inf"))).alias("g")))).alias("cells"))
    schema = T.StructType([*(rows.schema[c] for c in key), T.StructField("x", T.IntegerType()), rows.schema["y"], T.StructField("d", T.DoubleType())])

    def envelope(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = b.column("cells")
            offsets = cells.offsets.to_numpy()
            x, g = (c.to_numpy(zero_copy_only=False) for c in cells.values.flatten())
            i = 0
            while i < b.num_rows:
                # as many rows as fit an array of CELLS, one at least
                j, wide = i, 0
                while j < b.num_rows:
                    w = max(wide, int(x[offsets[j + 1] - 1]) + 1)
                    if j > i and w * (j + 1 - i) > CELLS:
                        break
                    j, wide = j + 1, w
                part = slice(offsets[i], offsets[j])
                row = np.repeat(np.arange(j - i), np.diff(offsets[i:j + 1]))
                a = np.full((j - i, wide), np.inf)
                a[row, x[part]] = g[part] ** 2
                some = np.isfinite(a).any(1)
                a[some] = _least_parabola(a[some])
                take = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in key), pa.array(x[part], pa.int32()), b.column("y").take(take), pa.array(np.sqrt(a[row, x[part]]))], names=[*key, "x", "y", "d"])
                i = j

    return rows.mapInArrow(envelope, schema)
