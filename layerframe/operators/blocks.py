"""Blocks of pixel tables as array rows: one row per block, so tasks work on whole arrays and never on whole images.

A block is a square of ``block`` × ``block`` pixels of one image. `gather` sends every pixel to its own block
and, within ``halo`` of a side, to the adjoining ones; nothing else is copied. What lies beyond the frame
(repeated, reflected or zero borders) is made inside the arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK = 256
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
_PAD = {"edge": {"mode": "edge"}, "reflect": {"mode": "symmetric"}, "zero": {"mode": "constant"}}


def gather(px: DataFrame, key: list[str], values: list[str], block: int = BLOCK, halo: int = 0) -> DataFrame:
    """``key, bx, by, cells``: pixels (x, y from 0) of each block and its halo, as an array of (x, y, values…) structs."""

    def reach(axis: str) -> Column:
        lo, hi = (F.floor(F.greatest(F.lit(0), F.col(axis) + k) / block) for k in (-halo, halo))
        return F.explode(F.sequence(lo, hi)) if halo else lo

    cell = F.struct(F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), *[F.col(v).cast("double").alias(f"v{i}") for i, v in enumerate(values)])
    d = px.select(*key, cell.alias("cell"), "y", reach("x").alias("bx")).select(*key, "cell", "bx", reach("y").alias("by"))
    return d.groupBy(*key, "bx", "by").agg(F.collect_list("cell").alias("cells"))


def map_blocks(blocks: DataFrame, key: list[str], fn: Callable[..., tuple[np.ndarray, ...]], out: list[tuple[str, str]]) -> DataFrame:
    """Rows made from blocks: ``key`` and the columns ``out`` (name, type).

    ``fn(bx, by, offsets, x, y, values…)`` gets the blocks of one Arrow batch as flat arrays, told apart by
    ``offsets``, and returns the number of the block of each output row and one array per output column.
    """
    schema = T.StructType([*(blocks.schema[c] for c in key), *(T.StructField(n, T._parse_datatype_string(t)) for n, t in out)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cells = b.column("cells")
            offsets = cells.offsets.to_numpy()
            flat = [c.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]] for c in cells.values.flatten()]
            bx, by = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bx", "by"))
            rows, *columns = fn(bx, by, (offsets - offsets[0]).astype(np.int64), *flat)
            take = pa.array(np.asarray(rows, np.int64))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in key), *(pa.array(c, type=_KINDS[t]) for c, (_, t) in zip(columns, out, strict=True))], names=[*key, *(n for n, _ in out)]
            )

    return blocks.mapInArrow(run, schema)


class Frame:
    """One block and its halo as arrays. Images are frames from (0, 0) to the last pixel they have.

    A side of the image is recognised by the halo that is missing there.
    """

    def __init__(self, bx: int, by: int, block: int, halo: int, x: np.ndarray, y: np.ndarray):
        left, top = bx * block, by * block
        self.x0, self.y0 = max(0, left - halo), max(0, top - halo)
        self.x, self.y = x - self.x0, y - self.y0
        self.shape = int(self.y.max()) + 1, int(self.x.max()) + 1
        #: margin to be made on each side, so that ``halo`` pixels surround the own ones
        end_x, end_y = self.x0 + self.shape[1], self.y0 + self.shape[0]
        self.pad = ((halo - (top - self.y0), max(0, min(halo, top + block + halo - end_y))), (halo - (left - self.x0), max(0, min(halo, left + block + halo - end_x))))
        # an image that ends inside the halo of the next block still needs the rest of the margin only
        self.own = (x >= left) & (x < left + block) & (y >= top) & (y < top + block)
        self.at = y[self.own] - top, x[self.own] - left

    def fill(self, v: np.ndarray, empty: float = 0.0) -> np.ndarray:
        a = np.full(self.shape, empty)
        a[self.y, self.x] = v
        return a

    def padded(self, a: np.ndarray, mode: str) -> np.ndarray:
        """``a`` with its margin; own pixel (0, 0) is at (halo, halo)."""
        return np.pad(a, self.pad, **_PAD[mode])


def frames(bx: np.ndarray, by: np.ndarray, offsets: np.ndarray, block: int, halo: int, x: np.ndarray, y: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, Frame, list[np.ndarray]]]:
    """The blocks of a batch one by one; a block of halo pixels only lies beyond the image and is left out."""
    for k in range(len(bx)):
        part = slice(offsets[k], offsets[k + 1])
        f = Frame(int(bx[k]), int(by[k]), block, halo, x[part], y[part])
        if f.own.any():
            yield k, f, [v[part] for v in values]


def joined(parts: list[tuple], n: int) -> tuple[np.ndarray, ...]:
    """Tuples of arrays (number of the block first), one array per place; ``n`` places if there are none."""
    if not parts:
        return tuple(np.zeros(0) for _ in range(n))
    return tuple(np.concatenate(c) for c in zip(*((np.full(len(p[1]), p[0]), *p[1:]) for p in parts), strict=True))


# ---------------------------------------------------------------- runs of pixels, and what hangs together


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least node that each of ``n`` nodes is connected to by the pairs (a, b): hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        m = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], m)
        np.minimum.at(label, label[b], m)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def label_blocks(block: int) -> Callable[..., tuple[np.ndarray, ...]]:
    """Task code of `map_blocks`: 8-connected pieces inside blocks.

    Per pixel: x, y, and the first pixel of its piece in raster order. Pixels become horizontal runs, runs of
    neighbouring rows that touch are found by binary search, and all blocks of a batch are labelled together.
    """
    wide = block + 2  # an empty column on each side keeps rows apart

    def run(bx, by, offsets, x, y):
        k = np.repeat(np.arange(len(bx)), np.diff(offsets))
        lx, ly = x - bx[k] * block, y - by[k] * block
        code = np.unique((k * (block + 1) + ly) * wide + lx + 1)  # repeated pixels are one
        new = np.r_[True, np.diff(code) != 1] if len(code) else np.zeros(0, bool)
        first, last = code[new], code[np.r_[new[1:], True]] if len(code) else code
        # runs of the next row from one left to one right of this run
        lo, hi = np.searchsorted(last, first + wide - 1, "left"), np.searchsorted(first, last + wide + 1, "right")
        touch = np.maximum(hi - lo, 0)
        a = np.repeat(np.arange(len(first)), touch)
        b = np.repeat(lo, touch) + np.arange(len(a)) - np.repeat(np.cumsum(touch) - touch, touch)
        root = first[least_labels(len(first), a, b)][np.cumsum(new) - 1] if len(code) else code

        def place(c):
            row, col = np.divmod(c, wide)
            blk, row = np.divmod(row, block + 1)
            return blk, col - 1 + bx[blk] * block, row + by[blk] * block

        blk, px, py = place(code)
        _, rx, ry = place(root)
        return blk, px, py, rx, ry

    return run
