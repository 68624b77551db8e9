"""Hard-negative mining with an STR-packed R-tree.

Rows are tiled by sort-tile-recursive packing: slabs of equal size along the most spread coordinate, within
them along the next one, and so on; runs of the tiled order become subtrees, each packed the same way down to
leaves. Box corners give an interval for the inner product with an anchor, coordinate by coordinate. Blocks of
anchors meet the subtrees, the most promising first, in one task per block: a best-first queue per anchor drops
boxes that lie outside the score window or strictly below the k-th score so far.
"""

from __future__ import annotations

import heapq
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..iterate import cut, global_order

#: Rows of a subtree, of a leaf, children of an inner box, anchors of a block, and slabs per tiled coordinate.
SUBTREE, LEAF, FAN, ANCHORS, SLABS = 4096, 512, 8, 128, 16
#: Sums of products up to here are exact as doubles; beyond, Python integers are used.
EXACT = 1 << 53
#: Scores are reported as longs; larger ones (components beyond about 2**28) are compared exactly and reported as the bound.
LONG = (1 << 63) - 1


def quantise(embeddings: DataFrame, scale: int = 256, relabel_every: int = 7, labels: int = 10) -> DataFrame:
    """(vec_id, label, q): whole-number vectors of the usable rows.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part. A component x
    becomes floor(scale * x); rows whose id ``relabel_every`` divides move to the next label.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    # floor of a double as a double: whole numbers beyond 2**63 stay what they are
    whole = F.transform(x, lambda v: F.when(F.abs(v) < 2.0**40, F.floor(v * scale).cast("double")).otherwise(v * scale))
    return embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(usable).select(
        F.col("vec_id").cast("long").alias("vec_id"), moved.cast("long").alias("label"), whole.alias("q")
    )


def _tiled(rows: DataFrame) -> DataFrame:
    """``rows`` with their place ``rn`` in the order of the tiles, and their dimension ``dim``."""
    rows = rows.withColumn("dim", F.size("q"))
    at = [k / SLABS for k in range(1, SLABS)]
    spread = rows.select("dim", F.posexplode("q").alias("pos", "x")).groupBy("pos").agg(F.var_pop("x").alias("v"), F.percentile_approx("x", at, 1000).alias("cuts"))
    tiles = spread.orderBy(F.desc("v"), "pos").limit(2)

    def slab(pos: int, cuts: list[float]) -> Column:
        return F.size(F.filter(F.lit([float(c) for c in cuts]), lambda c: c <= F.try_element_at("q", F.lit(pos + 1))))

    slabs = [slab(*t) for t in tiles.select("pos", "cuts").collect()]  # two rows of SLABS numbers
    names = [f"slab{k}" for k in range(len(slabs))]
    return global_order(rows.withColumns(dict(zip(names, slabs, strict=True))), ["dim", *names, "vec_id", "label"]).drop(*names)


def _str_order(v: np.ndarray, most: int) -> np.ndarray:
    """Order of the rows of ``v`` in which runs of ``most`` are the leaves: slabs along the three most spread coordinates."""
    leaves = -(-len(v) // most)
    axes = np.argsort([-float(np.ptp(c.astype(float))) for c in v.T], kind="stable")[:3]
    groups = [np.arange(len(v))]
    for k, axis in enumerate(axes):
        cuts = max(1, round(leaves ** (1 / len(axes)))) if k < len(axes) - 1 else 1
        out = []
        for g in groups:
            g = g[np.argsort(v[g, axis], kind="stable")]
            size = -(-len(g) // cuts)
            size = -(-size // most) * most  # whole leaves in every slab
            out += [g[i:i + size] for i in range(0, len(g), size)]
        groups = out
    return np.concatenate(groups)


def _pack(v: np.ndarray) -> bytes:
    """Vectors in the smallest exact form: two bytes a component where they fit, else doubles."""
    small = not v.size or np.abs(v).max() < 1 << 15
    return (b"h" if small else b"d") + v.astype("<i2" if small else "<f8").tobytes()


def _unpack(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i2" if raw[:1] == b"h" else "<f8", offset=1).reshape(n, dim).astype(float)


BLOCK = "dim int, at bigint, ids binary, labels binary, vectors binary, low array<double>, high array<double>"


def _blocks(ordered: DataFrame, place: str, size: int, leaf: int) -> DataFrame:
    """Runs of ``size`` rows as one row each: ids, labels and vectors in the order of their leaves, and the corners of the box."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                v = np.array([x["q"] for x in r["rows"]], float).reshape(len(r["rows"]), r["dim"])
                o = _str_order(v, leaf) if r["dim"] else np.arange(len(v))
                v, ids, labels = v[o], *(np.array([x[k] for x in r["rows"]], "<i8")[o] for k in ("vec_id", "label"))
                row = {"dim": r["dim"], "at": r["at"], "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": _pack(v), "low": v.min(0).tolist(), "high": v.max(0).tolist()}
                yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("dim", pa.int32()), ("at", pa.int64()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    runs = ordered.groupBy("dim", F.expr(f"{place} div {size}").alias("at")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "q"))).alias("rows"))
    return runs.mapInArrow(build, BLOCK)


class Tree:
    """A subtree: rows in leaf order, and the boxes of all levels, leaves first and the root last."""

    def __init__(self, row: dict, exact: bool):
        self.ids, self.labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
        self.v = _unpack(row["vectors"], row["dim"], len(self.ids))
        if not exact:
            self.v = np.array([[int(x) for x in r] for r in self.v], object).reshape(self.v.shape)
        low, high = (f.reduceat(self.v, np.arange(0, len(self.v), LEAF)) for f in (np.minimum, np.maximum))
        lows, highs, self.children, first = [low], [high], {}, 0
        while len(low) > 1:
            steps = np.arange(0, len(low), FAN)
            for k, s in enumerate(steps):
                self.children[first + len(low) + k] = range(first + s, first + min(s + FAN, len(low)))
            first += len(low)
            low, high = np.minimum.reduceat(low, steps), np.maximum.reduceat(high, steps)
            lows.append(low)
            highs.append(high)
        self.low, self.high = np.concatenate(lows), np.concatenate(highs)

    def intervals(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest inner product of anchors ``a`` with a point of each box."""
        up, down = np.maximum(a, 0), np.minimum(a, 0)
        return up @ self.low.T + down @ self.high.T, up @ self.high.T + down @ self.low.T

    def scores(self, leaf: int, a: np.ndarray) -> np.ndarray:
        return self.v[leaf * LEAF:(leaf + 1) * LEAF] @ a


class Anchor:
    """One anchor in one subtree: scores of its leaves are computed when a queue first reaches them."""

    def __init__(self, tree: Tree, a: np.ndarray, ident: int, label: int, least: np.ndarray, most: np.ndarray):
        self.tree, self.a, self.ident, self.label, self.least, self.most, self.seen = tree, a, ident, label, least, most, {}

    def search(self, best: list[tuple[int, int]], k: int, same: bool, low: float = -float("inf"), high: float = float("inf")) -> None:
        """Put the first ``k`` rows of the same or of other labels with ``low`` <= score <= ``high`` into ``best`` (pairs -score, id)."""
        t, least, most = self.tree, self.least, self.most
        root = len(most) - 1
        queue = [(-min(most[root], high), root)] if most[root] >= low and least[root] <= high else []
        while queue:
            bound, node = heapq.heappop(queue)
            if len(best) == k and bound > best[-1][0]:
                return  # strictly below the k-th: equal scores may still have a smaller id
            for child in t.children.get(node, ()):
                if most[child] >= low and least[child] <= high:
                    heapq.heappush(queue, (-min(most[child], high), child))
            if node in t.children:
                continue
            if node not in self.seen:
                rows = slice(node * LEAF, (node + 1) * LEAF)
                self.seen[node] = t.scores(node, self.a), t.ids[rows], t.labels[rows] == self.label, t.ids[rows] != self.ident
            s, ids, alike, other = self.seen[node]
            fits = (alike if same else ~alike) & other & (s >= low) & (s <= high)
            if len(best) == k:
                fits &= s >= -best[-1][0]
            fits = np.flatnonzero(fits)
            if len(fits) > k:
                fits = fits[np.lexsort((ids[fits], -s[fits]))[:k]]
            for i in fits:
                insort(best, (-int(s[i]), int(ids[i])))
            del best[k:]


SEARCH = "block bigint, dim int, ids binary, labels binary, vectors binary, bound double, anchors boolean, found array<array<struct<score:string,id:bigint>>>"
MINED = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _stream(anchors: DataFrame, trees: DataFrame) -> DataFrame:
    """Each anchor block, followed by the subtrees with the greatest bound of their inner products first; a block is one key.

    Subtrees are repeated once per anchor block; the query set is meant to be a small, stated share of the rows.
    """
    corner = F.aggregate(F.arrays_zip("low", "high", "a_low", "a_high"), F.lit(0.0), lambda s, c: s + F.greatest(c["low"] * c["a_low"], c["low"] * c["a_high"], c["high"] * c["a_low"], c["high"] * c["a_high"]))
    n = anchors.count()
    boxes = anchors.select("block", F.col("dim").alias("a_dim"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    met = trees.select("*", F.explode(F.expr(f"sequence(0L, {n - 1}L)" if n else "cast(array() as array<bigint>)")).alias("block")).join(boxes, "block").filter("dim = a_dim")
    rows = met.select("block", "dim", "ids", "labels", "vectors", corner.alias("bound"), F.lit(False).alias("anchors"), F.lit(None).cast("array<array<struct<score:string,id:bigint>>>").alias("found"))
    first = anchors.select("block", "dim", "ids", "labels", "vectors", F.lit(float("inf")).alias("bound"), F.lit(True).alias("anchors"), "found")
    return first.unionByName(rows).repartition("block").sortWithinPartitions("block", F.desc("anchors"), F.desc("bound"))


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """Hard negatives per anchor and positive: ``MINED``.

    ``rows``: (vec_id, label, q) as `quantise` gives them; q holds whole numbers. Scores are inner products, higher
    first, ties by smaller id. Positives of an anchor: its first ``positives`` other rows of the same label.
    Negatives of a positive: the first ``negatives`` rows of other labels whose score is between ``window`` per cent
    of the positive's. Only vectors of equal length are compared. A row that repeats another in id, label and
    vector counts once; an id with several vectors or labels stands for each of them, and rows of the anchor's own id
    are never its positives or negatives. Anchors without positives, positives without negatives and an empty
    table give no rows. Other columns are not read.

    Memory of a task: one block of anchors, one subtree and the scores of one anchor with it. All rows are indexed.
    """
    spark = rows.sparkSession
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")  # a row is a block of rows here
    try:
        ordered = cut(_tiled(rows.select("vec_id", "label", "q").dropDuplicates()))
        trees = cut(_blocks(ordered, "rn", SUBTREE, LEAF))
        # a global number of blocks, whatever their dimension
        anchors = cut(_blocks(global_order(ordered.filter(is_anchor), ["dim", "rn"], "place"), "place", ANCHORS, ANCHORS))
        numbered = cut(global_order(anchors, ["dim", "at"], "block").withColumn("found", F.lit(None).cast("array<array<struct<score:string,id:bigint>>>")))
        first = cut(_stream(numbered, trees).mapInArrow(_searcher(positives, None, window), SEARCH))
        boxes = numbered.select("block", "low", "high")
        return cut(_stream(first.join(boxes, "block"), trees).mapInArrow(_searcher(positives, negatives, window), MINED))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)


def _searcher(positives: int, negatives: int | None, window: tuple[int, int]):
    """Task code: over blocks and their subtrees; without ``negatives`` the blocks come back with their positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["anchors"]:
                    if block is not None:
                        yield close(block, best)
                    block = r
                    n = len(r["ids"]) // 8
                    best = [[] for _ in range(n)] if negatives is None else [[[] for _ in f] for f in r["found"]]
                else:
                    visit(block, r, best)
        if block is not None:
            yield close(block, best)

    def visit(block: dict, row: dict, best: list) -> None:
        ids, labels = np.frombuffer(block["ids"], "<i8"), np.frombuffer(block["labels"], "<i8")
        a, v = (_unpack(r["vectors"], r["dim"], len(r["ids"]) // 8) for r in (block, row))
        exact = float(np.abs(a).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, row["dim"]) < EXACT
        if not exact:
            a = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape)
        tree = Tree(row, exact)
        least, most = tree.intervals(a)
        for i in range(len(ids)):
            anchor = Anchor(tree, a[i], int(ids[i]), int(labels[i]), least[i], most[i])
            if negatives is None:
                anchor.search(best[i], positives, True)
                continue
            for p, found in zip(block["found"][i], best[i], strict=True):
                score = int(p["score"])
                anchor.search(found, negatives, False, -(-window[0] * score // 100), window[1] * score // 100)

    def close(block: dict, best: list) -> pa.RecordBatch:
        if negatives is None:
            found = [[{"score": str(-s), "id": i} for s, i in top] for top in best]
            pair = pa.struct([("score", pa.string()), ("id", pa.int64())])
            names = ["block", "dim", "ids", "labels", "vectors", "bound", "anchors"]
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([*(pa.array([block[k]], t) for k, t in zip(names, kinds, strict=True)), pa.array([found], pa.list_(pa.list_(pair)))], names=[*names, "found"])
        out = []
        for ident, found, tops in zip(np.frombuffer(block["ids"], "<i8").tolist(), block["found"], best, strict=True):
            for p, top in zip(found, tops, strict=True):
                score = max(-LONG, min(LONG, int(p["score"])))
                out += [(ident, p["id"], k, i, score, max(-LONG, min(LONG, -s))) for k, (s, i) in enumerate(top, 1)]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names=names)

    return run
