"""Near-duplicate detection with SetSketch registers.

A document's shingle set is sketched into registers ``floor(1 - log_b(min of Exp(a)))``, truncated to
[0, q + 1]: exponentially spaced, mergeable by maximum, and equal in two sketches with a probability
that follows the Jaccard similarity. Bands of registers propose pairs, the joint likelihood of the
register order discards hopeless ones, and the rest are verified on the full shingle sets.

Documents with equal sets are one class. Each band bucket is compared with its first class, the links
found are contracted to components, and of the classes that share a bucket but still lie in different
components those are compared that share one of their rarest shingles; so neither a bucket of copies
nor one of texts that drifted apart costs all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import connected_labels, cut
from . import textcore as T

SHINGLE = 5
REGISTERS, ROWS = 128, 4  # a pair at similarity .75 shares none of the 32 bands with probability 5e-6
BASE, RATE, LIMIT = 1.001, 20.0, (1 << 16) - 2
SLACK = 0.2  # five standard deviations of the estimate from 128 registers
KEY_ROWS = 4096  # sets of one shingle and size band that one task compares the others with
_FACTORS = np.random.Generator(np.random.PCG64(91)).integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def shingles(data: np.ndarray, bounds: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each row; fewer words than ``width`` are one shingle."""
    low = T.LOWER[data]
    s, e, rows = T.word_spans(low, bounds, T.NOT_SPACE)
    words = T.word_hashes(low, s, e)
    n = len(bounds) - 1
    at = T.row_bounds(rows, n)
    count = np.diff(at)
    if len(words) >= width:
        m = len(words) - width + 1
        h = words[:m].copy()
        for k in range(1, width):
            h = h * _STEP + words[k:k + m]
        h = T.mix(h)
    else:
        h = np.zeros(0, np.uint64)
    out = []
    for r in range(n):
        if count[r] >= width:
            out.append(np.unique(h[at[r]:at[r + 1] - width + 1]))
        elif count[r]:
            whole = np.uint64(count[r])
            for w in words[at[r]:at[r + 1]].tolist():
                whole = np.uint64((int(whole) * int(_STEP) + w) & 0xFFFFFFFFFFFFFFFF)
            out.append(T.mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS uint16 per set; an empty set has zeros. Minima of the uniform hashes give those of the exponentials."""
    least = np.full((len(sets), REGISTERS), 0xFFFFFFFF, np.uint32)
    for r, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        for k in range(0, len(x), 2048):
            np.minimum(least[r], (x[k:k + 2048, None] * _FACTORS).min(0), out=least[r])
    value = -np.log1p(-(least + 0.5) / 4294967296.0) / RATE
    out = np.clip(np.floor(1 - np.log(value) / np.log(BASE)), 0, LIMIT + 1).astype(np.uint16)
    out[[not len(s) for s in sets]] = 0
    return out


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sketch of the union."""
    return np.maximum(a, b)


def joint_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 64) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of register rows, given the set sizes, on a grid."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    u = (na / (na + nb))[:, None]
    v = 1 - u
    j = np.minimum(u / v, v / u) * np.linspace(0, 1, grid + 1)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    even = np.maximum(1 - up - down, 1e-12)
    best = (more * np.log(up) + less * np.log(down) + same * np.log(even)).argmax(1)
    return j[np.arange(len(j)), best]


def sketch(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, set_a, set_b, sketch`` per row of ``docs(doc_id, text)``; set_a and set_b name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.bytes_of(b.column(1))
            for i, j in T.runs(offsets):
                sets = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                names = np.array([(T.mix(s).sum(dtype=np.uint64), T.mix(s ^ _STEP).sum(dtype=np.uint64)) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([r.tobytes() for r in registers(sets)], pa.binary())],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, set_a bigint, set_b bigint, sketch binary")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose joint estimate is not far below the threshold."""
    for side in ("a", "b"):
        pairs = pairs.join(classes.select(F.col("rep").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    pairs = pairs.filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("sketch_a", "sketch_b"))
                est = joint_estimate(left, right, b.column("n_a").to_numpy().astype(float), b.column("n_b").to_numpy().astype(float))
                yield b.select(["a", "b"]).filter(pa.array(est >= threshold - SLACK))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full shingle sets reach ``percent`` of their union."""
    both = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sets = []
                for c in ("text_a", "text_b"):
                    data, offsets = T.bytes_of(part.column(c))
                    sets.append([s for i, j in T.runs(offsets) for s in shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])])
                good = []
                for x, y in zip(*sets, strict=True):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint").distinct()


def _sharing_rare(open_classes: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of classes with different labels that share one of their rarest shingles.

    Two sets of the wanted similarity must share one of the first ``n - ceil(percent * n) + 1`` shingles in
    any common order (prefix filter), and from the first one on must have enough left (positional
    filter). In the order of frequency, classes that drifted apart by many
    edits have only shingles of their own there, so a bucket full of them makes no pairs. Sets meet only in the size bands
    that both filters leave open, so texts that share a passage but not enough of it are not compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.bytes_of(b.column(2))
            for i, j in T.runs(offsets):
                sets = shingles(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                n = np.array([len(x) for x in sets])
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(b.column(c).to_numpy()[i:j], n)) for c in (0, 1)), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets).view(np.int64))], names=["rep", "label", "n", "shingle"]
                )

    rows = cut(open_classes.join(texts, "rep").select("rep", "label", "text").mapInArrow(run, "rep bigint, label bigint, n bigint, shingle bigint"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("freq")).filter("freq > 1")
    ranked = rows.join(shared, "shingle")  # shingles of one class alone come first in the order and are only counted
    of_class = Window.partitionBy("rep")
    place = F.col("n") - F.count("*").over(of_class) + F.row_number().over(of_class.orderBy("freq", "shingle"))
    prefix = cut(ranked.withColumn("place", place).filter(F.col("place") <= F.floor(F.col("n") * (100 - percent) / 100) + 1).select("shingle", "rep", "label", "n", (F.col("n") - F.col("place") + 1).alias("left")))
    # n_a + n_b <= (100 + percent) / percent * left for both sides: from their first common shingle on, two sets have at
    # most the smaller rest in common. So the smaller set names the sizes its partners can have, in bands of an eighth of a doubling
    most = F.least(F.floor(F.col("left") * (100 + percent) / percent) - F.col("n"), F.floor(F.col("n") * 100 / percent))
    band = lambda n: F.floor(F.log2(n.cast("double")) * 8).cast("int")
    smaller = prefix.withColumn("most", most).filter("most >= n").withColumn("band", F.explode(F.sequence(band(F.col("n")), band(F.col("most")))))
    larger = prefix.withColumn("band", band(F.col("n")))
    # a key that many sets have is cut into blocks of its smaller sets; the larger ones go to every block of theirs
    salt = F.pmod(F.xxhash64(F.lit("salt"), "rep"), F.col("blocks"))
    many = smaller.groupBy("shingle", "band").agg(F.ceil(F.count("*") / KEY_ROWS).alias("blocks"))
    small = smaller.join(many.hint("merge"), ["shingle", "band"]).withColumn("block", salt)
    large = larger.join(many.hint("merge"), ["shingle", "band"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    key = ["shingle", "band", "block"]
    left = small.select(*key, F.col("rep").alias("a"), F.col("label").alias("label_a"), F.col("n").alias("n_a"), F.col("left").alias("left_a"))
    right = large.select(*key, F.col("rep").alias("b"), F.col("label").alias("label_b"), F.col("n").alias("n_b"), F.col("left").alias("left_b"))
    enough = (100 + percent) * F.least("left_a", "left_b") >= percent * (F.col("n_a") + F.col("n_b"))
    order = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    near = order & (F.col("label_a") != F.col("label_b")) & enough
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in key]
    # tables of repeated shingles are small as files and large in memory: never a broadcast by file size
    found = left.alias("l").join(right.alias("r").hint("merge"), reduce(and_, same) & near)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row of ``docs(doc_id, text)``.

    Words are runs of non-space characters, A-Z lower-cased. Texts without words have no shingles and
    are linked with nothing. ``component_id`` is the smallest id reachable by links of at least
    ``percent`` similarity, ``kept`` tells that it is the row's own. Rows that share an id count as one
    document; rows without id join the component of an equal text that has one, and are else kept
    alone with a null component. Empty table: no rows. Other columns are not read.
    """
    threshold = percent / 100
    rows = cut(sketch(docs))
    named = rows.filter("n_shingles > 0 and doc_id is not null")
    classes = cut(named.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    width = 2 * ROWS
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", k * width + 1, width)) for k in range(REGISTERS // ROWS)])
    keys = classes.select("rep", F.explode(bands).alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("lead"), F.max("rep").alias("last")).filter("lead < last").select("key", "lead")
    live = cut(keys.join(buckets, "key"))
    members = live.select("rep").distinct()
    texts = cut(docs.select(F.col("doc_id").cast("long").alias("rep"), "text").join(members, "rep", "left_semi"))
    first = cut(live.filter("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct())
    links = cut(_verified(_likely(first, classes, threshold), texts, percent))
    nodes = members.select(F.col("rep").alias("node"))
    labels = cut(connected_labels(nodes, links))
    # classes of one bucket that are still apart
    placed = live.join(labels.withColumnRenamed("node", "rep"), "rep").select("key", "rep", "label")
    apart = placed.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).filter("least < most").select("key")
    rest = _sharing_rare(cut(placed.join(apart, "key").select("rep", "label").distinct()), texts, percent).join(first, ["a", "b"], "left_anti")
    more = cut(_verified(_likely(rest, classes, threshold), texts, percent))
    ends = more.join(labels.toDF("a", "label_a"), "a").join(labels.toDF("b", "label_b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    merged = connected_labels(labels.select(F.col("label").alias("node")).distinct(), ends).toDF("label", "component")
    final = labels.join(merged, "label").select(F.col("node").alias("rep"), "component")
    by_set = classes.select("set_a", "set_b", "rep").join(final, "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component"))
    out = rows.drop("sketch").join(by_set, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
