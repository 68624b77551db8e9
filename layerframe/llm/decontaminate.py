"""Benchmark decontamination by suffix arrays over the training texts.

Each task builds word suffix arrays over its shards of the training texts. The suffixes of all
benchmark items are looked up by binary search; every range found gives the locations of a verbatim
match, and the spans they cover decide whether the document goes.

A suffix array holds only the suffixes that begin with enough words of the benchmark to match any
window: the others cannot be found by any search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T

WINDOW = 13
BLOCK_BYTES = 16 << 20  # benchmark text that is broadcast at once; more is searched block after block


class Patterns:
    """The distinct windows of a block of benchmark items, as word numbers, by length."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        split = [(i, bytes(T.LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes())) for i, t in items]
        table = bytes(b if T.WORD[b] else 32 for b in range(256))
        texts = [(i, t.translate(table).split()) for i, t in split]
        names = sorted({w for _, ws in texts for w in ws})
        hashes = T.hash_words(names)
        order = np.argsort(hashes)
        self.vocabulary = hashes[order]  # number of a word: its place here, plus 1
        number = dict(zip((names[k] for k in order), range(1, len(names) + 1), strict=True))
        found: dict[tuple[int, ...], set[str]] = {}
        for item, ws in texts:
            ids = [number[w] for w in ws]
            n = min(window, len(ids))
            for k in range(len(ids) - n + 1 if n else 0):
                found.setdefault(tuple(ids[k:k + n]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[tuple[str, ...]]]] = {}
        for n in sorted({len(p) for p in found}):
            own = sorted(p for p in found if len(p) == n)
            self.by_length[n] = np.array(own, np.int32), [tuple(found[p]) for p in own]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers; 0 for words that no item has."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0).astype(np.int32)


def suffix_array(ids: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` sorted by the words that follow, to ``depth`` words; 0 ends a suffix. Prefix doubling."""
    n = len(ids)
    rank = ids.astype(np.int64)
    length = 1
    while length < depth:
        after = np.zeros(n, np.int64)
        if length < n:
            after[:n - length] = rank[length:]
        key = rank * (rank.max(initial=0) + 1) + after
        key[ids == 0] = 0  # nothing goes on beyond an end
        values, rank = np.unique(key, return_inverse=True)
        rank = rank.astype(np.int64) + (values[0] != 0 if len(values) else 0)
        length *= 2
        if len(values) == n:
            break
    return starts[np.argsort(rank[starts], kind="stable")]


def search(ids: np.ndarray, order: np.ndarray, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Range of ``order`` whose suffixes begin with each pattern, by binary search of all patterns at once."""
    padded = np.concatenate([ids, np.zeros(patterns.shape[1], ids.dtype)])

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order), np.int64)
        while (live := lo < hi).any():
            mid = (lo + hi) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            less, same, ended = np.zeros(len(patterns), bool), np.ones(len(patterns), bool), np.zeros(len(patterns), bool)
            for j in range(patterns.shape[1]):
                w = np.where(ended, 0, padded[at + j])
                ended |= w == 0
                less |= same & (w < patterns[:, j])
                same &= w == patterns[:, j]
            right = less | (same if upper else False)
            lo, hi = np.where(live & right, mid + 1, lo), np.where(live & ~right, mid, hi)
        return lo

    return bound(False), bound(True)


def find(ids: np.ndarray, rows: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Words covered by matches, and the items found in each row, of one shard of texts."""
    covered = np.zeros(len(ids) + 1, np.int64)
    items: dict[int, set[str]] = {}
    if not patterns.by_length or not len(ids):
        return covered[:-1] > 0, items
    least, most = min(patterns.by_length), max(patterns.by_length)
    # runs of known words within a row; only those long enough are kept, each ended by a 0
    known = ids > 0
    first = known.copy()
    first[1:] &= ~known[:-1] | (rows[1:] != rows[:-1])
    last = known.copy()
    last[:-1] &= ~known[1:] | (rows[1:] != rows[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    keep = b - a >= least
    a, b = a[keep], b[keep]
    if not len(a):
        return covered[:-1] > 0, items
    size = b - a + 1
    begin = np.cumsum(size) - size
    place = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(a, size)  # of each kept word in ids
    end = np.zeros(len(place), bool)
    end[begin + size - 1] = True
    short = np.where(end, 0, ids[np.minimum(place, len(ids) - 1)]).astype(np.int32)
    left = np.repeat(begin + size - 1, size) - np.arange(len(place))  # words up to the end of the run
    order = suffix_array(short, np.flatnonzero(left >= least), most)
    for n, (own, names) in patterns.by_length.items():
        lo, hi = search(short, order, own)
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            continue
        count = hi[hit] - lo[hit]
        which = np.repeat(hit, count)
        at = place[order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo[hit], count)]]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + n, -1)
        for row, k in np.unique(np.stack([rows[at], which]), axis=1).T.tolist():
            items.setdefault(row, set()).update(names[k])
    return np.cumsum(covered[:-1]) > 0, items


MARKED = "n_words bigint, hit_spans array<struct<start:bigint,end:bigint>>, item_ids array<string>"


def _mark(texts: pa.Array, before: pa.Array | None, patterns: Patterns) -> list[pa.Array]:
    data, offsets = T.bytes_of(texts)
    n_words, spans, items = [], [], []
    earlier = before.to_pylist() if before is not None else None
    for i, j in T.runs(offsets):
        base = offsets[i]
        part = T.LOWER[data[base:offsets[j]]]
        bounds = offsets[i:j + 1] - base
        s, e, rows = T.word_spans(part, bounds, T.WORD)
        ids = patterns.numbers(T.word_hashes(part, s, e))
        covered, found = find(ids, rows, patterns)
        at = T.row_bounds(rows, j - i)
        if earlier is not None:
            for k in range(j - i):
                for span in earlier[i + k]["hit_spans"]:
                    covered[at[k] + span["start"]:at[k] + span["end"]] = True
                if earlier[i + k]["item_ids"]:
                    found.setdefault(k, set()).update(earlier[i + k]["item_ids"])
        n_words += np.diff(at).tolist()
        own: list[list[dict]] = [[] for _ in range(j - i)]
        if covered.any():
            up = covered.copy()
            up[1:] &= ~covered[:-1] | (rows[1:] != rows[:-1])
            down = covered.copy()
            down[:-1] &= ~covered[1:] | (rows[1:] != rows[:-1])
            for x, y in zip(np.flatnonzero(up).tolist(), (np.flatnonzero(down) + 1).tolist(), strict=True):
                own[rows[x]].append({"start": x - int(at[rows[x]]), "end": y - int(at[rows[x]])})
        spans += own
        items += [sorted(found.get(k, ())) for k in range(j - i)]
    return [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of ``docs`` (with a text column), then MARKED, one row per row of ``docs``.

    Words: digits, a-z (A-Z lower-cased) and all beyond ASCII. ``hit_spans``: maximal runs [start, end)
    of word numbers covered by occurrences of benchmark windows; ``item_ids``: the items found, sorted
    as strings. A window is ``window`` words; an item of fewer, but not none, is one window. Null and
    empty texts have no words. Items without id count under the empty id, repeated items once. An
    empty benchmark marks nothing. The benchmark is the stated query set: its size is summed first, and
    beyond ``block_bytes`` it is searched in blocks, one pass over the texts after the other.
    """
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    out = docs.select(*[c for c in keep if c != "text"], "text")
    kept = out.schema
    marked = None
    for k in range(blocks):
        own = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        patterns = docs.sparkSession.sparkContext.broadcast(Patterns([(r.item_id, r.text) for r in own.collect()], window))

        def mark(batches: Iterator[pa.RecordBatch], patterns=patterns, again: bool = k > 0) -> Iterator[pa.RecordBatch]:
            for b in batches:
                text = b.column(len(kept) - 1)
                before = pa.StructArray.from_arrays([b.column("hit_spans"), b.column("item_ids")], names=["hit_spans", "item_ids"]) if again else None
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(len(kept))), *_mark(text, before, patterns.value)], names=[*kept.names, "n_words", "hit_spans", "item_ids"])

        marked = (out if marked is None else marked).mapInArrow(mark, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), MARKED]))
    return marked.drop("text") if "text" not in keep else marked


def verdicts(marked: DataFrame) -> DataFrame:
    """Adds ``n_hit, n_items, items_sha256, contaminated`` (hit, and at least a twentieth of the words)."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    out = marked.withColumn("n_hit", n_hit)
    return out.withColumns({
        "n_items": F.size("item_ids").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "item_ids").cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")),
    })


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    names = tuple(c for c in docs.columns if c != "text")
    inner = docs.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(names)], "text")
    marked = verdicts(mark_contamination(inner, benchmark, keep=(*[f"_{i}" for i in range(len(names))], "text"), **how))
    by_name = {c: f"_{i}" for i, c in enumerate(names)}
    return marked.filter(~F.col("contaminated")).select(*[F.col(by_name[c]).alias(c) if c in by_name else F.col("text") for c in docs.columns])
