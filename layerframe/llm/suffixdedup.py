"""Removal of long repeated substrings by sorted arrays of sampled suffixes.

The suffixes that are indexed start where a 32-byte gram has the least hash of its neighbourhood, so
every 100-byte string contains such an anchor, at the same place wherever the string occurs. Groups of
texts build the sorted array of the 100-byte strings around their anchors and resolve their own
repeats; the first occurrences that are left, with just the bytes around them, are merged across groups
by gram. Grams that only one group has are never moved further than a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as T

LENGTH, GRAM = 100, 32
GROUP_BYTES = 4 << 20
HOT = 4096  # anchors with one gram; beyond, their strings are merged one by one instead of by gram
NO_ID = (1 << 63) - 1


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, first, last, row): anchors with the range of the starts of the ``length``-byte strings they stand for.

    Of equal least hashes in a string the first is its anchor. ``bounds``: n + 1 row offsets from 0; no string crosses them.
    """
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < length:
        return z.view(np.uint64), z, z, z
    h = T.prefix_hash(data)
    inverse = T.powers(n + 1)[1]
    grams = (h[gram:] - h[:-gram]) * inverse[:n - gram + 1]
    bits = np.uint64(int(n).bit_length())
    key = ((grams >> bits) << bits) | np.arange(len(grams), dtype=np.uint64)
    width, done = length - gram + 1, 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    if width > done:
        key = np.minimum(key[:done - width], key[width - done:])
    starts = np.arange(len(key))
    row = np.searchsorted(bounds, starts, "right") - 1
    inside = starts + length <= bounds[row + 1]
    starts, row = starts[inside], row[inside]
    if not len(starts):
        return z.view(np.uint64), z, z, z
    at = (key[inside] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (row[1:] != row[:-1])])
    return T.mix(grams[at[new]]), starts[new], starts[np.r_[new[1:] - 1, len(starts) - 1]], row[new]


def strings(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """64-bit hashes of the ``length``-byte strings at ``starts``."""
    h = T.prefix_hash(data)
    return T.mix((h[starts + length] - h[starts]) * T.powers(len(data) + 1)[1][starts])


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all starts of the ranges, number of the range of each)."""
    size = last - first + 1
    which = np.repeat(np.arange(len(first)), size)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size), which


def repeated(h: np.ndarray) -> np.ndarray:
    """True for each hash that occurs earlier in the array."""
    later = np.ones(len(h), bool)
    later[np.unique(h, return_index=True)[1]] = False
    return later


def stretches(mask: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the first and last of each run of consecutive starts of one range where ``mask`` holds."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(which[at]) != 0) | (np.diff(starts[at]) != 1)]
    return at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]]


FOUND = "key bigint, g int, doc bigint, t bigint, start int, stop int, bytes binary"


def _found(key, g, doc, t, start, stop, texts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(g, pa.int32()), pa.array(doc, pa.int64()), pa.array(t, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(texts, pa.binary())],
        names=["key", "g", "doc", "t", "start", "stop", "bytes"],
    )


def _distinct(part: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, bounds, doc, t, chosen rows) of the first row of each text of a group, in document order."""
    doc = part.column("doc_id").fill_null(NO_ID).to_numpy()
    t = part.column("t").to_numpy()
    has = part.column("text").is_valid().to_numpy()
    order = np.lexsort((t, doc))
    order = order[has[order]]
    rows = order[np.sort(np.unique(t[order], return_index=True)[1])] if len(order) else order
    raw = part.column("text").take(pa.array(rows))
    data, offsets = T.bytes_of(raw)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0], doc[rows], t[rows], rows


def _chunks(bounds: np.ndarray) -> Iterator[tuple[int, int]]:
    return T.runs(bounds)


def remove_repeats(docs: DataFrame, length: int = LENGTH, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs(doc_id, text)``.

    Texts are UTF-8 bytes, null is empty. A byte goes if a ``length``-byte string that covers it also starts
    earlier: in a document with a smaller id, or before in the same one; strings are judged on the input.
    Rows without id come after all others. Of rows with equal id and text one stays and the rest count as
    later. Rows of one id with different texts are ordered by a hash of the text. Strings are compared by
    64-bit hashes among those with an equal gram. Empty table: no rows; other columns are not read.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    base = base.withColumn("g", F.pmod("t", F.lit(groups)).cast("int"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = T.bytes_of(b.column(0))
            g = b.column(1).to_numpy()
            out = []
            for i, j in T.runs(offsets):
                h, _, _, row = anchors(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], length)
                out.append((h, g[i + row]))
            h, own = (np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64) for k in (0, 1))
            h = h.view(np.int64)
            _, first, n = np.unique(h.view(np.uint64) ^ T.mix(own.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array((own[first].astype(np.int64) << 32) | np.minimum(n, 0x7FFFFFFF))], names=["h", "gn"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Grams that more than one group has, for each of the groups."""
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        h, gn = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(h, kind="stable")
        h, g, n = h[order], (gn >> 32)[order], (gn & 0xFFFFFFFF)[order]
        if not len(h):
            return
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        several = np.minimum.reduceat(g, first) != np.maximum.reduceat(g, first)
        hot = np.add.reduceat(n, first) > HOT
        size = np.diff(np.r_[first, len(h)])
        keep = np.repeat(several, size)
        yield pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(g[keep].astype(np.int32)), pa.array(np.repeat(hot, size)[keep])], names=["h", "g", "hot"])

    anchored = base.filter(F.octet_length("text") >= length).select("text", "g").mapInArrow(grams, "h bigint, gn bigint")
    common = anchored.repartition("h").mapInArrow(shared, "h bigint, g int, hot boolean").distinct()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts that a smaller id of the batch has too are sent on without their bytes."""
        for b in batches:
            doc, t = b.column(0).fill_null(NO_ID).to_numpy(), b.column(2).to_numpy()
            order = np.argsort(doc, kind="stable")
            again = np.zeros(len(t), bool)
            again[order] = repeated(t[order])
            size = np.diff(T.bytes_of(b.column(1))[1])
            text = pa.compute.if_else(pa.array(again & (size >= length)), pa.scalar(None, b.column(1).type), b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), text, b.column(2), b.column(3), pa.array(size)], names=["doc_id", "text", "t", "g", "n_bytes"])

    import pyarrow.compute  # noqa: F401  (pa.compute is used in tasks)

    sent = base.select("doc_id", "text", "t", "g").mapInArrow(once, "doc_id bigint, text string, t bigint, g int, n_bytes bigint").repartition("g")

    def local(part: pa.Table, grams_: pa.Table) -> pa.Table:
        """Repeats within the group, as spans; first occurrences whose gram other groups have, with their bytes."""
        data, bounds, doc, t, _ = _distinct(part)
        g = part.column("g")[0].as_py() if part.num_rows else 0
        known = grams_.column("h").to_numpy()
        order = np.argsort(known)
        known, hot_of = known[order], grams_.column("hot").to_numpy(zero_copy_only=False)[order]
        h, first, last, row = (list(x) for x in ([], [], [], []))
        for i, j in _chunks(bounds):
            a = anchors(data[bounds[i]:bounds[j]], bounds[i:j + 1] - bounds[i], length)
            for to, x in zip((h, first, last, row), (a[0], a[1] + bounds[i], a[2] + bounds[i], a[3] + i), strict=True):
                to.append(x)
        if not h:
            return pa.Table.from_batches([_found([], [], [], [], [], [], [])])
        h, first, last, row = (np.concatenate(x) for x in (h, first, last, row))
        h = h.view(np.int64)
        at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
        elsewhere = known[at] == h if len(known) else np.zeros(len(h), bool)
        _, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
        use = elsewhere | (n[inverse] > 1)
        h, first, last, row, elsewhere = h[use], first[use], last[use], row[use], elsewhere[use]
        hot = hot_of[at[use]] & elsewhere if len(known) else elsewhere
        starts, which = spread(first, last)
        hashes = np.zeros(len(starts), np.uint64)
        for i, j in _chunks(bounds):
            x, y = np.searchsorted(row[which], [i, j]) if len(which) else (0, 0)
            if y > x:
                hashes[x:y] = strings(data[bounds[i]:bounds[j]], starts[x:y] - bounds[i], length)
        later = repeated(hashes)
        a, b = stretches(later, starts, which)
        r = row[which[a]] if len(a) else a
        out = [_found(t[r], np.full(len(a), g), doc[r], t[r], starts[a] - bounds[r], starts[b] + length - bounds[r], [None] * len(a))]
        fresh = ~later & elsewhere[which] if len(which) else later
        a, b = stretches(fresh & ~hot[which], starts, which)
        r = row[which[a]] if len(a) else a
        raw = data.tobytes()
        out.append(_found(h[which[a]], np.full(len(a), g), doc[r], t[r], starts[a] - bounds[r], starts[b] + length - bounds[r], [raw[x:y + length] for x, y in zip(starts[a].tolist(), starts[b].tolist(), strict=True)]))
        a = np.flatnonzero(fresh & hot[which]) if len(which) else np.zeros(0, np.int64)
        r = row[which[a]] if len(a) else a
        out.append(_found(hashes[a].view(np.int64), np.full(len(a), g), doc[r], t[r], starts[a] - bounds[r], starts[a] + length - bounds[r], [b""] * len(a)))
        return pa.Table.from_batches(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Later occurrences across groups; rows come sorted by key. Spans pass through."""
        held: list[pa.RecordBatch] = []

        def resolve(table: pa.Table) -> pa.RecordBatch:
            kind = np.array([-1 if v is None else len(v) for v in table.column("bytes").to_pylist()])
            key, g, doc, t, start, stop = (table.column(c).to_numpy() for c in ("key", "g", "doc", "t", "start", "stop"))
            spans = [(g[kind < 0], t[kind < 0], start[kind < 0], stop[kind < 0])]
            one = np.flatnonzero(kind == 0)  # single strings, compared by their hash
            one = one[np.lexsort((start[one], t[one], doc[one]))]
            one = one[repeated(key[one])]
            spans.append((g[one], t[one], start[one], stop[one]))
            many = np.flatnonzero(kind > 0)
            many = many[np.lexsort((start[many], t[many], doc[many]))]
            if len(many):
                raw = table.column("bytes").take(pa.array(many))
                data, offsets = T.bytes_of(raw)
                data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
                first, last = offsets[:-1], offsets[1:] - length
                begin, which = spread(first, last)
                hashes = np.zeros(len(begin), np.uint64)
                for i, j in _chunks(offsets):
                    x, y = np.searchsorted(which, [i, j])
                    hashes[x:y] = strings(data[offsets[i]:offsets[j]], begin[x:y] - offsets[i], length)
                a, b = stretches(repeated(hashes), begin, which)
                r = many[which[a]] if len(a) else a
                own = begin[a] - first[which[a]] if len(a) else a
                spans.append((g[r], t[r], start[r] + own, start[r] + own + (begin[b] - begin[a]) + length))
            cols = [np.concatenate([s[k] for s in spans]) for k in range(4)]
            return pa.RecordBatch.from_arrays([pa.array(c.astype(k), v) for c, k, v in zip(cols, (np.int32, np.int64, np.int32, np.int32), (pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["g", "t", "start", "stop"])

        size = 0
        for b in batches:
            while b.num_rows:
                keys = b.column("key").to_numpy()
                if size > 40_000 and held and keys[0] != held[-1].column("key")[-1].as_py():
                    yield resolve(pa.Table.from_batches(held))
                    held, size = [], 0
                end = b.num_rows
                if size + end > 40_000:  # cut at the last change of key
                    change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
                    end = int(change[-1]) if len(change) else end
                held.append(b.slice(0, end))
                size += end
                b = b.slice(end)
                if size > 40_000 and b.num_rows:
                    yield resolve(pa.Table.from_batches(held))
                    held, size = [], 0
        if held:
            yield resolve(pa.Table.from_batches(held))

    found = sent.groupBy("g").cogroup(common.groupBy("g")).applyInArrow(local, FOUND)
    spans = found.repartition("key").sortWithinPartitions("key").mapInArrow(merge, "g int, t bigint, start int, stop int")

    def finish(part: pa.Table, marks: pa.Table) -> pa.Table:
        doc_ids, size, t = part.column("doc_id"), part.column("n_bytes").to_numpy(), part.column("t").to_numpy()
        n = part.num_rows
        removed, count = np.where(size >= length, size, 0), np.where(size >= length, 1, 0)
        sha = [hashlib.sha256(b"").hexdigest()] * n
        data, bounds, _, own, rows = _distinct(part)
        mt, ms, me = (marks.column(c).to_numpy() for c in ("t", "start", "stop"))
        order = np.lexsort((ms, mt))
        mt, ms, me = mt[order], ms[order].astype(np.int64), me[order].astype(np.int64)
        raw = data.tobytes()
        small = {}
        for k, r in enumerate(rows.tolist()):
            text = raw[bounds[k]:bounds[k + 1]]
            lo, hi = np.searchsorted(mt, [own[k], own[k] + 1]) if own[k] < NO_ID else (np.searchsorted(mt, own[k]), len(mt))
            parts, at, gone, runs = [], 0, 0, 0
            if hi > lo:
                ends = np.maximum.accumulate(me[lo:hi])
                new = np.r_[True, ms[lo + 1:hi] > ends[:-1]]
                for a, b in zip(ms[lo:hi][new].tolist(), ends[np.r_[np.flatnonzero(new)[1:] - 1, hi - lo - 1]].tolist(), strict=True):
                    parts.append(text[at:a])
                    at, gone, runs = b, gone + b - a, runs + 1
            parts.append(text[at:])
            removed[r], count[r], sha[r] = gone, runs, hashlib.sha256(b"".join(parts)).hexdigest()
            if len(text) < length:
                small[int(own[k])] = sha[r]
        if small:
            for r in np.flatnonzero(size < length).tolist():
                sha[r] = small[int(t[r])]
        return pa.Table.from_arrays([doc_ids, pa.array(size), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return sent.groupBy("g").cogroup(spans.groupBy("g")).applyInArrow(finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
