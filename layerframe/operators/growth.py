"""Layers inside tasks: neighbours, cycles, growth and centroid vectors of all groups that a task holds, in one exchange.

The rules are those of the set operators in :mod:`points`, :mod:`cycles` and :mod:`lattice`, which keep their rounds in stored
tables. Here the points of a group are rows of one task, and a step or round is a few array operations over all
groups that the task has read since the last ones, so none is stored or sent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cycles as C

#: What a row of `layers` tells: a cycle of a patch, an edge between centroids, a group.
CYCLE, EDGE, GROUP = 0, 1, 2

#: Rows of whole groups that grow together, and combinations of matched atoms that are compared at once.
ROWS, COMBINATIONS = 1 << 15, 1 << 20
#: Width of a cell in radii: a little over two, so that a disc with its rounding errors meets two cells a side at most.
WIDTH = 2.0 + 1e-6


def _key(g: np.ndarray, cx: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Hash of a cell of a group; other cells with the same hash only add candidates."""
    with np.errstate(invalid="ignore"):
        h = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + cx.astype(np.int64).view(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + cy.astype(np.int64).view(np.uint64)
        return (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the list, place in it) of each entry of lists of the given lengths."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


class _Grid:
    """Points by cell, one cell as wide as two radii of their group: a disc meets four cells at most."""

    def __init__(self, g: np.ndarray, x: np.ndarray, y: np.ndarray, radius: np.ndarray):
        self.g, self.x, self.y = g, x, y
        key = _key(g, np.floor(x / (WIDTH * radius)), np.floor(y / (WIDTH * radius)))
        self.order = np.argsort(key, kind="stable")
        self.keys, self.start, self.count = np.unique(key[self.order], return_index=True, return_counts=True)

    def near(self, g: np.ndarray, x: np.ndarray, y: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, point, squared distance) of all pairs of one group within the radius."""
        found = []
        if len(self.keys) and len(g):
            r = radius * (1 + 1e-9)
            lo, hi = ([np.floor((v + s * r) / (WIDTH * radius)) for v in (x, y)] for s in (-1, 1))
            for i in range(4):
                q = np.flatnonzero(((i < 2) | (hi[0] > lo[0])) & ((i % 2 == 0) | (hi[1] > lo[1])))
                key = _key(g[q], (hi if i >= 2 else lo)[0][q], (hi if i % 2 else lo)[1][q])
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                q, at = q[hit], at[hit]
                row, n = _spread(self.count[at])
                found.append((q[row], self.order[self.start[at][row] + n]))
        q, p = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        dx, dy = self.x[p] - x[q], self.y[p] - y[q]
        d2 = dx * dx + dy * dy
        ok = (self.g[p] == g[q]) & (d2 <= radius[q] * radius[q])
        return q[ok], p[ok], d2[ok]


def score(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(score, strict): :func:`cycles.with_score` of quadrilaterals (n, 4, 2)."""
    v = np.roll(xy, -1, axis=1) - xy
    n = np.sqrt(v[..., 0] * v[..., 0] + v[..., 1] * v[..., 1])
    u = np.where(n[..., None] >= 1e-12, v / np.maximum(n, 1e-300)[..., None], 0.0)
    side = (n[:, 0] + n[:, 1] + n[:, 2] + n[:, 3]) / 4.0
    off = (n - side[:, None]) ** 2
    cv = np.where(side > 1e-9, np.sqrt((off[:, 0] + off[:, 1] + off[:, 2] + off[:, 3]) / 4.0) / np.maximum(side, 1e-300), 1e9)

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.degrees(np.arccos(np.minimum(1.0, np.abs(a[..., 0] * b[..., 0] + a[..., 1] * b[..., 1]))))

    par0, par1 = between(u[:, 0], u[:, 2]), between(u[:, 1], u[:, 3])
    angs = between(u[:, :1], u)
    angs[:, 0] = 0.0
    first = np.argmax(angs, axis=1)
    sep, far = angs[np.arange(len(u)), first], u[np.arange(len(u)), first]
    group = angs > between(u, far[:, None])
    ones = group.sum(axis=1)
    opposite = (group[:, 0] == group[:, 2]).astype(int) + (group[:, 1] == group[:, 3])
    pen = ((cv / 0.12) ** 2 + (par0 / 8.0) ** 2 + (par1 / 8.0) ** 2 + ((angs[:, 1] - 60.0) / 15.0) ** 2 + ((sep - 60.0) / 20.0) ** 2
           + np.abs(2 - ones) ** 2.0 + (2.0 - opposite) ** 2)
    bad = (side < 1e-6) | (sep < 25.0) | (ones == 0) | (ones == 4)
    out = np.where(bad, -1e9, 1.0 / (1.0 + pen))
    strict = (out > 0) & (par0 <= 6.0) & (par1 <= 6.0) & (angs[:, 1] >= 45.0) & (angs[:, 1] <= 75.0) & (sep >= 35.0) & (ones == 2) & (opposite == 2)
    return out, strict


def _crossing(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of quadrilaterals of one instance with properly crossing edges, met in the cells of their boxes; ``cell``: width per instance."""

    def laid(i: np.ndarray, xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = (np.floor(f(axis=1) / cell[i][:, None]) for f in (xy.min, xy.max))
        size = (hi - lo + 1).astype(np.int64)
        row, n = _spread(size[:, 0] * size[:, 1])
        return row, _key(i[row], lo[row, 0] + n // size[row, 1], lo[row, 1] + n % size[row, 1])

    (ra, ka), (rb, kb) = laid(ia, a), laid(ib, b)
    order = np.argsort(kb, kind="stable")
    keys, start, count = np.unique(kb[order], return_index=True, return_counts=True)
    if not len(keys) or not len(ka):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, ka), len(keys) - 1)
    hit = keys[at] == ka
    row, n = _spread(count[at[hit]])
    pair = np.unique(ra[hit][row] * len(ib) + rb[order[start[at[hit]][row] + n]])
    p, q = pair // len(ib), pair % len(ib)
    ok = (ia[p] == ib[q]) & (a.min(axis=1)[p] < b.max(axis=1)[q]).all(axis=1) & (b.min(axis=1)[q] < a.max(axis=1)[p]).all(axis=1)
    p, q = p[ok], q[ok]
    a1, b1 = a[p][:, :, None], b[q][:, None]
    r, s, d = np.roll(a[p], -1, axis=1)[:, :, None] - a1, np.roll(b[q], -1, axis=1)[:, None] - b1, b1 - a1
    den = r[..., 0] * s[..., 1] - r[..., 1] * s[..., 0]
    some = np.abs(den) >= 1e-12
    safe = np.where(some, den, 1.0)
    t, u = (d[..., 0] * s[..., 1] - d[..., 1] * s[..., 0]) / safe, (d[..., 0] * r[..., 1] - d[..., 1] * r[..., 0]) / safe
    cross = (some & (t > 1e-9) & (t < 1.0 - 1e-9) & (u > 1e-9) & (u < 1.0 - 1e-9)).any(axis=(1, 2))
    return p[cross], q[cross]


def _axial(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Angle between two undirected axes in degrees, 90 for a vanishing one."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    flat = (na < 1e-12) | (nb < 1e-12)
    cos = np.abs(np.clip((a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1]) / np.where(flat, 1.0, na * nb), -1.0, 1.0))
    return np.where(flat, 90.0, np.degrees(np.arccos(cos)))


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.sqrt((v * v).sum(axis=1))[:, None]
    return np.where(n >= 1e-9, v / np.maximum(n, 1e-300), np.array([1.0, 0.0]))


def _directions(a: np.ndarray, b: np.ndarray, max_hop: int) -> np.ndarray:
    """(instances, directions, 2): :func:`cycles._directions`."""
    c = np.where((_axial(a, b) < 90.0)[:, None], a + b, b - a)
    return np.stack([v * float(n) for v in (a, -a, b, -b, c, -c) for n in range(1, max_hop + 1)], axis=1)


class Patches:
    """Groups of points with candidate cycles: arrays over all of them.

    ``g, x, y``: group (from 0, in order) and place of each point, points of a group in the order of their ids; ``nn_med``, ``scale``
    (px per Angstrom) per group; ``cg, cv, cxy, cs``: group, vertices (numbers of points), corners and score of each candidate.
    """

    def __init__(self, g, x, y, nn_med, scale, cg, cv, cxy, cs):
        self.g, self.x, self.y, self.nn_med, self.scale = g, x, y, nn_med, scale
        self.cg, self.cv, self.cxy, self.cs = cg, cv, cxy, cs
        self.first = np.searchsorted(g, np.arange(len(nn_med)))
        self.size = np.bincount(g, minlength=len(nn_med))
        self.snap, self.cell = np.maximum(2.0, 0.35 * nn_med), 1.5 * nn_med
        self.grid = _Grid(g, x, y, self.snap[g])

    def _matched(self, of: np.ndarray, places: np.ndarray, free: np.ndarray, offset: np.ndarray, match_k: int) -> tuple[np.ndarray, np.ndarray]:
        """(prediction, its four atoms) for the predictions ``places`` (n, 4, 2) of the instances' groups ``of`` that match: least sum of distances."""
        q, p, d2 = self.grid.near(np.repeat(of, 4), places[..., 0].ravel(), places[..., 1].ravel(), np.repeat(self.snap[of], 4))
        ok = free[offset[q // 4] + p]
        q, p, d2 = q[ok], p[ok], d2[ok]
        order = np.lexsort((p, d2, q))
        q, p, d = q[order], p[order], np.sqrt(d2[order])
        count = np.bincount(q, minlength=4 * len(of))
        start = (np.cumsum(count) - count).reshape(-1, 4)
        count = np.minimum(count, match_k).reshape(-1, 4)
        whole = np.flatnonzero((count > 0).all(axis=1))
        work = np.cumsum(count[whole].prod(axis=1))
        out = [(np.zeros(0, np.int64), np.zeros((0, 4), np.int64))]
        for part in np.split(whole, np.flatnonzero(np.diff(work // COMBINATIONS)) + 1):
            pred, met = part, []
            for v in range(4):
                row, n = _spread(count[pred, v])
                opt = start[pred[row], v] + n
                met = [m[row] for m in met]
                ok = np.ones(len(row), bool)
                for m in met:
                    ok &= p[m] != p[opt]
                pred, met = pred[row[ok]], [*[m[ok] for m in met], opt[ok]]
            if len(pred) > 1 and (pred[1:] == pred[:-1]).any():
                cost = d[met[0]] + d[met[1]] + d[met[2]] + d[met[3]]
                ties = [x for m in reversed(met) for x in (p[m], d[m])]
                order = np.lexsort((*ties, cost, pred))
                order = order[np.r_[True, pred[order][1:] != pred[order][:-1]]]
                pred, met = pred[order], [m[order] for m in met]
            out.append((pred, np.stack([p[m] for m in met], axis=1)))
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])

    def grow(self, of: np.ndarray, v: np.ndarray, xy: np.ndarray, a: np.ndarray, b: np.ndarray, max_hop: int, no_intersect: bool, old: tuple | None = None,
             min_score: float = 0.20, merge_tol: float = 2.0, match_k: int = 8) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(instance, vertices, corners, seq) of the cycles grown from one seed per instance; ``of``: groups of the instances.

        ``old``: (instance, vertices, corners) of cycles of earlier components.
        """
        offset = np.cumsum(self.size[of]) - self.size[of] - self.first[of]  # of an instance's points in its own copy of the flags
        free = np.ones(int(self.size[of].sum()), bool)
        cell = self.cell[of]
        if old is not None:
            free[(offset[old[0]][:, None] + old[1]).ravel()] = False
        template = xy - self._centre(xy)[:, None]
        steps = _directions(a, b, max_hop)
        n_dir = steps.shape[1]
        done_i, done_v, done_xy, done_seq = np.arange(len(of)), v, xy, np.zeros(len(of), np.int64)
        free[(offset[:, None] + v).ravel()] = False

        def children(i: np.ndarray, xy: np.ndarray, seq: np.ndarray) -> list[np.ndarray]:
            at = self._centre(xy)[:, None] + steps[i]
            return [np.repeat(i, n_dir), np.repeat(seq, n_dir) * 64 + np.tile(np.arange(n_dir), len(i)), at.reshape(-1, 2)]

        base = np.ones(len(of), np.int64)
        pi, rank, at = children(done_i, done_xy, done_seq)
        while len(pi):
            # predictions close to an accepted centre are settled
            c = self._centre(done_xy)
            near, _, _ = _Grid(done_i, c[:, 0], c[:, 1], np.full(len(c), merge_tol)).near(pi, at[:, 0], at[:, 1], np.full(len(pi), merge_tol))
            open_ = np.ones(len(pi), bool)
            open_[near] = False
            pi, rank, at = pi[open_], rank[open_], at[open_]
            k, m = self._matched(of[pi], at[:, None] + template[pi], free, offset[pi], match_k)
            quad = np.stack([self.x[m], self.y[m]], axis=-1)
            good = score(quad)[0] >= min_score
            k, m, quad = k[good], m[good], quad[good]
            # one candidate per vertex set: the earliest prediction
            vs = np.sort(m, axis=1)
            order = np.lexsort((rank[k], *vs.T, pi[k]))
            same = (pi[k][order][1:] == pi[k][order][:-1]) & (vs[order][1:] == vs[order][:-1]).all(axis=1)
            one = order[np.r_[np.ones(min(1, len(order)), bool), ~same]]
            k, m, quad = k[one], m[one], quad[one]
            if no_intersect and len(k):
                hit, _ = _crossing(pi[k], quad, done_i, done_xy, cell)
                stay = np.ones(len(k), bool)
                stay[hit] = False
                if old is not None:
                    stay[_crossing(pi[k], quad, old[0], old[2], cell)[0]] = False
                k, m, quad = k[stay], m[stay], quad[stay]
            if not len(k):
                break
            i, rk, slots = pi[k], rank[k], offset[pi[k]][:, None] + m
            least = np.full(len(free), np.iinfo(np.int64).max)
            np.minimum.at(least, slots.ravel(), np.repeat(rk, 4))
            late = (least[slots] < rk[:, None]).any(axis=1)
            if no_intersect:
                p, q = _crossing(i, quad, i, quad, cell)
                apart = ~(m[p][:, :, None] == m[q][:, None]).any(axis=(1, 2))
                late[p[apart & (rk[q] < rk[p])]] = True
            new = np.flatnonzero(~late)
            new = new[np.lexsort((rk[new], i[new]))]
            added = np.bincount(i[new], minlength=len(of))
            seq = base[i[new]] + _spread(added)[1]
            base += added
            free[slots[new].ravel()] = False
            done_i, done_v = np.concatenate([done_i, i[new]]), np.concatenate([done_v, m[new]])
            done_xy, done_seq = np.concatenate([done_xy, quad[new]]), np.concatenate([done_seq, seq])
            again = k[late]
            pi, rank, at = (np.concatenate([x, y[again]]) for x, y in zip(children(i[new], quad[new], seq), (pi, rank, at), strict=True))
        return done_i, done_v, done_xy, done_seq

    @staticmethod
    def _centre(xy: np.ndarray) -> np.ndarray:
        return (xy[:, 0] + xy[:, 1] + xy[:, 2] + xy[:, 3]) / 4.0

    def components(self, da: float, db: float, max_hop: int, max_components: int, no_intersect: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(component, group, vertices, corners, seq) of the patches; see :func:`lattice.grow_components`."""
        used, live = np.zeros(len(self.g), bool), np.ones(len(self.nn_med), bool)
        old = np.zeros(0, np.int64), np.zeros((0, 4), np.int64), np.zeros((0, 4, 2))

        for comp in range(max_components):
            c = np.flatnonzero(live[self.cg] & ~used[self.cv].any(axis=1))
            c = c[np.lexsort((*self.cv[c][:, [2, 0, 3, 1]].T, -self.cs[c], self.cg[c]))]
            c = c[np.r_[np.ones(min(1, len(c)), bool), self.cg[c][1:] != self.cg[c][:-1]]]
            if not len(c):
                return
            of, v, xy = self.cg[c], self.cv[c], self.cxy[c]
            u0, u1 = _unit(xy[:, 1] - xy[:, 0]), _unit(xy[:, 2] - xy[:, 1])
            la, lb = (da * self.scale[of])[:, None], (db * self.scale[of])[:, None]
            a, b = np.concatenate([u0 * la, u0 * lb]), np.concatenate([u1 * lb, u1 * la])
            two = np.concatenate([of, of])
            n = np.bincount(self.grow(two, np.concatenate([v, v]), np.concatenate([xy, xy]), a, b, 2, False)[0], minlength=len(two)).reshape(2, -1)
            pick = (n[1] > n[0]) * len(of) + np.arange(len(of))
            a, b = a[pick], b[pick]
            # a later seed that crosses an accepted patch starts nothing
            stay = np.ones(len(of), bool)
            number = np.full(len(self.nn_med), -1)
            number[of] = np.arange(len(of))
            mine = number[old[0]] >= 0
            before = number[old[0][mine]], old[1][mine], old[2][mine]
            if no_intersect and len(before[0]):
                p, q = _crossing(np.arange(len(of)), xy, before[0], before[2], self.cell[of])
                stay[p[~(v[p][:, :, None] == before[1][q][:, None]).any(axis=(1, 2))]] = False
            live[:] = False
            live[of[stay]] = True
            if not stay.any():
                return
            left = np.cumsum(stay) - 1
            kept = stay[before[0]]
            i, nv, nxy, seq = self.grow(of[stay], v[stay], xy[stay], a[stay], b[stay], max_hop, no_intersect, (left[before[0][kept]], before[1][kept], before[2][kept]))
            g = of[stay][i]
            used[nv.ravel()] = True
            old = tuple(np.concatenate(x) for x in zip(old, (g, nv, nxy), strict=True))
            yield comp, g, nv, nxy, seq




def knn(g: np.ndarray, x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(point, neighbour, rank from 0, squared distance) of the k nearest others in the group; ties go to the lower number.

    Discs are doubled until they hold k others or the whole group; ``g`` is sorted, from 0.
    """
    size = np.bincount(g)
    first = np.cumsum(size) - size
    ext = np.maximum(np.maximum(*[np.maximum.reduceat(v, first) - np.minimum.reduceat(v, first) for v in (x, y)]), 1e-9) if len(g) else np.zeros(0)
    r, whole = ext / np.maximum(4, size), 3.0 * ext
    open_, found = np.flatnonzero(size[g] > 1), []
    while len(open_):
        live = np.zeros(len(size), bool)
        live[g[open_]] = True
        there = np.flatnonzero(live[g])
        q, p, d2 = _Grid(g[there], x[there], y[there], r[g[there]]).near(g[open_], x[open_], y[open_], r[g[open_]])
        p, q_all = there[p], open_[q]
        other = p != q_all
        q, p, d2 = q[other], p[other], d2[other]
        done = (np.bincount(q, minlength=len(open_)) >= np.minimum(k, size[g[open_]] - 1)) | ~(r[g[open_]] < whole[g[open_]])
        take = done[q]
        found.append((open_[q[take]], p[take], d2[take]))
        open_ = open_[~done]
        r = r * 2
    q, p, d2 = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in range(3))
    order = np.lexsort((p, d2, q))
    q, p, d2 = q[order], p[order], d2[order]
    rank = _spread(np.bincount(q, minlength=len(g)))[1]
    near = rank < k
    return q[near], p[near], rank[near], d2[near]


def quantile(g: np.ndarray, v: np.ndarray, n: int, p: float) -> np.ndarray:
    """Exact interpolated quantile of each of ``n`` groups; nan for one without values."""
    v = v[np.lexsort((v, g))]
    size = np.bincount(g, minlength=n)
    first, at = np.cumsum(size) - size, p * (size - 1)
    some = size > 0
    low, high = (np.where(some, v[np.where(some, first + f(at), 0).astype(np.int64)], np.nan) if len(v) else np.full(n, np.nan) for f in (np.floor, np.ceil))
    return np.where(low == high, low, low + (high - low) * (at - np.floor(at)))


def four_cycles(g: np.ndarray, x: np.ndarray, y: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Vertices (n, 4) of :func:`cycles.enumerate_cycles`; ``limit`` per group."""
    n, r = len(g), limit[g]
    i, j, _ = _Grid(g, x, y, r).near(g, x, y, r)
    i, j = i[i != j], j[i != j]
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    keys, degree = i * n + j, np.bincount(i, minlength=n)
    start = np.cumsum(degree) - degree

    def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, a * n + b), max(0, len(keys) - 1))
        return keys[at] == a * n + b if len(keys) else np.zeros(len(a), bool)

    edge = np.flatnonzero(i < j)
    row, at = _spread(degree[i[edge]])
    k = j[start[i[edge]][row] + at]
    ok = (k != j[edge][row]) & linked(j[edge][row], k)
    row, k = row[ok], k[ok]
    count = np.bincount(row, minlength=len(edge))
    after = count[row] - (np.arange(len(row)) - (np.cumsum(count) - count)[row]) - 1
    pair, at = _spread(after)
    a, b, e = k[pair], k[pair + 1 + at], edge[row[pair]]
    one = ~linked(a, b) | (j[e] < a)
    return np.stack([a, i[e], b, j[e]], axis=1)[one]


def _half_turn(v: np.ndarray) -> np.ndarray:
    a = np.fmod(np.degrees(np.arctan2(v[:, 1], v[:, 0])), 180.0)
    return np.where(a < 0, np.fmod(a + 180.0, 180.0), a)


def in_main_direction(g: np.ndarray, v: np.ndarray, xy: np.ndarray, n: int, tol: float, min_cluster: int = 4) -> np.ndarray:
    """Which cycles :func:`cycles.dominant_direction_filter` keeps."""
    tol = max(1.0, tol)
    a, b = xy[:, 2] - xy[:, 0], xy[:, 3] - xy[:, 1]
    u = _unit(np.where((np.sqrt((b * b).sum(axis=1)) > np.sqrt((a * a).sum(axis=1)))[:, None], b, a))
    at, m = _half_turn(u), len(g)
    t = np.concatenate([at, at + 180.0, at + 360.0, at + 180.0 - tol, at + 180.0 + tol])
    sign = np.repeat([0, 0, 0, -1, 1], m)
    order = np.lexsort((sign, t, np.tile(g, 5)))
    seen = np.empty(5 * m, np.int64)
    seen[order] = np.cumsum(sign[order] == 0)
    count = seen[4 * m:] - seen[3 * m:4 * m]
    order = np.lexsort((v[:, 2], v[:, 0], v[:, 3], v[:, 1], -count, g))
    lead = order[np.r_[np.ones(min(1, m), bool), g[order][1:] != g[order][:-1]]]
    ref, best = np.tile([1.0, 0.0], (n, 1)), np.zeros(n, np.int64)
    ref[g[lead]], best[g[lead]] = u[lead], count[lead]
    near = _axial(ref[g], u) <= tol
    along = np.where((u[:, 0] * ref[g][:, 0] + u[:, 1] * ref[g][:, 1] < 0.0)[:, None], -u, u)
    mean = np.stack([np.bincount(g[near], along[near][:, c], n) for c in (0, 1)], axis=1)
    axis = np.where((np.sqrt((mean * mean).sum(axis=1)) > 1e-9)[:, None], _unit(mean), ref)
    free = (np.bincount(g, minlength=n) < max(1, min_cluster)) | (best < max(2, min_cluster // 2))
    return free[g] | (_axial(u, axis[g]) <= tol)


def short(g: np.ndarray, d: np.ndarray, n: int, max_rounds: int = 25) -> np.ndarray:
    """Which lengths are in the shorter of two clusters, or all when that is too small: :func:`lattice.short_vectors` for groups of four and more."""
    c0, c1 = quantile(g, d, n, 0.2), quantile(g, d, n, 0.8)
    top = np.full(n, -np.inf)
    np.maximum.at(top, g, d)
    c1 = np.where(np.abs(c1 - c0) < 1e-9, top, c1)
    for _ in range(max_rounds):
        high = np.abs(d - c1[g]) < np.abs(d - c0[g])
        new = []
        for part, old in ((~high, c0), (high, c1)):
            size = np.bincount(g[part], minlength=n)
            new.append(np.where(size > 0, np.bincount(g[part], d[part], n) / np.maximum(size, 1), old))
        if np.array_equal(new[0], c0, equal_nan=True) and np.array_equal(new[1], c1, equal_nan=True):
            break
        c0, c1 = new
    low = (np.abs(d - c1[g]) >= np.abs(d - c0[g])) == (c0 <= c1)[g]
    size = np.bincount(g, minlength=n)
    few = np.bincount(g[low], minlength=n) < np.maximum(8, np.floor(size * 0.25))
    return few[g] | low


def layers(points: DataFrame, images: DataFrame, keys: list[str], dist_factor: float, strict: bool, reject_flip: bool, flip_tol: float,
           da_angstrom: float, db_angstrom: float, max_hop: int, max_components: int, min_atoms: int) -> DataFrame:
    """Cycles of the grown patches, edges between their centroids and one row per group; ``kind`` tells which.

    ``images``: keys and px_per_angstrom, one row per group; groups without one, or of fewer than ``min_atoms`` points, have no row.
    One exchange, of the points. Columns of a kind, others are null:
    CYCLE: p0..p3, x0..y3, cx, cy, seq, component. EDGE: p0 < p1 (numbers of centroids), x0, y0 (vector from the lower one), cx (length).
    GROUP: seq (0: no neighbours, 1: no cycle, 2: none that scores, 3: none in the main direction, 4: the rest), component (cycles of the
    patches), cx and cy (median and least distance of the centroids), h (:func:`lattice.direction_histogram`).
    """
    ids = dict(points.dtypes)["pt_id"]
    rows = points.select(*keys, F.lit(1).alias("_kind"), F.col("pt_id").cast("bigint").alias("p"), F.col("x").cast("double"), F.col("y").cast("double"))
    rows = rows.unionByName(images.select(*keys, F.lit(0).alias("_kind"), F.lit(None).cast("bigint").alias("p"), F.col("px_per_angstrom").cast("double").alias("x"), F.lit(None).cast("double").alias("y")))

    def groups(t: pa.Table) -> np.ndarray:
        """Number of each row's group; rows of a group adjoin."""
        new = np.zeros(t.num_rows, bool)
        for k in keys:
            code = t.column(k).combine_chunks().dictionary_encode()
            code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.fill_null(-1).to_numpy()
            new[1:] |= code[1:] != code[:-1]
        return np.cumsum(new)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < ROWS:
                continue
            t = pa.Table.from_batches(held)
            at = groups(t)
            end = int(np.searchsorted(at, at[-1]))  # the last group may go on in the next batch
            if end:
                yield from grown(t.slice(0, end), at[:end])
            held, n = t.slice(end).to_batches(), (t.num_rows - end if end else 0)
        if held:
            t = pa.Table.from_batches(held)
            yield from grown(t, groups(t))

    def grown(t: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        point = t.column("_kind").to_numpy() == 1
        size = np.bincount(group[point], minlength=group[-1] + 1)
        image = np.zeros(len(size), bool)
        image[group[~point]] = True
        col = lambda c, at: t.column(c).take(pa.array(at)).to_numpy()
        there = point & np.isfinite(t.column("x").to_numpy()) & np.isfinite(t.column("y").to_numpy())
        whole = image & (size >= min_atoms) & (np.bincount(group[there], minlength=len(size)) > 0)
        number, own = np.cumsum(whole) - 1, np.flatnonzero(there & whole[group])
        head = np.flatnonzero(~point & whole[group])
        head = head[np.r_[np.ones(min(1, len(head)), bool), group[head][1:] != group[head][:-1]]]
        if not len(head):
            return
        n, g, pt, x, y = len(head), number[group[own]], col("p", own), col("x", own), col("y", own)
        stage = np.zeros(n, np.int32)
        q, _, _, d2 = knn(g, x, y, 1)
        nn = quantile(g[q], np.sqrt(d2), n, 0.5)
        near = np.nan_to_num(nn) > 0
        stage[near] = 1
        some = np.flatnonzero(near[g])
        v = some[four_cycles(g[some], x[some], y[some], nn * dist_factor)]
        xy = np.stack([x[v], y[v]], axis=-1)
        cg = g[v[:, 0]]
        stage[cg] = 2
        points_, tight = score(xy)
        good = points_ > 0.20
        if strict:
            good &= tight
        v, xy, cg, points_ = v[good], xy[good], cg[good], points_[good]
        stage[cg] = 3
        if reject_flip:
            good = in_main_direction(cg, v, xy, n, flip_tol)
            v, xy, cg, points_ = v[good], xy[good], cg[good], points_[good]
        stage[cg] = 4
        patches = Patches(g, x, y, np.where(near, nn, 1.0), col("x", head), cg, v, xy, points_)
        found = list(patches.components(da_angstrom, db_angstrom, max_hop, max_components, True))

        def out(kind: int, of: np.ndarray, **cols: np.ndarray) -> pa.RecordBatch:
            made = [x.chunk(0) if isinstance(x := t.column(k).take(pa.array(head[of])).combine_chunks(), pa.ChunkedArray) else x for k in keys]
            made.append(pa.array(np.full(len(of), kind, np.int32)))
            for name, kind_of in types:
                made.append(pa.array(cols[name], kind_of) if name in cols else pa.nulls(len(of), kind_of))
            return pa.RecordBatch.from_arrays(made, names=[*keys, "kind", *(name for name, _ in types)])

        for comp, of, nv, nxy, seq in found:
            c = Patches._centre(nxy)
            yield out(CYCLE, of, **{f"p{i}": pt[nv[:, i]] for i in range(4)}, **{f"{a}{i}": nxy[:, i, j] for i in range(4) for j, a in enumerate("xy")}, cx=c[:, 0], cy=c[:, 1], seq=seq, component=np.full(len(of), comp))
        cycles = np.zeros(n, np.int64)
        hist, med, least = [None] * n, np.full(n, np.nan), np.full(n, np.nan)
        if found:
            # one number per cycle: the least vertex id is unique, cycles are disjoint
            cg, name = np.concatenate([f[1] for f in found]), pt[np.concatenate([f[2] for f in found])].min(axis=1)
            c = Patches._centre(np.concatenate([f[3] for f in found]))
            cycles = np.bincount(cg, minlength=n)
            order = np.lexsort((name, cg))
            order = order[cycles[cg[order]] >= 2]
            cg, name, c = cg[order], name[order], c[order]
            number = np.cumsum(cycles >= 2) - 1
            q, p, rank, d2 = knn(number[cg], c[:, 0], c[:, 1], 6)
            d, step = np.sqrt(d2), c[p] - c[q]
            one = rank == 0
            med = quantile(cg[q[one]], d[one], n, 0.5)
            least = np.full(n, np.inf)
            np.minimum.at(least, cg[q[one]], d[one])
            # an edge found from either end counts once; its vector follows the lower number
            a, b = np.minimum(q, p), np.maximum(q, p)
            _, edge = np.unique(a * len(c) + b, return_index=True)
            along = np.where((q < p)[:, None], step, -step)[edge]
            yield out(EDGE, cg[a[edge]], p0=name[a[edge]], p1=name[b[edge]], x0=along[:, 0], y0=along[:, 1], cx=d[edge])
            far = d >= 1e-9
            q, p, d, step = q[far], p[far], d[far], step[far]
            vg = cg[q]
            big = cycles[vg] >= 4
            stay = ~big & (q < p)
            stay[big] = short(vg[big], d[big], n)
            at = np.minimum(179, np.floor(_half_turn(step[stay]))).astype(np.int64)
            bins = np.bincount(vg[stay] * 180 + at, minlength=180 * n).reshape(n, 180)
            some = bins.any(axis=1)
            hist = [h.tolist() if s else None for h, s in zip(bins, some, strict=True)]
        yield out(GROUP, np.arange(n), seq=stage, component=cycles, cx=med, cy=least, h=hist)

    types = [*((v, pa.int64()) for v in C.VERTS), *((c, pa.float64()) for c in [*C.COORDS, "cx", "cy"]), ("seq", pa.int32()), ("component", pa.int32()), ("h", pa.list_(pa.int64()))]
    kinds = dict(points.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "kind int", *(f"{v} bigint" for v in C.VERTS), *(f"{c} double" for c in [*C.COORDS, "cx", "cy"]), "seq int", "component int", "h array<bigint>"])
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "_kind", "p")
    return dealt.mapInArrow(task, schema).withColumns({v: F.col(v).cast(ids) for v in C.VERTS})
