"""Outlines of selections of parcels, for batches of selections in numpy: what parcels.py describes, without a row for a side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from terraloom.functions import cutting

#: Degrees: coordinates that agree to so many digits are one vertex (a tenth of a millimetre).
DIGITS = 9
#: Share of the summed area by which parcels may overlap.
SAME_AREA = 1e-6
#: Pairs of sides, or of sides and corners, that are worked on at once.
AT_ONCE = 1 << 18


def _turn(px, py, qx, qy, rx, ry) -> np.ndarray:
    return (qx - px) * (ry - py) - (qy - py) * (rx - px)


def _shoelace(seg: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Twice the signed area of each group of sides about its first side's start, in square degrees; of is ascending."""
    ox, oy = np.zeros(n), np.zeros(n)
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    ox[of[first]], oy[of[first]] = seg[first, 0], seg[first, 1]
    ax, ay, bx, by = seg.T
    return np.bincount(of, (ax - ox[of]) * (by - oy[of]) - (bx - ox[of]) * (ay - oy[of]), n)


def _begins(of: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(of, np.arange(n + 1))


def _pairs(of: np.ndarray, begins: np.ndarray):
    """(i, j) of each of the rows of groups ``of`` and all others of its group, which are those from begins on, in blocks."""
    size = np.diff(begins)[of]
    total, at = np.cumsum(size), 0
    while at < len(of):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        i = np.repeat(np.arange(at, to), size[at:to])
        yield i, begins[of[i]] + np.arange(len(i)) - np.repeat(np.cumsum(size[at:to]) - size[at:to], size[at:to])
        at = to


def borders(lon: np.ndarray, lat: np.ndarray, begins: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """(x, y, p, q, group): vertices of all selections (group), ascending by selection, x and y, and the pieces p to q of their open rings' sides, counter-clockwise, cut at the vertices; of: each
    ring's selection."""
    lon, lat = (np.round(v, DIGITS) + 0.0 for v in (lon, lat))
    seg, ring = cutting.around(lon, lat, begins), np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    real = (seg[:, 0] != seg[:, 2]) | (seg[:, 1] != seg[:, 3])
    seg, ring = seg[real], ring[real]
    good = (np.bincount(ring, minlength=len(begins) - 1) >= 3)[ring]
    seg, ring = seg[good], ring[good]
    back = (_shoelace(seg, ring, len(begins) - 1) < 0)[ring]
    seg = np.where(back[:, None], seg[:, [2, 3, 0, 1]], seg)
    own = of[ring]
    order = np.lexsort((seg[:, 1], seg[:, 0], own))
    new = np.append(True, (np.diff(own[order]) != 0) | (seg[order][1:, :2] != seg[order][:-1, :2]).any(1)) if len(order) else np.zeros(0, bool)
    x, y, group = seg[order][new, 0], seg[order][new, 1], own[order][new]
    a = np.zeros(len(order), np.int64)
    a[order] = np.cumsum(new) - 1
    # A side ends where its ring's next one begins; of a ring that was turned, where the one before does.
    size = np.bincount(ring, minlength=len(begins) - 1)
    at = np.arange(len(ring)) - (np.cumsum(size) - size)[ring]
    b = a[(np.cumsum(size) - size)[ring] + (at + np.where(back, -1, 1)) % size[ring]] if len(ring) else a
    dx, dy = x[b] - x[a], y[b] - y[a]
    square = dx * dx + dy * dy
    found = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    for i, c in _pairs(own, _begins(group, int(of.max(initial=-1)) + 1)):
        ux, uy = x[c] - x[a[i]], y[c] - y[a[i]]
        share = (ux * dx[i] + uy * dy[i]) / square[i]
        on = (c != a[i]) & (c != b[i]) & (share > 0) & (share < 1) & (np.abs(ux * dy[i] - uy * dx[i]) / np.sqrt(square[i]) <= 2 * 10**-DIGITS)
        found.append((i[on], share[on], c[on]))
    i, t, c = (np.concatenate(v) for v in zip(*found))
    side = np.arange(len(a))
    i, t, c = np.concatenate([side, i, side]), np.concatenate([np.full(len(a), -1.0), t, np.full(len(a), 2.0)]), np.concatenate([a, c, b])
    order = np.lexsort((c, t, i))
    i, c = i[order], c[order]
    same = np.flatnonzero(i[1:] == i[:-1])
    return x, y, c[same], c[same + 1], group


def union(rings: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(ring, area_m2, reason) of each selection of rings: ring and area are null with a reason."""
    n = len(rings)
    each, outer = cutting.spread(rings)
    lon, lat, begins = cutting.opened(*cutting.rings(each))
    of, ring = np.repeat(np.arange(n), np.diff(outer)), np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    twice = np.abs(_shoelace(cutting.around(lon, lat, begins), ring, len(begins) - 1))
    twice = np.bincount(of, twice, n)
    x, y, p, q, group = borders(lon, lat, begins, of)
    lo, hi, up = np.minimum(p, q), np.maximum(p, q), p < q
    order = np.lexsort((hi, lo))
    lo, hi, up = lo[order], hi[order], up[order]
    first = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))) if len(lo) else np.zeros(0, np.int64)
    ups, all_ = (np.add.reduceat(v.astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in (up, np.ones(len(up))))
    lo, hi, downs = lo[first], hi[first], all_ - ups
    sel = group[lo]
    doubled = np.bincount(sel, (ups > 1) | (downs > 1), n) > 0
    left = ups != downs
    a, b = np.where(ups > downs, lo, hi)[left], np.where(ups > downs, hi, lo)[left]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    own = group[a]
    edge, begin = np.stack([x[a], y[a], x[b], y[b]], 1), _begins(own, n)
    size = np.diff(begin)
    got, crossed = _shoelace(edge, own, n), np.zeros(n, bool)
    for i, j in _pairs(own, begin):
        (ax, ay, bx, by), (cx, cy, dx, dy) = edge[i].T, edge[j].T
        met = (_turn(ax, ay, bx, by, cx, cy) * _turn(ax, ay, bx, by, dx, dy) < 0) & (_turn(cx, cy, dx, dy, ax, ay) * _turn(cx, cy, dx, dy, bx, by) < 0)
        crossed[own[i[met]]] = True
    reason = np.full(n, "", object)
    reason[(size == 0) | ~(twice > 0)] = "invalid"
    told = lambda where, why: reason.__setitem__(where & (reason == ""), why)
    told(doubled | ~(np.abs(got - twice) <= SAME_AREA * twice) | crossed, "overlap")
    # One side starts at each corner, or two parcels meet in one alone.
    starts = np.bincount(own, np.append(True, a[1:] != a[:-1])[: len(a)], n)
    told(starts != size, "apart")
    # From the first side on, always to the side that starts where the last one ended. The first vertex is the westernmost, so it lies on an outer ring.
    where = np.full(len(x), -1)
    where[a] = np.arange(len(a))
    there, path, steps = np.zeros(len(a), bool), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    walk = np.flatnonzero(reason == "")
    now, k = begin[walk], 0
    while len(walk):
        there[now] = True
        path.append(now)
        steps.append(np.full(len(now), k))
        now, k = where[b[now]], k + 1
        on = now != begin[walk]
        walk, now = walk[on], now[on]
    path, steps = np.concatenate(path), np.concatenate(steps)
    path = path[np.lexsort((steps, own[path]))]
    around = _begins(own[path], n)
    rest = np.flatnonzero(~there & (reason[own] == ""))
    turned, has = _shoelace(edge[rest], own[rest], n), np.bincount(own[rest], minlength=n) > 0
    nested = np.zeros(n, bool)
    for i, j in _pairs(own[rest], around):
        lon, lat = edge[rest[i], 0], edge[rest[i], 1]
        ax, ay, bx, by = edge[path[j]].T
        rise = np.where(ay - by == 0, 2.220446049250313e-16, ay - by)
        met = ((by > lat) != (ay > lat)) & (lon < (ax - bx) * (lat - by) / rise + bx)
        nested[own[rest]] |= (np.bincount(i, met, len(rest)) % 2 == 1) & (turned[own[rest]] > 0)
    told(has & nested, "overlap")
    told(has & (turned < 0), "hole")
    told(has, "apart")
    good = reason == ""
    path = path[good[own[path]]]
    of, count = own[path], np.bincount(own[path], minlength=n)
    px, py = edge[path, 0], edge[path, 1]
    open_ = np.concatenate([[0], np.cumsum(count)])
    ref = tuple(np.bincount(of, v, n) / np.maximum(count, 1) for v in (px, py))
    mx, my = cutting.metres(px, py, ref, of)
    ax, ay, bx, by = cutting.around(mx, my, open_).T
    area = np.abs(np.bincount(of, ax * by - bx * ay, n)) / 2
    ends = np.flatnonzero(count)
    px, py = (np.insert(v, open_[ends + 1], v[open_[ends]]) for v in (px, py))
    closed = np.concatenate([[0], np.cumsum(count + (count > 0))])
    points = pa.StructArray.from_arrays([pa.array(px), pa.array(py)], ["lon", "lat"])
    return pa.ListArray.from_arrays(pa.array(closed, pa.int32()), points, mask=pa.array(~good)), pa.array(area, mask=~good), pa.array([r or None for r in reason], pa.string())
