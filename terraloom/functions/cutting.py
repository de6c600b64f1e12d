"""Paths cut at the sides of rings, for batches of them in numpy.

Segments are rows (ax, ay, bx, by) in the order of their paths; ``path`` numbers the path of each, ascending. Sides are (paths, most sides, 4), padded with NaN, which is met by nothing;
a first dimension of 1 stands for all paths or points.
Paths are points (x, y) with begins: path i has those from begins[i] to begins[i + 1].
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa

EARTH_M, RAD = 6371008.8, math.pi / 180
#: Metres: points this near to a side lie on it; smaller gaps between pieces don't part them.
ON_SIDE, JOINED = 1e-5, 1e-7
#: Shares of a segment: closer cuts are one.
SAME_CUT = 1e-9
#: Segments that are worked on at once; their arrays stay in a core's cache.
AT_ONCE = 4096


def number(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for null."""
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def spread(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(values, begins) of a column of lists; a null list is empty."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    return column.flatten(), np.concatenate([[0], np.cumsum(sizes)])


def corners(values: pa.Array) -> np.ndarray:
    """(n, 4): the ends of sides given as structs a, b of (x, y)."""
    return np.stack([number(values.field(p).field(c)) for p in "ab" for c in "xy"], 1) if len(values) else np.zeros((0, 4))


def padded(ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Sides of groups begins[i] to begins[i + 1] as one array with NaN behind each group."""
    sizes = np.diff(begins)
    out = np.full((len(sizes), max(1, int(sizes.max(initial=0))), 4), np.nan)
    group = np.repeat(np.arange(len(sizes)), sizes)
    out[group, np.arange(len(group)) - begins[:-1][group]] = ends[: len(group)]
    return out


def opened(x: np.ndarray, y: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings without their closing points, where they have one."""
    sizes = np.diff(begins)
    some = np.flatnonzero(sizes > 1)
    first, last = begins[some], begins[some + 1] - 1
    closed = some[(x[first] == x[last]) & (y[first] == y[last])]
    stay = np.ones(len(x), bool)
    stay[begins[closed + 1] - 1] = False
    sizes[closed] -= 1
    return x[stay], y[stay], np.concatenate([[0], np.cumsum(sizes)])


def around(x: np.ndarray, y: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The sides of open rings, the last one of each back to its first point."""
    after = np.arange(len(x)) + 1
    some = np.diff(begins) > 0
    after[begins[1:][some] - 1] = begins[:-1][some]
    return np.stack([x, y, x[after], y[after]], 1)


def rings(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lon, lat, begins) of a column of rings or paths."""
    points, begins = spread(column)
    return number(points.field("lon")), number(points.field("lat")), begins


def framed(ring: pa.Array, exclusions: pa.Array) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(ref, sides) of columns of rings and arrays of rings: the means of the rings, and all sides of a field in metres about its own, padded."""
    x, y, begins = opened(*rings(ring))
    field = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    mean = lambda v: np.bincount(field, v, len(begins) - 1) / np.maximum(np.diff(begins), 1)
    ref = mean(x), mean(y)
    holes, outer = spread(exclusions)
    hx, hy, inner = opened(*rings(holes))
    hole = np.repeat(np.repeat(np.arange(len(outer) - 1), np.diff(outer)), np.diff(inner))
    ends = np.concatenate([around(*metres(x, y, ref, field), begins), around(*metres(hx, hy, ref, hole), inner)])
    owner = np.concatenate([field, hole])
    order = np.argsort(owner, kind="stable")
    sides = padded(ends[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(begins) - 1))]))
    # Exclusions of nothing are no region.
    sides[~ring.is_valid().to_numpy(zero_copy_only=False)] = np.nan
    return ref, sides


def turned(ring: pa.Array, exclusions: pa.Array, cos: np.ndarray, sin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(outer, holes, of): the sides of rings and of each exclusion in metres about its field's ring's mean, turned, padded; ``of`` is the field of each exclusion. Rings of fewer than three points have no sides."""
    x, y, begins = opened(*rings(ring))
    field = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    ref = tuple(np.bincount(field, v, len(begins) - 1) / np.maximum(np.diff(begins), 1) for v in (x, y))
    each, outer = spread(exclusions)
    hx, hy, inner = opened(*rings(each))
    of = np.repeat(np.arange(len(outer) - 1), np.diff(outer))

    def sides(x: np.ndarray, y: np.ndarray, begins: np.ndarray, field: np.ndarray) -> np.ndarray:
        x, y = metres(x, y, ref, field)
        out = padded(around(x * cos[field] - y * sin[field], x * sin[field] + y * cos[field], begins), begins)
        out[np.diff(begins) < 3] = np.nan
        return out

    return sides(x, y, begins, field), sides(hx, hy, inner, np.repeat(of, np.diff(inner))), of


def metres(lon: np.ndarray, lat: np.ndarray, ref: tuple[np.ndarray, np.ndarray], field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Metres east and north of each point's field's ref."""
    return (lon - ref[0][field]) * RAD * EARTH_M * np.cos(ref[1] * RAD)[field], (lat - ref[1][field]) * RAD * EARTH_M


def parts(seg: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, s, e): the shares s to e of segment i between two cuts; a crossing cuts once, a side on the same line at both its ends."""
    ax, ay, bx, by = (seg[:, c, None] for c in range(4))
    dx, dy = bx - ax, by - ay
    sx, sy = sides[..., 2] - sides[..., 0], sides[..., 3] - sides[..., 1]
    cx, cy = sides[..., 0] - ax, sides[..., 1] - ay
    det = dx * sy - dy * sx
    t = (cx * sy - cy * sx) / det
    within = lambda v: (v >= -SAME_CUT) & (v <= 1 + SAME_CUT)
    # Few pairs of a segment and a side meet; the rest is worked out for those alone.
    i, j = np.nonzero(within(t) | (np.abs(det) <= 1e-10))
    det, t, cx, cy, sx, sy, dx, dy = det[i, j], t[i, j], cx[i, j], cy[i, j], *((v[0, j] if v.shape[0] == 1 else v[i, j]) for v in (sx, sy)), dx[i, 0], dy[i, 0]
    beside, square = cx * dy - cy * dx, dx * dx + dy * dy
    cross = (np.abs(det) > 1e-10) & within(beside / det)
    along = (np.abs(det) <= 1e-10) & (square >= 1e-12) & (np.abs(beside) <= 1e-8)
    found = [(i[cross], t[cross])] + [(i[along & within(v)], v[along & within(v)]) for v in ((cx * dx + cy * dy) / square, ((cx + sx) * dx + (cy + sy) * dy) / square)]
    i, v = np.concatenate([i for i, _ in found]), np.clip(np.concatenate([v for _, v in found]), 0, 1)
    all_ = np.arange(len(seg))
    i, v = np.concatenate([all_, all_, i]), np.concatenate([np.zeros(len(seg)), np.ones(len(seg)), v])
    order = np.lexsort((v, i))
    i, v = i[order], v[order]
    apart = np.ones(len(i), bool)
    apart[1:] = (i[1:] != i[:-1]) | (v[1:] - v[:-1] > SAME_CUT)
    i, v = i[apart], v[apart]
    same = i[1:] == i[:-1]
    return i[:-1][same], v[:-1][same], v[1:][same]


def holds(x: np.ndarray, y: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether a region holds each point: an odd number of its rings around it, or a side through it."""
    x, y = x[:, None], y[:, None]
    px, py = sides[..., 0], sides[..., 1]
    sx, sy = sides[..., 2] - px, sides[..., 3] - py
    square, beside = sx * sx + sy * sy, sx * (y - py) - sy * (x - px)
    i, j = np.nonzero((py > y) != (sides[..., 3] > y))
    of = lambda v: v[0, j] if v.shape[0] == 1 else v[i, j]
    out = np.bincount(i[x[i, 0] < of(sx) * (y[i, 0] - of(py)) / of(sy) + of(px)], minlength=len(x))
    # Only what is near a side's line can lie on the side.
    i, j = np.nonzero(beside * beside <= 1.001 * ON_SIDE * ON_SIDE * square)
    dx, dy, ex, ey, square = x[i, 0] - of(px), y[i, 0] - of(py), of(sx), of(sy), of(square)
    t = np.where(square > 0, np.clip((dx * ex + dy * ey) / square, 0, 1), 0.0)
    on = np.zeros(len(x), bool)
    on[i[np.hypot(dx - t * ex, dy - t * ey) <= ON_SIDE]] = True
    return on | (out % 2 == 1)


def apart(seg: np.ndarray, sides: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which segments lie wholly on one side of each of their sides' lines, further than ON_SIDE from it, so that they meet none; row: each segment's row of sides, ascending."""
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
    out = np.zeros(len(seg), bool)
    # A row of sides is worked on at once; where each has few segments that would take longer than the rest of the cutting.
    if len(begins) * 64 > len(seg):
        return out
    for i, j in zip(begins, np.append(begins[1:], len(seg))):
        px, py, qx, qy = sides[row[i]][~np.isnan(sides[row[i]]).any(1)].T
        sx, sy = qx - px, qy - py
        # Twice the area of the triangle of a side and a point is linear in the point.
        turn = np.stack([-sy, sx, sy * px - sx * py], 1)
        a, b = (turn @ np.stack([seg[i:j, c], seg[i:j, c + 1], np.ones(j - i)]) for c in (0, 2))
        far = (1.1 * ON_SIDE * np.hypot(sx, sy) + 1e-9)[:, None]
        out[i:j] = ((np.minimum(a, b) > far) | (np.maximum(a, b) < -far)).all(0)
    return out


def _between(seg: np.ndarray, i: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """What of segments i lies between the shares s and e."""
    ax, ay, bx, by = seg[i].T
    dx, dy = bx - ax, by - ay
    return np.stack([ax + s * dx, ay + s * dy, ax + e * dx, ay + e * dy], 1)


def pieces(seg: np.ndarray, path: np.ndarray, sides: np.ndarray, keep: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, begins, owner, piece) of what is kept of paths cut at their sides; keep(x, y, path) judges the middle of each part, and parts that follow each other are one piece.

    owner: the path of each piece; pieces count from 1 along a path. row: each path's row of sides, ascending, if paths share them. Segments that run on and come near no side are judged by the first of them.
    """
    ends, owners = [np.zeros((0, 4))], [np.zeros(0, np.int64)]
    at = path if row is None and len(sides) > 1 else np.zeros(len(path), np.int64) if row is None else row[path]
    # Few of the segments of paths that share sides meet any, so more of them are worked on at once.
    step = AT_ONCE if row is None else 4 * AT_ONCE
    for c in range(0, len(seg), step):
        some, own, of = seg[c : c + step], path[c : c + step], at[c : c + step]
        plain = apart(some, sides, of)
        runs = np.zeros(len(some), bool)
        runs[1:] = plain[1:] & plain[:-1] & (own[1:] == own[:-1]) & (some[1:, 0] == some[:-1, 2]) & (some[1:, 1] == some[:-1, 3])
        met = np.flatnonzero(~plain)
        i, s, e = parts(some[met], sides if len(sides) == 1 else sides[of[met]])
        first = np.flatnonzero(plain & ~runs)
        i, s, e = np.concatenate([met[i], first]), np.concatenate([s, np.zeros(len(first))]), np.concatenate([e, np.ones(len(first))])
        ends_ = _between(some, i, s, e)
        of, mid = own[i], _between(some, i, (s + e) / 2, e)
        good = keep(mid[:, 0], mid[:, 1], of)
        # The others of a run are as its first one is.
        stays = np.zeros(len(some), bool)
        stays[first] = good[len(good) - len(first) :]
        rest = np.flatnonzero(runs)
        rest = rest[stays[np.maximum.accumulate(np.where(runs, 0, np.arange(len(some))))[rest]]]
        i, ends_ = np.concatenate([i[good], rest]), np.concatenate([ends_[good], some[rest]])
        order = np.argsort(i, kind="stable")
        ends.append(ends_[order])
        owners.append(own[i[order]])
    end, owner = np.concatenate(ends), np.concatenate(owners)
    new = np.ones(len(end), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (np.hypot(end[1:, 0] - end[:-1, 2], end[1:, 1] - end[:-1, 3]) > JOINED)
    at = np.arange(len(end)) + np.cumsum(new)
    xy = np.empty((len(end) + int(new.sum()), 2))
    xy[at], xy[at[new] - 1] = end[:, 2:], end[new, :2]
    owner = owner[new]
    return xy[:, 0], xy[:, 1], np.concatenate([at[new] - 1, [len(xy)]]), owner, np.arange(len(owner)) - np.searchsorted(owner, owner) + 1


def segments(x: np.ndarray, y: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seg, path) of consecutive points."""
    path = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    k = np.flatnonzero(path[1:] == path[:-1])
    return np.stack([x[k], y[k], x[k + 1], y[k + 1]], 1), path[k]


def lengths(x: np.ndarray, y: np.ndarray, begins: np.ndarray) -> np.ndarray:
    seg, path = segments(x, y, begins)
    return np.bincount(path, np.hypot(seg[:, 2] - seg[:, 0], seg[:, 3] - seg[:, 1]), len(begins) - 1)


def trimmed(x: np.ndarray, y: np.ndarray, begins: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, begins, owner) of paths without ``cut`` metres at both ends; what is no longer than twice that and 5 cm goes altogether."""
    sizes = np.diff(begins)
    if not cut.any() and sizes.all():
        return x, y, begins.astype(np.int64), np.arange(len(sizes))
    path = np.repeat(np.arange(len(sizes)), sizes)
    inner = np.zeros(len(x), bool)
    inner[1:] = path[1:] == path[:-1]
    d = np.zeros(len(x))
    d[1:] = np.where(inner[1:], np.hypot(np.diff(x), np.diff(y)), 0.0)
    # Sums of each path alone, as a sum that runs on from path to path would differ in the last bits; side by side where the paths are about as long.
    end, most = d.copy(), int(sizes.max(initial=0))
    if len(sizes) * most <= 8 * len(x) + 1024:
        table, place = np.zeros((len(sizes), most)), np.arange(len(x)) - begins[:-1][path]
        table[path, place] = d
        end = np.cumsum(table, 1)[path, place]
    else:
        order = np.argsort(-sizes, kind="stable")
        for k in range(1, most):
            at = begins[order[: np.searchsorted(-sizes[order], -k)]] + k
            end[at] += end[at - 1]
    total = np.where(sizes > 0, end[np.maximum(begins[1:] - 1, 0)], 0.0) if len(x) else np.zeros(len(sizes))
    lo, hi, begin = cut[path], (total - cut)[path], end - d
    stay = ((cut == 0) | (total > 2 * cut + 0.05))[path]
    marks = [np.flatnonzero(stay & ((lo == 0) | ((end > lo) & (end < hi))))] + [np.flatnonzero(stay & (lo > 0) & inner & (begin < m) & (end >= m)) for m in (lo, hi)]
    at, where = np.concatenate(marks), np.concatenate([end[marks[0]], lo[marks[1]], hi[marks[2]]])
    share = np.ones(len(at))
    some = np.arange(len(at)) >= len(marks[0])
    share[some] = ((where - begin[at]) / np.where(d[at] > 0, d[at], 1))[some]
    order = np.lexsort((where, at))
    at, share = at[order], share[order]
    before = np.maximum(at - 1, 0)
    put = lambda v: np.where(share == 1, v[at], v[before] + share * (v[at] - v[before]))
    owner, count = np.unique(path[at], return_counts=True)
    return put(x), put(y), np.concatenate([[0], np.cumsum(count)]).astype(np.int64), owner


def listed(begins: np.ndarray, **values: np.ndarray) -> pa.Array:
    """A column of lists of structs."""
    return pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays([pa.array(v) for v in values.values()], list(values)))
