"""Cells of plane regions, for batches of fields in numpy: what slabs.py describes, a field's sides at a time without a row for a side.

Sides are rows (x1, y1, x2, y2) with ``field``, ascending, and ``ring``: 0 is the field's own, the others are those that cut it. Fields of about as many sides are
worked on together, and neither the pairs of a large field's sides nor its slabs are held at once.
"""

from __future__ import annotations

import numpy as np

from terraloom.functions import cutting

#: Metres: what is no height or no shared side; exclusions that end so near the perimeter reach it.
THIN, CONTACT = 1e-9, 0.001
#: Values that an array of sides by sides or slabs by sides may have.
AT_ONCE = 1 << 18


def reaching(outer: np.ndarray, holes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The sides of exclusions whose sides along the perimeter, not further than CONTACT from it, are moved 2 mm beyond it; outer: the perimeters, ``of``: each exclusion's."""
    out = holes.copy()
    for at in range(0, len(of), max(1, AT_ONCE // max(1, outer.shape[1] * holes.shape[1]))):
        some = slice(at, at + max(1, AT_ONCE // max(1, outer.shape[1] * holes.shape[1])))
        out[some] = _reaching(outer[of[some]], holes[some])
    return out


def _reaching(walls: np.ndarray, holes: np.ndarray) -> np.ndarray:
    ax, ay, bx, by = (walls[..., c] for c in range(4))
    sign = np.where(np.nansum(ax * by - bx * ay, 1) < 0, -1.0, 1.0)[:, None]
    m = np.hypot(bx - ax, by - ay)
    m = np.where(m > THIN, m, np.nan)
    nx, ny = sign * (by - ay) / m, sign * (ax - bx) / m
    px, py = holes[..., 0, None], holes[..., 1, None]
    gap = (px - ax[:, None]) * nx[:, None] + (py - ay[:, None]) * ny[:, None]
    along = sign[..., None] * (nx[:, None] * (py - ay[:, None]) - ny[:, None] * (px - ax[:, None]))
    on = (np.abs(gap) <= CONTACT) & (along >= -CONTACT) & (along <= m[:, None] + CONTACT)
    # Corner i begins side i; the side before a ring's first one is its last.
    size = np.count_nonzero(~np.isnan(holes[..., 0]), 1)[:, None]
    corner = np.arange(holes.shape[1])[None]
    each = np.arange(len(holes))[:, None]
    next_, before_ = np.where(corner + 1 < size, corner + 1, 0), np.where(corner > 0, corner - 1, np.maximum(size - 1, 0))
    both = on & on[each, next_]
    after = np.where(both.any(2), both.argmax(2), -1)
    before = after[each, before_]
    x, y = holes[..., 0].copy(), holes[..., 1].copy()
    for wall, some in ((before, before >= 0), (after, (after >= 0) & (after != before))):
        h, i = np.nonzero(some)
        w = wall[h, i]
        push = 2 * CONTACT - gap[h, i, w]
        x[h, i] += nx[h, w] * push
        y[h, i] += ny[h, w] * push
    near = on.any((1, 2))[:, None]
    x, y = np.where(near, x, holes[..., 0]), np.where(near, y, holes[..., 1])
    return np.stack([x, y, x[each, next_], y[each, next_]], -1) * np.where(corner < size, 1.0, np.nan)[..., None]


def flat(outer: np.ndarray, holes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sides, field, ring) of padded sides of fields and of the rings that cut them; ``of``, ascending, is each one's field."""
    number = np.arange(len(of)) - np.searchsorted(of, of) + 1
    i, a = np.nonzero(~np.isnan(outer[..., 0]))
    h, b = np.nonzero(~np.isnan(holes[..., 0]))
    return np.concatenate([outer[i, a], holes[h, b]]), np.concatenate([i, of[h]]), np.concatenate([np.zeros(len(i), np.int64), number[h]])


def cells(sides: np.ndarray, field: np.ndarray, ring: np.ndarray, keep: str) -> dict[str, np.ndarray]:
    """field, slab, cell (both from 1 within the field), y0, y1, l0, r0, l1, r1 of all cells kept (``difference`` or ``intersection``), by field, from below and from the left."""
    order = np.lexsort((sides[:, 3], sides[:, 2], sides[:, 1], sides[:, 0], ring, field))
    order = order[(sides[order, 1] != sides[order, 3]) & np.isfinite(sides[order]).all(1)]
    sides, field, ring = sides[order], field[order], ring[order]
    names, begins = np.unique(field, return_index=True)
    sizes = np.diff(np.append(begins, len(field)))
    found = []
    # Fields of one number of sides together: none is padded.
    for n in np.unique(sizes):
        own = np.flatnonzero(sizes == n)
        step = max(1, AT_ONCE // int(n * n))
        for at in range(0, len(own), step):
            mine = own[at : at + step]
            rows = begins[mine][:, None] + np.arange(n)
            f, *rest = _cells(sides[rows], ring[rows], keep)
            found.append([names[mine[f]], *rest])
    out = [np.concatenate(v) for v in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 6
    order = np.argsort(out[0], kind="stable")
    f, *rest = (v[order] for v in out)
    return {"field": f, "cell": np.arange(len(f)) - np.searchsorted(f, f) + 1, **dict(zip(("slab", "y0", "y1", "l0", "r0", "l1", "r1"), rest))}


def _heights(xa: np.ndarray, ya: np.ndarray, yb: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """Sorted heights of ends and crossings of each field's sides, NaN behind them."""
    n = xa.shape[1]
    found = [np.concatenate([ya, yb], 1)]
    i, j = np.triu_indices(n, 1) if n * n <= AT_ONCE else (None, None)
    blocks = [(i, j)] if i is not None else [(np.full(n - k - 1, k), np.arange(k + 1, n)) for k in range(n - 1)]
    for i, j in blocks:
        y = (xa[:, j] - ya[:, j] * slope[:, j] - xa[:, i] + ya[:, i] * slope[:, i]) / (slope[:, i] - slope[:, j])
        good = (y > np.maximum(ya[:, i], ya[:, j])) & (y < np.minimum(yb[:, i], yb[:, j]))
        # Few sides cross; columns without a crossing are left out, or what a large field keeps would be all its pairs.
        some = good.any(0)
        found.append(np.where(good, y, np.nan)[:, some])
    return np.sort(np.concatenate(found, 1), 1)


def _cells(sides: np.ndarray, ring: np.ndarray, keep: str) -> tuple[np.ndarray, ...]:
    low = sides[..., 1] < sides[..., 3]
    xa, ya, xb, yb = (np.where(low, sides[..., a], sides[..., b]) for a, b in ((0, 2), (1, 3), (2, 0), (3, 1)))
    slope = (xb - xa) / (yb - ya)
    ys = _heights(xa, ya, yb, slope)
    of, at = np.nonzero(np.diff(ys, axis=1) > THIN)
    y0, y1, slab = ys[of, at], ys[of, at + 1], np.arange(len(of)) - np.searchsorted(of, of) + 1
    step, found = max(1, AT_ONCE // xa.shape[1]), []
    for k in range(0, len(of), step):
        f, lo, hi = of[k : k + step], y0[k : k + step, None], y1[k : k + step, None]
        l0, l1 = (xa[f] + (y - ya[f]) * slope[f] for y in (lo, hi))
        spans = (ya[f] <= lo + THIN) & (yb[f] >= hi - THIN)
        # Sides are sorted by ring, so a stable sort leaves ties in the order of rings.
        order = np.argsort(np.where(spans, l0 + l1, np.inf), axis=1, kind="stable")[:, : max(1, int(spans.sum(1).max(initial=0)))]
        there, l0, l1, r = (np.take_along_axis(v, order, 1) for v in (spans, l0, l1, ring[f]))
        inside = (np.cumsum(there & (r == 0), 1) & 1).astype(bool)
        cut = np.zeros(inside.shape, bool)
        for n in np.unique(ring[ring > 0]):
            cut |= (np.cumsum(there & (r == n), 1) & 1).astype(bool)
        inside &= cut if keep == "intersection" else ~cut
        width = np.where(there[:, 1:], l0[:, 1:] - l0[:, :-1] + l1[:, 1:] - l1[:, :-1], np.nan)
        i, s = np.nonzero(inside[:, :-1] & there[:, :-1] & (width > THIN))
        found.append((f[i], slab[k + i], y0[k + i], y1[k + i], l0[i, s], l0[i, s + 1], l1[i, s], l1[i, s + 1]))
    return tuple(np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * 6)


def areas(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["y1"] - c["y0"]) * (c["r0"] - c["l0"] + c["r1"] - c["l1"]) / 2


def parts(c: dict[str, np.ndarray]) -> np.ndarray:
    """The connected part of each cell, from 1 within its field in the order of first cells: cells of neighbouring slabs are connected if they share more than a point."""
    n = len(c["field"])
    row = np.cumsum(np.append(True, (c["field"][1:] != c["field"][:-1]) | (c["slab"][1:] != c["slab"][:-1]))) - 1 if n else np.zeros(0, np.int64)
    begins = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if n else np.zeros(0, np.int64)
    ends = np.append(begins[1:], n)
    below = row - 1
    some = np.flatnonzero((below >= 0) & (c["field"][begins[below]] == c["field"]) & (c["slab"][begins[below]] == c["slab"] - 1)) if n else np.zeros(0, np.int64)
    pairs = []
    for d in range(int((ends - begins).max(initial=0))):
        mine = some[begins[below[some]] + d < ends[below[some]]]
        under = begins[below[mine]] + d
        met = np.minimum(c["r0"][mine], c["r1"][under]) - np.maximum(c["l0"][mine], c["l1"][under]) > THIN
        pairs.append((mine[met], under[met]))
    a, b = (np.concatenate(v) for v in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            break
    first = np.cumsum(label == np.arange(n))
    at = np.searchsorted(c["field"], c["field"])
    return first[label] - first[at] + 1


def portions(c: dict[str, np.ndarray], part: np.ndarray) -> dict[str, np.ndarray]:
    """field, part, area, x and y of each part's widest cell's middle (of equal ones the first), portions: how many the field has."""
    order = np.lexsort((part, c["field"]))
    new = np.append(True, (c["field"][order][1:] != c["field"][order][:-1]) | (part[order][1:] != part[order][:-1])) if len(order) else np.zeros(0, bool)
    begins, group = np.flatnonzero(new), np.cumsum(new) - 1
    width = (c["r0"] - c["l0"] + c["r1"] - c["l1"])[order]
    widest = order[np.lexsort((-width, group))[begins]]
    field = c["field"][widest]
    count = np.searchsorted(field, field, "right") - np.searchsorted(field, field)
    x, y = (c["l0"] + c["r0"] + c["l1"] + c["r1"])[widest] / 4, (c["y0"] + c["y1"])[widest] / 2
    return {"field": field, "part": part[widest], "area": np.bincount(group, areas(c)[order], len(begins)), "x": x, "y": y, "portions": count}


def lonlat(x: np.ndarray, y: np.ndarray, ring, field: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees of points in metres about their fields' rings' means."""
    lon, lat, begins = cutting.opened(*cutting.rings(ring))
    of, size = np.repeat(np.arange(len(begins) - 1), np.diff(begins)), np.maximum(np.diff(begins), 1)
    lon, lat = (np.bincount(of, v, len(size)) / size for v in (lon, lat))
    metre = cutting.RAD * cutting.EARTH_M
    return lon[field] + x / (metre * np.cos(lat * cutting.RAD)[field]), lat[field] + y / metre


def field_sides(ring, exclusions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """flat() of columns of rings and arrays of rings, in metres about each ring's mean, exclusions reaching the perimeter that they touch; rings of fewer than three points are left out."""
    plain = np.ones(len(ring))
    outer, holes, of = cutting.turned(ring, exclusions, plain, 0 * plain)
    sides, field, number = flat(outer, reaching(outer, holes, of), of)
    # What is cut out of nothing is nothing.
    some = ~np.isnan(outer[field, 0, 0])
    return sides[some], field[some], number[some]


def owners(seg: np.ndarray, line: np.ndarray, field: np.ndarray, c: dict[str, np.ndarray], part: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(line, part) of the part that holds the greatest length of each line, of those that don't differ by more than ``least`` the first; of a line outside all the nearest. seg: segments
    (ax, ay, bx, by) with their line and that line's field; c, part: the fields' cells, ascending by field. Lines of fields without any cell have none."""
    begin, end = np.searchsorted(c["field"], field), np.searchsorted(c["field"], field, "right")
    total, own = np.cumsum(end - begin), []
    # Segments in blocks, as each meets all cells of its field; a line's segments stay together.
    whole = np.append(np.flatnonzero(line[1:] != line[:-1]) + 1, len(line)) if len(line) else np.zeros(0, np.int64)
    at = 0
    while at < len(line):
        done = total[at - 1] if at else 0
        to = int(whole[max(np.searchsorted(whole, np.searchsorted(total, done + AT_ONCE, "right"), "right") - 1, np.searchsorted(whole, at, "right"))])
        own.append(_owners(seg[at:to], line[at:to], begin[at:to], (end - begin)[at:to], c, part, least))
        at = to
    return tuple(np.concatenate(v) for v in zip(*own)) if own else (np.zeros(0, np.int64),) * 2


def _owners(seg: np.ndarray, line: np.ndarray, begin: np.ndarray, size: np.ndarray, c: dict[str, np.ndarray], part: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    i = np.repeat(np.arange(len(seg)), size)
    k = begin[i] + np.arange(len(i)) - (np.cumsum(size) - size)[i]
    ax, ay, bx, by = seg[i].T
    y0, y1, l0, r0, l1, r1 = (c[n][k] for n in ("y0", "y1", "l0", "r0", "l1", "r1"))
    dx, dy, lo, hi = bx - ax, by - ay, np.zeros(len(i)), np.ones(len(i))
    left, right = (l1 - l0) / (y1 - y0), (r1 - r0) / (y1 - y0)
    # A cell is convex, so each of its four sides cuts at one end only.
    for start, change in ((ay - y0, dy), (y1 - ay, -dy), (ax - l0 - left * (ay - y0), dx - left * dy), (right * (ay - y0) + r0 - ax, right * dy - dx)):
        t = -start / change
        lo = np.where((change == 0) & (start < 0), 2.0, np.where(change > 0, np.maximum(lo, t), lo))
        hi = np.where(change < 0, np.minimum(hi, t), hi)
    held = np.maximum(0.0, hi - lo) * np.hypot(dx, dy)
    lines, at = np.unique(line, return_inverse=True)
    own = at[i]
    order = np.lexsort((part[k], own))
    new = np.append(True, (own[order][1:] != own[order][:-1]) | (part[k][order][1:] != part[k][order][:-1])) if len(order) else np.zeros(0, bool)
    pair, begins = np.zeros(len(order), np.int64), np.flatnonzero(new)
    pair[order] = np.cumsum(new) - 1
    of, number = own[order][begins], part[k][order][begins]
    most, held = np.zeros(len(lines)), np.bincount(pair, held, len(begins))
    np.maximum.at(most, of, held)
    # Gaps are worked out only for lines that no part holds.
    out = np.flatnonzero(most[own] <= least)
    gap, nearest = np.full(len(begins), np.inf), np.full(len(lines), np.inf)
    np.minimum.at(gap, pair[out], _gap(*(v[out] for v in (ax, ay, bx, by, y0, y1, l0, r0, l1, r1))))
    np.minimum.at(nearest, of, gap)
    wins = np.flatnonzero(np.where(most[of] > least, held >= most[of] - least, gap <= nearest[of] + 1e-5))
    # Parts ascend within a line, so the first one that wins is the least.
    of, first = np.unique(of[wins], return_index=True)
    return lines[of], number[wins][first]


def _gap(ax, ay, bx, by, y0, y1, l0, r0, l1, r1) -> np.ndarray:
    """Metres between segments and the sides of cells that they don't meet: the least over ends against sides."""
    corner, seg = [(l0, y0), (r0, y0), (r1, y1), (l1, y1)], ((ax, ay), (bx, by))
    least = np.full(len(ax), np.inf)
    for p, q, r in [(p, q, r) for p in seg for q, r in zip(corner, corner[1:] + corner[:1])] + [(p, *seg) for p in corner]:
        dx, dy = r[0] - q[0], r[1] - q[1]
        square = dx * dx + dy * dy
        t = np.where(square > 0, np.clip(((p[0] - q[0]) * dx + (p[1] - q[1]) * dy) / square, 0, 1), 0.0)
        least = np.minimum(least, np.hypot(p[0] - q[0] - t * dx, p[1] - q[1] - t * dy))
    return least
