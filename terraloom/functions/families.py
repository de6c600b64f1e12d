"""Families of curved rows, for batches of tracts in numpy: their guides, the guides shifted by the spacing, and what of them lies in the field, its tract and outside exclusions.

Tracts are a dict of arrays; what is made of them names its tract by its place there, ``own``, ascending.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from terraloom.functions import cutting

#: Tracts that are worked on at once; their segments stay in a core's cache.
AT_ONCE = 24


def guides(t: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """(gx, gy, nx, ny, own): points of the guides over their whole fields' heights and their normals. spans: (tracts, most, 6), cubic Hermite spans (t, w, o0, o1, m0, m1), padded with NaN."""
    step = np.maximum(0.25, np.minimum(1.0, t["spacing"] / 3))
    samples = np.maximum(2, np.ceil(t["span_y"] / step)).astype(np.int64)
    own = np.repeat(np.arange(len(samples)), samples + 1)
    k = np.arange(len(own)) - np.repeat(np.cumsum(samples + 1) - samples - 1, samples + 1)
    low, span, start, end = (t[c][own] for c in ("min_y", "span_y", "start", "end"))
    gy = low + k / samples[own] * span
    u = ((gy - low) / span - start) / (end - start)

    def offset(v: np.ndarray) -> np.ndarray:
        before = np.zeros(len(v), np.int64)
        for n in range(t["spans"].shape[1]):
            before += t["spans"][own, n, 0] < v
        at, w, a, b, m0, m1 = t["spans"][own, np.maximum(0, before - 1)].T
        h = (v - at) / w
        return a + h * h * (3 - 2 * h) * (b - a) + h * (1 - h) * w * ((1 - h) * m0 - h * m1)

    v = np.clip(u, 0, 1)
    v0, v1 = np.clip(v - 0.001, 0, 1), np.clip(v + 0.001, 0, 1)
    dx, dy = np.where((u >= 0) & (u <= 1), (offset(v1) - offset(v0)) / (v1 - v0), 0.0), span * (end - start)
    long = np.maximum(1e-9, np.hypot(dx, dy))
    return t["mid_x"][own] + offset(v), gy, dy / long, -dx / long, own


def shifted(t: dict[str, np.ndarray], g: tuple[np.ndarray, ...], todo: np.ndarray, blend: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, line, seg) of all rows of the tracts to do as far as they can meet the field's box, by line; lines count spacings from the guide.

    Rows are the guide shifted along its normals, from twice the spacing outwards partly level (``blend``); None shifts all level, by distances that count from the field's left side.
    A segment that doesn't run on with the guide is left out, which parts its row.
    """
    here = np.flatnonzero((g[4][1:] == g[4][:-1]) & todo[g[4][:-1]])
    (gx, gx1), (gy, gy1), (nx, nx1), (ny, ny1) = ((v[here], v[here + 1]) for v in g[:4])
    own = g[4][here]
    level, s, lo_x, hi_x, mid_x, widest, span_y = blend is None, *(t[c][own] for c in ("spacing", "min_x", "max_x", "mid_x", "widest", "span_y"))
    first = lo_x + s / 2 - np.ceil(widest / s) * s - mid_x if level else np.zeros(len(own))
    # A row's x is that of the guide plus its shift times something between the normal's x and 1.
    pull = [1.0] if level else [1.0, nx, nx1]
    lows, highs = ([(side - x) / m + 0 * x for x in (gx, gx1) for m in pull] for side in (lo_x, hi_x))
    reach = np.hypot(hi_x - lo_x, span_y) + widest + 2 * s
    least, most = (0 * s, np.ceil((hi_x + widest + s / 2 - mid_x - first) / s) - 1) if level else (-np.ceil(reach / s), np.floor(reach / s))
    # Never a bound that isn't a number, where a normal runs level.
    bounded = lambda v, none: np.where(np.isnan(v), none, v)
    lo = np.maximum(least, bounded(np.ceil((np.min(lows, 0) - first) / s - 1e-6), least))
    hi = np.minimum(most, bounded(np.floor((np.max(highs, 0) - first) / s + 1e-6), most))
    count = np.maximum(0, hi - lo + 1).astype(np.int64)
    k = np.repeat(np.arange(len(own)), count)
    line = lo[k].astype(np.int64) + np.arange(len(k)) - np.repeat(np.cumsum(count) - count, count)
    order = np.lexsort((line, own[k]))
    k, line = k[order], line[order]
    own, s, lo_x, hi_x, gx, gx1, gy, gy1, d = own[k], s[k], lo_x[k], hi_x[k], gx[k], gx1[k], gy[k], gy1[k], first[k] + line * s[k]
    if level:
        ax, ay, bx, by = gx + d, gy, gx1 + d, gy1
    else:
        nx, nx1, ny, ny1 = nx[k], nx1[k], ny[k], ny1[k]
        b = blend * np.clip((np.abs(d) - 2 * s) / np.maximum(2 * s, (hi_x - lo_x) / 2), 0, 1)
        ax, ay, bx, by = gx + (nx * (1 - b) + b) * d, gy + ny * (1 - b) * d, gx1 + (nx1 * (1 - b) + b) * d, gy1 + ny1 * (1 - b) * d
    low, high = t["min_y"][own], (t["min_y"] + t["span_y"])[own]
    near = lambda p, q, low, high: (np.minimum(p, q) <= high + 1) & (np.maximum(p, q) >= low - 1)
    good = near(ax, bx, lo_x, hi_x) & near(ay, by, low, high)
    if not level:
        dx, dy, ex, ey = bx - ax, by - ay, gx1 - gx, gy1 - gy
        good &= dx * ex + dy * ey > 0.02 * np.hypot(dx, dy) * np.hypot(ex, ey)
    return own[good], line[good], np.stack([ax, ay, bx, by], 1)[good]


def family(t: dict[str, np.ndarray], g: tuple[np.ndarray, ...], todo: np.ndarray, blend: float | None, short: float) -> tuple:
    """(x, y, begins, own, line, row, length) of one try: within the field, without headlands, outside exclusions, within its tract, none shorter than ``short``."""
    own, line, seg = shifted(t, g, todo, blend)
    new = np.append(True, (own[1:] != own[:-1]) | (line[1:] != line[:-1])) if len(own) else np.zeros(0, bool)
    path, own, lines = np.cumsum(new) - 1, own[new], line[new]
    x, y, begins, owner, outer = cutting.pieces(seg, path, t["sides"], lambda x, y, p: cutting.holds(x, y, t["sides"][own[p]]), own)
    x, y, begins, kept = cutting.trimmed(x, y, begins, t["headland"][own[owner]])
    owner, outer = owner[kept], outer[kept]
    mine = own[owner]

    def usable(x: np.ndarray, y: np.ndarray, p: np.ndarray) -> np.ndarray:
        at = mine[p]
        good = np.ones(len(x), bool)
        for edge, sign in ((t["below"], 1), (t["above"], -1)):
            nx, ny, level = edge[at].T
            good &= np.isnan(level) | (sign * (nx * x + ny * y - level) >= -1e-7)
        for n in range(int(t["hole_count"][at].max(initial=0))):
            some = np.flatnonzero(good & (t["hole_count"][at] > n))
            good[some] = ~cutting.holds(x[some], y[some], t["holes"][t["hole_begin"][at[some]] + n])
        return good

    seg, path = cutting.segments(x, y, begins)
    x, y, begins, whole, piece = cutting.pieces(seg, path, t["walls"], usable, mine)
    length = cutting.lengths(x, y, begins)
    good = length >= short
    stay = np.repeat(good, np.diff(begins))
    begins = np.concatenate([[0], np.cumsum(np.diff(begins)[good])])
    return x[stay], y[stay], begins, mine[whole][good], lines[owner[whole]][good], np.stack([outer[whole][good], piece[good]], 1), length[good]


def _away(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Metres between points p and segments q-r."""
    d = r - q
    square = (d * d).sum(1)
    t = np.where(square > 0, np.clip(((p - q) * d).sum(1) / square, 0, 1), 0.0)
    return np.hypot(*(p - q - t[:, None] * d).T)


def apart(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Metres between segments of e and f; 0 where they cross."""
    a, b, c, d = e[:, :2], e[:, 2:], f[:, :2], f[:, 2:]
    turn = lambda p, q, r: (q[:, 0] - p[:, 0]) * (r[:, 1] - p[:, 1]) - (q[:, 1] - p[:, 1]) * (r[:, 0] - p[:, 0])
    crossed = (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)
    return np.where(crossed, 0.0, np.minimum(np.minimum(_away(a, c, d), _away(b, c, d)), np.minimum(_away(c, a, b), _away(d, a, b))))


def unsafe(x: np.ndarray, y: np.ndarray, begins: np.ndarray, own: np.ndarray, line: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which tracts have rows of different shifts that come nearer than ``near``, a distance for each tract: segments meet in cells of that size, of which few hold two rows where rows are a spacing apart."""
    seg, path = cutting.segments(x, y, begins)
    own, line, out = own[path], line[path], np.zeros(len(near), bool)
    lo, hi, wide = np.minimum(seg[:, :2], seg[:, 2:]), np.maximum(seg[:, :2], seg[:, 2:]), near[own][:, None]
    c0, c1 = np.floor((lo - wide / 2) / wide).astype(np.int64), np.floor((hi + wide / 2) / wide).astype(np.int64)
    cells = c1 - c0 + 1
    times = cells[:, 0] * cells[:, 1]
    i = np.repeat(np.arange(len(seg)), times)
    k = np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
    # Cells far from the frame's middle may share a number, which only makes more pairs to look at.
    cell = own[i] * (1 << 48) + (c0[i, 0] + k % cells[i, 0]) % (1 << 24) * (1 << 24) + (c0[i, 1] + k // cells[i, 0]) % (1 << 24)
    order = np.argsort(cell, kind="stable")
    i, cell = i[order], cell[order]
    # Cells that hold one row alone tell nothing.
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    many = np.minimum.reduceat(line[i], begin) != np.maximum.reduceat(line[i], begin) if len(begin) else np.zeros(0, bool)
    some = np.repeat(many, np.diff(np.append(begin, len(cell))))
    i, cell = i[some], cell[some]
    ahead = 1
    while ahead < len(i):
        same = np.flatnonzero(cell[ahead:] == cell[:-ahead])
        if not len(same):
            break
        p, q = i[same], i[same + ahead]
        close = line[p] != line[q]
        p, q = p[close], q[close]
        close = (lo[p] < hi[q] + wide[p]).all(1) & (lo[q] < hi[p] + wide[p]).all(1)
        p, q = p[close], q[close]
        bad = own[p[apart(seg[p], seg[q]) < wide[p, 0]]]
        if len(bad):
            out[bad] = True
            rest = ~out[own[i]]
            i, cell = i[rest], cell[rest]
        ahead += 1
    return out


def _tracts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """What guides() and the rest read of a batch of tracts."""
    n = batch.num_rows
    t = {c: cutting.number(batch.column(c)) for c in ("start", "end", "widest", "spacing", "headland", "min_x", "max_x", "min_y", "mid_x", "span_y")}
    for c in ("below", "above"):
        edge = batch.column(c).flatten()
        names = [f.name for f in batch.column(c).type]
        t[c] = np.stack([cutting.number(edge[names.index(f)]) for f in ("nx", "ny", "at")], 1)
    spans, of = cutting.spread(batch.column("spans"))
    each = np.repeat(np.arange(n), np.diff(of))
    t["spans"] = np.full((n, max(1, int(np.diff(of).max(initial=0))), 6), np.nan)
    t["spans"][each, np.arange(len(each)) - of[each]] = np.stack([cutting.number(spans.field(c)) for c in ("t", "w", "o0", "o1", "m0", "m1")], 1)
    sides, begins = cutting.spread(batch.column("sides"))
    t["sides"] = cutting.padded(cutting.corners(sides), begins)
    holes, outer = cutting.spread(batch.column("holes"))
    ends, inner = cutting.spread(holes)
    ends = cutting.corners(ends)
    t |= {"holes": cutting.padded(ends, inner), "hole_begin": outer[:-1], "hole_count": np.diff(outer)}
    # Walls are the exclusions' sides and the edges of the tract's passages, across the field's box.
    x0, x1 = t["min_x"] - 1, t["max_x"] + 1
    across = [np.stack([x0, (e[:, 2] - e[:, 0] * x0) / e[:, 1], x1, (e[:, 2] - e[:, 0] * x1) / e[:, 1]], 1) for e in (t["below"], t["above"])]
    across = [np.where(np.isnan(a).any(1)[:, None], np.nan, a) for a in across]
    t["walls"] = np.concatenate([cutting.padded(ends, inner[outer]), np.stack(across, 1)], 1)
    return t


def rows(batches: Iterator[pa.RecordBatch], carry: list[str], blends: tuple[float | None, ...], near: float, short: float) -> Iterator[pa.RecordBatch]:
    """(carry, line, row, length_m, blend, path) of batches of tracts: the first family whose rows keep ``near`` spacings from each other, else the last one."""
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            found, todo = [], np.ones(batch.num_rows, bool)
            with np.errstate(all="ignore"):
                t = _tracts(batch)
                g = guides(t)
                for blend in blends:
                    x, y, begins, own, line, row, length = family(t, g, todo, blend, short)
                    todo = unsafe(x, y, begins, own, line, near * t["spacing"]) if blend is not None else np.zeros(len(todo), bool)
                    done = ~todo[own]
                    stay = np.repeat(done, np.diff(begins))
                    found.append((x[stay], y[stay], np.diff(begins)[done], own[done], line[done], row[done], length[done], np.full(np.count_nonzero(done), np.nan if blend is None else blend)))
                    if not todo.any():
                        break
            x, y, size, own, line, row, length, blend = (np.concatenate(v) for v in zip(*found))
            mine, begins = pa.array(own), np.concatenate([[0], np.cumsum(size)])
            names = pa.array([f"{a}.{b}" for a, b in row.tolist()], pa.string())
            columns = [*[batch.column(c).take(mine) for c in carry], pa.array(line, pa.int64()), names, pa.array(length, pa.float64()), pa.array(blend, pa.float64(), mask=np.isnan(blend)), cutting.listed(begins, x=x, y=y)]
            yield pa.RecordBatch.from_arrays(columns, [*carry, "line", "row", "length_m", "blend", "path"])
