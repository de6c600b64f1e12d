"""Pairs of rings that may meet, for batches of them in numpy: their boxes' grid cells and the exact test."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from terraloom.functions import cutting

#: Pairs of sides that are worked on at once.
AT_ONCE = 1 << 18


def boxes(ring: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, boxes): the rows of a column that have points, and (x0, x1, y0, y1) of each."""
    x, y, begins = cutting.rings(ring)
    rows = np.flatnonzero(np.diff(begins) > 0)
    return rows, np.stack([f.reduceat(v, begins[rows]) for v in (x, y) for f in (np.fmin, np.fmax)], 1) if len(rows) else np.zeros((0, 4))


def gridded(box: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, cx, cy): all grid cells that each box touches."""
    low, high = (np.floor(box[:, c] / size).astype(np.int64) for c in ((0, 2), (1, 3)))
    wide, tall = (high - low + 1).T
    i = np.repeat(np.arange(len(box)), wide * tall)
    n = np.arange(len(i)) - np.repeat(np.cumsum(wide * tall) - wide * tall, wide * tall)
    return i, low[i, 0] + n // tall[i], low[i, 1] + n % tall[i]


def _held(p: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Whether any of a pair's points lies in its ring, by the even-odd rule; points (pairs, n, 2), sides (pairs, m, 4)."""
    lon, lat = p[..., 0, None], p[..., 1, None]
    ax, ay, bx, by = (sides[:, None, :, c] for c in range(4))
    rise = ay - by
    met = ((by > lat) != (ay > lat)) & (lon < (ax - bx) * (lat - by) / np.where(rise == 0, np.finfo(float).eps, rise) + bx)
    return (met.sum(2) % 2 == 1).any(1)


def _crossed(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    e, f = e[:, :, None], f[:, None]
    turn = lambda q, x, y: (q[..., 2] - q[..., 0]) * (y - q[..., 1]) - (q[..., 3] - q[..., 1]) * (x - q[..., 0])
    parts = lambda q, p: turn(q, p[..., 0], p[..., 1]) * turn(q, p[..., 2], p[..., 3]) < 0
    return (parts(e, f) & parts(f, e)).any((1, 2))


def meets(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Whether the rings of each row intersect: sides cross, or one holds a vertex of the other."""
    open_ = [cutting.opened(*cutting.rings(c)) for c in (a, b)]
    (ea, eb), (ba, bb) = ([cutting.around(*o) for o in open_], [o[2] for o in open_])
    na, nb = np.diff(ba), np.diff(bb)
    out = np.zeros(len(na), bool)
    kinds, kind = np.unique(np.stack([na, nb], 1), axis=0, return_inverse=True)
    for k, (n, m) in enumerate(kinds):
        own = np.flatnonzero(kind.reshape(-1) == k)
        step, block = max(1, AT_ONCE // max(1, n * m)), max(1, AT_ONCE // max(1, m))
        for at in range(0, len(own) if n and m else 0, step):
            rows = own[at : at + step]
            x, y = ea[ba[rows][:, None] + np.arange(n)], eb[bb[rows][:, None] + np.arange(m)]
            found = np.zeros(len(rows), bool)
            for i in range(0, n, block):
                found |= _crossed(x[:, i : i + block], y) | _held(x[:, i : i + block, :2], y)
            for i in range(0, m, max(1, AT_ONCE // n)):
                found |= _held(y[:, i : i + max(1, AT_ONCE // n), :2], x)
            out[rows] = found
    return out
