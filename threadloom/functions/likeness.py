"""Similarities of many pairs of poses at once in numpy, each as poses.similarity gives it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from threadloom.functions import hulls


class Poses:
    """Poses of a table, nodes side by side: x, y (NaN where missing), there (both coordinates are)."""

    def __init__(self, column: pa.ChunkedArray):
        c = column.combine_chunks()
        n = pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False).astype(int)
        node = c.flatten()
        at = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shape = len(n), int(n.max(initial=0))
        both = [pc.cast(pc.struct_field(node, [a]), pa.float64()) for a in "xy"]
        self.x, self.y = np.full(shape, np.nan), np.full(shape, np.nan)
        self.x[at], self.y[at] = (v.to_numpy(zero_copy_only=False) for v in both)
        self.there = np.zeros(shape, bool)
        self.there[at] = pc.and_(*(pc.is_valid(v) for v in both)).to_numpy(zero_copy_only=False)
        self._made: dict = {}

    def once(self, name: str, make) -> np.ndarray:
        """What is made of each pose, however many pairs it is in."""
        if name not in self._made:
            with np.errstate(all="ignore"):
                self._made[name] = make()
        return self._made[name]

    def box(self) -> np.ndarray:
        """Columns x1, y1, x2, y2."""
        none = np.full((len(self.x), 1), np.nan)
        return self.once("box", lambda: np.column_stack([f.reduce(np.hstack([none, v]), axis=1) for f in (np.fmin, np.fmax) for v in (self.x, self.y)]))

    def centre(self) -> np.ndarray:
        def middle(v: np.ndarray) -> np.ndarray:
            s, n = np.sort(np.hstack([v, np.full((len(v), 1), np.nan)]), axis=1), (~np.isnan(v)).sum(axis=1)
            each = np.arange(len(v))
            return (s[each, np.maximum((n + 1) // 2 - 1, 0)] + s[each, n // 2]) / 2

        return self.once("centre", lambda: np.column_stack([middle(self.x), middle(self.y)]))

    def hull(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Corners, how many, boxes and areas of convex hulls; no corners where points lie on a line."""

        def make() -> tuple[np.ndarray, ...]:
            all_ = [hulls.hull(list(zip(x, y, strict=True))) for x, y in zip(self.x.tolist(), self.y.tolist(), strict=True)]
            n = np.array([len(h) for h in all_], int)
            out = np.full((len(all_), max(3, n.max(initial=0)), 2), np.nan)
            out[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = np.array([p for h in all_ for p in h], float).reshape(-1, 2)
            return out, n, np.concatenate([np.fmin.reduce(out, axis=1), np.fmax.reduce(out, axis=1)], axis=1), _area(out, n)

        return self.once("hull", make)


def _next(n: np.ndarray, width: int) -> np.ndarray:
    k = np.arange(1, width + 1)[None, :]
    return np.where(k >= n[:, None], 0, k)


def _area(p: np.ndarray, n: np.ndarray) -> np.ndarray:
    q = np.take_along_axis(p, _next(n, p.shape[1])[:, :, None], axis=1)
    cross = p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]
    total = np.zeros(len(p))
    for k in range(p.shape[1]):
        total += np.where(k < n, cross[:, k], 0.0)
    return np.abs(total) / 2


def _clipped(p: np.ndarray, n: np.ndarray, window: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """hulls.clipped of polygons (padded corners and how many) by windows, one by one: each side of all windows at once."""
    after = np.take_along_axis(window, _next(m, window.shape[1])[:, :, None], axis=1)
    for e in range(window.shape[1]):
        a, d = window[:, e, None], after[:, e, None] - window[:, e, None]
        side = d[..., 0] * (p[..., 1] - a[..., 1]) - d[..., 1] * (p[..., 0] - a[..., 0])
        order = _next(n, p.shape[1])
        ahead, q = np.take_along_axis(side, order, axis=1), np.take_along_axis(p, order[:, :, None], axis=1)
        live = (np.arange(p.shape[1])[None, :] < n[:, None]) & (e < m)[:, None]
        cut = live & (side * ahead < 0)
        t = side / (side - ahead)
        flags = np.stack([live & (side >= 0), cut], axis=2).reshape(len(p), -1)
        # a polygon that this window has no side for stays
        flags[e >= m, 0::2] = (np.arange(p.shape[1])[None, :] < n[:, None])[e >= m]
        found = np.stack([p, p + t[..., None] * (q - p)], axis=2).reshape(len(p), -1, 2)
        n = flags.sum(axis=1)
        out = np.full((len(p), max(1, n.max(initial=0)), 2), np.nan)
        row, _ = np.nonzero(flags)
        out[row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)] = found[flags]
        p = out
    return p, n


def _hulls(a: Poses, i: np.ndarray, b: Poses, j: np.ndarray) -> np.ndarray:
    (p, n, box, size), (q, m, other, else_) = a.hull(), b.hull()
    u, v = box[i], other[j]
    met = np.flatnonzero((u[:, 0] <= v[:, 2]) & (v[:, 0] <= u[:, 2]) & (u[:, 1] <= v[:, 3]) & (v[:, 1] <= u[:, 3]))
    out = np.zeros(len(i))
    if not len(met):
        return out
    i, j = i[met], j[met]
    both, sure = _shared(p, n, i, q, m, j)
    some = np.flatnonzero(~sure)
    if len(some):
        both[some] = _area(*_clipped(p[i[some]], n[i[some]], q[j[some]], m[j[some]]))
    out[met] = both / (size[i] + else_[j] - both)
    return out


def _shared(p: np.ndarray, n: np.ndarray, i: np.ndarray, q: np.ndarray, m: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Areas that hulls p[i] and q[j] share, and whether they are sure: not where a corner of one is on the line of the other's side, or nearly.

    The area within is half the sum, over the sides of both, of the cross product of the part of each side that is within the other.
    """
    origin = p[i, 0]
    one, two = ([(h[k, c, 0] - origin[:, 0], h[k, c, 1] - origin[:, 1]) for c in range(h.shape[1])] for h, k in ((p, i), (q, j)))
    n, m = n[i], m[j]
    sure = (n > 2) & (m > 2)
    twice = np.zeros(len(i))

    def ends(corners: list, n: np.ndarray) -> list:
        first, after = corners[0], []
        for c in range(len(corners)):
            x, y = corners[c + 1] if c + 1 < len(corners) else first
            after.append((np.where(c + 1 < n, x, first[0]), np.where(c + 1 < n, y, first[1])))
        return after

    for a, k, b, w in ((one, n, two, m), (two, m, one, n)):
        after, sides = ends(a, k), list(zip(b, ends(b, w), strict=True))
        low, high = ([np.full(len(i), t) for _ in a] for t in (0.0, 1.0))
        for at, ((ux, uy), (vx, vy)) in enumerate(sides):
            dx, dy, there = vx - ux, vy - uy, at < w
            least = 1e-9 * (np.abs(dx) + np.abs(dy)) * (1 + np.abs(ux) + np.abs(uy))
            side = [dx * (y - uy) - dy * (x - ux) for x, y in a]
            for c in range(len(a)):
                sure &= (np.abs(side[c]) > least) | ~there | (c >= k)
                s, t = side[c], np.where(c + 1 < k, side[(c + 1) % len(a)], side[0])
                cut = s / (s - t)
                low[c] = np.where(there & (s < 0), np.maximum(low[c], np.where(t < 0, 2.0, cut)), low[c])
                high[c] = np.where(there & (s >= 0) & (t < 0), np.minimum(high[c], cut), high[c])
        for c, ((x, y), (u, v)) in enumerate(zip(a, after, strict=True)):
            twice += np.where(c < k, np.maximum(high[c] - low[c], 0.0) * (x * v - u * y), 0.0)
    return np.abs(twice) / 2, sure


def _keypoints(a: Poses, i: np.ndarray, b: Poses, j: np.ndarray, spread: float = 0.025) -> np.ndarray:
    box = a.box()
    scale = ((box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1]) + 2.220446049250313e-16)[i]
    total = np.zeros(len(i))
    for k in range(min(a.x.shape[1], b.x.shape[1])):
        x, y = a.x[i, k] - b.x[j, k], a.y[i, k] - b.y[j, k]
        total += np.where(a.there[i, k] & b.there[j, k], np.exp(-(x * x + y * y) / (2 * scale * (2 * spread) ** 2)), 0.0)
    return total / a.once("nodes", lambda: a.there.sum(axis=1).astype(float))[i]


def _boxes(a: Poses, i: np.ndarray, b: Poses, j: np.ndarray) -> np.ndarray:
    area = lambda p: p.once("area", lambda: (p.box()[:, 2] - p.box()[:, 0] + 1) * (p.box()[:, 3] - p.box()[:, 1] + 1))
    u, v = a.box()[i], b.box()[j]
    side = [np.maximum(np.minimum(u[:, k + 2], v[:, k + 2]) - np.maximum(u[:, k], v[:, k]) + 1, 0.0) for k in (0, 1)]
    both = side[0] * side[1]
    return both / (area(a)[i] + area(b)[j] - both)


def _centres(a: Poses, i: np.ndarray, b: Poses, j: np.ndarray, scale: float) -> np.ndarray:
    d = a.centre()[i] - b.centre()[j]
    return np.exp(-np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) / scale)


def similarity(method: str, a: Poses, i: np.ndarray, b: Poses, j: np.ndarray, scale: float = 1.0) -> np.ndarray:
    """poses.similarity of poses i of a and j of b, one by one; what is not finite counts 0."""
    how = {"bounding_box": _boxes, "keypoint": _keypoints, "hull": _hulls, "centroid": lambda *p: _centres(*p, scale)}[method]
    with np.errstate(all="ignore"):
        s = how(a, i, b, j)
    return np.where(np.isfinite(s), s, 0.0)


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """To digits behind the point, halves up; v is not negative."""
    return np.floor(v * 10.0**digits + 0.5) / 10.0**digits
