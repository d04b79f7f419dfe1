"""A bulk-loaded R-tree over boxes, and a quadtree over the globe, on numpy arrays."""

from __future__ import annotations

import numpy as np

EARTH_KM = 6371.0


class RTree:
    """Sort-tile-recursive packing; nodes hold up to ``fan`` entries."""

    def __init__(self, boxes: np.ndarray, fan: int = 16):
        """``boxes``: rows of lat_lo, lat_hi, lon_lo, lon_hi."""
        self.boxes, self.fan = boxes, fan
        n = len(boxes)
        mid_lat, mid_lon = boxes[:, :2].mean(1), boxes[:, 2:].mean(1)
        slices = max(1, int(np.ceil(np.sqrt(n / fan))))
        rank = np.empty(n, dtype=np.int64)
        rank[np.argsort(mid_lon, kind="stable")] = np.arange(n)
        self.order = np.lexsort((mid_lat, rank * slices // max(n, 1)))
        self.levels = [boxes[self.order]]
        while len(self.levels[-1]) > fan:
            low = self.levels[-1]
            at = np.arange(0, len(low), fan)
            self.levels.append(np.column_stack([f.reduceat(low[:, i], at) for i, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum))]))

    def hits(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (point, box) of all boxes that contain a point."""
        top = self.levels[-1]
        q = np.repeat(np.arange(len(lat)), len(top))
        node = np.tile(np.arange(len(top)), len(lat))
        for k in range(len(self.levels) - 1, -1, -1):
            b = self.levels[k][node]
            keep = (lat[q] >= b[:, 0]) & (lat[q] <= b[:, 1]) & (lon[q] >= b[:, 2]) & (lon[q] <= b[:, 3])
            q, node = q[keep], node[keep]
            if k:
                below = node[:, None] * self.fan + np.arange(self.fan)
                ok = below < len(self.levels[k - 1])
                q, node = np.repeat(q, ok.sum(1)), below[ok]
        return q, self.order[node]


def haversine_km(lat1, lon1, lat2, lon2):
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(1.0, h)))


def circle_boxes(lat: np.ndarray, lon: np.ndarray, km: float) -> tuple[np.ndarray, np.ndarray]:
    """Boxes around circles, and the index of the circle of each.

    A circle over the antimeridian gives a second box, shifted by 360 degrees; one over a
    pole gives a single box of all longitudes.
    """
    r = km / EARTH_KM * (1 + 1e-9) + 1e-12
    dlat = np.full(len(lat), np.degrees(r))
    s = np.sin(min(r, np.pi / 2)) / np.maximum(np.cos(np.radians(lat)), 1e-15)
    pole = (np.abs(lat) + dlat >= 90) | (s >= 1)
    dlon = np.degrees(np.arcsin(np.minimum(s, 1)))
    lo, hi = np.where(pole, -180.0, lon - dlon), np.where(pole, 180.0, lon + dlon)
    idx = np.arange(len(lat))
    west, east = ~pole & (lo < -180), ~pole & (hi > 180)
    rows = np.column_stack([lat - dlat, lat + dlat, lo, hi])
    shifted = lambda m, by: rows[m] + np.array([0, 0, by, by])
    return np.vstack([rows, shifted(west, 360.0), shifted(east, -360.0)]), np.concatenate([idx, idx[west], idx[east]])


class Quadtree:
    """Cells of the globe, split where a sample of points is dense.

    Whatever the sample, the leaves cover the globe without overlap, so it decides only
    the balance of the work, never its result.
    """

    def __init__(self, lat: np.ndarray, lon: np.ndarray, per_leaf: int, max_depth: int = 16):
        self.inner: list[np.ndarray] = []
        x, y = self._unit(lat, lon)
        for depth in range(max_depth):
            code = self._code(x, y, depth)
            cells, n = np.unique(code, return_counts=True)
            split = cells[n > per_leaf]
            self.inner.append(split)
            keep = np.isin(code, split)
            x, y = x[keep], y[keep]
            if not len(split):
                break

    @staticmethod
    def _unit(lat, lon):
        return np.clip((lon + 180) / 360, 0, 1 - 1e-12), np.clip((lat + 90) / 180, 0, 1 - 1e-12)

    @staticmethod
    def _code(x, y, depth):
        n = 1 << depth
        return (x * n).astype(np.int64) * n + (y * n).astype(np.int64)

    @staticmethod
    def _leaf(depth, code):
        return code * 32 + depth

    def of_points(self, lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
        x, y = self._unit(lat, lon)
        out = np.empty(len(x), dtype=np.int64)
        todo = np.arange(len(x))
        for depth in range(len(self.inner) + 1):
            code = self._code(x[todo], y[todo], depth)
            more = np.isin(code, self.inner[depth]) if depth < len(self.inner) else np.zeros(len(todo), bool)
            out[todo[~more]] = self._leaf(depth, code[~more])
            todo = todo[more]
            if not len(todo):
                break
        return out

    def of_boxes(self, boxes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (box, leaf) of all leaves that a box touches."""
        x0, y0 = self._unit(boxes[:, 0], boxes[:, 2])
        x1, y1 = self._unit(boxes[:, 1], boxes[:, 3])
        b, cx, cy = np.arange(len(boxes)), np.zeros(len(boxes), np.int64), np.zeros(len(boxes), np.int64)
        who, leaf = [], []
        for depth in range(len(self.inner) + 1):
            n = 1 << depth
            code = cx * n + cy
            more = np.isin(code, self.inner[depth]) if depth < len(self.inner) else np.zeros(len(b), bool)
            who.append(b[~more])
            leaf.append(self._leaf(depth, code[~more]))
            b, cx, cy = np.repeat(b[more], 4), np.repeat(cx[more] * 2, 4), np.repeat(cy[more] * 2, 4)
            if not len(b):
                break
            cx, cy = cx + np.tile([0, 0, 1, 1], len(b) // 4), cy + np.tile([0, 1, 0, 1], len(b) // 4)
            n *= 2
            keep = (x0[b] * n < cx + 1) & (x1[b] * n >= cx) & (y0[b] * n < cy + 1) & (y1[b] * n >= cy)
            b, cx, cy = b[keep], cx[keep], cy[keep]
        return np.concatenate(who), np.concatenate(leaf)
