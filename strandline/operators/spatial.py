"""Points near other points, and the regions that contain points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.geo import usable_position
from strandline.operators.rtree import EARTH_KM, Quadtree, RTree, circle_boxes, haversine_km
from strandline.session import materialize

#: Rows of the sample that the quadtree's cells are drawn from.
SAMPLE = 20_000
#: Sampled points per cell, and rows of one side in a task; beyond, a cell is split by hash.
PER_LEAF, PER_TASK = 200, 200_000


def _sample(df: DataFrame, n: int) -> pd.DataFrame:
    have = df.count()
    return (df if have <= n else df.sample(n / have, seed=7)).limit(2 * n).toPandas()


def _splits(df: DataFrame, per_task: int) -> dict[int, int]:
    """Parts of each cell, from exact counts: one row per cell, and cells are bounded by the sample."""
    return {r["cell"]: -(-r["count"] // per_task) for r in df.groupBy("cell").count().collect()}


def _inside(lat: np.ndarray, lon: np.ndarray, which: np.ndarray, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Even-odd rule of points and the rings ``which`` they may lie in, over all edges of the pairs at once.

    Points on the boundary count as inside where the ring starts low.
    """
    size = np.array([len(x) for x in lats], np.int64)
    start = np.cumsum(size) - size
    y, x = np.concatenate([np.asarray(v, float) for v in lats]), np.concatenate([np.asarray(v, float) for v in lons])
    after = np.arange(len(y)) + 1
    after[start + size - 1] = start
    out = np.zeros(len(which), bool)
    upto = np.cumsum(size[which])
    k = 0
    while k < len(which):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + 2_000_000, "right")))
        n = size[which[k:end]]
        pair = np.repeat(np.arange(k, end), n)
        e = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + start[which[pair]]
        f, la, lo = after[e], lat[pair], lon[pair]
        cross = (y[e] > la) != (y[f] > la)
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (x[f] - x[e]) * (la - y[e]) / (y[f] - y[e]) + x[e]
        out[k:end] = np.bincount(pair - k, weights=cross & (lo < at), minlength=end - k).astype(np.int64) % 2 == 1
        k = end
    return out


def _join(left: DataFrame, right: DataFrame, km: float | None, sample: int, per_leaf: int, per_task: int) -> DataFrame:
    """left(id, lat, lon) against right(id, lat, lon) or right(id, lats, lons); ids are long."""
    s = _sample(left.select("lat", "lon"), sample)
    tree = Quadtree(s.lat.to_numpy(float), s.lon.to_numpy(float), per_leaf)

    def boxes_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        if km is not None:
            return circle_boxes(pdf.lat.to_numpy(float), pdf.lon.to_numpy(float), km)
        edge = [(min(a), max(a), min(o), max(o)) for a, o in zip(pdf.lats, pdf.lons, strict=True)]
        return np.array(edge, float).reshape(-1, 4), np.arange(len(pdf))

    def spread(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            box, of = boxes_of(pdf)
            b, leaf = tree.of_boxes(box)
            out = pdf.iloc[of[b]].reset_index(drop=True)
            yield out.assign(cell=leaf, lat_lo=box[b, 0], lat_hi=box[b, 1], lon_lo=box[b, 2], lon_hi=box[b, 3])

    shape = ", ".join(f"{n} {t}" for n, t in right.dtypes)
    copies = materialize(right.mapInPandas(spread, f"{shape}, cell long, lat_lo double, lat_hi double, lon_lo double, lon_hi double"), "copies")
    right_parts = _splits(copies, per_task)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = np.array(sorted(right_parts), np.int64)
        for pdf in parts:
            cell = tree.of_points(pdf.lat.to_numpy(float), pdf.lon.to_numpy(float))
            keep = np.isin(cell, cells)  # elsewhere nothing is near
            yield pdf.assign(cell=cell)[keep]

    points = materialize(left.select("id", "lat", "lon").mapInPandas(place, "id long, lat double, lon double, cell long"), "placed")  # counted, then joined
    left_parts = _splits(points, per_task)

    def part(parts: dict[int, int], own: bool) -> Column:
        """Own part by hash, or all parts of the other side."""
        many = {c: n for c, n in parts.items() if n > 1}
        n = F.lit(1)
        if many:
            n = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("cell")], F.lit(1))
        return F.pmod(F.xxhash64("id"), n).cast("int") if own else F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))

    a = points.withColumn("pl", part(left_parts, True)).withColumn("pr", part(right_parts, False))
    b = copies.withColumn("pr", part(right_parts, True)).withColumn("pl", part(left_parts, False))

    def probe(_, pts: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(pts) and len(near):
            rt = RTree(near[["lat_lo", "lat_hi", "lon_lo", "lon_hi"]].to_numpy(float))
            for k in range(0, len(pts), 20_000):
                p = pts.iloc[k : k + 20_000]
                lat, lon = p.lat.to_numpy(float), p.lon.to_numpy(float)
                i, j = rt.hits(lat, lon)
                if km is not None:
                    d = haversine_km(lat[i], lon[i], near.lat.to_numpy(float)[j], near.lon.to_numpy(float)[j])
                    ok = d <= km
                else:
                    lats, lons = near.lats.to_numpy(), near.lons.to_numpy()
                    ok = _inside(lat[i], lon[i], j, lats, lons)
                    d = np.zeros(len(i))
                found.append(pd.DataFrame({"left_id": p.id.to_numpy()[i[ok]], "right_id": near.id.to_numpy()[j[ok]], "km": d[ok]}))
        return pd.concat(found) if found else pd.DataFrame({"left_id": [], "right_id": [], "km": []})

    return a.groupBy("cell", "pl", "pr").cogroup(b.groupBy("cell", "pl", "pr")).applyInPandas(probe, "left_id long, right_id long, km double")


def near_points(left: DataFrame, right: DataFrame, km: float, sample: int = SAMPLE, per_leaf: int = PER_LEAF, per_task: int = PER_TASK) -> DataFrame:
    """(left_id, right_id, km): all pairs of left(id, lat, lon), right(id, lat, lon) at most ``km`` apart.

    A quadtree drawn from a bounded sample cuts the globe into cells; a left point lies in
    one cell, a right point is copied to every cell its circle touches. In each
    cell an R-tree over the copies is probed and the great-circle distance checked. The left point
    is the pair's reference point: only its own cell can report the pair, so no pair comes
    twice. Cells with more than ``per_task`` rows on a side are split by hash, the other
    side copied to each part, so a place that holds a third of all rows stays spread.

    Positions that are NULL, NaN or off the globe match nothing. Rows with the same id are
    points of their own and give a pair each. Antimeridian and poles are handled. Empty
    inputs give an empty result; further columns are ignored.
    """
    ok = usable_position(F.col("lat"), F.col("lon"), null_island=False)
    points = lambda x: x.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(ok & F.col("id").isNotNull())
    return _join(points(left), points(right), km, sample, per_leaf, per_task)


def in_regions(left: DataFrame, regions: DataFrame, sample: int = SAMPLE, per_leaf: int = PER_LEAF, per_task: int = PER_TASK) -> DataFrame:
    """(left_id, right_id): the regions(id, lats, lons: one ring, not over the antimeridian) containing left(id, lat, lon).

    The same cells, copies and trees as :func:`near_points`, over the rings' boxes, with
    the even-odd rule as exact refinement. Rings that are NULL or have fewer than three
    corners contain nothing.
    """
    ok = usable_position(F.col("lat"), F.col("lon"), null_island=False)
    pts = left.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(ok & F.col("id").isNotNull())
    rings = regions.select(F.col("id").cast("long").alias("id"), F.col("lats").cast("array<double>").alias("lats"), F.col("lons").cast("array<double>").alias("lons"))
    rings = rings.where("id is not null and size(lats) >= 3 and size(lats) = size(lons)")
    return _join(pts, rings, None, sample, per_leaf, per_task).drop("km")


def nearest_point(left: DataFrame, right: DataFrame, apart: bool = False, sample: int = SAMPLE, per_leaf: int = PER_LEAF, per_task: int = PER_TASK) -> DataFrame:
    """(left_id, right_id, km): the nearest right point of each left one, however far; ties go to the smaller id.

    Left points lie in the cells of a quadtree drawn from a sample. A sampled right point bounds how far the nearest one of any
    point of a cell can be, so a right point is copied only to the cells it can be nearest in; no circle
    ever covers the globe. Cells with more than ``per_task`` left rows are split by hash. With ``apart`` a point is not
    its own neighbour: partners of the same id don't count. Positions that are unusable get no row; nor does anything where the right side is empty.
    """
    ok = usable_position(F.col("lat"), F.col("lon"), null_island=False)
    points = lambda x: x.select(F.col("id").cast("long").alias("id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).where(ok & F.col("id").isNotNull())
    pts, far = points(left), points(right)
    seeds, some = _sample(pts.select("lat", "lon"), sample), _sample(far.select("lat", "lon"), sample)
    shape = "left_id long, right_id long, km double"
    if seeds.empty or len(some) < (2 if apart else 1):
        return left.sparkSession.createDataFrame([], shape)
    tree = Quadtree(seeds.lat.to_numpy(float), seeds.lon.to_numpy(float), per_leaf)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pdf.assign(cell=tree.of_points(pdf.lat.to_numpy(float), pdf.lon.to_numpy(float)))

    placed = materialize(pts.mapInPandas(place, "id long, lat double, lon double, cell long"), "placed")
    # a row per cell, bounded by the sample
    box = placed.groupBy("cell").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("e"), F.count("*").alias("n")).toPandas()
    lat, lon = ((box.a + box.b) / 2).to_numpy(float), ((box.c + box.e) / 2).to_numpy(float)
    widest = np.where((box.a <= 0) & (box.b >= 0), 1.0, np.cos(np.radians(np.minimum(box.a.abs(), box.b.abs()))))
    half = EARTH_KM * np.radians((box.b - box.a).to_numpy(float) / 2 + (box.e - box.c).to_numpy(float) / 2 * widest)
    s_lat, s_lon = some.lat.to_numpy(float), some.lon.to_numpy(float)
    kth = 1 if apart else 0  # with apart, the nearest sampled point may be the point itself
    bound = np.array([np.partition(haversine_km(lat[i], lon[i], s_lat, s_lon), kth)[kth] for i in range(len(box))]) + half
    reach, cells = (bound + half) * (1 + 1e-9) + 1e-6, box.cell.to_numpy(np.int64)

    def copy(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 4_000_000 // len(cells))
        for pdf in parts:
            for k in range(0, len(pdf), step):
                p = pdf.iloc[k : k + step]
                i, j = np.nonzero(haversine_km(p.lat.to_numpy(float)[:, None], p.lon.to_numpy(float)[:, None], lat, lon) <= reach)
                yield p.iloc[i].assign(cell=cells[j])

    many = {int(c): -(-int(n) // per_task) for c, n in zip(cells, box.n, strict=True) if n > per_task}
    n = F.coalesce(F.create_map(*(F.lit(x) for kv in many.items() for x in kv))[F.col("cell")], F.lit(1)) if many else F.lit(1)
    a = placed.withColumn("part", F.pmod(F.xxhash64("id"), n).cast("int"))
    b = far.mapInPandas(copy, "id long, lat double, lon double, cell long").withColumn("part", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))

    def probe(_, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(p) and len(q):
            q = q.sort_values("id", kind="stable")
            q_id, q_lat, q_lon = q.id.to_numpy(), q.lat.to_numpy(float), q.lon.to_numpy(float)
            step = max(1, 4_000_000 // len(q))
            for k in range(0, len(p), step):
                x = p.iloc[k : k + step]
                d = haversine_km(x.lat.to_numpy(float)[:, None], x.lon.to_numpy(float)[:, None], q_lat, q_lon)
                if apart:
                    d[x.id.to_numpy()[:, None] == q_id] = np.inf
                at = d.argmin(1)
                km = d[np.arange(len(x)), at]
                found.append(pd.DataFrame({"left_id": x.id.to_numpy(), "right_id": q_id[at], "km": km})[np.isfinite(km)])
        return pd.concat(found) if found else pd.DataFrame({"left_id": [], "right_id": [], "km": []})

    return a.groupBy("cell", "part").cogroup(b.groupBy("cell", "part")).applyInPandas(probe, shape)
