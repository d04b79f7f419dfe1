"""Near points and regions against brute force, over poles, antimeridian and hot places."""

import random

import numpy as np

from strandline.operators.rtree import Quadtree, RTree, haversine_km
from strandline.operators.spatial import in_regions, near_points


def _brute(a, b, km):
    ok = lambda p: p[1] is not None and p[2] is not None and abs(p[1]) <= 90 and abs(p[2]) <= 180
    return sorted((x[0], y[0]) for x in a if ok(x) for y in b if ok(y) if haversine_km(x[1], x[2], y[1], y[2]) <= km)


def test_near_points_everywhere(spark):
    rnd = random.Random(1)
    spots = [(89.9, 0), (-89.95, 120), (10, 179.95), (10, -179.95), (0, 0), (45, 45)]
    pts = lambda n: [(i, min(90.0, max(-90.0, la + rnd.gauss(0, 1))), ((lo + rnd.gauss(0, 1) + 180) % 360) - 180) for i in range(n) for la, lo in [rnd.choice(spots)]]
    a, b = pts(400), pts(150)
    a += [(900, None, 1.0), (901, 95.0, 1.0), (902, float("nan"), 1.0), (5, a[5][1], a[5][2])]
    schema = "id long, lat double, lon double, cell string"  # a clashing name
    la, lb = spark.createDataFrame([(*x, "z") for x in a], schema), spark.createDataFrame([(*x, "z") for x in b], schema)
    for km in (30.0, 150.0):
        got = sorted((r.left_id, r.right_id) for r in near_points(la, lb, km, sample=200, per_leaf=10).collect())
        assert got == _brute([x for x in a if x[0] != 902], b, km)


def test_hot_place_is_split(spark):
    a = [(i, 10.0, 20.0) for i in range(300)] + [(1000 + i, 10.0 + i, 20.0) for i in range(5)]
    b = [(i, 10.0, 20.0) for i in range(40)]
    got = near_points(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "id long, lat double, lon double"), 1.0, sample=50, per_leaf=5, per_task=25)
    assert got.count() == 301 * 40 and got.distinct().count() == got.count()


def test_empty(spark):
    e = spark.createDataFrame([], "id long, lat double, lon double")
    p = spark.createDataFrame([(1, 1.0, 1.0)], "id long, lat double, lon double")
    assert near_points(e, p, 5.0).count() == near_points(p, e, 5.0).count() == near_points(e, e, 5.0).count() == 0


def test_regions(spark):
    rnd = random.Random(2)
    pts = [(i, rnd.uniform(-10, 10), rnd.uniform(-10, 10)) for i in range(500)]
    rings = [(1, [0.0, 0.0, 5.0, 5.0], [0.0, 5.0, 5.0, 0.0]), (2, [-8.0, -2.0, -8.0], [-8.0, -5.0, -2.0]), (3, None, None), (4, [1.0], [1.0])]
    got = sorted((r.left_id, r.right_id) for r in in_regions(spark.createDataFrame(pts, "id long, lat double, lon double"), spark.createDataFrame(rings, "id long, lats array<double>, lons array<double>"), per_leaf=20).collect())

    def tri(la, lo):
        p = [(-8.0, -8.0), (-2.0, -5.0), (-8.0, -2.0)]
        s = [(p[(i + 1) % 3][0] - p[i][0]) * (lo - p[i][1]) - (p[(i + 1) % 3][1] - p[i][1]) * (la - p[i][0]) for i in range(3)]
        return all(x >= 0 for x in s) or all(x <= 0 for x in s)

    want = sorted([(i, 1) for i, la, lo in pts if 0 <= la <= 5 and 0 <= lo <= 5] + [(i, 2) for i, la, lo in pts if tri(la, lo)])
    assert got == want


def test_rtree_and_quadtree():
    rng = np.random.default_rng(3)
    c = rng.uniform(-50, 50, (700, 2))
    boxes = np.column_stack([c[:, 0] - 2, c[:, 0] + 2, c[:, 1] - 2, c[:, 1] + 2])
    q = rng.uniform(-50, 50, (200, 2))
    i, j = RTree(boxes).hits(q[:, 0], q[:, 1])
    want = {(a, b) for a in range(200) for b in range(700) if boxes[b, 0] <= q[a, 0] <= boxes[b, 1] and boxes[b, 2] <= q[a, 1] <= boxes[b, 3]}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)
    t = Quadtree(c[:, 0], c[:, 1], 20)
    leaf = t.of_points(q[:, 0], q[:, 1])
    b, cell = t.of_boxes(np.column_stack([q[:, 0], q[:, 0], q[:, 1], q[:, 1]]))
    assert (np.sort(cell[np.argsort(b)]) == np.sort(leaf)).all() and len(set(leaf)) > 5
