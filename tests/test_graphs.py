"""Graphs too large for one task: the ways over all tasks give what the others give."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.operators import graph, joins


def test_components_by_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    e = [(rnd.randrange(90), rnd.randrange(90)) for _ in range(60)] + [(i, i + 1) for i in range(200, 240)] + [(300, i) for i in range(301, 340)] + [(None, 1), (7, 7)]
    df = spark.createDataFrame(e, "src long, dst long").repartition(3)
    once = {tuple(r) for r in graph.connected_components(df).collect()}
    monkeypatch.setattr(graph, "IN_TASK", 0)
    assert {tuple(r) for r in graph.connected_components(df).collect()} == once and (240, 200) in once and (339, 300) in once
    assert graph.connected_components(df.limit(0)).count() == 0


def test_communities_by_rounds(spark):
    """Cliques in a ring: moved and folded over all tasks they come out as they do in one task."""
    n, k = 12, 6
    e = [(c * k + i, c * k + j, 1.0) for c in range(n) for i in range(k) for j in range(i)] + [(c * k, (c + 1) % n * k + 1, 0.5) for c in range(n)] + [(1000, 1001, 2.0), (5, 5, 1.0), (3, None, 1.0)]
    df = spark.createDataFrame(e, "src long, dst long, weight double")
    one = {r.id: r.community for r in graph.louvain(df).collect()}
    many = {r.id: r.community for r in graph.louvain(df, in_task=40, rounds=10).collect()}
    assert set(one) == set(many) == {*range(n * k), 1000, 1001}

    def modularity(com):
        w = [(a, b, x) for a, b, x in e if b is not None and a != b]
        m = sum(x for *_, x in w)
        deg = {}
        for a, b, x in w:
            deg[a], deg[b] = deg.get(a, 0) + x, deg.get(b, 0) + x
        tot = {}
        for v, d in deg.items():
            tot[com[v]] = tot.get(com[v], 0) + d
        return sum(x for a, b, x in w if com[a] == com[b]) / m - sum((t / (2 * m)) ** 2 for t in tot.values())

    assert modularity(many) > 0.95 * modularity(one) > 0.6
    assert all(com == min(v for v in many if many[v] == com) for com in many.values())


def test_window_cosines_by_brute_force(spark):
    """Stretches split over tasks, days that many rows share, missing vectors and buckets."""
    rnd = random.Random(6)
    vec = lambda: [rnd.gauss(0, 1) for _ in range(4)]
    rows = [(i, rnd.choice(["x", "x", "y", None]), date(2020, 1, 1) + timedelta(rnd.choice([3, 3, rnd.randrange(60)])), vec() if i % 17 else None) for i in range(120)] + [(500, "x", None, vec())]
    df = spark.createDataFrame(rows, "id long, b string, d date, v array<double>").withColumn("u", V.unit(F.col("v")))
    u = {r.id: r.u for r in df.collect()}
    want = {}
    for i, b, d, v in rows:
        for j, b2, d2, v2 in rows:
            if i < j and b and b == b2 and v and v2 and d and d2 and abs((d - d2).days) <= 5 and (w := sum(x * y for x, y in zip(u[i], u[j], strict=True))) >= 0.3:
                want[i, j] = w
    for per_task in (7, 1000):
        got = {(r.src, r.dst): r.weight for r in joins.window_cosines(df, "b", "id", "d", "u", 5, 0.3, per_task).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want) and len(want) > 100
    assert joins.window_cosines(df.limit(0), "b", "id", "d", "u", 5, 0.3).count() == 0
