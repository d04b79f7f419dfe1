"""Small fixtures for operators whose queries can't show their edges."""

import random
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from strandline.functions import dates as D
from strandline.functions import strings as T
from strandline.functions import urls as U
from strandline.functions.geo import equirectangular_km, haversine_atan2_km, haversine_km, planar_km
from strandline.operators import dedupe, filters, graph, joins, merge, models, panel
from strandline.operators.assignment import assign


def _one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_dates_and_periods(spark):
    given = {"2020-02-03": "2020-02-03", "20200203": "2020-02-03", "2020/02/03": "2020-02-03", "3 Feb 2020": "2020-02-03", "February 3, 2020": "2020-02-03", "feb 3, 2020": "2020-02-03", "2020-02-03T10:00:00+00:00": "2020-02-03", "2020-02-31": None, "yesterday": None, "": None, None: None, "3.2.2020": "2020-02-03"}
    got = spark.createDataFrame([(k,) for k in given], "t string").select("t", D.read_date(F.col("t")).cast("string").alias("d")).collect()
    assert {r.t: r.d for r in got} == given
    y, m, k = D.period(F.col("t"))
    got = spark.createDataFrame([("2020M05",), ("2020Q2",), ("2020",), ("x",)], "t string").select(y, m, k).collect()
    assert [tuple(r) for r in got] == [(2020, 5, 3), (2020, 4, 2), (2020, None, 1), (None, None, None)]
    r = _one(spark, a=D.compact_to_iso(F.lit("20190524.0")), b=D.compact_to_iso(F.lit("20191324")), w=D.dynamic_window(F.lit(2), F.lit(14), F.lit(73.0), F.lit(None).cast("double")), t=D.asymmetric_tolerance(F.lit("event"), F.lit("publish")))
    assert tuple(r) == ("2019-05-24", None, 5, 2)


def test_urls(spark):
    r = _one(spark, n=U.normalize_url(F.lit(" HTTP://Ex.Test/a%2Fb?x=&utm_a=1&Ref=z&y=2#f ")), bare=U.normalize_url(F.lit("ex.test/a")), s=U.search_text(F.lit("http://ex.test/a-b_c/d?q=one+two%20three")), slug=U.slug_text(F.lit("http://ex.test/2019/05/big-flood-2019.html")), bad=U.normalize_url(F.lit("http://x/%zz?%")), d=U.domain(F.lit("https://www.Ex.test:8080/")))
    assert tuple(r) == ("http://ex.test/a%2Fb?x=&y=2", "http://ex.test/a", "ex.test a b c d q=one+two three", "big flood", "http://x/%zz?%", "ex.test")
    u = spark.createDataFrame([("http://x/2019/05/24/a",), ("http://x/2019-05-24.html",), ("http://x/20190524/a",), ("http://x/2019/05/",), ("http://x/1999/05/24/",), ("http://x/2019/13/24/",), (None,)], "u string")
    assert [str(r[0]) for r in u.select(U.date_from_url(F.col("u"))).collect()] == ["2019-05-24"] * 3 + ["2019-05-01", "None", "None", "None"]
    f = spark.createDataFrame([("ftp://x/a",), ("http://x/a.jpg",), ("http://x/sport/a",), ("http://x/start-up",), ("http://x/z",), (None,)], "u string")
    loose = filters.url_reason(F.col("u"), ["jpg"], ["sport"], ["art", "up"])
    strict = filters.url_reason(F.col("u"), ["jpg"], ["sport"], ["art", "up"], strict_tokens=True)
    assert [tuple(r) for r in f.select(loose, strict).collect()] == [("not http",) * 2, ("extension",) * 2, ("section",) * 2, ("keyword: art", "keyword: up"), (None, None), ("not http",) * 2]


def test_phrases_and_texts(spark):
    days = {"a 10-day strike": 10, "for two weeks": 14, "a month": 30, "no time": None}
    got = spark.createDataFrame([(k,) for k in days], "t string").select("t", T.explicit_days(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == days
    nth = {"entered its tenth day": 10, "Day 4 of": 4, "the 3rd day": 3, "its second week": 14, "nothing": None}
    got = spark.createDataFrame([(k,) for k in nth], "t string").select("t", T.day_number(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == nth
    assert T.token_set_ratio("new york mets", "mets new york") == 1.0 and T.token_set_ratio("", "x") == 0.0 and 0 < T.token_set_ratio("abc def", "abd xyz") < 1


def test_distances(spark):
    none = spark.createDataFrame([(None, 1.0)], "a double, b double").select(haversine_km(F.col("a"), F.col("b"), F.lit(0.0), F.lit(0.0)).alias("km")).first().km
    assert none is None
    a = [F.lit(float(x)) for x in (10, 179.5, 10, -179.5)]
    h, t, e, p = _one(spark, h=haversine_km(*a), t=haversine_atan2_km(*a), e=equirectangular_km(*a), p=planar_km(*a))
    assert abs(h - 109.5) < 0.1 and abs(h - t) < 1e-9 and e > 30000 and p > 30000  # only the first two cross the antimeridian


def test_keep_first_and_modes(spark):
    df = spark.createDataFrame([("a", 2, None), ("a", 1, "x"), ("a", 1, "y"), (None, 5, "z"), ("b", None, "q")], "k string, o int, v string")
    assert {(r.k, r.v) for r in dedupe.keep_first(df, ["k"], ["o"]).collect()} == {("a", "x"), (None, "z"), ("b", "q")}
    assert {(r.k, r.v) for r in dedupe.keep_max(df, ["k"], "o", ["v"]).collect()} == {("a", None), (None, "z"), ("b", "q")}
    m = spark.createDataFrame([("a", 1, "y"), ("a", 2, "x"), ("a", 3, "x"), ("a", 4, "y"), ("b", 1, None)], "k string, o int, v string")
    assert [(r.k, r.mode, r.n, r.conflict) for r in dedupe.stable_mode(m, ["k"], "v", "o").collect()] == [("a", "y", 2, True)]
    up = dedupe.upsert(spark.createDataFrame([(1, "o"), (None, "o")], "k int, v string"), spark.createDataFrame([(None, "n"), (2, "n")], "k int, v string"), ["k"])
    assert {tuple(r) for r in up.collect()} == {(1, "o"), (None, "n"), (2, "n")}
    assert sorted(map(str, dedupe.append_new(up, up, ["k"]).collect())) == sorted(map(str, up.collect()))  # a NULL key is a key
    more = spark.createDataFrame([(None, "m"), (3, "m"), (3, "m2")], "k int, v string")
    assert dedupe.append_new(up, more, ["k"]).count() == up.count() + 2
    sized = spark.createDataFrame([(i, (i * 7) % 5) for i in range(200)], "id long, size int")
    ids = {r.id: r.o for r in dedupe.ordinal_ids(sized, "size", "id", "o", 10).collect()}
    assert [i for i, _ in sorted(ids.items(), key=lambda kv: kv[1])] == [i for i, _ in sorted(((i, (i * 7) % 5) for i in range(200)), key=lambda x: (-x[1], x[0]))] and sorted(ids.values()) == list(range(1, 201))
    assert dedupe.sample_rows(sized, 17, ["id"]).count() == 17 and dedupe.sample_rows(sized, 17, ["id"]).collect() == dedupe.sample_rows(sized.repartition(7), 17, ["id"]).collect()


def test_graphs(spark):
    rnd = random.Random(1)
    e = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(200, 260)] + [(5, 5), (None, 1)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        if a is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(e, "src long, dst long")
    assert {r.id: r.root for r in graph.connected_components(df).collect()} == {x: find(x) for x in parent}
    ids = spark.createDataFrame([(i,) for i in range(6)], "id long")
    near = spark.createDataFrame([(0, 1), (1, 2), (0, 2), (2, 3)], "src long, dst long")
    assert {(r.id, r.cluster, r.role) for r in graph.dbscan(near, ids, 3).collect()} == {(0, 0, "core"), (1, 0, "core"), (2, 0, "core"), (3, 0, "border"), (4, 4, "noise"), (5, 5, "noise")}
    two = [(a, b, 1.0) for g in (0, 10) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(4, 10, 0.1)]
    com = {r.id: r.community for r in graph.louvain(spark.createDataFrame(two, "src long, dst long, weight double")).collect()}
    assert {com[i] for i in range(5)} == {0} and {com[i] for i in range(10, 15)} == {10}
    pairs = [(1, 2), (2, 3), (3, 4), (1, 5), (4, 5)]
    got = {r.id: r.representative for r in graph.greedy_clusters(spark.createDataFrame([(i,) for i in range(1, 7)], "id long"), spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1, 6: 6}


def test_assignment_beats_greedy(spark):
    w = [(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.8), (2, 2, 0.1), (3, 3, 0.2)]
    got = {(r.l, r.r) for r in assign(spark.createDataFrame(w, "l long, r long, w double"), 0.35).collect()}
    assert got == {(1, 2), (2, 1)}


def test_merges(spark):
    assert tuple(_one(spark, x=merge.duration_days(F.lit(5), F.lit(5), F.lit(None), F.lit(1))).x) == (5.0, "explicit")
    m = spark.createDataFrame([("c", {"a": "x", "b": None}), ("c", {"a": "y"}), ("c", {"a": "x"}), ("d", None)], "k string, m map<string,string>")
    assert [(r.k, r.merged) for r in merge.merge_maps(m, "k", "m").collect()] == [("c", {"a": ["x", "y"]})]


def test_stitch(spark):
    rows = [("a", 1, date(2020, 1, i), float(i)) for i in range(1, 7)] + [("a", 2, date(2020, 1, i), 10.0 * i) for i in range(4, 10)] + [("b", 1, date(2020, 1, 1), None)]
    got = [(r.d.day, r.v) for r in merge.stitch(spark.createDataFrame(rows, "k string, b int, d date, v double"), "k", "b", "d", "v").orderBy("d").collect()]
    assert got == [(i, float(i)) for i in range(1, 10)]


def test_window_edges(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), 1.0), ("a", date(2020, 1, 4), 2.0), (None, date(2020, 1, 2), 3.0)], "k string, d date, v double")
    g = panel.dense(df, ["k"], "d", {})
    assert g.count() == 4
    w = panel.by(["k"], "d")
    got = g.select("d", panel.ffill(F.col("v"), w, 1).alias("f"), panel.forward_label(F.lit(1), w, 3).alias("l"), panel.forward_any(F.lit(1), w, 3).alias("n")).orderBy("d").collect()
    assert [(r.f, r.l, r.n) for r in got] == [(1.0, 1, 1), (1.0, 0, None), (None, 0, None), (2.0, 0, None)]
    assert panel.spine(df.limit(0), ["k"], "d").count() == 0
    p = joins.token_pairs(spark.createDataFrame([(1, ["a", "b"]), (2, ["b", "c"]), (3, []), (4, None)], "id int, t array<string>"), "id", "t").collect()
    assert [(r.a, r.b, r.common, round(r.jaccard, 3)) for r in p] == [(1, 2, 1, 0.333)]


def test_models(spark):
    rng = np.random.default_rng(1)
    rows = [(i, date(2018 + i % 4, 1 + i % 12, 1), float(x), float(x + rng.normal(0, 0.01)), float(rng.normal()) if i % 7 else None, int(x + rng.normal(0, 0.5) > 0)) for i, x in enumerate(rng.normal(0, 1, 800))]
    df = spark.createDataFrame(rows, "id int, date date, a double, b double, c double, y int")
    assert set(models.vif_filter(df, ["a", "b", "c"])) in ({"a", "c"}, {"b", "c"})
    for kind in (None, "sigmoid", "isotonic"):
        pred = models.walk_forward(df, "date", ["a", "c"], [2021], lambda f, n: models.logistic(f, 1.0, n), kind)
        s = models.fold_scores(pred, ["fold"], "p_cal" if kind else "p").first()
        assert s.fold == 2021 and s.roc_auc > 0.85
    assert _one(spark, p=models.elkan_noto(F.lit(0.9), 0.6)).p == 1.0
