"""Edges of column expressions: NULLs, blanks, malformed and very long texts, ties."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from strandline.functions import collections as C
from strandline.functions import dates as D
from strandline.functions import geo
from strandline.functions import pages as P
from strandline.functions import scores as S
from strandline.functions import strings as T
from strandline.operators import filters, joins, merge, models
from strandline.operators.spatial import nearest_point
from strandline.sources import fetching, readers, sinks
from strandline.sources.paged import Unauthorized, with_retries


def _one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_scores(spark):
    n, d = F.lit(None).cast("double"), F.lit
    r = _one(spark, a=S.decay(n, 7), b=S.with_day_bonus(n, d(3), d(1), d(2)), c=filters.damped(d(1.0), n), e=models.elkan_noto(n, 0.6), f=geo.haversine_km(n, d(1.0), d(1.0), d(1.0)))
    assert tuple(r) == (None,) * 5  # the unknown stays unknown
    r = _one(spark, none=S.known_mean([(0.5, n), (0.5, n)]), some=S.known_mean([(0.5, n), (0.1, d(0.4))]), far=S.decay(d(9), 7), credit=S.place_credit(d(" "), [n]), best=S.place_credit(d("x"), [n, d(0.4)]), same=S.place_credit(d("x"), [n]),
        odd=S.type_agreement(d("flood"), d("Riots")), riot=S.type_agreement(d("protests"), d("Riots")), null=S.type_agreement(F.lit(None).cast("string"), d("Riots")), ratio=S.ratio(d("50"), d(100)), bad=S.ratio(d("many"), d(100)), zero=S.ratio(d("0"), d(100)),
        bonus=S.with_day_bonus(d(0.95), d(3), d(1), d(2)), no=S.with_day_bonus(d(0.5), n, d(1), d(2)), edge=S.trusted_edge(d(0.8), n, d(1.0)), tier=S.place_tier((d(""), d("")), (d("Main Square, X"), d("main square")), (d("r"), d("r"))))
    assert (r.none, round(r.some, 9), r.far, r.credit, r.best, r.same, r.odd, r.riot, r.null) == (None, 0.4, 0.0, 0.3, 0.4, 0.0, 0.0, 0.6, 0.0)
    assert (r.ratio, r.bad, r.zero, r.bonus, r.no, r.edge, r.tier) == (0.5, None, None, 1.0, 0.5, 0.0, 0.8)


def test_pages(spark):
    meta = '<meta property="article:published_time" content="2020-02-31"><meta content=\'March 4, 2020\' name="PubDate">'
    pages = {meta: date(2020, 3, 4), '<time datetime="2021-05-06T10:00">': date(2021, 5, 6), '<script type="application/ld+json">{"datePublished": "2019-01-02"}</script>': date(2019, 1, 2), '<script type="application/ld+json">{broken</script>': None, "": None, None: None, "<meta " * 20_000: None}
    got = spark.createDataFrame([(i, k) for i, k in enumerate(pages)], "i int, h string").select("i", P.publish_date(F.col("h")).alias("d")).collect()
    assert {r.i: r.d for r in got} == dict(enumerate(pages.values()))
    html = "<nav><p>" + "menu " * 30 + "</p></nav><p>" + "Workers walked out. " * 10 + "</p><p><a href=x>" + "more links " * 20 + "</a></p>"
    r = _one(spark, main=P.main_text(F.lit(html)), short=P.main_text(F.lit("<p>a</p> b")), none=P.main_text(F.lit(None).cast("string")), head=P.html_head(F.lit(b"<head>\xe9</head><body>" + b"x" * 99)), cut=F.length(P.html_head(F.lit(b"x" * 400_000))))
    assert r.main == ("Workers walked out. " * 10).strip() and r.short == "a b" and r.none is None and r.head == "<head>\xe9</head>" and r.cut == 256 * 1024
    x = _one(spark, a=T.looks_like_xml(F.lit(None).cast("string"), F.lit(" \n<URLSET>")), b=T.looks_like_xml(F.lit("text/rss"), F.lit("")), c=T.looks_like_xml(F.lit("text/html"), F.lit(None).cast("string")))
    assert (x.a, x.b, x.c) == (True, True, False)


def test_cells(spark):
    r = _one(spark, a=C.parse_with_defaults(F.lit('{"x": null, "z": 1}'), "x string, n int", {"x": "d"}), b=C.parse_with_defaults(F.lit("no json"), "x string, n int", {"n": 3}), c=C.parse_with_defaults(F.lit(None).cast("string"), "x string", {}), d=C.json_list(F.lit(' ["a", "b"] ')), e=C.json_list(F.lit("[broken")), f=C.json_list(F.lit(" ")),
        g=C.clean_list(F.array(F.lit(" A"), F.lit("a"), F.lit(""), F.lit(None))), h=C.overlap(F.lit(None).cast("array<string>"), F.array(F.lit("a"))), i=C.is_filled(F.lit("  "), "string"), j=C.is_filled(F.array(), "array<string>"))
    assert (tuple(r.a), tuple(r.b), r.c.x, r.d, r.e, r.f, r.g, r.h, r.i, r.j) == (("d", None), (None, 3), None, ["a", "b"], [], [], ["a"], False, False, False)
    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "id int, l array<string>")
    assert {(x.id, x.e) for x in C.exploded(df, "l", "e").collect()} == {(1, "a"), (1, "b"), (2, None), (3, None)}
    top = merge.top_values(spark.createDataFrame([("k", 1, ["b", "a"]), ("k", 2, ["a", "b", None, " "]), ("k", 3, None), ("e", 1, [])], "k string, o int, l array<string>"), "k", [F.col("l")], "o", 1)
    assert [tuple(x) for x in top.collect()] == [("k", "b")]


def test_day_specs_and_windows(spark):
    assert D.parse_days("20200229") == [date(2020, 2, 29)] and D.parse_days("20200302-20200228") == [date(2020, 2, 28), date(2020, 2, 29), date(2020, 3, 1), date(2020, 3, 2)]
    assert D.parse_days("20200302, 20200301,20200302") == [date(2020, 3, 1), date(2020, 3, 2)]
    for bad in ("20200230", "x", ""):
        with pytest.raises(ValueError):
            D.parse_days(bad)
    assert D.month_windows(date(2020, 1, 15), date(2020, 2, 10), 3) == [(date(2020, 1, 12), date(2020, 2, 3), date(2020, 1, 15), date(2020, 1, 31)), (date(2020, 1, 29), date(2020, 2, 13), date(2020, 2, 1), date(2020, 2, 10))]
    assert len(D.quarter_hours(date(2020, 1, 1))) == 96 and D.quarter_hours(date(2020, 1, 1))[1] == datetime(2020, 1, 1, 0, 15)
    assert models.periods(date(2020, 11, 1), date(2021, 1, 31), 2) == [(date(2020, 10, 31), date(2020, 11, 1), date(2020, 12, 31)), (date(2020, 12, 31), date(2021, 1, 1), date(2021, 1, 31))]
    said = {"began on 5 March": date(2020, 3, 5), "since last Monday, 2020-01-02": None, "from Feb 3, 2019": date(2019, 2, 3), "on 1850-01-01": None, "": None, None: None}
    got = spark.createDataFrame([(k,) for k in said], "t string").select("t", D.event_start(F.col("t"), F.lit(date(2020, 6, 1))).alias("d")).collect()
    assert {r.t: r.d for r in got} == said


def test_names(spark):
    want = {"Texas, US": "Texas, United States", "US TX": "US TX", "U.S.A., DRC": "United States, Democratic Republic of the Congo", "uk": "United Kingdom", "Dublin": "Dublin", None: None}
    got = spark.createDataFrame([(k,) for k in want], "t string").select("t", T.country_names(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in got}["Texas, US"] == want["Texas, US"] and {r.t: r.c for r in got}["uk"] == want["uk"] and {r.t: r.c for r in got}[None] is None
    assert readers.registry("# c\na: 1\nb:\n  c: 'x' # y\n  d:\n    e: \"z\"\nf: g\n") == {"a": "1", "b.c": "x", "b.d.e": "z", "f": "g"}
    assert readers.matching_columns(["Date of Issue", "CPI index"], {"date": ["date"], "value": ["index"], "none": ["zz"]}) == {"date": "Date of Issue", "value": "CPI index"}
    df = spark.createDataFrame([(1, 2, 3)], " A int, b_30d int, c_30d int")
    assert filters.columns_like(df, suffix="_30d", pattern="^b") == ["b_30d"] and filters.renamed(df, {"a": "key"}, "_x", ["key"]).columns == ["key", "b_30d_x", "c_30d_x"]


def test_pairs_by_brute_force(spark):
    sets = {i: {f"t{(i * k) % 11}" for k in range(1, 2 + i % 6)} for i in range(60)} | {99: set()}
    df = spark.createDataFrame([(i, sorted(t)) for i, t in sets.items()] + [(98, None)], "id long, t array<string>")
    for least in (0.0, 0.4, 0.7, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b and sets[a] & sets[b]}
        got = {(r.a, r.b): r.jaccard for r in joins.token_pairs(df, "id", "t", least=least).collect()}
        assert got == {k: v for k, v in want.items() if v >= least - 1e-12}
    pts = [(i, (i * 37 % 170) - 85.0, (i * 73 % 360) - 180.0) for i in range(90)] + [(200, None, 1.0)]
    p = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {r.left_id: r.km for r in nearest_point(p, p, apart=True, per_leaf=10, per_task=7).collect()}
    from strandline.operators.rtree import haversine_km

    for i, a, o in pts[:90]:
        assert abs(got[i] - min(haversine_km(a, o, b, q) for j, b, q in pts[:90] if j != i)) < 1e-6
    assert set(got) == set(range(90)) and nearest_point(p, p.limit(0)).count() == 0


def test_services(spark, tmp_path):
    tries = []

    def refuse():
        tries.append(1)
        if len(tries) == 1:
            raise Unauthorized
        if len(tries) < 4:
            raise OSError
        return ["ok"]

    assert with_retries(refuse, pause=0.0, renew=lambda: None) == ["ok"] and len(tries) == 4
    with pytest.raises(Unauthorized):
        with_retries(lambda: (_ for _ in ()).throw(Unauthorized()), pause=0.0)

    def get(url):
        if url == "c":
            raise OSError("x")
        yield b"a" * 100 + b"</HEAD>" + b"b" * 100

    got = {r.url: (r.content and len(r.content), r.error) for r in fetching.fetch_pages(spark.createDataFrame([("a",), ("a",), ("c",), (None,)], "u string"), "u", get).collect()}
    assert got == {"a": (107, None), "c": (None, "OSError: x")}
    k = spark.createDataFrame([("x",), ("y",), (None,)], "k string")
    for _ in range(2):
        assert {tuple(r) for r in fetching.cached_lookup(k, "k", lambda ks: [(1.0, 2.0) if q == "x" else None for q in ks], str(tmp_path / "c")).collect()} == {("x", 1.0, 2.0, None), ("y", None, None, None)}
    assert spark.read.parquet(str(tmp_path / "c")).count() == 2
    text = sinks.text_report({"Types": spark.createDataFrame([("a", 1), (None, 22)], "k string, n int")})
    assert text.splitlines()[:3] == ["Types", "=====", "k  n"] and "a  1" in text
    assert readers.sheet_rows(sinks.workbook({"s": spark.createDataFrame([("<&", None, 3)], "a string, b int, c int")})) == [["a", "b", "c"], ["<&", None, "3"]]
