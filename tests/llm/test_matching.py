"""Neighbourhoods and assignments against brute force."""

import random

import numpy as np
import pytest

from strandline.llm import happenings as H
from strandline.llm import matching as M
from strandline.llm.happenings import same_happenings
from strandline.llm.neighbourhood import sorted_neighbours
from strandline.llm.slips import Names, similarity

NAMES = ["garlo wexan", "pivu solnar", "tamki bredol", "henu zafori"]


def _equal_names(l, r):
    a, b = l.name.to_numpy(object), r.name.to_numpy(object)
    return lambda i, j: (a[i] == b[j]).astype(float)


@pytest.mark.parametrize("per_stretch", [7, 60, 50_000])
def test_sorted_windows_lose_nothing(spark, per_stretch):
    """Stretches of a few rows: windows cross many borders, and one key and day holds a third of all rows."""
    rnd = random.Random(1)
    day = lambda i: rnd.choice([None, -4000, 90_000]) if i % 9 == 0 else 30 if i % 3 == 0 else rnd.randrange(60)
    side = lambda n: [(i, day(i), rnd.choice([["k"], ["l"], ["k", "l"], [None, "m"], [], None]), rnd.choice(NAMES)) for i in range(n)]
    a, b = side(150), side(70)
    df = lambda rows: spark.createDataFrame(rows, "id long, day int, keys array<string>, name string")
    got = [(r.l_id, r.r_id, r.gap) for r in sorted_neighbours(df(a), df(b), 3, _equal_names, per_stretch).collect()]
    shared = lambda x, y: {*(x or [])} & {*(y or [])} - {None}
    want = {(x[0], y[0], x[1] - y[1]) for x in a for y in b if x[1] is not None and y[1] is not None and abs(x[1] - y[1]) <= 3 and shared(x[2], y[2]) and x[3] == y[3]}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    assert sorted_neighbours(df(a).limit(0), df(b), 3, _equal_names).count() == 0


@pytest.mark.parametrize("per_stretch", [2, 50_000])
def test_stretches_without_pairs(spark, per_stretch):
    """Stretches with rows of both sides, none in another's window, and parts of one side only; ids are text."""
    df = lambda rows: spark.createDataFrame([(i, d, ["k"], NAMES[0]) for i, d in rows], "id string, day int, keys array<string>, name string")
    a, far = df([(f"a{d}", d) for d in range(0, 40, 10)]), [(f"b{d}", d + 5) for d in range(0, 40, 10)]
    assert sorted_neighbours(a, df(far), 3, _equal_names, per_stretch).count() == 0
    b = df([*far, ("b", 11), *[("c", 70)] * 9])
    assert [tuple(r) for r in sorted_neighbours(a, b, 3, _equal_names, per_stretch).collect()] == [("a10", "b", -1, 1.0)]


def test_similarity_of_many_pairs():
    rnd = random.Random(2)
    word = lambda n: "".join(rnd.choice("abcdé") for _ in range(n))
    a = [word(rnd.randrange(12)) for _ in range(600)] + [word(70)] * 3
    b = ["".join(rnd.choice([c, c, c, c, "x", ""]) for c in s) for s in a]
    b[:60] = [s[:2] + s[3:4] + s[2:3] + s[4:] for s in a[:60]]
    i = np.arange(len(a))
    got = similarity(Names(a), Names(b), i, i, 0.6)
    for x, y, s in zip(a, b, got, strict=True):
        want = 1 - _steps(x, y) / max(len(x), len(y), 1)
        assert abs(s - (want if want >= 0.6 - 1e-9 else 0.0)) < 1e-9, (x, y)


def test_one_to_one(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(12), rnd.randrange(6), round(rnd.random(), 3)) for _ in range(40)]
    pairs += [(100 + i, 50, round(0.3 + i / 1000, 3)) for i in range(300)] + [(None, 1, 0.5), (1, None, 0.5), (2, 2, None), (3, 3, 0.0)]
    df = spark.createDataFrame(pairs, "l long, r long, w double")
    best = {}
    for a, b, w in pairs:
        if a is not None and b is not None and w:
            best[(a, b)] = max(w, best.get((a, b), 0))

    def total(rs, used):
        if not rs:
            return 0.0
        return max([total(rs[1:], used)] + [w + total(rs[1:], used | {a}) for (a, b), w in best.items() if b == rs[0] and a not in used])

    want = total(sorted({b for _, b in best if b < 50}), frozenset()) + max(w for (_, b), w in best.items() if b == 50)
    for kw in ({}, {"in_task": 0}):
        got = M.one_to_one(df, **kw).collect()
        assert len({r.l for r in got}) == len(got) == len({r.r for r in got})
        assert abs(sum(r.w for r in got) - want) < 1e-9
    assert M.one_to_one(df.limit(0)).count() == 0


def test_same_happenings(spark):
    gaz = spark.createDataFrame([(1, "Memani", ["Old Memani"], "Ridihi", "ZAF", "South Africa", -31.4, 24.9), (2, "Wevago", None, "Nagarse", "PHL", "Philippines", 14.6, 120.9)], "place_id long, place_name string, alt_names array<string>, admin1 string, iso3 string, country string, latitude double, longitude double")
    rec = [
        (1, "Beha Wenuvo Hosp., Memani, South Africa", "ZAF", "2020-01-30", None),
        (2, '["South Africa", "Ridihi", "Old Memani", "Beha Wnuvo Hospital"]', None, None, "Feb 1, 2020"),
        (3, "Beha Wenuvo Hospital, Memani, South Africa", "zaf", "2020-02-09", None),
        (4, "Beha Wenuvo Market, Memani, South Africa", "ZAF", "2020-01-30", None),
        (5, "Beha Wenuvo Hospital, Wevago, Philippines", "ZAF", "2020-01-30", None),
        (6, None, None, None, None), (7, "", "ZAF", "", ""), (8, "Beha Wenuvo Hospital, Memani", "ZAF", None, None), (9, "x" * 50_000, "ZAF", "2020-01-30", None),
    ]
    records = spark.createDataFrame([(*r, None, None) for r in rec], "record_id long, location_name string, iso3 string, event_date string, publish_date string, lat double, lon double")
    ev = [("ZAF1", "2020-01-30", "ZAF", "Ridihi", None, "Memani (Beha Wenuvo)"), ("ZAF1", "2020-01-30", "ZAF", "Ridihi", None, "Memani (Beha Wenuvo)"), ("ZAF2", None, "ZAF", None, None, None), (None, "2020-01-30", "ZAF", None, None, "Memani (Beha Wenuvo)")]
    events = spark.createDataFrame(ev, "event_id_cnty string, d string, iso3 string, admin1 string, admin2 string, location string").selectExpr("event_id_cnty", "to_date(d) as event_date", "iso3", "admin1", "admin2", "location", "cast(null as double) as latitude", "cast(null as double) as longitude", "current_timestamp() as ingest_time")
    got = {(r.record_id, r.event_id_cnty) for r in same_happenings(records, events, gaz).collect()}
    assert got == {(1, "ZAF1"), (2, "ZAF1"), (4, "ZAF1")}  # the event names no kind of spot, so 4 may be it
    assert same_happenings(records.limit(0), events, gaz).count() == same_happenings(records, events.limit(0), gaz).count() == 0


def _steps(a, b):
    d = {}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            d[i, j] = max(i, j) if not i or not j else min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_every_two_rows_of_a_country_meet_once(spark):
    """Unless both name towns and none in common: the composite keys of rows with and without town and kind."""
    rows = [(i, c, t, k) for i, (c, t, k) in enumerate((c, t, k) for c in ("ZAF", "PHL", None) for t in ([], [1], [2], [1, 3]) for k in (None, "depot", "bridge"))]
    df = spark.createDataFrame(rows, "id long, iso3 string, towns array<long>, kind string")
    meet = {left: {r.id: r.k or [] for r in df.select("id", H._keys(left).alias("k")).collect()} for left in (True, False)}
    for i, c, t, k in rows:
        for j, c2, t2, k2 in rows:
            n = len(set(meet[True][i]) & set(meet[False][j]))
            compatible = c is not None and c == c2 and (k is None or k2 is None or k == k2)
            if not compatible:
                assert n == 0 or (c == c2 and set(t) & set(t2))  # kinds are compared in the window
            elif t and t2:
                assert n == len(set(t) & set(t2))
            else:
                assert n == 1, (t, k, t2, k2)


def test_spots_without_a_kind(spark):
    gaz = spark.createDataFrame([(1, "Memani", None, "Ridihi", "ZAF", "South Africa", -31.4, 24.9)], "place_id long, place_name string, alt_names array<string>, admin1 string, iso3 string, country string, latitude double, longitude double")
    rec = [(1, "Golden Arrow, Memani, Ridihi Region, South Africa", None, None), (2, "Memani, South Africa", None, None), (3, "Goldne Arow, South Africa", -31.41, 24.91), (4, "Goldne Arow, South Africa", -21.41, 24.91), (5, "Golden Arrow Depot, Ridhi", None, None)]
    records = spark.createDataFrame([(r[0], r[1], "ZAF", "2020-01-30", None, r[2], r[3]) for r in rec], "record_id long, location_name string, iso3 string, event_date string, publish_date string, lat double, lon double")
    events = spark.createDataFrame([("ZAF1", "Memani - Golden Arrow Depot", -31.4, 24.9)], "event_id_cnty string, location string, latitude double, longitude double").selectExpr("event_id_cnty", "date'2020-01-30' as event_date", "'ZAF' as iso3", "'Ridihi' as admin1", "cast(null as string) as admin2", "location", "latitude", "longitude", "current_timestamp() as ingest_time")
    got = {r.record_id for r in same_happenings(records, events, gaz).collect()}
    assert got == {1, 3, 5}  # 2 names a town only, 4 lies elsewhere


def test_same_happenings_with_slips_on_both_sides(spark):
    gaz = spark.createDataFrame([(1, "Memani", None, "Ridihi", "ZAF", "South Africa", -31.4, 24.9)], "place_id long, place_name string, alt_names array<string>, admin1 string, iso3 string, country string, latitude double, longitude double")
    rec = [(1, "Fbo Dasaki Depot, Memani, South Africa"), (2, "Wane Fakangrri Brdg, Memani, South Africa"), (3, "Near Benwili Term.,Memani,,South Africa"), (4, "near Beha Wenuvo Hospital, Memani")]
    records = spark.createDataFrame([(*r, "ZAF", "2020-01-30", None, None, None) for r in rec], "record_id long, location_name string, iso3 string, event_date string, publish_date string, lat double, lon double")
    ev = [("ZAF1", "Memani (Febo Daaki)"), ("ZAF2", "Memani (Wnae Fakangri)"), ("ZAF3", "Memani - Ngar Benwili Terminal"), ("ZAF4", "Beha Wenuvo Hosp., Memani")]
    events = spark.createDataFrame(ev, "event_id_cnty string, location string").selectExpr("event_id_cnty", "date'2020-01-30' as event_date", "'ZAF' as iso3", "'Ridihi' as admin1", "cast(null as string) as admin2", "location", "cast(null as double) as latitude", "cast(null as double) as longitude", "current_timestamp() as ingest_time")
    assert {(r.record_id, r.event_id_cnty) for r in same_happenings(records, events, gaz).collect()} == {(1, "ZAF1"), (2, "ZAF2"), (3, "ZAF3"), (4, "ZAF4")}
