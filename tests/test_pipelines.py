"""The layers with services that the test brings, broken off and run again."""

import json
from datetime import date, datetime

from pyspark.sql import functions as F

from strandline import pipelines as P
from strandline.plans.pipeline_queries import FILTERS


def _head(url):
    if "bad" in url:
        raise OSError("gone")
    yield b'<html><head><title>Dock workers walk out at the port</title><meta name="description" content="A strike of three days.">'
    yield b"</head><body>" + b"x" * 400_000


def _ask(text):
    if "bad" in text:
        raise TimeoutError("no answer")
    return '```json\n{"disruption_type": "Labour_Strike ", "event_date": null, "location_name": "Port X", "odd": 1}\n```'


def _call(row):
    if row["event_date"] is None:
        raise ValueError("no date")
    return {"rain": 1.5}


def test_run_and_run_again(spark, tmp_path):
    days = [date(2020, 1, 1), date(2020, 1, 2), date(2020, 1, 3)]
    rows = [("http://a.example/port-strike-grows", 1), ("HTTP://A.example/port-strike-grows?utm_x=1", 1), ("http://a.example/port-strike-grows", 2), ("http://a.example/sport/x", 1), ("http://bad.example/bad-weather-report-of-today", 2), (None, 1)]
    events = spark.createDataFrame([(u, datetime(2020, 1, d, 5)) for u, d in rows], "url string, ts timestamp")
    out = str(tmp_path / "out")
    first = P.run(events, days, out, FILTERS, _ask, _call, _head)
    assert first == {"pages": 3, "records": 3, "enriched": 3, "failed": 0}
    assert P.run(events, days, out, FILTERS, None, None, None) == first  # nothing is asked for again
    kept = {(r.day.day, r.url): r for r in spark.read.parquet(f"{out}/pages/kept").collect()}
    assert kept[1, "http://a.example/port-strike-grows"].text == "Dock workers walk out at the port. A strike of three days."
    assert kept[2, "http://bad.example/bad-weather-report-of-today"].text == "bad weather report of today"
    records = {r.url: r for r in spark.read.parquet(f"{out}/records").collect()}
    good = records["http://a.example/port-strike-grows"]
    assert (good.disruption_type, good.location_name, good.date_source) == ("labour_strike", "port x", "publish")
    assert records["http://bad.example/bad-weather-report-of-today"].disruption_type == "unknown" and "no answer" in records["http://bad.example/bad-weather-report-of-today"].raw
    done = spark.read.parquet(f"{out}/enriched/version=1").collect()
    assert all(json.loads(r.layers) == {"rain": 1.5} and r.event_date == r.day.isoformat() for r in done)  # the day's date was put in for the retry
    assert spark.read.parquet(f"{out}/enriched/version=0").where("error is not null").count() == 3


def test_empty_and_lonely_records(spark):
    r = spark.createDataFrame([(1, None, "flood", None, None, None, None, None, None, None, None, None), (2, "KEN", "flood", date(2020, 1, 1), "event", "", None, None, None, None, None, None), (3, "KEN", "flood", date(2020, 1, 1), "event", None, None, None, None, None, None, None)],
        "record_id long, iso3 string, disruption_type string, event_day date, date_source string, location_name string, source_title string, url string, duration_hours double, confidence double, lat double, lon double")
    assert P.consolidate(r).count() == 3 and P.consolidate(r.limit(0)).count() == 0
    labels = P.daily_labels(spark.createDataFrame([("KEN", date(2020, 1, 5), None)], "iso3 string, start date, end date"), "iso3", spark.createDataFrame([("KEN", date(2020, 1, 5), 4)], "iso3 string, d date, n_articles long"), "2020-01-01", "2020-01-20")
    got = {x.d.day: (x.today, x.coverage, x.ahead, x.next) for x in labels.collect()}
    assert len(got) == 20 and got[5] == (1, "medium", 0, 0) and got[4] == (0, "low", 1, 1)
    panel = P.build_panel(labels.withColumn("g", F.lit("x")), "iso3", [], group="g").where("d = date'2020-01-08'").first()
    assert (panel.lag_7d, panel.others) == (1, 0)
    assert P.backtest(labels.limit(0).withColumn("f", F.lit(1.0)), ["f"], [2021]).count() == 0
