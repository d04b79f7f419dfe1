"""Formats, sinks and streams on small files; a stream's result equals the batch query's."""

import json
import zipfile
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from strandline.sources import readers as R
from strandline.sources import sinks as W
from strandline.sources.paged import PagedSource, page_digest
from strandline.streaming import incremental as S

SF = "/root/testdata/sf0.001"


def test_json_lines_and_csv(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "x"}\n\nnot json\n{"a": 2}\n')
    good, bad = R.read_json_lines(spark, str(tmp_path / "a.jsonl"), StructType([StructField("a", IntegerType()), StructField("b", StringType())]))
    assert {tuple(r) for r in good.collect()} == {(1, "x"), (2, None)} and [r[0] for r in bad.collect()] == ["not json"]
    (tmp_path / "b.csv").write_text("title of the file\nissued by\nDate,Food Index\n2020-01,1.5\n,\n2020-02,\n")
    got = R.read_csv_with_preamble(spark, str(tmp_path / "b.csv"), 2)
    assert got.columns == ["date", "food index"] and got.count() == 2
    (tmp_path / "c.tsv").write_text("A\tb \n1\t2\n")
    assert R.clean_header(R.read_table(spark, str(tmp_path / "c.tsv"))).columns == ["a", "b"]
    with pytest.raises(ValueError, match="missing"):
        R.read_table(spark, str(tmp_path / "c.tsv"), ["zz"])
    (tmp_path / "words.txt").write_text("# comment\n one \n\ntwo\n")
    assert R.word_list(str(tmp_path / "words.txt")) == ["one", "two"]


def test_file_lists_and_zips(spark, tmp_path):
    lines = ["12 abc http://x/20180115001500.export.CSV.zip", "bad line", "x y http://x/20180115001500.export.CSV.zip", "9 d http://x/20180116001500.export.CSV.zip", "7 e http://x/20180115003000.mentions.CSV.zip"]
    files = R.parse_file_list(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert files.count() == 3 and [r.size for r in R.files_of_day(files, date(2018, 1, 15), ".export.csv.zip").collect()] == [12]
    row = "\t".join([str(i) for i in range(61)])
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("a.csv", row + "\nshort\trow\n" + "\t".join(map(str, range(12))) + "\n")
    (tmp_path / "broken.zip").write_bytes(b"no zip")
    got = R.read_zipped_events(spark, str(tmp_path / "*.zip")).orderBy("sourceurl").collect()
    assert [(r.globaleventid, r.sourceurl, r.eventcode) for r in got] == [("0", "11", None), ("0", "60", "26")]
    assert R.daily_paths("d/{day}.csv", date(2020, 2, 28), date(2020, 3, 1)) == ["d/20200228.csv", "d/20200229.csv", "d/20200301.csv"]
    names = spark.createDataFrame([("20200101_20200131_grouped",), ("20200210_grouped",), ("x",)], "n string")
    assert [r[0] for r in names.select(R.overlaps_range(F.col("n"), "20200115", "20200209")).collect()] == [True, False, False]


def test_partitioned_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "KEN", None), ("B ", 2, "KEN", 1), (None, 3, "PER", 2), ("skip", 4, "PER", 3)], "k string, v int, iso3 string, _tmp int")
    W.split_by_key(df, str(tmp_path / "t"), "k", ["skip"])
    assert {r[0] for r in spark.read.json(str(tmp_path / "t")).select("by_type").collect()} == {"a", "b", "unknown"}
    W.replace_partitions(df.select("v", "iso3"), str(tmp_path / "p"), ["iso3"])
    W.replace_partitions(spark.createDataFrame([(9, "PER")], "v int, iso3 string"), str(tmp_path / "p"), ["iso3"])
    assert {(r.v, r.iso3) for r in spark.read.parquet(str(tmp_path / "p")).collect()} == {(1, "KEN"), (2, "KEN"), (9, "PER")}
    for c in ("KEN", "PER"):
        for y in (2019, 2020):
            spark.createDataFrame([(y,)], "x int").toPandas().to_parquet((tmp_path / f"e/iso3={c}").mkdir(parents=True, exist_ok=True) or tmp_path / f"e/iso3={c}/year={y}.parquet")
    got = R.read_by_country_and_year(spark, str(tmp_path / "e"), [2020])
    assert {(r.iso3, r.year, r.x) for r in got.collect()} == {("KEN", 2020, 2020), ("PER", 2020, 2020)}
    W.tee(df.select("k", "v"), str(tmp_path / "all"), str(tmp_path / "some"), F.col("v") > 2)
    assert spark.read.parquet(str(tmp_path / "all")).count() == 4 and spark.read.parquet(str(tmp_path / "some")).count() == 2
    W.write_both(spark.createDataFrame([(1, ["x", "y"])], "i int, a array<string>"), str(tmp_path / "both"))
    assert spark.read.option("header", True).csv(str(tmp_path / "both.csv")).first().a == "x;y"
    assert {(r.v, r.iso3) for r in W.patched(df.select("v", "iso3"), spark.createDataFrame([(1, "XXX"), (2, None)], "v int, iso3 string"), "v", ["iso3"]).where("v < 3").collect()} == {(1, "XXX"), (2, "KEN")}
    assert W.without_internal(df).columns == ["k", "v", "iso3"]
    r = W.run_report(df, spark.createDataFrame([(1,), (3,), (7,)], "n int"), "n").first()
    assert (r.n_before, r.n_after, r.reduction_pct, r.size_1, r.size_2_3, r.size_6_plus) == (4, 3, 25.0, 1, 1, 1)
    t = spark.createDataFrame([(datetime(2020, 5, 6),)], "ts timestamp")
    W.append_daily(t, str(tmp_path / "d"), "ts")
    assert spark.read.parquet(str(tmp_path / "d")).first().day == 6


def test_paged_source(spark, tmp_path):
    a, b = date(2020, 1, 1), date(2020, 1, 10)
    for start, end, page, rows in ((a, date(2020, 1, 5), 1, [{"id": 1, "v": "x"}]), (a, date(2020, 1, 5), 2, [{"id": 2}]), (date(2020, 1, 6), b, 1, [{"id": 3, "v": "y"}])):
        (tmp_path / f"{page_digest(start, end, page)}.json").write_text(json.dumps(rows))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").options(folder=str(tmp_path), start=str(a), end=str(b), days="5", columns="id,v").load()
    assert {tuple(r) for r in df.collect()} == {("1", "x"), ("2", None), ("3", "y")} and df.rdd.getNumPartitions() == 2


def _events(spark, path):
    e = spark.read.parquet(f"{SF}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    for i in range(3):
        e.where(F.floor(F.datediff(F.to_date("ts"), F.lit(date(2024, 1, 1))) / 10) == i).coalesce(1).write.mode("append").parquet(path)
    return e


def test_streams_equal_batches(spark, tmp_path):
    at = lambda n: str(tmp_path / n)
    e = _events(spark, at("in"))
    src = lambda: S.file_stream(spark, at("in"), e.schema, files_per_batch=1)
    S.drain(S.daily_counts(src(), "ts", ["event_type"], "1 day"), at("days"), at("c1"))
    batch = e.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"))
    got = {tuple(r) for r in spark.read.parquet(at("days")).select("day", "event_type", "n").collect()}
    want = {tuple(r) for r in batch.collect()}
    assert got <= want and len(got) > 0.8 * len(want)  # days the watermark has not passed are still open
    S.drain_batches(src(), at("c2"), S.append_unseen(at("seen"), ["user_id", "event_type"]))
    S.drain_batches(src(), at("c2"), S.append_unseen(at("seen"), ["user_id", "event_type"]))  # nothing new
    assert spark.read.parquet(at("seen")).count() == e.select("user_id", "event_type").distinct().count()
    S.drain_batches(src(), at("c3"), S.running_totals(at("state"), ["user_id"], "ts", 7))
    last = e.agg(F.max(F.to_date("ts"))).first()[0]
    tail = {tuple(r) for r in e.where(F.to_date("ts") > last - timedelta(7)).groupBy("user_id", F.to_date("ts").alias("day")).count().collect()}
    assert {tuple(r) for r in spark.read.parquet(at("state/version=2")).select("user_id", "day", "n").collect()} == tail
    S.drain(S.first_occurrences(src(), ["user_id"], "ts", "40 days"), at("first"), at("c4"))
    assert spark.read.parquet(at("first")).count() == e.select("user_id").distinct().count()
    S.drain(S.sessions(src(), "ts", "12 hours", ["user_id"], "1 hour"), at("sess"), at("c5"))
    assert spark.read.parquet(at("sess")).count() > 0
    S.drain(S.sliding_counts(src(), "ts", "8 days", "4 days", ["event_type"], "1 day"), at("slide"), at("c6"))
    assert spark.read.parquet(at("slide")).count() > 0
