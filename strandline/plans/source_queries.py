"""Queries that go through files: each writes a table in one of the formats, sinks or streams, and reads it back by the operator."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import code_key
from strandline.functions.strings import html_title
from strandline.plans.tables import table
from strandline.session import shared_dir
from strandline.sources import fetching, readers, sinks
from strandline.sources.paged import PagedSource, file_system
from strandline.streaming import incremental


def _place(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/strandline/files-{uuid.uuid4().hex}/{what}"


def _put(path: str, content: bytes) -> str:
    files, at = file_system(path)
    files.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(at) as f:
        f.write(content)
    return path


def csv_columns(spark, d):
    """Two columns of a Latin-1 CSV with a spaced, upper-case header."""
    path = _place(spark, "sites.csv")
    s = table(spark, d, "sites").select(F.col("site_id").alias(" SITE_ID "), F.concat(F.lit("Zürich "), "site_name").alias("Site Name"), F.col("iso3").alias("ISO3"))
    s.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return readers.read_table(spark, path, ["site_id", "site name"], encoding="ISO-8859-1").select(F.col("site_id").cast("long").alias("site_id"), F.col("site name").alias("name"))


def json_line_counts(spark, d):
    """Good rows and bad lines of JSON lines, some of which are none."""
    path, k = _place(spark, "records.jsonl"), F.col("record_id") % 5
    line = F.when(k == 0, "{not json").when(k == 1, "").otherwise(F.to_json(F.struct("record_id", "iso3", "confidence")))
    table(spark, d, "extract_records").select(line.alias("value")).write.text(path)
    from pyspark.sql.types import StructType

    good, bad = readers.read_json_lines(spark, path, StructType.fromDDL("record_id long, iso3 string, confidence double"))
    n = good.groupBy(F.upper("iso3").alias("kind")).agg(F.count("*").alias("n"), F.sum("record_id").alias("ids"))
    return n.unionByName(bad.agg(F.lit("bad lines").alias("kind"), F.count("*").alias("n"), F.lit(0).cast("long").alias("ids")))


def csv_without_malformed(spark, d):
    """Rows of a CSV whose malformed lines are dropped."""
    from pyspark.sql.types import StructType

    path = _place(spark, "orders.csv")
    line = F.when(F.col("o_orderkey") % 7 == 0, F.lit("x,y,z,too many")).otherwise(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")))
    table(spark, d, "orders").select(line.alias("value")).write.text(path)
    df = spark.read.option("mode", "DROPMALFORMED").schema(StructType.fromDDL("k long, c long")).csv(path)
    return df.agg(F.count("k").alias("n"), F.sum("k").alias("keys"), F.sum("c").alias("customers"))


def csv_with_preamble(spark, d):
    """Two files with a byte order mark, two lines before the header, columns in other orders and empty rows."""
    s = table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows, a file's content
    root = _place(spark, "index")
    for i, (head, row) in enumerate((("Date of year,Nation NAME", "{k},{n}"), ("The nation's name,Date", "{n},{k}"))):
        body = "\n".join(row.format(k=r[0], n=r[1]) for r in s if r[0] % 2 == i)
        _put(f"{root}/{i}.csv", f"\ufefftitle\nissued by\n{head}\n,\n{body}\n".encode())
    df = readers.read_csv_with_preamble(spark, root, 2, wanted={"name": ["name"], "key": ["date"]})
    return df.select(F.col("key").cast("long").alias("key"), "name")


def file_lists(spark, d):
    """Files of a master list by day: sizes and times from its lines, lines that are none left out."""
    path, k = _place(spark, "list"), F.col("record_id") % 6
    name = F.concat(F.lit("http://x/"), F.date_format("ingest_time", "yyyyMMddHHmmss"), F.when(k < 4, ".export.CSV.zip").otherwise(".mentions.CSV.zip"))
    line = F.when(k == 0, "bad").when(k == 1, F.concat_ws(" ", F.lit("size"), F.lit("digest"), name)).otherwise(F.concat_ws("  ", F.col("record_id").cast("string"), F.md5("url"), name))
    table(spark, d, "extract_records").select(F.coalesce(line, F.lit("- -")).alias("value")).write.text(path)
    files = readers.parse_file_list(spark.read.text(path))
    of_day = readers.files_of_day(files, date(2020, 1, 15), ".export.csv.zip").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).withColumn("day", F.lit(date(2020, 1, 15)))
    return files.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.sum("size").alias("size")).unionByName(of_day)


def zipped_events(spark, d):
    """Ragged rows of zip archives, with the time in the archive's name; short rows and rows without a source are dropped."""
    root = _place(spark, "zips")
    rows = table(spark, d, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # 25 rows, an archive each for even and odd ones
    for odd in (0, 1):
        text = "\n".join("\t".join([str(k), "20200101", *(["x"] * (20 + k)), "" if k % 5 == 0 else f"http://h/{n}"]) for k, n in rows if k % 2 == odd)
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            z.writestr("e.csv", f"{text}\nshort\trow\n")
        _put(f"{root}/2020010112{odd}500.export.CSV.zip", raw.getvalue())
    _put(f"{root}/20200101130000.export.CSV.zip", b"no archive")
    return readers.read_zipped_events(spark, f"{root}/*.zip").select(F.col("globaleventid").cast("long").alias("id"), "sourceurl", F.minute("ingest_time").alias("minute"))


def partitions_of_years(spark, d):
    """Two years of files by country and year, written twice, the second time nothing."""
    path = _place(spark, "panel")
    p = table(spark, d, "modelling_panel_gdelt").select("panel_id", code_key(F.col("country_iso3")).alias("iso3"), F.year("date").alias("year"))
    sinks.write_new_partitions(p.where("panel_id % 2 = 0"), path, ["iso3", "year"])
    sinks.write_new_partitions(p.where("panel_id % 2 = 0").withColumn("panel_id", F.lit(0).cast("long")), path, ["iso3", "year"])
    return spark.read.parquet(path).where(F.col("year").isin(2019, 2020)).groupBy("iso3", "year").agg(F.count("*").alias("n"), F.sum("panel_id").alias("ids"))


def daily_files(spark, d):
    """Days of a range read from daily files, missing days skipped, and only the keys that are needed."""
    root = _place(spark, "daily")
    table(spark, d, "events").select("event_id", "user_id", F.date_format("ts", "yyyyMMdd").alias("day")).write.partitionBy("day").parquet(root)
    lo = table(spark, d, "events").agg(F.min("ts").cast("date")).first()[0] or date(2024, 1, 1)
    paths = readers.daily_paths(f"{root}/day={{day}}", date(lo.year, lo.month, 1), date(lo.year, 12, 31), spark)
    near = [p for p in paths if int(p[-8:]) < int(f"{lo:%Y%m}16")]
    df = spark.read.schema("event_id long, user_id long").parquet(*near) if near else spark.createDataFrame([], "event_id long, user_id long")
    need = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id")).where("user_id % 3 = 0")
    return readers.only_needed(df, need, "user_id").groupBy("user_id").agg(F.count("*").alias("n"))


def workbook_sheets(spark, d):
    """A sheet of a workbook that the report writer made."""
    n, r = table(spark, d, "nation").orderBy("n_nationkey"), table(spark, d, "region").orderBy("r_regionkey")
    path = _put(_place(spark, "report.xlsx"), sinks.workbook({"regions": r.select("r_regionkey", "r_name"), "nations & more": n.select("n_nationkey", "n_name", "n_regionkey")}))
    got = readers.read_workbook(spark, path, ["n_name", "n_regionkey"], "nations & more")
    return got.select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("long").alias("region"))


def registries(spark, d):
    """Aliases and codes from a registry's text."""
    rows = table(spark, d, "nation").select("n_name", "n_nationkey").orderBy("n_nationkey").collect()  # 25 rows
    text = "# codes\nnations:\n" + "".join(f"  '{n}': \"{k}\"  # {n}\n" for n, k in rows) + "other: x\n"
    return spark.createDataFrame(list(readers.registry(text).items()), "alias string, code string")


def fallback_files(spark, d):
    """A broken Parquet file is thrown away, the CSV beside it read."""
    root = _place(spark, "cache")
    _put(f"{root}/r.parquet", b"PAR1 broken")
    table(spark, d, "region").select("r_regionkey", "r_name").coalesce(1).write.option("header", True).csv(f"{root}/r.csv")
    df = readers.read_first(spark, [f"{root}/none.parquet", f"{root}/r.parquet", f"{root}/r.csv"])
    return df.select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name"), F.lit(readers.exists(spark, f"{root}/r.parquet")).alias("broken_left"))


def pages(start: date, end: date, page: int, token: str | None) -> list[dict]:
    """A service of three pages per window, for the query below; it refuses the first token."""
    from strandline.sources.paged import Unauthorized

    if token == "old":  # noqa: S105
        raise Unauthorized
    return [{"id": start.toordinal() * 10 + page, "page": page, "end": str(end)}] if page <= 3 else []


_TOKENS = iter(["old"])


def token() -> str:
    return next(_TOKENS, "new")


def paged_windows(spark, d):
    """Pages of ten-day windows from a service, kept and read a second time from the cache."""
    spark.dataSource.register(PagedSource)
    o = {"folder": _place(spark, "pages"), "start": "2020-01-01", "end": "2020-02-04", "days": "10", "columns": "id,page,end"}
    fetched = spark.read.format("paged").options(**o, fetch=f"{__name__}:pages", token=f"{__name__}:token").load()
    n = fetched.count()
    kept = spark.read.format("paged").options(**o).load()
    return kept.select(F.col("id").cast("long").alias("id"), F.col("page").cast("int").alias("page"), F.to_date("end").alias("end"), F.lit(n).alias("fetched"))


def _page(url: str) -> Iterator[bytes]:
    if "?" in url:
        raise TimeoutError(url)
    yield b"<html><head><title>"
    yield url.encode() + b"</title></he"
    yield b"ad><body>" + b"x" * 10_000


def fetched_heads(spark, d):
    """Titles of fetched heads, and how many fetches fail."""
    got = fetching.fetch_pages(table(spark, d, "extract_records"), "url", _page)
    return got.select(F.md5("url").alias("page"), F.md5(html_title(F.decode("content", "UTF-8"))).alias("title"), F.length("content").alias("bytes"), F.substring_index("error", ":", 1).alias("error"))


def _resolve(keys: list[str]) -> list[tuple | None]:
    return [(float(len(k)), 1.0) if len(k) % 2 else (0.0, 0.0, k) if len(k) % 4 else None for k in keys]


def looked_up_places(spark, d):
    """Places looked up once, the second time from the cache, which older entries are read from too."""
    g, cache = table(spark, d, "gazetteer"), _place(spark, "places")
    fetching.cached_lookup(g.where("place_id % 2 = 0"), "place_name", _resolve, cache)
    got = fetching.cached_lookup(g, "place_name", _resolve, cache)
    old = fetching.legacy_entry(F.to_json(F.array(F.col("lat").cast("string"), F.col("lon").cast("string"), F.col("name"))))
    return got.select("key", old["lat"].alias("lat"), old["lon"].alias("lon"), "name")


def upserted_partitions(spark, d):
    """Customers' orders by status, one status written anew."""
    path = _place(spark, "status")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    sinks.replace_partitions(o, path, ["o_orderstatus"])
    sinks.replace_partitions(o.where("o_orderstatus = 'P'").withColumn("o_custkey", F.lit(0).cast("long")), path, ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("customers"))


def split_types(spark, d):
    """Records by type of disruption, a folder each, as JSON lines; floods left out, no type as unknown."""
    path = _place(spark, "types")
    r = table(spark, d, "extract_records").select("record_id", F.when(F.col("record_id") % 9 > 0, F.concat(F.lit(" "), F.upper("disruption_type"))).alias("disruption_type"))
    sinks.split_by_key(r, path, "disruption_type", ["flood"])
    return spark.read.schema("record_id long, by_type string").json(path).groupBy("by_type").agg(F.count("*").alias("n"), F.sum("record_id").alias("ids"))


def teed_outputs(spark, d):
    """All records and those that pass, both as Parquet; lists as text in the CSV beside a Parquet table."""
    a, b, c = (_place(spark, n) for n in ("all", "some", "both"))
    r = table(spark, d, "extract_records").select("record_id", F.array(F.upper("iso3"), F.lit("x")).alias("codes"))
    sinks.tee(r, a, b, F.col("record_id") % 3 == 0)
    sinks.write_both(spark.read.parquet(b), c)
    csv = spark.read.option("header", True).csv(f"{c}.csv").select(F.col("record_id").cast("long").alias("record_id"), "codes")
    return csv.withColumn("whole", F.lit(spark.read.parquet(a).count()))


def patched_records(spark, d):
    """A new version of a table of which some rows have later values, without its internal columns."""
    r = table(spark, d, "extract_records").select("record_id", "iso3", F.lit(1).alias("_seen"))
    patch = r.where("record_id % 4 = 0").select("record_id", F.when(F.col("record_id") % 8 == 0, F.lit("XXX")).alias("iso3"))
    return sinks.without_internal(sinks.patched(r, patch, "record_id", ["iso3"]))


def run_reports(spark, d):
    """What a consolidation leaves of its records."""
    return sinks.run_report(table(spark, d, "source_articles"), table(spark, d, "event_clusters"), "n_articles")


def daily_csv(spark, d):
    """Records appended by day as CSV in two runs, and read back."""
    path = _place(spark, "days")
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    for half in (0, 1):
        sinks.append_csv(e.where(F.col("event_id") % 2 == half), path, "ts")
    df = spark.read.option("header", True).schema("event_id long, user_id long, ts timestamp, day int").csv(path)
    return df.groupBy("day").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def json_lines_back(spark, d):
    """Documents' labels as JSON lines with NULLs kept, read back."""
    path = _place(spark, "labels")
    sinks.write_json_lines(table(spark, d, "documents").select("doc_id", "lang", "published_at"), path)
    lines = spark.read.text(path)
    back = lines.select(F.from_json("value", "doc_id long, lang string").alias("r"), F.contains("value", F.lit('"lang":null')).alias("kept"))
    return back.select("r.doc_id", "r.lang", "kept")


def moved_files(spark, d):
    """Files put into folders by the date in their names, and intermediates of finished days deleted."""
    root, kept = _place(spark, "move"), _place(spark, "days")
    for day in ("20200131", "20200201"):
        _put(f"{root}/{day}_x.csv", b"x")
        _put(f"{kept}/{day}_deduped.csv", b"x")
    _put(f"{root}/plain.csv", b"x")
    _put(f"{kept}/20200131_final.csv", b"x")
    moved = sinks.file_by_date(spark, root)
    gone = sinks.drop_intermediates(spark, kept, "{day}_final.csv", ["{day}_deduped.csv", "{day}_raw.csv"])
    return spark.createDataFrame([(moved, ",".join(gone), readers.exists(spark, f"{root}/2020/02/01/20200201_x.csv"), readers.exists(spark, f"{root}/plain.csv"))], "moved int, gone string, there boolean, left boolean")


def _stream(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, str]:
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    path = _place(spark, "in")
    for half in (0, 1):
        e.where(F.pmod(F.hash("event_id"), F.lit(2)) == half).coalesce(1).write.mode("append").parquet(path)
    return incremental.file_stream(spark, path, e.schema, files_per_batch=1), e, _place(spark, "out")


def stream_unseen(spark, d):
    """Users' kinds of events seen first, over micro-batches, run twice from its checkpoint."""
    src, _, to = _stream(spark, d)
    for _ in range(2):
        incremental.drain_batches(src, f"{to}-c", incremental.append_unseen(to, ["user_id", "event_type"]))
    return spark.read.parquet(to).select("user_id", "event_type")


def stream_running(spark, d):
    """Users' counts on each of the last seven days, kept up over micro-batches."""
    src, _, to = _stream(spark, d)
    incremental.drain_batches(src, f"{to}-c", incremental.running_totals(to, ["user_id"], "ts", 7))
    return spark.read.parquet(f"{to}/version=1").select("user_id", "day", "n")


def stream_first(spark, d):
    """The users of a stream, each once while its watermark lasts."""
    src, _, to = _stream(spark, d)
    incremental.drain(incremental.first_occurrences(src, ["user_id"], "ts", "400 days"), to, f"{to}-c")
    return spark.read.parquet(to).select("user_id")


QUERIES = {f.__name__: f for f in (
    csv_columns, json_line_counts, csv_without_malformed, csv_with_preamble, file_lists, zipped_events, partitions_of_years, daily_files, workbook_sheets, registries, fallback_files, paged_windows, fetched_heads, looked_up_places,
    upserted_partitions, split_types, teed_outputs, patched_records, run_reports, daily_csv, json_lines_back, moved_files, stream_unseen, stream_running, stream_first,
)}

_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
SQL = {
    "csv_columns": "select site_id, 'Zürich ' || site_name as name from sites",
    "json_line_counts": "select upper(iso3) as kind, count(*) as n, sum(record_id) as ids from extract_records where record_id % 5 > 1 group by 1 union all select 'bad lines', count(*), 0 from extract_records where record_id % 5 = 0",
    "csv_without_malformed": "select count(*) as n, sum(o_orderkey) as keys, sum(o_custkey) as customers from orders where o_orderkey % 7 <> 0",
    "csv_with_preamble": "select n_nationkey as key, n_name as name from nation",
    "file_lists": (
        "with f as (select record_id as size, cast(ingest_time as date) as day, record_id % 6 as k from extract_records where record_id % 6 > 1 and url is not null and ingest_time is not null) select day, count(*) "
        "as n, sum(size) as size from f group by 1 union all select date '2020-01-15', count(*), coalesce(sum(size), 0) from f where day = date '2020-01-15' and k < 4"
    ),
    "zipped_events": "select n_nationkey as id, 'http://h/' || n_name as sourceurl, (n_nationkey % 2 * 10 + 5)::int as minute from nation where n_nationkey % 5 <> 0",
    "partitions_of_years": f"select {_K.format('country_iso3')} as iso3, year(date) as year, count(*) as n, sum(panel_id) as ids from modelling_panel_gdelt where panel_id % 2 = 0 and year(date) in (2019, 2020) group by 1, 2",
    "daily_files": "select user_id, count(*) as n from events where cast(ts as date) < date_trunc('month', (select min(ts) from events))::date + 15 and user_id % 3 = 0 and user_id in (select c_custkey from customer) group by 1",
    "workbook_sheets": "select n_name as name, n_regionkey as region from nation",
    "registries": "select 'nations.' || n_name as alias, n_nationkey::varchar as code from nation union all select 'other', 'x'",
    "fallback_files": "select r_regionkey as key, r_name as name, false as broken_left from region",
    "paged_windows": (
        "with w as (select date '2020-01-01' + (i * 10)::int as s, least(date '2020-01-01' + (i * 10 + 9)::int, date '2020-02-04') as e from generate_series(0, 3) t(i)) select (date_diff('day', date '0001-01-01', "
        "s) + 1) * 10 + p as id, p::int as page, e as \"end\", 12 as fetched from w, generate_series(1, 3) q(p)"
    ),
    "fetched_heads": (
        r"with u as (select distinct url from extract_records where url is not null) select md5(url) as page, case when not contains(url, '?') then md5(nullif(trim(regexp_replace(url, '[\s\x{00a0}]+', ' ', 'g')), "
        r"'')) end as title, case when not contains(url, '?') then strlen(url) + length('<html><head><title></title></head>') end as bytes, case when contains(url, '?') then 'TimeoutError' end as error from u"
    ),
    "looked_up_places": (
        "with k as (select distinct place_name as key, length(place_name) as n from gazetteer where place_name is not null) select key, case when n % 2 = 1 then n::double when n % 4 = 2 then 0.0 end as lat, case "
        "when n % 2 = 1 then 1.0 when n % 4 = 2 then 0.0 end as lon, case when n % 4 = 2 then key end as name from k"
    ),
    "upserted_partitions": "select o_orderstatus, count(*) as n, sum(case when o_orderstatus = 'P' then 0 else o_custkey end) as customers from orders group by 1",
    "split_types": "select coalesce(case when record_id % 9 > 0 then lower(trim(disruption_type)) end, 'unknown') as by_type, count(*) as n, sum(record_id) as ids from extract_records where coalesce(case when record_id % 9 > 0 then lower(trim(disruption_type)) end, 'unknown') <> 'flood' group by 1",
    "teed_outputs": "select record_id, case when iso3 is null then 'x' else upper(iso3) || ';x' end as codes, (select count(*) from extract_records) as whole from extract_records where record_id % 3 = 0",
    "patched_records": "select record_id, case when record_id % 8 = 0 then 'XXX' else iso3 end as iso3 from extract_records",
    "run_reports": (
        "select (select count(*) from source_articles) as n_before, count(*) as n_after, round(100.0 * ((select count(*) from source_articles) - count(*)) / (select count(*) from source_articles), 2) as reduction_pct, "
        "count(*) filter (n_articles = 1) as size_1, count(*) filter (n_articles between 2 and 3) as size_2_3, count(*) filter (n_articles between 4 and 5) as size_4_5, count(*) filter (n_articles >= 6) as size_6_plus "
        "from event_clusters"
    ),
    "daily_csv": "select strftime(ts, '%Y%m%d')::int as day, count(*) as n, sum(event_id) as ids from events group by 1",
    "json_lines_back": "select doc_id, lang, lang is null as kept from documents",
    "moved_files": "select 2 as moved, '20200131_deduped.csv' as gone, true as there, true as left",
    "stream_unseen": "select distinct user_id, event_type from events",
    "stream_running": "select user_id, cast(ts as date) as day, count(*) as n from events where cast(ts as date) > (select max(cast(ts as date)) from events) - 7 group by all",
    "stream_first": "select distinct user_id from events",
}
