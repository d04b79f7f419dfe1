"""The layers run over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline import pipelines
from strandline.functions.dates import parse_days, read_date
from strandline.functions.keys import code_key, finite
from strandline.plans.tables import table
from strandline.plans.text_queries import _ISO, _NORM, _PATH, _SEARCH, EXTENSIONS, KEYWORDS, SECTIONS, _T
from strandline.session import shared_dir

FILTERS = pipelines.Filters(EXTENSIONS, SECTIONS, KEYWORDS, ["access denied"])


def retrieved_pages(spark, d):
    """Relevant pages per day of a month, retrieved in two runs of which the second finds the first one's days done."""
    e = table(spark, d, "extract_records").select("url", F.col("ingest_time").alias("ts"))
    out = f"{shared_dir(spark)}/strandline/pages-{uuid.uuid4().hex}"
    pipelines.retrieve(e, parse_days("20200101-20200110"), out, FILTERS)
    kept = pipelines.retrieve(e, parse_days("20200131-20200101"), out, FILTERS)
    return kept.groupBy("day").agg(F.count("*").alias("pages"), F.min("url").alias("first"))


def consolidated_records(spark, d):
    """Records of one happening as one row."""
    e, p = read_date(F.col("event_date")), read_date(F.col("publish_date"))
    r = table(spark, d, "extract_records").select(
        "record_id", code_key(F.col("iso3")).alias("iso3"), "disruption_type", F.coalesce(e, p).alias("event_day"), F.when(e.isNotNull(), "event").when(p.isNotNull(), "publish").alias("date_source"),
        "location_name", "source_title", "url", finite(F.col("duration_hours")).alias("duration_hours"), finite(F.col("confidence")).alias("confidence"), finite(F.col("lat")).alias("lat"), finite(F.col("lon")).alias("lon"),
    )
    return pipelines.consolidate(r).select("event_id", "event_date", "event_end_date", "n_articles", "n_urls")


def _labels(spark, d):
    c = table(spark, d, "event_clusters").select(code_key(F.col("iso3")).alias("iso3"), F.col("event_date").cast("date").alias("start"), F.col("event_end_date").cast("date").alias("end")).where("iso3 is not null")
    a = table(spark, d, "extract_records").select(code_key(F.col("iso3")).alias("iso3"), F.col("ingest_time").cast("date").alias("d"), "num_articles").where("iso3 is not null and d is not null")
    return pipelines.daily_labels(c, "iso3", a.groupBy("iso3", "d").agg(F.sum("num_articles").alias("n_articles")), "2019-01-01", "2020-12-31")


def labelled_days(spark, d):
    """Labels of every country on every day of two years, summed by month."""
    x = _labels(spark, d).groupBy("iso3", F.date_format("d", "yyyy-MM").alias("month"))
    return x.agg(F.count("*").alias("days"), F.sum("today").alias("today"), F.sum("n_articles").alias("n_articles"), F.count_if(F.col("coverage") == "low").alias("low"), F.sum("ahead").alias("ahead"), F.sum("next").alias("next"))


def panel_layers(spark, d):
    """The labels with yearly figures and lags, summed by month."""
    g = table(spark, d, "country_indicators").where("lower(trim(indicator)) = 'gdp_growth'").select(code_key(F.col("country_iso3")).alias("iso3"), "year", finite(F.col("value")).alias("v"))
    g = g.groupBy("iso3", "year").agg(F.max("v").alias("gdp_growth"))
    p = pipelines.build_panel(_labels(spark, d).withColumns({"year": F.year("d"), "region": F.substring("iso3", 1, 1)}), "iso3", [(g, ["iso3", "year"])], group="region")
    x = p.groupBy("iso3", F.date_format("d", "yyyy-MM").alias("month"))
    return x.agg(F.sum("lag_7d").alias("lag_7d"), F.sum("lag_28d").alias("lag_28d"), F.sum("others").alias("others"), F.round(F.max("gdp_growth"), 6).alias("gdp_growth"))


QUERIES = {f.__name__: f for f in (retrieved_pages, consolidated_records, labelled_days, panel_layers)}

_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_F = lambda c: f"(case when isfinite({c}) then {c} end)"
_TOK = r"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(location_name), '\([^)]*\)', ' ', 'g'), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) > 2))"
_HAV = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_L = f"""c as (select {_K.format('iso3')} as iso3, event_date::date as s, least(coalesce(event_end_date, event_date)::date, event_date::date + 59) as e from event_clusters), m as (select distinct iso3, unnest(generate_series(s::timestamp, e::timestamp, interval 1 day))::date
  as d from c where iso3 is not null and e >= s),
a as (select {_K.format('iso3')} as iso3, ingest_time::date as d, sum(num_articles) as n from extract_records where {_K.format('iso3')} is not null and ingest_time is not null group by 1, 2),
g as (select iso3, unnest(generate_series(timestamp '2019-01-01', timestamp '2020-12-31', interval 1 day))::date as d from (select distinct iso3 from a)),
x as (select g.iso3, g.d, (m.d is not null)::int as today, coalesce(n, 0) as n_articles from g left join m using (iso3, d) left join a using (iso3, d)),
l as (select *, case when count(*) over h < 7 then 0 else max(today) over h end as ahead, coalesce(lead(today) over (partition by iso3 order by d), 0) as next from x window h as (partition by iso3 order by d rows between 1 following and 7 following))"""
SQL = {
    "retrieved_pages": (
        rf"with n as (select distinct ingest_time::date as day, {_NORM} as u, {_SEARCH} as s, lower({_PATH}) as p from extract_records where url is not null and {_T} <> '' and ingest_time::date between '2020-01-01' "
        rf"and '2020-01-31'), k as (select day, u, bool_and(not regexp_matches(p, '\.(jpg|png|pdf|mp4)$') and not regexp_matches(p, '/(sport|video|weather)(/|$)') and not contains(s, 'flood') and not contains(s, "
        rf"'pension reform') and not contains(s, 'school fees')) as ok from n group by all) select day, count(*) as pages, min(u) as first from k where ok group by 1"
    ),
    "consolidated_records": f"""with recursive r as (select record_id, {_K.format('iso3')} as iso3, disruption_type, coalesce({_ISO.format('trim(event_date)')}, {_ISO.format('trim(publish_date)')}) as day, ({_ISO.format('trim(event_date)')} is not null)::int
  as e, {_TOK} as t, url, {_F('lat')} as lat, {_F('lon')} as lon from extract_records),
 p as (select a.record_id as a, b.record_id as b from r a join r b on a.iso3 = b.iso3 and a.disruption_type = b.disruption_type and a.record_id < b.record_id and abs(date_diff('day', a.day, b.day)) <= 3 - a.e - b.e
  where len(list_intersect(a.t, b.t)) >= 0.5 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t))) and len(a.t) + len(b.t) > 0 and (a.lat + a.lon + b.lat + b.lon is null or {_HAV} <= 50)),
 u as (select a as src, b as dst from p union select b, a from p), w(id, o) as (select src, src from u union select w.id, u.dst from w join u on w.o = u.src), k as (select id, min(o) as root from w group by 1)
 select coalesce(root, record_id) as event_id, min(day) as event_date, max(day) as event_end_date, count(*) as n_articles, count(distinct url) as n_urls from r left join k on id = record_id group by 1""",
    "labelled_days": f"with {_L} select iso3, strftime(d, '%Y-%m') as month, count(*) as days, sum(today) as today, sum(n_articles) as n_articles, count(*) filter (n_articles < 3) as low, sum(ahead) as ahead, sum(next) as next from l group by 1, 2",
    "panel_layers": f"""with {_L}, v as (select {_K.format('country_iso3')} as iso3, year, max({_F('value')}) as gdp from country_indicators where lower(trim(indicator)) = 'gdp_growth' group by 1, 2),
 z as (select iso3, d, coalesce(sum(today) over (partition by iso3 order by d rows between 7 preceding and 1 preceding), 0) as a, coalesce(sum(today) over (partition by iso3 order by d rows between 28 preceding
  and 1 preceding), 0) as b, sum(today) over (partition by substr(iso3, 1, 1), d) - today as o from l)
 select z.iso3, strftime(d, '%Y-%m') as month, sum(a) as lag_7d, sum(b) as lag_28d, sum(o) as others, round(max(gdp), 6) as gdp_growth from z left join v on v.iso3 = z.iso3 and v.year = year(d) group by 1, 2""",
}
