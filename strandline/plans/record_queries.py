"""Queries of scores, filters, parsed cells and free text of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import collections as C
from strandline.functions import dates as D
from strandline.functions import geo
from strandline.functions import pages as P
from strandline.functions import scores as S
from strandline.functions import strings as T
from strandline.functions import urls as U
from strandline.functions.keys import code_key, finite
from strandline.operators import dedupe, filters
from strandline.plans.tables import table
from strandline.plans.text_queries import _ISO, _NORM, _PATH, _T


def _records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extract_records")


def _r(c, n: int = 6):
    return F.round(c, n)


def filtered_records(spark, d):
    """How many records pass each of several filters, by type."""
    r, day = _records(spark, d), D.read_date(F.col("event_date"))
    x = r.select(
        "disruption_type", filters.date_between(F.trim("event_date"), "2018-01-01", "2018-12-31").alias("text_range"), filters.within_buffer(day, "2018-01-01", "2018-12-31").alias("buffered"),
        filters.confident(F.col("confidence")).alias("confident"), geo.near_origin(finite(F.col("lat")), finite(F.col("lon"))).alias("near_origin"),
        filters.agreement(F.col("llm_disruption_type"), F.col("expert_disruption_type")).alias("agreed"),
    )
    return x.groupBy("disruption_type").agg(F.count("*").alias("n"), *(F.count_if(c).alias(c) for c in x.columns[1:]))


def missing_feature_units(spark, d):
    """Panel rows of the units that lack a figure throughout a month."""
    p = table(spark, d, "modelling_panel_gdelt").select("panel_id", code_key(F.col("adm1_code")).alias("unit"), F.date_format("date", "yyyy-MM").alias("month"), finite(F.col("gini_coef")).alias("gini"))
    return filters.without_any(p, ["unit", "month"], "gini").select("panel_id", "unit", "month")


def article_buckets(spark, d):
    """Clusters by how many articles they have, on two scales."""
    n = table(spark, d, "event_clusters").select(filters.size_bucket(F.col("n_articles")).alias("bucket"), filters.size_bucket(F.col("n_articles"), [2, 3, 6, 11]).alias("wide"))
    return n.groupBy("bucket", "wide").agg(F.count("*").alias("n"))


def panel_interactions(spark, d):
    """Selected columns by name, renamed with a suffix, and two kinds of products."""
    p = table(spark, d, "modelling_panel_gdelt")
    names = filters.columns_like(p, suffix="_30d")
    x = p.select("panel_id", *(finite(F.col(c)).alias(c) for c in [*names, "gdp_growth", "political_stability_est"]))
    x = x.withColumns({"plain": _r(filters.interaction(F.col("fx_pct_30d"), F.col("gdp_growth"))), "damped": _r(filters.damped(F.col("oil_brent_pct_30d"), F.col("political_stability_est")))})
    return filters.renamed(x.select("panel_id", *names, "plain", "damped"), {"plain": "growth_x_fx"}, "_f", ["panel_id"])


def pair_scores(spark, d):
    """How well each article fits its cluster: time, place, head count, day number, trust."""
    a = table(spark, d, "source_articles").where("cluster_id is not null").select("article_id", "cluster_id", "event_date", "subloc", "estimated_participants", "reported_day_number", finite(F.col("confidence")).alias("confidence"), "ingest_time")
    a = dedupe.keep_last(a, ["article_id", "cluster_id"], ["ingest_time"])
    e = table(spark, d, "event_clusters").select("cluster_id", F.col("event_date").alias("e_date"), "location_name", "n_articles", finite(F.col("confidence_max")).alias("e_conf"), "disruption_type")
    gap = F.datediff(F.col("event_date").cast("date"), F.col("e_date").cast("date"))
    same = (F.lower(F.trim("subloc")) == F.lower(F.trim(F.substring_index("location_name", ",", 1)))).cast("double")
    x = a.join(e, "cluster_id").select("*", gap.alias("gap"), S.place_credit(F.col("subloc"), [same]).alias("place"))
    x = x.withColumns({"time": S.decay(F.col("gap"), 7), "heads": S.ratio(F.col("estimated_participants"), F.col("n_articles") * 100), "type": S.type_agreement(F.col("disruption_type"), F.lit("Protests"))})
    x = x.withColumn("score", S.with_day_bonus(S.known_mean([(0.4, F.col("time")), (0.3, F.col("place")), (0.2, F.col("type")), (0.1, F.col("heads"))]), F.col("reported_day_number"), F.lit(1), F.col("gap")))
    return x.select("article_id", "cluster_id", *(_r(F.col(c)).alias(c) for c in ("time", "place", "type", "heads", "score")), S.trusted_edge(_r(F.col("score")), _r(F.col("confidence")), _r(F.col("e_conf"))).alias("edge"))


def place_tiers(spark, d):
    """Tier of agreement between a place's names and its province's."""
    g = table(spark, d, "gazetteer")
    alt = F.try_element_at("alt_names", F.lit(1))
    t = S.place_tier((F.col("place_name"), F.when(F.col("place_id") % 3 == 0, F.upper("place_name")).otherwise(alt)), (F.col("place_name"), alt), (F.col("admin1"), F.when(F.col("place_id") % 2 == 0, F.col("admin1"))))
    return g.select("place_id", t.alias("tier"))


def port_scores(spark, d):
    """Counts of what holds, a weighted score, and the span of the box around each country's sites."""
    s = table(spark, d, "sites").withColumns({"is_port": F.when(F.col("asset_type") == "port", " Yes"), "is_large": F.when(F.col("harbor_size") == "L", "yes").otherwise("no")})
    low, high = (lambda f: [f("latitude"), f("longitude")])(F.min), (lambda f: [f("latitude"), f("longitude")])(F.max)
    x = s.withColumns({"yes": S.count_yes(["is_port", "is_large"]), "north": (F.col("latitude") > 0).cast("int")})
    x = x.withColumn("score", S.weighted_score({"yes": 0.4, "north": 0.1}))
    out = x.groupBy("iso3").agg(F.sum("yes").alias("yes"), _r(F.sum("score")).alias("score"), low[0].alias("a"), high[0].alias("b"), low[1].alias("c"), high[1].alias("e"))
    return out.select("iso3", "yes", "score", _r(S.box_span_km(F.col("a"), F.col("b"), F.col("c"), F.col("e")), 4).alias("span_km"))


def distance_forms(spark, d):
    """Three more forms of distance between each verified event and a fixed point."""
    v = table(spark, d, "verified_events").select("event_id_cnty", finite(F.col("latitude")).alias("lat"), finite(F.col("longitude")).alias("lon"))
    v = v.groupBy("event_id_cnty").agg(F.max("lat").alias("lat"), F.max("lon").alias("lon"))
    args = (F.col("lat"), F.col("lon"), F.lit(10.0), F.lit(20.0))
    return v.select("event_id_cnty", _r(geo.haversine_atan2_km(*args), 4).alias("atan2_km"), _r(geo.equirectangular_km(*args), 4).alias("flat_km"), _r(geo.planar_km(*args), 4).alias("planar_km"))


EXTRAS = "reported_day_number double, sector string, issue string, protest_type string"


def parsed_extras(spark, d):
    """The records' extras with defaults for what is missing, as columns."""
    x = _records(spark, d).select("record_id", C.parse_with_defaults(F.col("extras"), EXTRAS, {"sector": "None", "reported_day_number": -1.0}).alias("e"))
    return C.expanded(x, "e").select("record_id", "reported_day_number", "sector", F.coalesce("issue", F.lit("-")).alias("issue"))


def place_lists(spark, d):
    """Records by how many names their place gives, lists and single texts alike; a row per name counted again."""
    r = _records(spark, d).select("record_id", C.json_list(F.col("location_name")).alias("names"))
    each = C.exploded(r, "names", "name")
    filled = each.groupBy("record_id").agg(F.count("name").alias("n"), F.count("*").alias("rows"), F.max("name").alias("last"))
    return filled.join(r.select("record_id", C.is_filled(F.col("names"), "array<string>").alias("filled")), "record_id")


def cluster_actors(spark, d):
    """Whom a place's names and its province name together, whether lists overlap, and lists without repeats."""
    g = table(spark, d, "gazetteer")
    who = C.actors([F.col("alt_names"), F.array("place_name")], F.col("admin1"))
    return g.select("place_id", F.array_join(F.array_sort(who), ";").alias("names"), C.overlap(F.col("alt_names"), F.array("place_name")).alias("own"), F.array_join(C.clean_list(F.concat(F.array("place_name"), F.array("place_name"))), ";").alias("once"))


def page_dates(spark, d):
    """The date that pages made of the records give: in a meta tag, a time tag, linked data, or none, by turns."""
    when, k = F.coalesce("publish_date", F.lit("")), F.col("record_id") % 4
    head = F.when(k == 0, F.concat(F.lit('<meta content="'), when, F.lit('" property="article:published_time">'))).when(k == 1, F.concat(F.lit('<META name="pubdate" content="'), when, F.lit('">')))
    head = head.when(k == 2, F.concat(F.lit('<time class="x" datetime="'), when, F.lit('">then</time>'))).otherwise(F.concat(F.lit('<script type="application/ld+json">{"dateModified": "'), when, F.lit('"}</script>')))
    page = F.concat(F.lit("<html><head>"), head, F.lit("</head><body><nav><p>Home and everything else that is on this site for you</p></nav><p>"), F.coalesce("event_description", F.lit("")), F.lit("</p></body></html>"))
    x = _records(spark, d).select("record_id", "event_date", page.alias("html"))
    day = D.read_date(F.col("event_date"))
    text = F.length(P.main_text(F.col("html"), 1))
    return x.select("record_id", P.publish_date(F.col("html"), day).alias("published"), text.alias("chars"), F.length(P.html_head(F.encode("html", "utf-8"))).alias("head"))


def xml_sniffs(spark, d):
    """Content types and beginnings that are XML, over the records."""
    begin = F.element_at(F.array(*(F.lit(x) for x in ("  <?xml version", "<RSS>", "<urlset>", "<sitemapindex>", "<html>", "<feed"))), (F.col("record_id") % 6 + 1).cast("int"))
    kind = F.element_at(F.array(*(F.lit(x) for x in ("text/html", "application/atom", "text/RSS", "text/plain", None))), (F.col("record_id") % 5 + 1).cast("int"))
    return _records(spark, d).select("record_id", T.looks_like_xml(kind, begin).alias("xml"))


def country_spellings(spark, d):
    """Short names of countries written out, slugs, and feature names."""
    short = F.element_at(F.array(*(F.lit(x) for x in ("USA", "the UK", "DR Congo", "drc", "US", "U.S."))), (F.col("record_id") % 6 + 1).cast("int"))
    text = F.concat_ws(", ", F.coalesce("location_name", F.lit("-")), short)
    return _records(spark, d).select("record_id", T.country_names(text).alias("place"), T.slug(F.concat(F.lit(" Fuel Price / "), short)).alias("slug"), T.feature_name(F.concat(F.lit("num__x_"), F.col("record_id").cast("string"))).alias("feature"))


def event_starts(spark, d):
    """Dates that phrases around the records' dates give, relative phrases left aside."""
    day = D.read_date(F.col("publish_date"))
    k = F.col("record_id") % 4
    text = F.when(k == 0, F.concat(F.lit("began on "), F.date_format(day, "d MMMM"))).when(k == 1, F.concat(F.lit("since last week, "), F.date_format(day, "yyyy-MM-dd"))).when(k == 2, F.concat(F.lit("from "), F.date_format(day, "MMM d, yyyy"))).otherwise("no date at all")
    return _records(spark, d).select("record_id", D.event_start(text, day).alias("start"), D.event_start(text, day, True).alias("any_start"))


def period_ranks(spark, d):
    """Year, month and rank of period notations, and the tolerance between two kinds of dates."""
    day = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy'M'MM")).when(F.col("o_orderkey") % 3 == 1, F.concat(F.year(day), F.lit("Q"), F.quarter(day))).otherwise(F.year(day).cast("string"))
    y, m, k = D.period(text)
    own, other = F.when(F.col("o_orderkey") % 2 == 0, "event").otherwise("publish"), F.when(F.col("o_custkey") % 2 == 0, "event").otherwise("publish")
    return table(spark, d, "orders").groupBy(y.alias("year"), m.alias("month"), k.alias("rank")).agg(F.count("*").alias("n"), F.sum(D.asymmetric_tolerance(own, other)).alias("days"))


def calendar_windows(spark, d):
    """Counts of orders in months read with a week on either side, and in windows of a year every half year."""
    lo, hi = table(spark, d, "orders").agg(F.min("o_orderdate").cast("date"), F.max("o_orderdate").cast("date")).first()
    if lo is None:
        return spark.createDataFrame([], "kind string, start date, n long")
    windows = [("month", c, a, b) for a, b, c, _ in D.month_windows(lo, hi, 7)] + [("half", a, a, b) for a, b in D.sliding_windows(lo, hi, 364, 182)] + [("year", a, a, b) for a, b in D.year_windows(lo.year, hi)]
    w = spark.createDataFrame(windows, "kind string, start date, a date, b date")  # a few hundred rows
    day = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    each = w.select("kind", "start", F.explode(F.sequence("a", "b")).alias("day"))
    return each.join(day, "day").groupBy("kind", "start").agg(F.sum("n").alias("n"))


def url_sets(spark, d):
    """All addresses of each cluster of hosts, and how many tokens their paths hold."""
    from strandline.operators.merge import union_array

    r = _records(spark, d).select(U.domain(F.col("url")).alias("host"), F.array(U.normalize_url(F.col("url"))).alias("urls"), U.tokens(U.url_path(U.stripped(F.col("url")))).alias("tokens")).where("host is not null")
    x = r.groupBy("host").agg(union_array("urls").alias("u"), F.sum(F.size("tokens")).alias("tokens"))
    return x.select("host", F.size("u").alias("n_urls"), F.try_element_at("u", F.lit(1)).alias("first"), "tokens")


def ordered_places(spark, d):
    """Ports by size in the order of sizes, then unknown dates last: the place of each in the whole order."""
    s = table(spark, d, "sites").select("site_id", F.coalesce("harbor_size", F.lit("?")).alias("size"))
    return s.select("site_id", dedupe.in_order(F.col("size"), ["L", "M", "S", "V"]).alias("at"), dedupe.dated_last(F.when(F.col("site_id") % 2 == 0, F.lit("2020-01-01"))).alias("key"))


def numbered_clusters(spark, d):
    """Clusters numbered by size, and a sample that is the same on any cluster."""
    c = table(spark, d, "event_clusters").select("cluster_id", F.coalesce("n_articles", F.lit(0)).alias("n_articles"))
    return dedupe.ordinal_ids(c, "n_articles", "cluster_id", "ordinal").select("cluster_id", "n_articles", "ordinal")


def value_ranks(spark, d):
    """Empirical distribution, rank and running maximum of the daily totals of each event type."""
    from pyspark.sql import Window

    v = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.round(F.sum("value"), 2).alias("v"))
    by, at = Window.partitionBy("event_type").orderBy("v"), Window.partitionBy("event_type").orderBy("d")
    return v.select("event_type", "d", _r(F.cume_dist().over(by)).alias("cdf"), F.rank().over(by).alias("rank"), F.max("v").over(at.rowsBetween(Window.unboundedPreceding, 0)).alias("top"))


QUERIES = {f.__name__: f for f in (
    filtered_records, missing_feature_units, article_buckets, panel_interactions, pair_scores, place_tiers, port_scores, distance_forms, parsed_extras, place_lists, cluster_actors, page_dates, xml_sniffs,
    country_spellings, event_starts, period_ranks, calendar_windows, url_sets, ordered_places, numbered_clusters, value_ranks,
)}

_F = lambda c: f"(case when isfinite({c}) then {c} end)"
_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_DAY = lambda c: _ISO.format(f"trim({c})")
_COMPAT = "case e.disruption_type when 'protests' then 1.0 when 'labour_strike' then 0.8 else 0.0 end"
_HAV = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_LISTED = r"list_distinct(list_filter(list_transform({}, lambda x: lower(trim(x))), lambda x: x is not null and x <> ''))"
SQL = {
    "filtered_records": f"""with x as (select disruption_type, coalesce(trim(event_date) between '2018-01-01' and '2018-12-31', false) as text_range, coalesce({_DAY('event_date')} between date '2018-01-01' - 21 and date '2018-12-31' + 21, false) as buffered,
 coalesce({_F('confidence')}, 0) >= 0.6 as confident, coalesce(abs({_F('lat')}) < 1 and abs({_F('lon')}) < 1, false) as near_origin, coalesce(llm_disruption_type = expert_disruption_type, false) as agreed from extract_records)
 select disruption_type, count(*) as n, {', '.join(f'count(*) filter ({c}) as {c}' for c in ('text_range', 'buffered', 'confident', 'near_origin', 'agreed'))} from x group by 1""",
    "missing_feature_units": f"select panel_id, unit, month from (select panel_id, {_K.format('adm1_code')} as unit, strftime(date, '%Y-%m') as month, count({_F('gini_coef')}) over (partition by {_K.format('adm1_code')}, strftime(date, '%Y-%m')) as n from modelling_panel_gdelt) where n = 0",
    "article_buckets": (
        "select case when n_articles < 1 then null when n_articles < 2 then '1' when n_articles < 4 then '2-3' when n_articles < 6 then '4-5' when n_articles >= 6 then '6+' end as bucket, case when n_articles "
        "< 1 then null when n_articles < 2 then '1' when n_articles < 3 then '2' when n_articles < 6 then '3-5' when n_articles < 11 then '6-10' when n_articles >= 11 then '11+' end as wide, count(*) as n from "
        "event_clusters group by all"
    ),
    "panel_interactions": (
        f"select panel_id, {_F('fx_pct_30d')} as fx_pct_30d_f, {_F('oil_brent_pct_30d')} as oil_brent_pct_30d_f, round({_F('fx_pct_30d')} * {_F('gdp_growth')}, 6) as growth_x_fx_f, case when {_F('political_stability_est')} "
        f"is not null then round({_F('oil_brent_pct_30d')} * (1 - greatest(-3.0, least(3.0, {_F('political_stability_est')}))), 6) end as damped_f from modelling_panel_gdelt"
    ),
    "pair_scores": f"""with a as (select article_id, cluster_id, arg_max((event_date, subloc, estimated_participants, reported_day_number, {_F('confidence')}), ingest_time) as r from source_articles where cluster_id is not null group by all),
 x as (select article_id, cluster_id, date_diff('day', e.event_date, r[1]) as gap, r[4] as day, case when r[1] is not null and e.event_date is not null then greatest(0.0, 1 - abs(date_diff('day', e.event_date, r[1])) / 7.0) end as "time",
  case when r[2] is null or trim(r[2]) = '' then 0.3 else coalesce((lower(trim(r[2])) = lower(trim(split_part(location_name, ',', 1))))::double, 0) end as place, {_COMPAT}::double as "type",
  case when try_cast(trim(r[3]) as double) > 0 and n_articles > 0 then least(try_cast(trim(r[3]) as double), n_articles * 100.0) / greatest(try_cast(trim(r[3]) as double), n_articles * 100.0) end as heads, r[5] as c, {_F('confidence_max')} as ec
  from a join event_clusters e using (cluster_id)),
 y as (select *, (0.4 * coalesce("time", 0) + 0.3 * place + 0.2 * "type" + 0.1 * coalesce(heads, 0)) / (("time" is not null)::int * 0.4 + 0.5 + (heads is not null)::int * 0.1) as s from x),
 z as (select *, case when abs(abs(day - 1) - abs(gap)) <= 1 and s is not null then least(1.0, s + 0.1) else s end as score from y)
 select article_id, cluster_id, round("time", 6) as "time", round(place, 6) as place, round("type", 6) as "type", round(heads, 6) as heads, round(score, 6) as score, round(round(score, 6) * sqrt(least(coalesce(round(c, 6), 0), coalesce(round(ec, 6), 0))), 4) as edge from z""",
    "place_tiers": (
        "select place_id, case when place_id % 3 = 0 or lower(trim(place_name)) = lower(trim(alt_names[1])) then 1.0 when contains(lower(place_name), lower(alt_names[1])) or contains(lower(alt_names[1]), lower(place_name)) "
        "then 0.8 when place_id % 2 = 0 and admin1 is not null then 0.5 else 0.0 end as tier from gazetteer"
    ),
    "port_scores": (
        f"with s as (select *, coalesce((asset_type = 'port')::int, 0) + coalesce((harbor_size = 'L')::int, 0) as yes, (latitude > 0)::int as north from sites) select iso3, sum(yes) as yes, round(sum((yes * 0.4 "
        f"+ coalesce(north, 0) * 0.1) * 20), 6) as score, round({_HAV.format('min(latitude)', 'min(longitude)', 'max(latitude)', 'max(longitude)')}, 4) as span_km from s group by 1"
    ),
    "distance_forms": f"""with v as (select event_id_cnty, max({_F('latitude')}) as lat, max({_F('longitude')}) as lon from verified_events group by 1) select event_id_cnty, case when lat is not null and lon is not null then round({_HAV.format('lat', 'lon', '10.0', '20.0')}, 4) end as atan2_km,
 round(6371 * sqrt(pow(radians(20 - lon) * cos(radians((lat + 10) / 2)), 2) + pow(radians(10 - lat), 2)), 4) as flat_km, round(6371 * sqrt(pow(radians(10 - lat), 2) + pow(radians(20 - lon), 2)), 4) as planar_km from v""",
    "parsed_extras": (
        "select record_id, coalesce(try_cast(json_extract_string(extras, '$.reported_day_number') as double), -1) as reported_day_number, lower(trim(coalesce(json_extract_string(extras, '$.sector'), 'None'))) "
        "as sector, coalesce(lower(trim(json_extract_string(extras, '$.issue'))), '-') as issue from extract_records"
    ),
    "place_lists": (
        "with r as (select record_id, case when location_name is null or trim(location_name) = '' then [] when starts_with(trim(location_name), '[') then from_json(trim(location_name), '[\"VARCHAR\"]') else [trim(location_name)] "
        "end as names from extract_records) select record_id, len(names) as n, greatest(len(names), 1) as rows, list_max(names) as last, len(names) > 0 as filled from r"
    ),
    "cluster_actors": f"select place_id, array_to_string(list_sort({_LISTED.format('list_concat(coalesce(alt_names, []), [place_name, admin1])')}), ';') as names, coalesce(list_has_any(alt_names, [place_name]), false) as own, lower(trim(place_name)) as once from gazetteer",
    "page_dates": f"""with x as (select record_id, {_DAY('event_date')} as e, {_DAY('publish_date')} as p, record_id % 4 as k, coalesce(publish_date, '') as w, coalesce(event_description, '') as t from extract_records)
 select record_id, coalesce(p, e) as published, coalesce(length(nullif(trim(regexp_replace(t, '\\s+', ' ', 'g')), '')), case k when 2 then 4 end) as chars,
 length('<html><head></head>') + length(w) + case k when 0 then length('<meta content="" property="article:published_time">') when 1 then length('<META name="pubdate" content="">') when 2 then length('<time class="x" datetime="">then</time>')
  else length('<script type="application/ld+json">{{"dateModified": ""}}</script>') end as head from x""",
    "xml_sniffs": "select record_id, record_id % 5 in (1, 2) or record_id % 6 <> 4 as xml from extract_records",
    "country_spellings": (
        "with x as (select record_id, ['United States', 'the United Kingdom', 'Democratic Republic of the Congo', 'Democratic Republic of the Congo', 'United States', 'U.S.'][record_id % 6 + 1] as s, ['usa', 'the_uk', "
        "'dr_congo', 'drc', 'us', 'u_s'][record_id % 6 + 1] as g, coalesce(location_name, '-') as l from extract_records) select record_id, l || ', ' || s as place, 'fuel_price_' || g as slug, 'x_' || record_id "
        "as feature from x"
    ),
    "event_starts": f"with x as (select record_id, record_id % 4 as k, {_DAY('publish_date')} as p from extract_records) select record_id, case when k in (0, 2) then p end as start, case when k <> 3 then p end as any_start from x",
    "period_ranks": (
        "select year(o_orderdate) as year, case o_orderkey % 3 when 0 then month(o_orderdate) when 1 then quarter(o_orderdate) * 3 - 2 end as month, case o_orderkey % 3 when 0 then 3 when 1 then 2 else 1 end as "
        "rank, count(*) as n, sum(case when o_orderkey % 2 = 0 and o_custkey % 2 = 0 then 1 when o_orderkey % 2 = 0 or o_custkey % 2 = 0 then 2 else 3 end) as days from orders group by 1, 2, 3"
    ),
    "calendar_windows": """with o as (select o_orderdate::date as d from orders), b as (select min(d) as lo, max(d) as hi from o), m as (select unnest(generate_series(date_trunc('month', lo), hi::timestamp, interval 1 month))::date as m, lo, hi from b),
 w as (select 'month' as kind, greatest(m, lo) as start, greatest(m, lo) - 7 as a, least(last_day(m), hi) + 7 as b from m
  union all select 'half', lo + (i * 182)::int, lo + (i * 182)::int, least(lo + (i * 182 + 363)::int, hi) from (select lo, hi, unnest(generate_series(0, 400)) as i from b) where i = 0 or lo + ((i - 1) * 182 + 363)::int < hi
  union all select 'year', make_date(y, 1, 1), make_date(y, 1, 1), least(make_date(y, 12, 31), hi) from (select hi, unnest(generate_series(year(lo), year(hi)))::int as y from b))
 select kind, start, count(*) as n from w join o on d between a and b group by 1, 2""",
    "url_sets": (
        rf"with x as (select nullif(lower(regexp_extract({_T}, '^(?i)https?://(?:www\.)?([^/:?#]+)', 1)), '') as host, {_NORM} as u, len(list_distinct(list_filter(regexp_split_to_array(lower({_PATH}), '[^a-z0-9]+'), "
        rf"lambda t: t <> ''))) as k from extract_records) select host, count(distinct u) as n_urls, min(u) as first, sum(k) as tokens from x where host is not null group by 1"
    ),
    "ordered_places": "select site_id, coalesce(list_position(['L', 'M', 'S', 'V'], coalesce(harbor_size, '?')), 5) as at, case when site_id % 2 = 0 then '2020-01-01' else '9999' end as key from sites",
    "numbered_clusters": "select cluster_id, coalesce(n_articles, 0) as n_articles, row_number() over (order by coalesce(n_articles, 0) desc, cluster_id) as ordinal from event_clusters",
    "value_ranks": (
        "with v as (select event_type, cast(ts as date) as d, round(sum(value), 2) as v from events group by all) select event_type, d, round(cume_dist() over (partition by event_type order by v), 6) as cdf, rank() "
        "over (partition by event_type order by v) as rank, max(v) over (partition by event_type order by d rows unbounded preceding) as top from v"
    ),
}
