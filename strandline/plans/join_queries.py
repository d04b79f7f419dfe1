"""Queries that join events in time and space."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import code_key, days
from strandline.functions.strings import location_tokens
from strandline.operators import dedupe, joins, metrics, reshape
from strandline.plans.tables import table

# Straits, as (latitude, longitude).
STRAITS = {"hormuz": (26.57, 56.25), "malacca": (2.5, 101.4), "suez": (30.5, 32.35), "bab_el_mandeb": (12.6, 43.3), "panama": (9.1, -79.7), "bosphorus": (41.1, 29.05), "gibraltar": (35.95, -5.6), "dover": (51.0, 1.45), "good_hope": (-34.36, 18.47)}


def _events(spark: SparkSession, d: str, kind: str) -> DataFrame:
    return table(spark, d, "events").where(F.col("event_type") == kind).select("event_id", "user_id", F.col("ts").cast("date").alias("d"), "value")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_clusters").select("cluster_id", "disruption_type", F.col("event_date").cast("date").alias("event_date"), code_key(F.col("iso3")).alias("iso3"), "location_name", "n_articles", "confidence_max", "lat", "lon")


def _verified(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "verified_events").select("event_id_cnty", F.col("event_date").cast("date").alias("event_date"), code_key(F.col("iso3")).alias("iso3"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), "fatalities", "ingest_time")
    nan = lambda c: F.when(~F.isnan(c), F.col(c))
    return dedupe.keep_last(v, ["event_id_cnty"], ["ingest_time"]).withColumns({"lat": nan("lat"), "lon": nan("lon")})


def interval_match_counts(spark, d):
    """Purchases, and their value, within two days of each error of the same user."""
    got = joins.interval_counts(_events(spark, d, "error"), _events(spark, d, "purchase"), ["user_id"], "d", "d", 2, {"n_near": F.lit(1), "value_near": F.col("value")})
    return got.select("event_id", "user_id", "d", "n_near", F.round("value_near", 4).alias("value_near"))


def interval_pairs(spark, d):
    """Each error with the user's signups of the same or the three days after."""
    p = joins.within_days(_events(spark, d, "error"), _events(spark, d, "signup"), ["user_id"], "d", "d", 0, 3)
    return p.select("event_id", F.col("r_event_id").alias("signup_id"), F.datediff("r_d", "d").alias("gap"))


def exists_near(spark, d):
    return joins.exists_within(_events(spark, d, "error"), _events(spark, d, "signup"), ["user_id"], "d", "d", 1, "has_signup").select("event_id", "has_signup")


def match_rate_levels(spark, d):
    """Share of clusters that a verified event of the country confirms within two days: overall, by type, by year."""
    c = joins.exists_within(_clusters(spark, d), _verified(spark, d), ["iso3"], "event_date", "event_date", 2, "hit").withColumn("year", F.year("event_date"))
    return metrics.match_rates(c, "hit", [[], ["disruption_type"], ["year"]])


def missed_events(spark, d):
    """Verified events with no cluster of their country within three days."""
    return joins.exists_within(_verified(spark, d), _clusters(spark, d), ["iso3"], "event_date", "event_date", 3, "seen").where("not seen").select("event_id_cnty", "iso3", "event_date")


def nearest_verified(spark, d):
    """Per cluster the nearest verified event of its country within two days."""
    return joins.nearest_within(_clusters(spark, d), _verified(spark, d), ["iso3"], "cluster_id", "event_id_cnty", "event_date", "event_date", 2, 100.0).select("cluster_id", "event_id_cnty", F.round("km", 4).alias("km"), "match")


def window_pairs(spark, d):
    """Pairs of clusters of one country and type at most a week apart."""
    p = joins.window_pairs(_clusters(spark, d).select("cluster_id", "iso3", "disruption_type", "event_date"), ["iso3", "disruption_type"], "cluster_id", "event_date", 7)
    return p.select("a_cluster_id", "b_cluster_id", F.abs(F.datediff("a_event_date", "b_event_date")).alias("gap"))


def location_jaccard(spark, d):
    """Pairs of clusters of one country and type whose places share words, and how much."""
    t = _clusters(spark, d).select("cluster_id", "iso3", "disruption_type", location_tokens(F.col("location_name")).alias("t"))
    p = joins.token_pairs(t, "cluster_id", "t", ["iso3", "disruption_type"], 0.6)
    return p.select("a", "b", "common", F.round("jaccard", 6).alias("jaccard"))


def sites_by_strait(spark, d):
    s = joins.nearest_constant(table(spark, d, "sites"), "latitude", "longitude", STRAITS, 3000.0)
    return s.select("site_id", "nearest", F.round("nearest_km", 4).alias("nearest_km"))


def outer_indicators(spark, d):
    """Both indicators' first releases by country and year, whichever exist."""
    i = table(spark, d, "country_indicators").select(code_key(F.col("country_iso3")).alias("iso3"), F.trim("indicator").alias("indicator"), "year", "value", "released_at").where("value is not null and not isnan(value)")
    first = dedupe.keep_first(i, ["iso3", "indicator", "year"], ["released_at"])
    of = lambda n: first.where(F.col("indicator") == n).select("iso3", "year", F.col("value").alias(n))
    return reshape.full_outer(of("political_stability_est"), of("gdp_growth"), ["iso3", "year"])


def mapped_countries(spark, d):
    """Records by whether their country code is known to the gazetteer."""
    known = table(spark, d, "gazetteer").select(code_key(F.col("iso3")).alias("k")).distinct().withColumn("known", F.lit(True))
    r = table(spark, d, "extract_records").select(code_key(F.col("iso3")).alias("iso3"))
    return r.join(known, F.col("iso3") == F.col("k"), "left").groupBy("iso3").agg(F.count("*").alias("n"), F.coalesce(F.max("known"), F.lit(False)).alias("mapped"))


def layered_orders(spark, d):
    """Orders with the fields of two layers joined by key; unmatched layer rows are ignored."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.sum("l_quantity").alias("quantity"))
    late = table(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("returned"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey").join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "items", "quantity", F.coalesce("returned", F.lit(0)).alias("returned"))


def month_matches(spark, d):
    """Clusters whose country has a verified event in the same month; no country gives NULL."""
    m = _verified(spark, d).groupBy("iso3", F.trunc("event_date", "MM").alias("month")).agg(F.count("*").alias("n_verified"))
    c = _clusters(spark, d).withColumn("month", F.trunc("event_date", "MM"))
    return c.join(m, ["iso3", "month"], "left").select("cluster_id", F.when(F.col("iso3").isNotNull(), F.coalesce("n_verified", F.lit(0))).alias("n_verified"))


def entity_baselines(spark, d):
    """Each order against the mean of its customer's nation."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    mean = o.groupBy(F.col("c_nationkey").alias("k")).agg(F.avg("o_totalprice").alias("mean"))
    return o.join(mean, F.col("c_nationkey") == F.col("k")).select("o_orderkey", F.round(F.col("o_totalprice") / F.col("mean"), 6).alias("ratio"))


def key_sets(spark, d):
    """Days with purchases, with errors, with both, by user."""
    day = lambda k: _events(spark, d, k).select("user_id", "d").distinct()
    a, b = day("purchase"), day("error")
    return a.union(b).distinct().join(a.intersect(b).withColumn("both", F.lit(1)), ["user_id", "d"], "left").groupBy("user_id").agg(F.count("*").alias("either"), F.count("both").alias("both"))


def upserted(spark, d):
    """Orders with urgent ones replaced by a later version."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_orderkey", F.lit("X").alias("o_orderstatus"), "o_totalprice")
    return dedupe.upsert(o, new, ["o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def backfill_days(spark, d):
    """Calendar days of the panel's span without any label row."""
    g = table(spark, d, "gdelt_daily_labels")
    lo, hi = g.agg(F.min("date"), F.max("date")).first()
    if lo is None:
        return g.select(F.col("date").alias("day")).limit(0)
    every = spark.range(1).select(F.explode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))).alias("day"))
    return every.join(g.select(F.col("date").cast("date").alias("day")).distinct(), "day", "left_anti")


def date_gaps(spark, d):
    """Days between an event's date and its arrival, by country."""
    v = table(spark, d, "verified_events").select(code_key(F.col("iso3")).alias("iso3"), (days(F.col("ingest_time")) - days(F.col("event_date"))).alias("lag"))
    return v.groupBy("iso3").agg(F.count("*").alias("n"), F.min("lag").alias("least"), F.max("lag").alias("most"), F.round(F.avg("lag"), 6).alias("mean"))


QUERIES = {f.__name__: f for f in (interval_match_counts, interval_pairs, exists_near, match_rate_levels, missed_events, nearest_verified, window_pairs, location_jaccard, sites_by_strait, outer_indicators, mapped_countries, layered_orders, month_matches, entity_baselines, key_sets, upserted, backfill_days, date_gaps)}

_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_E = "select event_id, user_id, cast(ts as date) as d, value from events where event_type = '{}'"
_C = f"c as (select cluster_id, disruption_type, event_date::date as event_date, {_K.format('iso3')} as iso3, location_name, lat, lon from event_clusters)"
_V = f"v as (select event_id_cnty, arg_max(event_date::date, ingest_time) as event_date, arg_max({_K.format('iso3')}, ingest_time) as iso3, arg_max(case when not isnan(latitude) then latitude end, ingest_time) as lat, arg_max(case when not isnan(longitude) then longitude end, ingest_time) as lon from verified_events group by 1)"
_HAV = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2))))"
_S = ", ".join(f"({i}, '{n}', {a}, {o})" for i, (n, (a, o)) in enumerate(STRAITS.items()))
SQL = {
    "interval_match_counts": (
        f"with l as ({_E.format('error')}), r as ({_E.format('purchase')}) select l.event_id, l.user_id, l.d, count(r.event_id) as n_near, round(coalesce(sum(r.value), 0), 4) as value_near from l left join r on "
        f"l.user_id = r.user_id and r.d between l.d - 2 and l.d + 2 group by all"
    ),
    "interval_pairs": f"with l as ({_E.format('error')}), r as ({_E.format('signup')}) select l.event_id, r.event_id as signup_id, date_diff('day', l.d, r.d) as gap from l join r on l.user_id = r.user_id and r.d between l.d and l.d + 3",
    "exists_near": f"with l as ({_E.format('error')}), r as ({_E.format('signup')}) select event_id, exists (select 1 from r where r.user_id = l.user_id and r.d between l.d - 1 and l.d + 1) as has_signup from l",
    "match_rate_levels": (
        f"with {_C}, {_V}, h as (select disruption_type, year(event_date) as year, case when iso3 is not null and event_date is not null then exists (select 1 from v where v.iso3 = c.iso3 and v.event_date between "
        f"c.event_date - 2 and c.event_date + 2) end as hit from c) select disruption_type, year, count(*) as n, count(hit) as resolved, count(*) filter (hit) as matched, grouping(disruption_type, year) as level, "
        f"count(*) filter (hit) / nullif(count(hit), 0) as rate from h group by grouping sets ((), (disruption_type), (year))"
    ),
    "missed_events": f"with {_C}, {_V} select event_id_cnty, iso3, event_date from v where iso3 is not null and event_date is not null and not exists (select 1 from c where c.iso3 = v.iso3 and c.event_date between v.event_date - 3 and v.event_date + 3)",
    "nearest_verified": (
        f"with {_C}, {_V}, x as (select cluster_id, event_id_cnty, v.event_date as vd, case when c.lat + c.lon + v.lat + v.lon is null or isnan(c.lat + c.lon + v.lat + v.lon) then null else {_HAV.format(a='c.lat', b='c.lon', c='v.lat', e='v.lon')} "
        f"end as km from c join v on c.iso3 = v.iso3 and v.event_date between c.event_date - 2 and c.event_date + 2), y as (select cluster_id, event_id_cnty, km, row_number() over (partition by cluster_id order "
        f"by km is null, km, vd, event_id_cnty) as n from x) select cluster_id, event_id_cnty, round(km, 4) as km, case when km <= 100 then 'geographic' else 'country_only' end as match from y where n = 1"
    ),
    "window_pairs": (
        f"with {_C} select a.cluster_id as a_cluster_id, b.cluster_id as b_cluster_id, abs(date_diff('day', b.event_date, a.event_date)) as gap from c a join c b on a.iso3 = b.iso3 and a.disruption_type = b.disruption_type "
        f"and a.cluster_id < b.cluster_id and abs(date_diff('day', a.event_date, b.event_date)) <= 7"
    ),
    "location_jaccard": (
        f"with {_C}, t as (select cluster_id, iso3, disruption_type, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(location_name), '\\([^)]*\\)', ' ', 'g'), '[^a-z]+', ' ', 'g'), ' "
        f"'), lambda x: length(x) > 2)) as t from c), p as (select a.cluster_id as a, b.cluster_id as b, len(list_intersect(a.t, b.t)) as common, len(a.t) + len(b.t) as n from t a join t b on a.iso3 = b.iso3 and "
        f"a.disruption_type = b.disruption_type and a.cluster_id < b.cluster_id) select a, b, common, round(common / (n - common), 6) as jaccard from p where common > 0 and common / (n - common) >= 0.6"
    ),
    "sites_by_strait": (
        f"with s(i, name, a, o) as (values {_S}), x as (select site_id, name, {_HAV.format(a='latitude', b='longitude', c='a', e='o')} as km, i from sites cross join s), y as (select *, row_number() over (partition "
        f"by site_id order by km, i) as n from x) select site_id, case when km <= 3000 then name end as nearest, round(km, 4) as nearest_km from y where n = 1"
    ),
    "outer_indicators": (
        f"with i as (select {_K.format('country_iso3')} as iso3, trim(indicator) as indicator, year, arg_min(value, released_at) as value from country_indicators where value is not null and not isnan(value) group "
        f"by all) select coalesce(a.iso3, b.iso3) as iso3, coalesce(a.year, b.year) as year, a.value as political_stability_est, b.value as gdp_growth from (select * from i where indicator = 'political_stability_est') "
        f"a full join (select * from i where indicator = 'gdp_growth') b on a.iso3 = b.iso3 and a.year = b.year"
    ),
    "mapped_countries": f"select {_K.format('iso3')} as iso3, count(*) as n, coalesce({_K.format('iso3')} in (select {_K.format('iso3')} from gazetteer), false) as mapped from extract_records group by 1",
    "layered_orders": (
        "select o_orderkey, items, quantity, coalesce(returned, 0) as returned from orders left join (select l_orderkey, count(*) as items, sum(l_quantity) as quantity from lineitem group by 1) a on a.l_orderkey "
        "= o_orderkey left join (select l_orderkey, count(*) as returned from lineitem where l_returnflag = 'R' group by 1) b on b.l_orderkey = o_orderkey"
    ),
    "month_matches": (
        f"with {_C}, {_V}, m as (select iso3, date_trunc('month', event_date) as m, count(*) as n from v group by all) select cluster_id, case when c.iso3 is not null then coalesce(n, 0) end as n_verified from "
        f"c left join m on m.iso3 = c.iso3 and m.m = date_trunc('month', c.event_date)"
    ),
    "entity_baselines": "select o_orderkey, round(o_totalprice / avg(o_totalprice) over (partition by c_nationkey), 6) as ratio from orders join customer on o_custkey = c_custkey",
    "key_sets": (
        "with a as (select distinct user_id, cast(ts as date) as d from events where event_type = 'purchase'), b as (select distinct user_id, cast(ts as date) as d from events where event_type = 'error') select "
        "user_id, count(*) as either, count(x.d) filter (a.d is not null and b.d is not null) as both from (select * from a union select * from b) x left join a using (user_id, d) left join b using (user_id, d) "
        "group by 1"
    ),
    "upserted": "select case when o_orderpriority = '1-URGENT' then 'X' else o_orderstatus end as o_orderstatus, count(*) as n from orders group by 1",
    "backfill_days": "with s as (select cast(unnest(generate_series(min(date)::timestamp, max(date)::timestamp, interval 1 day)) as date) as day from gdelt_daily_labels) select day from s where day not in (select date::date from gdelt_daily_labels)",
    "date_gaps": (
        f"select {_K.format('iso3')} as iso3, count(*) as n, min(date_diff('day', event_date::date, ingest_time::date)) as least, max(date_diff('day', event_date::date, ingest_time::date)) as most, round(avg(date_diff('day', "
        f"event_date::date, ingest_time::date)), 6) as mean from verified_events group by 1"
    ),
}
