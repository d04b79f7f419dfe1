"""Summaries over entities, months and years, and the patches of panels that follow from them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import collections as C
from strandline.functions.dates import read_date
from strandline.functions.keys import code_key, finite
from strandline.functions.urls import path_tokens
from strandline.operators import dedupe, merge, metrics, reshape
from strandline.operators import panel as P
from strandline.plans.tables import table
from strandline.plans.text_queries import _ISO, _PATH, _T, _UNQ


def _r(c, n=6):
    return F.round(c, n)


def coverage_change(spark, d):
    """How many records of a known type give place and date, before and after they were merged into clusters."""
    def of(df, name, place, day):
        known = df.where(F.coalesce(F.col("disruption_type"), F.lit("unknown")) != "unknown")
        return known.agg(F.lit(name).alias("stage"), F.count("*").alias("n"), F.count_if(C.is_filled(F.col(place), "string")).alias("place"), F.count_if(C.is_filled(F.col(day).cast("string"), "string")).alias("day"), F.count_if(C.is_filled(F.col(place), "string") | C.is_filled(F.col(day).cast("string"), "string")).alias("any"))
    return of(table(spark, d, "extract_records"), "before", "location_name", "event_date").unionByName(of(table(spark, d, "event_clusters"), "after", "location_name", "event_date"))


def conditional_fills(spark, d):
    """One figure filled from another, from the unit's next row, and by 0."""
    p = table(spark, d, "modelling_panel_gdelt").select("panel_id", code_key(F.col("adm1_code")).alias("unit"), "date", *(finite(F.col(c)).alias(c) for c in ("unemployment_rate", "unemployment_total", "fx_pct_30d")))
    w = Window.partitionBy("unit").orderBy("date", "panel_id").rowsBetween(0, Window.unboundedFollowing)
    return p.select("panel_id", F.coalesce("unemployment_rate", "unemployment_total").alias("rate"), F.coalesce(F.first("fx_pct_30d", ignorenulls=True).over(w), F.lit(0.0)).alias("fx"))


def history_lags(spark, d):
    """A daily series lagged over its whole history, mapped to the dates of its second half, which so has no gap at its start."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    w = Window.orderBy("day").partitionBy(F.lit(1))  # a row per day
    s = o.withColumn("lag_30", F.lag("n", 30).over(w))
    late = o.where("day >= date'1998-01-01'").select("day", "n")
    return late.join(s.select("day", "lag_30"), "day", "left")


def recomputed_series(spark, d):
    """Older rows put before a series, gaps of up to seven days filled, changes computed anew; where both have a day the current row holds."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderdate").cast("date").alias("day")).agg(F.count("*").alias("n"))
    thin = o.where("dayofmonth(day) % 3 <> 0")
    all_ = dedupe.prepend_history(thin.where("day >= date'1996-06-01'"), thin.where("day < date'1996-06-10'").withColumn("n", F.col("n") + 1000), ["day"]).withColumn("k", F.lit(1))
    full = P.dense(all_, ["k"], "day", {})
    w = P.by(["k"], "day")
    x = full.withColumn("n", P.ffill(F.col("n"), w, 7))
    return x.select("day", "n", _r(P.pct_change(F.col("n"), w, 7)).alias("pct_7"))


def scored_weeks(spark, d):
    """Records whose expert is fairly sure, by week."""
    r = table(spark, d, "extract_records").select(F.date_trunc("week", "ingest_time").cast("date").alias("week"), F.col("expert_probability").cast("string").try_cast("double").alias("p"))
    return r.where(finite(F.col("p")) > 0.4).groupBy("week").agg(F.count("*").alias("n"), _r(F.avg("p")).alias("mean"))


YEARS = [2017, 2018, 2019, 2020, 2021]


def activity_matrix(spark, d):
    """Verified events by country and year, the busiest countries first."""
    v = table(spark, d, "verified_events").select("event_id_cnty", "country", F.year("event_date").alias("year")).distinct().where("country is not null")
    p = reshape.pivot_agg(v, ["country"], "year", F.lit(1), F.count, YEARS, 0, "total").toDF("country", *(f"y{y}" for y in YEARS), "total")
    return dedupe.top_k(p.withColumn("all", F.lit(1)), ["all"], [F.desc("total"), F.col("country")], 30).drop("all")


def coverage_matrix(spark, d):
    """Share of a figure that is known, by country and year, and its total missing share."""
    p = table(spark, d, "modelling_panel_gdelt").select(code_key(F.col("country_iso3")).alias("iso3"), F.year("date").alias("year"), finite(F.col("gini_coef")).isNotNull().cast("double").alias("k"))
    by_year = reshape.pivot_agg(p, ["iso3"], "year", F.col("k"), F.avg, YEARS, 0.0).toDF("iso3", *(f"y{y}" for y in YEARS))
    missing = p.groupBy("iso3").agg((1 - F.avg("k")).alias("missing"), F.count("*").alias("n"))
    return by_year.join(missing, "iso3").select("iso3", *(_r(F.col(f"y{y}")).alias(f"y{y}") for y in YEARS), _r(F.col("missing")).alias("missing"), "n")


def month_frames(spark, d):
    """Verified events by month with the size of their marks."""
    v = table(spark, d, "verified_events").select(F.date_format("event_date", "yyyy-MM").alias("frame"), (F.least(F.coalesce("fatalities", F.lit(0)), F.lit(50)) / 10 + 4).alias("size"))
    return v.groupBy("frame").agg(F.count("*").alias("n"), _r(F.avg("size")).alias("mean_size"), F.max("size").alias("largest"))


def yearly_changes(spark, d):
    """Change of each country's mean figure against the year before, within +-100, a column per year."""
    p = table(spark, d, "modelling_panel_gdelt").select(code_key(F.col("country_iso3")).alias("iso3"), F.year("date").alias("year"), finite(F.col("food_cpi_inflation")).alias("x"))
    m = p.groupBy("iso3", "year").agg(F.avg("x").alias("x"))
    before = F.lag("x").over(Window.partitionBy("iso3").orderBy("year"))
    c = m.withColumn("c", (F.try_divide(F.col("x"), before) - 1) * 100)
    c = c.withColumn("c", F.when(F.col("c").isNotNull(), F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("c")))))
    out = reshape.pivot_agg(c, ["iso3"], "year", F.col("c"), F.max, YEARS).toDF("iso3", *(f"y{y}" for y in YEARS))
    return out.select("iso3", *(_r(F.col(f"y{y}"), 4).alias(f"y{y}") for y in YEARS))


def shared_series(spark, d):
    """One series for all members of a union, a constant one for the base, others their own."""
    n = table(spark, d, "nation").select("n_name", "n_nationkey")
    of = F.when(F.col("n_nationkey") % 5 == 0, "UNION").when(F.col("n_nationkey") % 5 == 1, "BASE").otherwise(F.col("n_name"))
    member = n.select("n_nationkey", of.alias("series"))
    s = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.avg("c_acctbal").alias("x")).join(member, "n_nationkey")
    one = s.groupBy("series").agg(F.min_by("x", "n_nationkey").alias("x"))
    return member.join(one, "series", "left").select("n_nationkey", "series", _r(F.when(F.col("series") == "BASE", 1.0).otherwise(F.col("x")), 4).alias("x"))


def grid_matrix(spark, d):
    """Mean fatalities on a grid of 30 degrees, a column per band of longitude, cells without events 0."""
    r = table(spark, d, "verified_events").select(finite(F.col("latitude")).alias("lat"), finite(F.col("longitude")).alias("lon"), "fatalities")
    g = reshape.grid_mean(r, "lat", "lon", "fatalities", 30.0)
    bands = [float(x) for x in range(-180, 180, 60)]
    out = reshape.pivot_agg(g.withColumn("band", F.floor(F.col("lon_cell") / 60) * 60.0), ["lat_cell"], "band", F.col("mean"), F.max, bands, 0.0)
    return out.toDF("lat_cell", *(f"b{int(b) + 180}" for b in bands)).select("lat_cell", *(_r(F.col(f"b{int(b) + 180}")).alias(f"b{int(b) + 180}") for b in bands))


def series_summaries(spark, d):
    """Each user's daily totals: first and last, total change, extremes, volatility of changes, and days of crisis."""
    v = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.sum("value").alias("v"))
    w = P.by(["user_id"], "d")
    x = v.withColumn("c", P.pct_change(F.col("v"), w, 1))
    out = x.groupBy("user_id").agg(F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.min_by("v", "d").alias("a"), F.max_by("v", "d").alias("b"), F.stddev_samp("c").alias("vol"), F.count_if(F.col("c") < -50).alias("crisis_days"))
    return out.select("user_id", "first_day", "last_day", _r((F.try_divide(F.col("b"), F.col("a")) - 1) * 100, 4).alias("total_pct"), _r(F.col("vol"), 4).alias("volatility"), "crisis_days")


def nested_field_stats(spark, d):
    """Of each number in the records' extras: how often it is there, its sum, median and largest."""
    r = table(spark, d, "extract_records").select("disruption_type", F.from_json("extras", "map<string,string>").alias("m")).where("m is not null")
    x = r.select("disruption_type", F.explode("m").alias("key", "v")).select("disruption_type", "key", F.col("v").try_cast("double").alias("v")).where("v is not null")
    return x.groupBy("disruption_type", "key").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.median("v").alias("median"), F.max("v").alias("most"))


def token_days(spark, d):
    """The tokens of addresses against the days of a fortnight: in how many records of each day."""
    x = table(spark, d, "extract_records").select("record_id", F.datediff(F.col("ingest_time").cast("date"), F.lit("2020-01-01")).alias("k"), F.explode(F.array_distinct(path_tokens(F.col("url")))).alias("token"))
    days = list(range(14))
    out = reshape.pivot_agg(x.where(F.col("k").between(0, 13)), ["token"], "k", F.lit(1), F.count, days, 0, "total")
    return out.toDF("token", *(f"d{k}" for k in days), "total")


def tidy_figures(spark, d):
    """Releases as long rows: code, indicator, year and a number, what can't be read left out."""
    r = table(spark, d, "country_indicators")
    return r.select(code_key(F.col("country_iso3")).alias("iso3"), F.lower(F.trim("indicator")).alias("indicator"), F.col("year").cast("string").try_cast("int").alias("year"), finite(F.col("value").cast("string").try_cast("double")).alias("value")).where("iso3 is not null and value is not null")


def flat_clusters(spark, d):
    """Clusters without their nested columns, but with what these tell."""
    c = table(spark, d, "event_clusters")
    flat = c.withColumns({"has_conflict": C.is_filled(F.col("conflicted_fields"), "array<string>"), "n_conflicts": F.greatest(F.size(F.coalesce("conflicted_fields", F.array().cast("array<string>"))), F.lit(0))})
    return flat.select(*(n for n, t in flat.dtypes if not t.startswith(("array", "map", "struct")) and n in ("cluster_id", "iso3", "n_articles", "has_conflict", "n_conflicts")))


def year_days(spark, d):
    """Yearly figures on every day of their year."""
    y = table(spark, d, "country_indicators").where("lower(trim(indicator)) = 'gdp_growth'").select(code_key(F.col("country_iso3")).alias("iso3"), "year", finite(F.col("value")).alias("v"))
    y = y.groupBy("iso3", "year").agg(F.max("v").alias("v")).where("iso3 is not null")
    return P.year_spine(y, "year", "day").groupBy("iso3", F.date_format("day", "yyyy-MM").alias("month")).agg(F.count("*").alias("days"), _r(F.max("v")).alias("v"))


def counted_sets(spark, d):
    """How many verified events were seen, over all, by year, by country, and by both."""
    v = table(spark, d, "verified_events").groupBy("event_id_cnty").agg(F.max("country").alias("country"), F.year(F.max("event_date")).alias("year"), F.max("fatalities").alias("f"))
    v = v.withColumn("seen", F.when(F.col("f").isNotNull(), F.col("f") > 0))
    m = metrics.match_rates(v, "seen", [[], ["year"], ["country"], ["year", "country"]])
    return m.select(*(c if t != "double" else _r(F.col(c)).alias(c) for c, t in m.dtypes))


def merged_dates(spark, d):
    """Distinct addresses of each day's records, sorted, and the day they were first in."""
    r = table(spark, d, "extract_records").select(read_date(F.col("event_date")).alias("day"), F.array("source_title", "source_title").alias("titles")).where("day is not null")
    x = r.groupBy("day").agg(merge.union_array("titles").alias("t"))
    return x.select("day", F.size("t").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"))


QUERIES = {f.__name__: f for f in (
    coverage_change, conditional_fills, history_lags, recomputed_series, scored_weeks, activity_matrix, coverage_matrix, month_frames, yearly_changes, shared_series, grid_matrix, series_summaries, nested_field_stats, token_days, tidy_figures,
    flat_clusters, year_days, counted_sets, merged_dates,
)}

_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_F = lambda c: f"(case when isfinite({c}) then {c} end)"
_COVER = "count(*) as n, count(*) filter (trim(location_name) <> '') as place, count(*) filter (trim(event_date::varchar) <> '') as day, count(*) filter (coalesce(trim(location_name) <> '', false) or coalesce(trim(event_date::varchar) <> '', false)) as \"any\""
_O = "o as (select o_orderdate::date as day, count(*) as n from orders group by 1)"
_BANDS = list(range(0, 360, 60))
SQL = {
    "coverage_change": f"select 'before' as stage, {_COVER} from extract_records where coalesce(disruption_type, 'unknown') <> 'unknown' union all select 'after', {_COVER} from event_clusters where coalesce(disruption_type, 'unknown') <> 'unknown'",
    "conditional_fills": (
        f"select panel_id, coalesce({_F('unemployment_rate')}, {_F('unemployment_total')}) as rate, coalesce(first_value({_F('fx_pct_30d')} ignore nulls) over (partition by {_K.format('adm1_code')} order by date, "
        f"panel_id rows between current row and unbounded following), 0) as fx from modelling_panel_gdelt"
    ),
    "history_lags": f"with {_O}, s as (select day, n, lag(n, 30) over (order by day) as lag_30 from o) select * from s where day >= date '1998-01-01'",
    "recomputed_series": f"""with {_O}, t as (select * from o where day(day) % 3 <> 0), u as (select day, n from t where day >= date '1996-06-01' union all select day, n + 1000 from t where day < date '1996-06-01'),
 g as (select unnest(generate_series(min(day)::timestamp, max(day)::timestamp, interval 1 day))::date as day from u), f as (select day, last_value(n ignore nulls) over (order by day rows between 7 preceding and current row) as n from g left join u using (day))
 select day, n, round((n / lag(n, 7) over (order by day) - 1) * 100, 6) as pct_7 from f""",
    "scored_weeks": f"select date_trunc('week', ingest_time)::date as week, count(*) as n, round(avg(expert_probability), 6) as mean from extract_records where {_F('expert_probability')} > 0.4 group by 1",
    "activity_matrix": "with v as (select distinct event_id_cnty, country, year(event_date) as y from verified_events where country is not null), p as (select country, " + ", ".join(f"count(*) filter (y = {y}) as y{y}" for y in YEARS) + ", " + " + ".join(f"count(*) filter (y = {y})" for y in YEARS) + " as total from v group by 1) select * from (select *, row_number() over (order by total desc, country) as rank from p) where rank <= 30",
    "coverage_matrix": f"with p as (select {_K.format('country_iso3')} as iso3, year(date) as y, ({_F('gini_coef')} is not null)::int::double as k from modelling_panel_gdelt) select iso3, " + ", ".join(f"round(coalesce(avg(k) filter (y = {y}), 0), 6) as y{y}" for y in YEARS) + ", round(1 - avg(k), 6) as missing, count(*) as n from p where iso3 is not null group by 1",
    "month_frames": "select strftime(event_date, '%Y-%m') as frame, count(*) as n, round(avg(least(coalesce(fatalities, 0), 50) / 10 + 4), 6) as mean_size, max(least(coalesce(fatalities, 0), 50) / 10 + 4) as largest from verified_events group by 1",
    "yearly_changes": f"with m as (select {_K.format('country_iso3')} as iso3, year(date) as y, avg({_F('food_cpi_inflation')}) as x from modelling_panel_gdelt group by 1, 2), c as (select iso3, y, x, lag(x) over (partition by iso3 order by y) as b from m), d as (select iso3, y, case when x is not null and b is not null and b <> 0 then greatest(-100.0, least(100.0, (x / b - 1) * 100)) end as c from c) select iso3, " + ", ".join(f"round(max(c) filter (y = {y}), 4) as y{y}" for y in YEARS) + " from d group by 1",
    "shared_series": (
        "with m as (select n_nationkey, case n_nationkey % 5 when 0 then 'UNION' when 1 then 'BASE' else n_name end as series from nation), s as (select series, n_nationkey, avg(c_acctbal) as x from customer join "
        "m on c_nationkey = n_nationkey group by all), o as (select series, arg_min(x, n_nationkey) as x from s group by 1) select n_nationkey, series, round(case when series = 'BASE' then 1.0 else x end, 4) as "
        "x from m left join o using (series)"
    ),
    "grid_matrix": f"with c as (select floor({_F('latitude')} / 30) * 30.0 as lat_cell, floor({_F('longitude')} / 30) * 30.0 as lon_cell, avg(fatalities) as m from verified_events where isfinite(latitude) and isfinite(longitude) group by 1, 2) select lat_cell, " + ", ".join(f"round(coalesce(max(m) filter (floor(lon_cell / 60) * 60 = {b - 180}), 0), 6) as b{b}" for b in _BANDS) + " from c group by 1",
    "series_summaries": (
        "with v as (select user_id, cast(ts as date) as d, sum(value) as v from events group by all), x as (select *, (v / nullif(lag(v) over (partition by user_id order by d), 0) - 1) * 100 as c from v) select "
        "user_id, min(d) as first_day, max(d) as last_day, round((arg_max(v, d) / nullif(arg_min(v, d), 0) - 1) * 100, 4) as total_pct, round(stddev_samp(c), 4) as volatility, count(*) filter (c < -50) as crisis_days "
        "from x group by 1"
    ),
    "nested_field_stats": (
        "with x as (select disruption_type, unnest(json_keys(extras)) as key, extras from extract_records where extras is not null), y as (select disruption_type, key, try_cast(json_extract_string(extras, '$.' "
        "|| key) as double) as v from x) select disruption_type, key, count(*) as n, sum(v) as total, median(v) as median, max(v) as most from y where v is not null group by all"
    ),
    "token_days": rf"with x as (select date_diff('day', date '2020-01-01', ingest_time::date) as k, unnest(list_distinct(list_filter(regexp_split_to_array(lower({_UNQ.format(_PATH)}), '[/\-_.]+'), lambda t: length(t) >= 3 and not regexp_matches(t, '^\d+$')))) as token from extract_records where url is not null and {_T} <> '') select token, " + ", ".join(f"count(*) filter (k = {k}) as d{k}" for k in range(14)) + ", count(*) as total from x where k between 0 and 13 group by 1",
    "tidy_figures": f"select {_K.format('country_iso3')} as iso3, lower(trim(indicator)) as indicator, year, {_F('value')} as value from country_indicators where {_K.format('country_iso3')} is not null and {_F('value')} is not null",
    "flat_clusters": "select cluster_id, iso3, n_articles, coalesce(len(conflicted_fields) > 0, false) as has_conflict, coalesce(len(conflicted_fields), 0) as n_conflicts from event_clusters",
    "year_days": (
        f"with y as (select {_K.format('country_iso3')} as iso3, year, max({_F('value')}) as v from country_indicators where lower(trim(indicator)) = 'gdp_growth' group by 1, 2), d as (select iso3, v, unnest(generate_series(make_timestamp(year, "
        f"1, 1, 0, 0, 0), make_timestamp(year, 12, 31, 0, 0, 0), interval 1 day))::date as day from y where iso3 is not null) select iso3, strftime(day, '%Y-%m') as month, count(*) as days, round(max(v), 6) as "
        f"v from d group by 1, 2"
    ),
    "counted_sets": (
        "with v as (select max(country) as country, year(max(event_date)) as year, max(fatalities) > 0 as seen from verified_events group by event_id_cnty) select year, country, count(*) as n, count(seen) as resolved, "
        "count(*) filter (seen) as matched, grouping(year, country) as level, round(count(*) filter (seen) / nullif(count(seen), 0), 6) as rate from v group by grouping sets ((), (year), (country), (year, country))"
    ),
    "merged_dates": (
        f"with x as (select {_ISO.format('trim(event_date)')} as day, source_title from extract_records) select day, count(distinct coalesce(source_title, '~null')) as n, case when count(*) > count(source_title) "
        f"then coalesce(min(source_title), null) else min(source_title) end as first from x where day is not null group by 1"
    ),
}
