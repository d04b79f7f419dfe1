"""Queries of aggregates, merges, deduplication and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.keys import code_key, finite
from strandline.operators import dedupe, merge, metrics, reshape
from strandline.plans.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
TYPES = ["click", "error", "purchase", "signup", "view"]


def pricing_summary(spark, d):
    """Counts, sums and means per return flag and line status."""
    x = table(spark, d, "lineitem").where("l_shipdate <= timestamp_ntz'2001-06-01'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return x.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(net), 2).alias("net"), F.round(F.avg("l_discount"), 6).alias("discount"), F.max("l_tax").alias("most_tax"))


def value_shares(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return n.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def value_percentiles(spark, d):
    v = F.col("value")
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.median(v), 6).alias("median"), F.round(F.percentile(v, 0.1), 6).alias("p10"), F.round(F.percentile(v, 0.9), 6).alias("p90"))


def price_quartiles(spark, d):
    """Quartiles as observed values."""
    return metrics.positive_stats(table(spark, d, "customer").select("c_mktsegment", F.col("c_acctbal").alias("x")), ["c_mktsegment"], "x").withColumn("total", F.round("total", 2))


def dedupe_first(spark, d):
    """The earliest document of each text."""
    docs = table(spark, d, "documents").where("text is not null").select(F.md5("text").alias("digest"), "doc_id", "source")
    return dedupe.keep_first(docs, ["digest"], ["doc_id"])


def dedupe_last(spark, d):
    """The latest event of each user and type."""
    return dedupe.keep_last(table(spark, d, "events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"])


def dedupe_max(spark, d):
    """The dearest order of each customer, of equals the first."""
    return dedupe.keep_max(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", ["o_orderkey"])


def stable_mode(spark, d):
    """Each customer's usual priority, and whether there are others."""
    return dedupe.stable_mode(table(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


def top_parts(spark, d):
    """The five dearest parts of each brand."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_retailprice")
    return dedupe.top_k(p, ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], 5)


def top_orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


def longest_name(spark, d):
    x = table(spark, d, "part").groupBy("p_brand").agg(dedupe.longest(F.col("p_name"), F.col("p_partkey")).alias("longest"), dedupe.first_value(F.col("p_type"), F.col("p_partkey")).alias("first_type"))
    return x


def merged_articles(spark, d):
    """Records of one url host and day merged into one row."""
    r = table(spark, d, "extract_records").select(
        "record_id", "event_date", "location_name", "source_title", "url", "duration_hours", "confidence", finite(F.col("lat")).alias("lat"), finite(F.col("lon")).alias("lon"),
        F.concat_ws("|", F.upper("iso3"), F.to_date("ingest_time")).alias("k"),
    )
    m = merge.merge_articles(r.withColumns({"duration_hours": finite(F.col("duration_hours")), "confidence": finite(F.col("confidence"))}), "k", "record_id")
    return m.withColumns({"lat": F.round("lat", 7), "lon": F.round("lon", 7)})


def merged_maps(spark, d):
    """Per cluster all values its articles give for each of three fields."""
    a = table(spark, d, "source_articles").where("cluster_id is not null")
    m = a.select("cluster_id", F.create_map(F.lit("issue"), F.col("issue"), F.lit("protest_type"), F.col("protest_type"), F.lit("subloc"), F.col("subloc")).alias("m"))
    return merge.merge_maps(m, "cluster_id", "m").select("cluster_id", F.to_json("merged").alias("merged"))


def richest_articles(spark, d):
    """Per cluster the article with most fields known."""
    a = table(spark, d, "source_articles").where("cluster_id is not null").select("cluster_id", "article_id", "issue", "protest_type", "sector", "estimated_participants")
    return merge.richest(a, "cluster_id", ["issue", "protest_type", "sector", "estimated_participants"], "article_id").select("cluster_id", "article_id")


def durations(spark, d):
    """The longest duration a record gives, and where it says so."""
    r = table(spark, d, "extract_records")
    hours, day = finite(F.col("duration_hours")), F.try_variant_get(F.try_parse_json("extras"), "$.reported_day_number", "double")
    x = r.select("record_id", merge.duration_days(F.ceil(hours / 24), day, F.lit(None), F.lit(1)).alias("x"))
    return x.select("record_id", "x.days", "x.source")


def canonical_events(spark, d):
    """Span, implied end and duration of each cluster's event."""
    a = table(spark, d, "source_articles").where("cluster_id is not null").select("cluster_id", F.col("event_date").cast("date").alias("d"), finite(F.col("reported_day_number").cast("double")).alias("n"), finite(F.col("confidence")).alias("c"))
    x = merge.canonical_events(a, "cluster_id", "d", "n", "c")
    return x.select("cluster_id", "start", "latest", "estimated_end", "duration", "n_articles")


def chosen_types(spark, d):
    """Whose type of disruption counts, by type."""
    r = table(spark, d, "extract_records").select(merge.chosen_type(F.col("expert_disruption_type"), finite(F.col("expert_probability")), F.col("llm_disruption_type")).alias("x"))
    return r.groupBy("x.type", "x.source").agg(F.count("*").alias("n"))


def json_fields(spark, d):
    """How often each key of the records' extras occurs, by type."""
    r = table(spark, d, "extract_records").select("disruption_type", F.from_json("extras", "map<string,string>").alias("m"))
    return r.where("m is not null").select("disruption_type", F.explode(F.map_keys("m")).alias("key")).groupBy("disruption_type", "key").agg(F.count("*").alias("n"))


def event_props(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.min("k").alias("low"), F.max("k").alias("high"))


def explode_collect(spark, d):
    """Items of each order collected in order of line number, and counted again."""
    a = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("items"))
    return a.select("l_orderkey", F.size("items").alias("n"), F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ";").alias("parts"))


def first_listed(spark, d):
    """The first, last and number of alternative names of each place."""
    g = table(spark, d, "gazetteer")
    return g.select("place_id", F.try_element_at("alt_names", F.lit(1)).alias("first"), F.try_element_at("alt_names", F.lit(-1)).alias("last"), F.greatest(F.size("alt_names"), F.lit(0)).alias("n"))


PANEL = ["gini_coef", "inflation_cpi_yoy", "unemployment_rate", "unemployment_total", "food_cpi_inflation", "political_stability_est", "gdp_growth"]


def missingness_report(spark, d):
    x = metrics.missingness(table(spark, d, "modelling_panel_gdelt"), PANEL)
    return x.withColumn("pct_missing", F.round("pct_missing", 6))


def coverage_by_country(spark, d):
    p = table(spark, d, "modelling_panel_gdelt").select(code_key(F.col("country_iso3")).alias("iso3"), *(finite(F.col(c)).alias(c) for c in PANEL))
    return metrics.fill_rate(p, "iso3", ["gini_coef", "unemployment_total"]).withColumn("fill_pct", F.round("fill_pct", 6))


def correlation_matrix(spark, d):
    p = table(spark, d, "modelling_panel_gdelt").select(*(finite(F.col(c)).alias(c) for c in ["unemployment_total", "food_cpi_inflation", "political_stability_est", "gdp_growth", "fx_pct_30d", "oil_brent_pct_30d"]))
    return metrics.correlations(p, p.columns).withColumn("r", F.round("r", 6))


def wilson_by_type(spark, d):
    n, k = F.count("*"), F.count_if(F.col("value") > 250)
    lo, hi = metrics.wilson(F.col("k"), F.col("n"))
    return table(spark, d, "events").groupBy("event_type").agg(n.alias("n"), k.alias("k")).select("event_type", "n", "k", F.round(lo, 6).alias("low"), F.round(hi, 6).alias("high"))


def confidence_histogram(spark, d):
    c = finite(F.col("confidence"))
    b = F.when(c.isNull(), "none").when(c < 0.5, "<0.5").when(c < 0.7, "<0.7").when(c < 0.9, "<0.9").otherwise("<=1")
    return table(spark, d, "extract_records").groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def entity_summary(spark, d):
    """First and last value, span, extremes and busy days of each user's daily totals."""
    v = table(spark, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(F.round(F.sum("value"), 4).alias("v"))
    return v.groupBy("user_id").agg(F.min_by("v", "d").alias("first"), F.max_by("v", "d").alias("last"), F.datediff(F.max("d"), F.min("d")).alias("span"), F.max_by("d", F.struct("v", "d")).alias("best_day"), F.count_if(F.col("v") > 500).alias("busy_days"))


def reliable_units(spark, d):
    g = table(spark, d, "gdelt_daily_labels").select(code_key(F.col("adm1_code")).alias("unit"), (finite(F.col("n_protest_events")) + finite(F.col("n_strike_events"))).alias("n"), finite(F.col("n_articles")).alias("a"))
    return metrics.reliable_entities(g, "unit", "n", "a")


def priority_mean(spark, d):
    """Mean price of each customer's orders of the most urgent priority they have."""
    o = table(spark, d, "orders").withColumn("top", F.min("o_orderpriority").over(Window.partitionBy("o_custkey")))
    return o.where(F.col("o_orderpriority") == F.col("top")).groupBy("o_custkey").agg(F.round(F.avg("o_totalprice"), 4).alias("mean"))


def row_index(spark, d):
    """Mean of the figures a row has, and the largest of them with its name."""
    cols = ["unemployment_total", "food_cpi_inflation", "gdp_growth"]
    p = table(spark, d, "modelling_panel_gdelt").select("panel_id", *(finite(F.col(c)).alias(c) for c in cols))
    known = sum((F.col(c).isNotNull().cast("int") for c in cols[1:]), F.col(cols[0]).isNotNull().cast("int"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(cols[0]), F.lit(0.0)))
    top = F.array_max(F.filter(F.array(*(F.struct(F.col(c).alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("n")) for i, c in enumerate(cols))), lambda s: s["v"].isNotNull()))
    return p.select("panel_id", F.round(F.try_divide(total, known), 6).alias("mean"), top["n"].alias("largest"), known.alias("n_known"))


def priority_pivot(spark, d):
    o = table(spark, d, "orders")
    return reshape.pivot_agg(o, ["o_orderstatus"], "o_orderpriority", F.lit(1), F.count, PRIORITIES, 0, "total")


def mean_pivot(spark, d):
    e = table(spark, d, "events")
    p = reshape.pivot_agg(e, ["user_id"], "event_type", F.col("value"), F.avg, TYPES)
    return p.select("user_id", *(F.round(t, 6).alias(t) for t in TYPES))


def first_pivot(spark, d):
    return reshape.pivot_first(table(spark, d, "events"), ["user_id"], "event_type", "event_id", "event_id", TYPES)


def priority_crosstab(spark, d):
    x = reshape.crosstab_percent(table(spark, d, "orders"), "o_orderstatus", "o_orderpriority", PRIORITIES)
    return x.select("o_orderstatus", *(F.round(c, 6).alias(c) for c in PRIORITIES))


def melted_panel(spark, d):
    p = table(spark, d, "modelling_panel_gdelt").select("panel_id", *(finite(F.col(c)).alias(c) for c in ["fx_pct_30d", "oil_brent_pct_30d", "gdp_growth"]))
    return reshape.melt(p, ["panel_id"], ["fx_pct_30d", "oil_brent_pct_30d", "gdp_growth"])


def grid_counts(spark, d):
    r = table(spark, d, "verified_events").select(finite(F.col("latitude")).alias("lat"), finite(F.col("longitude")).alias("lon"), "fatalities")
    return reshape.grid_mean(r, "lat", "lon", "fatalities", 5.0).withColumn("mean", F.round("mean", 6))


def session_chains(spark, d):
    """Runs of a user's events at most twelve hours apart."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("new", F.coalesce(F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")) > 43200, F.lit(True)).cast("int"))
    e = e.withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


def tumbling_days(spark, d):
    return table(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def sliding_windows(spark, d):
    """Counts over windows of eight days, one starting every four."""
    e = table(spark, d, "events").select(F.unix_date(F.col("ts").cast("date")).alias("d"), "event_type")
    k = F.floor(F.col("d") / 4)
    return e.select("event_type", F.explode(F.array(k - 1, k)).alias("k")).groupBy("event_type", F.date_from_unix_date((F.col("k") * 4).cast("int")).alias("start")).agg(F.count("*").alias("n"))


def cube_counts(spark, d):
    """Orders by status and priority, each alone, and in all."""
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping_id().cast("int").alias("level"))


QUERIES = {f.__name__: f for f in (
    pricing_summary, value_shares, value_percentiles, price_quartiles, dedupe_first, dedupe_last, dedupe_max, stable_mode, top_parts, top_orders, longest_name, merged_articles, merged_maps, richest_articles, durations, canonical_events, chosen_types, json_fields, event_props, explode_collect,
    first_listed, missingness_report, coverage_by_country, correlation_matrix, wilson_by_type, confidence_histogram, entity_summary, reliable_units, priority_mean, row_index, priority_pivot, mean_pivot, first_pivot, priority_crosstab, melted_panel, grid_counts, session_chains, tumbling_days, sliding_windows, cube_counts,
)}

_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_F = lambda c: f"(case when isfinite({c}) then {c} end)"
_W = "(({s} / n + 3.8416 / (2 * n)) {op} 1.96 * sqrt({s} / n * (1 - {s} / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)"
SQL = {
    "pricing_summary": (
        "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) as net, round(avg(l_discount), 6) as discount, max(l_tax) as "
        "most_tax from lineitem where l_shipdate <= timestamp '2001-06-01' group by all"
    ),
    "value_shares": "select event_type, count(*) as n, count(distinct user_id) as users, round(100.0 * count(*) / (select count(*) from events), 6) as pct from events group by 1",
    "value_percentiles": "select event_type, round(median(value), 6) as median, round(quantile_cont(value, 0.1), 6) as p10, round(quantile_cont(value, 0.9), 6) as p90 from events group by 1",
    "price_quartiles": (
        "select c_mktsegment, len(v) as n, round(list_sum(v), 2) as total, v[1] as low, v[len(v) // 4 + 1] as q1, v[len(v) // 2 + 1] as q2, v[3 * len(v) // 4 + 1] as q3, v[len(v)] as high from (select c_mktsegment, "
        "list(c_acctbal order by c_acctbal) as v from customer where c_acctbal > 0 group by 1)"
    ),
    "dedupe_first": "select md5(text) as digest, min(doc_id) as doc_id, nullif(arg_min(coalesce(source, '~'), doc_id), '~') as source from documents where text is not null group by 1",
    "dedupe_last": "select user_id, event_type, event_id, ts from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1",
    "dedupe_max": "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n = 1",
    "stable_mode": "with n as (select o_custkey, o_orderpriority as p, count(*) as n, min(o_orderkey) as f from orders group by all) select o_custkey, arg_min(p, (-n, f)) as mode, arg_min(n, (-n, f)) as n, count(*) > 1 as conflict from n group by 1",
    "top_parts": "select p_brand, p_partkey, p_retailprice, rank from (select p_brand, p_partkey, p_retailprice, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rank from part) where rank <= 5",
    "top_orders": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25",
    "longest_name": "select p_brand, arg_min(p_name, (-length(p_name), p_partkey)) as longest, arg_min(p_type, p_partkey) as first_type from part group by 1",
    "merged_articles": (
        f"with r as (select *, concat_ws('|', upper(iso3), ingest_time::date::varchar) as k from extract_records) select k, min(event_date) as event_date, max(event_date) as event_end_date, arg_min(location_name, "
        f"(-length(location_name), record_id)) as location_name, arg_min(source_title, (-length(source_title), record_id)) as source_title, count(distinct url) as n_urls, count(*) as n_articles, arg_min({_F('duration_hours')}, "
        f"record_id) filter ({_F('duration_hours')} is not null) as duration_hours, max({_F('confidence')}) as confidence, round(median({_F('lat')}), 7) as lat, round(median({_F('lon')}), 7) as lon from r group "
        f"by 1"
    ),
    "merged_maps": (
        "with a as (select cluster_id, unnest([issue, protest_type, subloc]) as v, unnest(['issue', 'protest_type', 'subloc']) as k from source_articles where cluster_id is not null), l as (select cluster_id, "
        "k, list_sort(list_distinct(list(v))) as vs from a where v is not null group by all) select cluster_id, '{' || string_agg('\"' || k || '\":' || to_json(vs), ',' order by k) || '}' as merged from l group "
        "by 1"
    ),
    "richest_articles": (
        "select cluster_id, article_id from (select cluster_id, article_id, row_number() over (partition by cluster_id order by (issue is not null)::int + (protest_type is not null)::int + (sector is not null)::int "
        "+ (estimated_participants is not null)::int desc, article_id) as n from source_articles where cluster_id is not null) where n = 1"
    ),
    "durations": (
        f"select record_id, greatest(coalesce(ceil({_F('duration_hours')} / 24), 0), coalesce(try_cast(json_extract_string(extras, '$.reported_day_number') as double), 0), 1.0) as days, case when ceil({_F('duration_hours')} "
        f"/ 24) >= greatest(coalesce(try_cast(json_extract_string(extras, '$.reported_day_number') as double), 0), 1.0) then 'explicit' when try_cast(json_extract_string(extras, '$.reported_day_number') as double) "
        f">= greatest(coalesce(ceil({_F('duration_hours')} / 24), 0), 1.0) then 'day_number' else 'range' end as source from extract_records"
    ),
    "canonical_events": (
        f"with x as (select cluster_id, min(event_date::date) as start, max(event_date::date) as latest, max({_F('reported_day_number::double')}) as n, count(*) as n_articles from source_articles where cluster_id "
        f"is not null group by 1) select cluster_id, start, latest, greatest(latest, start + coalesce(n, 1)::int - 1) as estimated_end, date_diff('day', start, greatest(latest, start + coalesce(n, 1)::int - 1)) "
        f"+ 1 as duration, n_articles from x"
    ),
    "chosen_types": (
        f"select case when {_F('expert_probability')} >= 0.6 and expert_disruption_type is not null then expert_disruption_type else coalesce(llm_disruption_type, 'unknown') end as type, case when {_F('expert_probability')} "
        f">= 0.6 and expert_disruption_type is not null then 'expert' else 'llm' end as source, count(*) as n from extract_records group by 1, 2"
    ),
    "json_fields": "select disruption_type, key, count(*) as n from (select disruption_type, unnest(json_keys(extras)) as key from extract_records where extras is not null) group by all",
    "event_props": "select event_type, count(k) as n, sum(k) as total, min(k) as low, max(k) as high from (select event_type, json_extract_string(props, '$.k')::int as k from events) group by 1",
    "explode_collect": "select l_orderkey, count(*) as n, string_agg(l_partkey::varchar, ';' order by l_linenumber, l_partkey) as parts from lineitem group by 1",
    "first_listed": "select place_id, alt_names[1] as first, alt_names[len(alt_names)] as last, len(alt_names) as n from gazetteer",
    "missingness_report": " union all ".join(f"select '{c}' as \"column\", count(*) filter ({c} is null or isnan({c})) as n_missing, round(100.0 * count(*) filter ({c} is null or isnan({c})) / count(*), 6) as pct_missing from modelling_panel_gdelt" for c in PANEL),
    "coverage_by_country": f"select {_K.format('country_iso3')} as iso3, round(100.0 * count(*) filter ({_F('gini_coef')} is not null or {_F('unemployment_total')} is not null) / count(*), 6) as fill_pct, count(*) as n from modelling_panel_gdelt group by 1",
    "correlation_matrix": " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({_F(a)}, {_F(b)}), 6) as r from modelling_panel_gdelt" for i, a in enumerate(["unemployment_total", "food_cpi_inflation", "political_stability_est", "gdp_growth", "fx_pct_30d", "oil_brent_pct_30d"]) for b in ["unemployment_total", "food_cpi_inflation", "political_stability_est", "gdp_growth", "fx_pct_30d", "oil_brent_pct_30d"][i + 1 :]),
    "wilson_by_type": f"select event_type, n, k, round(greatest(0.0, {_W.format(s='k', op='-')}), 6) as low, round(least(1.0, {_W.format(s='k', op='+')}), 6) as high from (select event_type, count(*)::double as n, (count(*) filter (value > 250))::double as k from events group by 1)",
    "confidence_histogram": f"select case when {_F('confidence')} is null then 'none' when confidence < 0.5 then '<0.5' when confidence < 0.7 then '<0.7' when confidence < 0.9 then '<0.9' else '<=1' end as bin, count(*) as n from extract_records group by 1",
    "entity_summary": (
        "with v as (select user_id, cast(ts as date) as d, round(sum(value), 4) as v from events group by all) select user_id, arg_min(v, d) as first, arg_max(v, d) as last, date_diff('day', min(d), max(d)) as "
        "span, arg_max(d, (v, d)) as best_day, count(*) filter (v > 500) as busy_days from v group by 1"
    ),
    "reliable_units": (
        f"with g as (select {_K.format('adm1_code')} as unit, {_F('n_protest_events')} + {_F('n_strike_events')} as n, {_F('n_articles')} as a from gdelt_daily_labels), m as (select unit from g where n > 0 group "
        f"by 1 having median(a / n) >= 2) select unit from m union select distinct unit from g where not exists (select 1 from m)"
    ),
    "priority_mean": "select o_custkey, round(avg(o_totalprice), 4) as mean from (select *, min(o_orderpriority) over (partition by o_custkey) as t from orders) where o_orderpriority = t group by 1",
    "row_index": (
        f"with p as (select panel_id, {_F('unemployment_total')} as a, {_F('food_cpi_inflation')} as b, {_F('gdp_growth')} as c from modelling_panel_gdelt) select panel_id, round((coalesce(a, 0) + coalesce(b, 0) "
        f"+ coalesce(c, 0)) / nullif((a is not null)::int + (b is not null)::int + (c is not null)::int, 0), 6) as mean, case when a is null and b is null and c is null then null when coalesce(a, -1e9) >= greatest(coalesce(b, "
        f"-1e9), coalesce(c, -1e9)) then 'unemployment_total' when coalesce(b, -1e9) >= coalesce(c, -1e9) then 'food_cpi_inflation' else 'gdp_growth' end as largest, (a is not null)::int + (b is not null)::int "
        f"+ (c is not null)::int as n_known from p"
    ),
    "priority_pivot": "select o_orderstatus, " + ", ".join(f"count(*) filter (o_orderpriority = '{p}') as \"{p}\"" for p in PRIORITIES) + ", count(*) as total from orders group by 1",
    "mean_pivot": "select user_id, " + ", ".join(f"round(avg(value) filter (event_type = '{t}'), 6) as {t}" for t in TYPES) + " from events group by 1",
    "first_pivot": "select user_id, " + ", ".join(f"min(event_id) filter (event_type = '{t}') as {t}" for t in TYPES) + " from events group by 1",
    "priority_crosstab": "select o_orderstatus, " + ", ".join(f"round(100.0 * count(*) filter (o_orderpriority = '{p}') / count(*), 6) as \"{p}\"" for p in PRIORITIES) + " from orders group by 1",
    "melted_panel": " union all ".join(f"select panel_id, '{c}' as variable, {_F(c)} as value from modelling_panel_gdelt where {_F(c)} is not null" for c in ["fx_pct_30d", "oil_brent_pct_30d", "gdp_growth"]),
    "grid_counts": f"select floor({_F('latitude')} / 5) * 5.0 as lat_cell, floor({_F('longitude')} / 5) * 5.0 as lon_cell, round(avg(fatalities), 6) as mean, count(fatalities) as n from verified_events where {_F('latitude')} is not null and {_F('longitude')} is not null group by 1, 2",
    "session_chains": (
        "with e as (select *, coalesce(date_trunc('second', ts) is not null and epoch_us(ts) - epoch_us(lag(ts) over w) >= 43201000000, true)::int as new from events window w as (partition by user_id order by "
        "ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id rows unbounded preceding) as session from e) select user_id, session, count(*) as n, min(ts) as start, max(ts) "
        "as \"end\" from s group by 1, 2"
    ),
    "tumbling_days": "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
    "sliding_windows": "with e as (select event_type, floor(date_diff('day', date '1970-01-01', cast(ts as date)) / 4)::int as k from events), x as (select event_type, unnest([k - 1, k]) as k from e) select event_type, date '1970-01-01' + k * 4 as start, count(*) as n from x group by 1, 2",
    "cube_counts": "select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderstatus, o_orderpriority) as level from orders group by cube (o_orderstatus, o_orderpriority)",
}
