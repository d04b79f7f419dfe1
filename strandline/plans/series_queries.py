"""Queries on per-entity time series: dense grids, rolling and expanding features, labels, gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.functions.dates import dynamic_window, month_cycle
from strandline.operators import panel as P
from strandline.operators.joins import fill_join, lag_of_global
from strandline.operators.merge import stitch
from strandline.plans.tables import table


def _r(c: Column, n: int = 6) -> Column:
    return F.round(c, n)


def _days(spark: SparkSession, d: str) -> DataFrame:
    """A row per user and active day: n events, error and purchase flags, value."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.col("ts").cast("date").alias("d")).agg(
        F.count("*").alias("n"), F.max((F.col("event_type") == "error").cast("int")).alias("f"), F.max((F.col("event_type") == "purchase").cast("int")).alias("g"), F.sum("value").alias("v")
    )


def _grid(spark: SparkSession, d: str) -> DataFrame:
    return P.dense(_days(spark, d), ["user_id"], "d", {"n": 0, "f": 0, "g": 0})


def _w() -> WindowSpec:
    return P.by(["user_id"], "d")


def dense_panel(spark, d):
    level = F.when(F.col("n") < 3, "low").when(F.col("n") < 10, "medium").otherwise("high")
    return _grid(spark, d).select("user_id", "d", "n", "f", "g", _r(F.col("v")).alias("v"), level.alias("coverage"))


def rolling_features(spark, d):
    n = F.col("n")
    return _grid(spark, d).select(
        "user_id", "d", P.lagged_sum(n, _w(), 7).alias("lag_7d"), P.lagged_sum(F.col("f"), _w(), 28).alias("lag_28d"), P.trailing_sum(n, _w(), 30).alias("last_30d"),
        _r(P.rolling_mean(n, _w(), 7, 3)).alias("mean_7d"), _r(P.rolling_std(n, _w(), 7)).alias("std_7d"), _r(P.rolling_z(n, _w())).alias("z_12"),
    )


def expanding_features(spark, d):
    n = F.col("n")
    return _grid(spark, d).select("user_id", "d", _r(P.expanding_z(n, _w(), 6)).alias("z"), P.above_expanding(n, _w()).alias("above_p90"))


def filled_series(spark, d):
    v = F.col("v")
    g = _grid(spark, d)
    mean = table(spark, d, "events").agg(F.avg("value")).first()[0]
    return g.select("user_id", "d", _r(P.ffill(v, _w())).alias("ffill"), _r(P.ffill(v, _w(), 7)).alias("ffill_7"), _r(P.impute(v, _w(), F.lit(mean)), 4).alias("imputed"))


def change_features(spark, d):
    """Daily mean price per return flag: lags, differences, percent changes and log returns."""
    li = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_shipdate").cast("date").alias("d")).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("p"))
    w, p = P.by(["l_returnflag"], "d"), F.col("p")
    return li.withColumn("lr", P.log_return(p, w)).select(
        "l_returnflag", "d", _r(p).alias("price"), _r(F.lag(p, 1).over(w)).alias("lag_1"), _r(P.diff(p, w, 30)).alias("diff_30"), _r(P.pct_change(p, w, 12)).alias("pct_12"), _r(F.col("lr"), 8).alias("log_return"),
        _r(P.annual_volatility(F.col("lr"), w, 30), 4).alias("volatility"), _r(F.greatest(F.lit(-3.0), F.least(F.lit(3.0), F.ln(F.lit(1) + p)))).alias("clipped"),
    )


def forward_labels(spark, d):
    f, n = F.col("f"), F.col("n")
    return _grid(spark, d).select(
        "user_id", "d", P.forward_label(f, _w(), 7).alias("any_7"), P.forward_any(f, _w(), 7).alias("any_7_full"), P.elevated(n, _w(), 7).alias("elevated"), P.shifted_max_label(f, _w(), 7).alias("shifted_7"), P.next_label(f, _w()).alias("next")
    )


def masked_targets(spark, d):
    g = _grid(spark, d).select("user_id", "d", P.forward_label(F.col("f"), _w(), 7).alias("label"))
    return P.cyclic_targets(g, "d", "label", 7)


def spillover(spark, d):
    g = _grid(spark, d).withColumn("region", F.col("user_id") % 5)
    return g.select("user_id", "d", P.spillover(F.col("n"), ["region"], "d").alias("others"))


def longest_gap(spark, d):
    g = _grid(spark, d)
    runs = P.islands(g, ["user_id"], "d", F.col("v").isNull())
    return runs.groupBy("user_id").agg(F.max("length").alias("longest_gap"), F.count("*").alias("gaps"))


def episodes(spark, d):
    """Runs of error days, and on how many of them a score of the days before was high."""
    g = _grid(spark, d).withColumn("score", P.lagged_sum(F.col("f"), _w(), 7))
    runs = P.islands(g, ["user_id"], "d", F.col("f") == 1)
    j = runs.join(g.select(F.col("user_id").alias("u"), F.col("d").alias("day"), "score"), (F.col("user_id") == F.col("u")) & F.col("day").between(F.col("start"), F.col("end")))
    return j.groupBy("user_id", "start", "end", "length").agg(F.max((F.col("score") >= 1).cast("int")).alias("hit"), F.min(F.when(F.col("score") >= 1, F.datediff("day", "start"))).alias("lead"))


def months_to_days(spark, d):
    """Monthly order totals on daily rows, and back to month ends."""
    m = table(spark, d, "orders").groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg(F.sum("o_totalprice").alias("total"))
    daily = P.month_spine(m, "m", "d")
    return daily.groupBy(F.last_day("d").alias("month_end")).agg(F.count("*").alias("days"), _r(F.avg("total"), 2).alias("mean_total"))


def open_orders_per_day(spark, d):
    """Orders on each day from order to ship date, at most ten days."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    spans = li.select(F.col("o_orderdate").cast("date").alias("a"), F.col("l_shipdate").cast("date").alias("b"))
    return P.expand_days(spans, "a", "b", "day", 10).groupBy("day").agg(F.count("*").alias("open_items"))


def frequency_coalesce(spark, d):
    """The monthly figure where there is one, else the quarter's."""
    o = table(spark, d, "orders")
    monthly = o.where("o_orderpriority = '1-URGENT' and month(o_orderdate) % 2 = 1").groupBy(F.trunc("o_orderdate", "MM").alias("m")).agg(F.count("*").alias("x"))
    quarterly = o.groupBy(F.date_trunc("quarter", "o_orderdate").cast("date").alias("q")).agg((F.count("*") / 3).alias("x"))
    by_month = quarterly.select(F.explode(F.sequence("q", F.add_months("q", 2), F.expr("interval 1 month"))).alias("m"), "x")
    every = o.select(F.trunc("o_orderdate", "MM").alias("m")).distinct()
    return fill_join(every.join(monthly, "m", "left").withColumn("x", F.col("x").cast("double")), by_month, ["m"], ["x"]).select("m", _r(F.col("x")).alias("x"))


def global_lag(spark, d):
    """A series that is the same for all users, five active days earlier."""
    e = _days(spark, d)
    g = e.groupBy("d").agg(F.sum("n").alias("all_n"))
    return lag_of_global(e.select("user_id", "d").join(g, "d"), "d", "all_n", 5, "all_n_lag_5")


def seasonal(spark, d):
    """Month as a point on a circle, and the dynamic window of an order's duration."""
    s, c = month_cycle(F.col("o_orderdate"))
    w = dynamic_window(F.lit(2), F.lit(14), F.col("o_totalprice") / 1000, F.lit(None).cast("double"))
    return table(spark, d, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(_r(F.max(s)).alias("month_sin"), _r(F.max(c)).alias("month_cos"), F.sum(w).alias("windows"))


def stitched_batches(spark, d):
    """Series brought to the scale of an anchor, by the ratio of the sums of whole series (anchor rescaling)."""
    e = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.sum("value").alias("v"))
    anchor = e.where("event_type = 'view'").agg(F.sum("v")).first()[0]
    ratio = F.lit(anchor) / F.sum("v").over(Window.partitionBy("event_type"))
    return e.select("event_type", "d", _r(F.col("v") * ratio, 4).alias("v"))


#: Days of a batch, and from one batch's start to the next one's.
BATCH, STEP = 12, 7


def overlap_stitched(spark, d):
    """Overlapping batches, each on a scale of its own up to 100, joined by the ratio of means on shared days."""
    e = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("d")).agg(F.sum("value").alias("v"))
    own = Window.partitionBy("event_type")
    e = e.withColumns({"n": F.datediff("d", F.min("d").over(own)), "last": F.datediff(F.max("d").over(own), F.min("d").over(own))})
    e = e.withColumn("batch", F.explode(F.sequence(F.greatest(F.floor((F.col("n") - BATCH) / STEP) + 1, F.lit(0)), F.floor(F.col("n") / STEP))))
    e = e.where((F.col("batch") == 0) | (F.col("last") >= (F.col("batch") - 1) * STEP + BATCH))  # a batch brings new days
    e = e.withColumn("v", F.try_divide(F.col("v") * 100, F.max("v").over(Window.partitionBy("event_type", "batch"))))
    return stitch(e, "event_type", "batch", "d", "v").withColumn("v", _r(F.col("v"), 4))


QUERIES = {f.__name__: f for f in (dense_panel, rolling_features, expanding_features, filled_series, change_features, forward_labels, masked_targets, spillover, longest_gap, episodes, months_to_days, open_orders_per_day, frequency_coalesce, global_lag, seasonal, stitched_batches, overlap_stitched)}

_B = """b as (select user_id, cast(ts as date) as d, count(*) as n, max((event_type = 'error')::int) as f, max((event_type = 'purchase')::int) as g, sum(value) as v from events group by all),
k as (select user_id, cast(unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day)) as date) as d from (select distinct user_id from b), (select min(d) as lo, max(d) as hi from b)),
p as (select user_id, d, coalesce(n, 0) as n, coalesce(f, 0) as f, coalesce(g, 0) as g, v from k left join b using (user_id, d))"""
_O = "partition by user_id order by d"
SQL = {
    "dense_panel": f"with {_B} select user_id, d, n, f, g, round(v, 6) as v, case when n < 3 then 'low' when n < 10 then 'medium' else 'high' end as coverage from p",
    "rolling_features": f"""with {_B} select user_id, d, sum(n) over ({_O} rows between 7 preceding and 1 preceding) as lag_7d, sum(f) over ({_O} rows between 28 preceding and 1 preceding) as lag_28d,
 sum(n) over ({_O} rows between 29 preceding and current row) as last_30d, case when count(n) over a >= 3 then round(avg(n) over a, 6) end as mean_7d, case when count(n) over a >= 3 then round(stddev_samp(n) over a, 6) end as std_7d,
 case when count(n) over z >= 6 and stddev_samp(n) over z > 1e-12 then round((n - avg(n) over z) / stddev_samp(n) over z, 6) end as z_12
 from p window a as ({_O} rows between 6 preceding and current row), z as ({_O} rows between 11 preceding and current row)""",
    "expanding_features": (
        f"with {_B} select user_id, d, case when count(n) over x >= 6 and stddev_samp(n) over x > 1e-12 then round((n - avg(n) over x) / stddev_samp(n) over x, 6) end as z, coalesce(count(n) over x >= 12 and n "
        f"> quantile_cont(n, 0.9) over x, false)::int as above_p90 from p window x as ({_O} rows between unbounded preceding and current row)"
    ),
    "filled_series": (
        f"with {_B} select user_id, d, round(last_value(v ignore nulls) over ({_O} rows between unbounded preceding and current row), 6) as ffill, round(last_value(v ignore nulls) over ({_O} rows between 7 preceding "
        f"and current row), 6) as ffill_7, round(coalesce(last_value(v ignore nulls) over ({_O} rows between unbounded preceding and current row), first_value(v ignore nulls) over ({_O} rows between current row "
        f"and unbounded following), (select avg(value) from events)), 4) as imputed from p"
    ),
    "change_features": """with s as (select l_returnflag, cast(l_shipdate as date) as d, avg(l_extendedprice / l_quantity) as p from lineitem group by all), t as (select *, ln(p / lag(p) over w) as lr from s window w as (partition by l_returnflag order by d))
 select l_returnflag, d, round(p, 6) as price, round(lag(p) over w, 6) as lag_1, round(p - lag(p, 30) over w, 6) as diff_30, round((p / lag(p, 12) over w - 1) * 100, 6) as pct_12, round(lr, 8) as log_return,
 case when count(lr) over v >= 15 then round(stddev_samp(lr) over v * sqrt(252.0) * 100, 4) end as volatility, round(greatest(-3.0, least(3.0, ln(1 + p))), 6) as clipped from t window w as (partition by l_returnflag
  order by d), v as (partition by l_returnflag order by d rows between 29 preceding and current row)""",
    "forward_labels": f"""with {_B}, q as (select *, row_number() over ({_O}) as i from p) select user_id, d, case when count(*) over h < 7 then 0 else coalesce(max(f) over h, 0) end as any_7, case when count(*) over h = 7 then (sum(f) over h >= 1)::int end as any_7_full,
 coalesce(sum(n) over h > 1.5 * 7 * avg(n) over ({_O} rows between 90 preceding and 1 preceding) and sum(n) over h >= 3, false)::int as elevated, list_max(list_transform(list_filter(list({{'i': i, 'f': f}}) over h, lambda x: x.i > 7), lambda x: x.f))
  as shifted_7, coalesce(lead(f) over ({_O}), 0) as next
 from q window h as ({_O} rows between 1 following and 7 following)""",
    "masked_targets": (
        f"with {_B}, q as (select user_id, d, case when count(*) over h < 7 then 0 else coalesce(max(f) over h, 0) end as label from p window h as ({_O} rows between 1 following and 7 following)) select user_id, "
        f"d, case when d <= (select max(d) from p) - 7 then label end as label from q"
    ),
    "spillover": f"with {_B} select user_id, d, greatest(sum(n) over (partition by user_id % 5, d) - n, 0) as others from p",
    "longest_gap": f"with {_B}, x as (select user_id, d, date_diff('day', date '2000-01-01', d) - row_number() over ({_O}) as g from p where v is null), r as (select user_id, count(*) as n from x group by user_id, g) select user_id, max(n) as longest_gap, count(*) as gaps from r group by 1",
    "episodes": f"""with {_B}, s as (select *, sum(f) over ({_O} rows between 7 preceding and 1 preceding) as score from p), x as (select *, date_diff('day', date '2000-01-01', d) - row_number() over ({_O}) as i from s where f = 1), y as (select *, min(d) over (partition by user_id, i) as st from x)
 select user_id, st as start, max(d) as "end", count(*) as length, max(coalesce(score >= 1, false)::int) filter (score is not null) as hit, min(date_diff('day', st, d)) filter (score >= 1) as lead from y group by user_id, i, st""",
    "months_to_days": "with m as (select date_trunc('month', o_orderdate)::date as m, sum(o_totalprice) as total from orders group by 1) select last_day(m) as month_end, date_diff('day', m, last_day(m)) + 1 as days, round(total, 2) as mean_total from m",
    "open_orders_per_day": (
        "with s as (select o_orderdate::date as a, least(l_shipdate::date, o_orderdate::date + 9) as b from lineitem join orders on l_orderkey = o_orderkey) select day, count(*) as open_items from (select cast(unnest(generate_series(a::timestamp, "
        "b::timestamp, interval 1 day)) as date) as day from s where b >= a) group by 1"
    ),
    "frequency_coalesce": (
        "with m as (select date_trunc('month', o_orderdate)::date as m, count(*) as x from orders where o_orderpriority = '1-URGENT' and month(o_orderdate) % 2 = 1 group by 1), q as (select date_trunc('quarter', "
        "o_orderdate)::date as q, count(*) / 3.0 as x from orders group by 1), e as (select distinct date_trunc('month', o_orderdate)::date as m from orders) select e.m, round(coalesce(m.x::double, q.x::double), "
        "6) as x from e left join m using (m) left join q on q.q = date_trunc('quarter', e.m)::date"
    ),
    "global_lag": "with b as (select user_id, cast(ts as date) as d, count(*) as n from events group by all), g as (select d, sum(n) as all_n from b group by 1), l as (select d, all_n, lag(all_n, 5) over (order by d) as l from g) select user_id, d, all_n, l as all_n_lag_5 from b join l using (d)",
    "seasonal": "select month(o_orderdate) as month, round(max(sin(2 * pi() * month(o_orderdate) / 12)), 6) as month_sin, round(max(cos(2 * pi() * month(o_orderdate) / 12)), 6) as month_cos, sum(least(14, greatest(2, ceil(o_totalprice / 1000 / 24) + 1))) as windows from orders group by 1",
    "stitched_batches": "with e as (select event_type, cast(ts as date) as d, sum(value) as v from events group by all) select event_type, d, round(v * (select sum(v) from e where event_type = 'view') / sum(v) over (partition by event_type), 4) as v from e",
}
