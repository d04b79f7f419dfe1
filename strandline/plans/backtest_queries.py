"""Queries on labels, targets and the model variants of backtests."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import code_key
from strandline.functions.strings import feature_name
from strandline.operators import models
from strandline.plans.model_queries import FEATURES, _panel
from strandline.plans.tables import table


def resolved_labels(spark, d):
    """Gold and weak labels of records brought together, and on which two labellers differ."""
    r, k = table(spark, d, "extract_records"), F.col("record_id")
    types = ["flood", "protests"]
    x = r.select(
        "record_id", (k % 4 == 0).alias("is_gold"), *(F.when(F.col("llm_disruption_type") == t, "Yes").otherwise("0").alias(t) for t in types), F.when(k % 3 == 0, "TRUE").alias("any"),
        *((F.coalesce(F.col("expert_disruption_type"), F.lit("")) == t).cast("string").alias(f"weak_{t}") for t in types), F.when(k % 5 == 0, "y").when(k % 5 == 1, "n").alias("weak_any"),
    )
    y = models.resolved_labels(x, F.col("is_gold"), types, "weak_", "any")
    return y.select("record_id", "y_flood", "y_protests", "y_any", F.array_join(models.disagreements(types, "", "weak_"), ",").alias("differ"))


def masked_labels(spark, d):
    """Daily labels without those that can't be trusted."""
    g = table(spark, d, "gdelt_daily_labels").select(code_key(F.col("adm1_code")).alias("unit"), F.col("date").cast("date").alias("date"), "protest_today", F.lower(F.trim("coverage_flag")).alias("coverage"))
    busy = g.where("protest_today = 1").select("unit")
    m = models.masked_target(g, "date", "protest_today", 30, "coverage", busy, ["unit"])
    return m.groupBy("unit").agg(F.count("*").alias("n"), F.count("protest_today").alias("known"), F.sum("protest_today").alias("positive"))


def unit_baselines(spark, d):
    """Each country's rate before 2020, on the rows of 2020."""
    p = table(spark, d, "modelling_panel_gdelt").select("panel_id", code_key(F.col("country_iso3")).alias("iso3"), F.year("date").alias("year"), "protest_7d")
    return models.group_baselines(p.where("year < 2020"), p.where("year = 2020"), "iso3", ["protest_7d"]).select("panel_id", F.round("baseline_protest_7d", 6).alias("baseline"))


def fold_means(spark, d):
    """Figures of monthly folds per year, and the features of largest mean weight over them."""
    m = table(spark, d, "orders").groupBy("o_orderstatus", F.trunc("o_orderdate", "MM").alias("month"), "o_orderpriority").agg(F.avg(F.col("o_totalprice") - 150_000).alias("w"))
    year = m.groupBy("o_orderstatus", F.year("month").alias("fold"), F.concat(F.lit("num__"), "o_orderpriority").alias("name")).agg(F.avg("w").alias("w"))
    return models.mean_importances(year, ["o_orderstatus"], feature_name(F.col("name")), "w", 3).select("o_orderstatus", "feature", F.round("mean", 4).alias("mean"), "rank")


def calibrated_svm(spark, d):
    """A linear margin model with probabilities from five folds, on a fifth of each class."""
    p = models.stratified(_panel(spark, d).where("y is not null"), "panel_id", "y")
    out = models.calibrated_margin(p.where("not is_test"), p.where("is_test"), "panel_id", FEATURES)
    return models.fold_scores(out.withColumn("fold", F.lit(0)), ["fold"], "p_cal")


def chosen_calibration(spark, d):
    """A logistic backtest with whichever calibration fits the year before better."""
    pred = models.walk_forward(_panel(spark, d), "date", FEATURES, [2021], lambda f, n: models.logistic(f, 1.0, n), "best")
    return models.fold_scores(pred, ["fold"], "p_cal")


def quarterly_backtest(spark, d):
    """A logistic model with units as categories, retrained each quarter of 2021."""
    spans = models.periods(date(2021, 1, 1), date(2021, 12, 31), 3)
    pred = models.walk_periods(_panel(spark, d), "date", FEATURES, spans, lambda f, n: models.logistic(f, 1.0, n, ["unit"]))
    return models.fold_scores(pred, ["fold"])


def group_backtest(spark, d):
    """Backtests of two groups of units apart, by the size of their figures."""
    p = _panel(spark, d).withColumn("group", F.when(F.col("gdp_growth") > 2, "high").otherwise("low"))
    run = lambda x: models.walk_forward(x, "date", FEATURES, [2021], lambda f, n: models.logistic(f, 1.0, n))
    return models.fold_scores(models.by_group(p, "group", ["high", "low"], run), ["group", "fold"])


def feature_importances(spark, d):
    """Features of a logistic model by the size of their coefficients."""
    p = _panel(spark, d).where("y is not null")
    s = p.agg(F.avg("y"), F.count("*")).first()
    if not s[1] or s[0] in (0.0, 1.0):
        return spark.createDataFrame([], "model string, feature string, mean double, rank int")
    model = models.logistic(FEATURES, 1.0, s[1]).fit(p.withColumn("w", models.class_weights(F.col("y"), s[0])))
    rows = spark.createDataFrame([("logistic", f"num__{f}", x) for f, x in models.importances(model, FEATURES)], "model string, name string, x double")
    return models.mean_importances(rows, ["model"], feature_name(F.col("name")), "x", 5)


QUERIES = {f.__name__: f for f in (resolved_labels, masked_labels, unit_baselines, fold_means, calibrated_svm, chosen_calibration, quarterly_backtest, group_backtest, feature_importances)}

_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
SQL = {
    "resolved_labels": """with x as (select record_id, record_id % 4 = 0 as g, coalesce((llm_disruption_type = 'flood')::int, 0) as gf, coalesce((llm_disruption_type = 'protests')::int, 0) as gp, (record_id % 3 = 0)::int as ga,
 coalesce((expert_disruption_type = 'flood')::int, 0) as wf, coalesce((expert_disruption_type = 'protests')::int, 0) as wp, record_id % 5 as k from extract_records)
 select record_id, case when g then gf else wf end as y_flood, case when g then gp else wp end as y_protests, case when g then ga when k = 0 then 1 when k = 1 then 0 else greatest(wf, wp) end as y_any,
 array_to_string(list_filter([case when gf <> wf then 'flood' end, case when gp <> wp then 'protests' end], lambda x: x is not null), ',') as differ from x""",
    "masked_labels": f"""with g as (select {_K.format('adm1_code')} as unit, date::date as date, protest_today as y, lower(trim(coverage_flag)) as c from gdelt_daily_labels), b as (select distinct unit from g where y = 1),
 m as (select unit, case when date <= (select max(date) from g) - 30 and not coalesce(y = 0 and c = 'low', false) and not (y = 0 and unit not in (select unit from b where unit is not null)) then y end
  as y from g) select unit, count(*) as n, count(y) as known, sum(y) as positive from m group by 1""",
    "unit_baselines": (
        f"with p as (select panel_id, {_K.format('country_iso3')} as iso3, year(date) as year, protest_7d as y from modelling_panel_gdelt), m as (select iso3, avg(y) as b from p where year < 2020 group by 1) select "
        f"panel_id, round(coalesce(b, (select avg(y) from p where year < 2020)), 6) as baseline from p left join m using (iso3) where year = 2020"
    ),
    "fold_means": (
        "with m as (select o_orderstatus, date_trunc('month', o_orderdate) as m, o_orderpriority, avg(o_totalprice - 150000) as w from orders group by all), y as (select o_orderstatus, year(m) as f, o_orderpriority "
        "as feature, avg(w) as w from m group by all), a as (select o_orderstatus, feature, avg(w) as mean from y group by all), r as (select *, row_number() over (partition by o_orderstatus order by abs(mean) "
        "desc, feature) as rank from a) select o_orderstatus, feature, round(mean, 4) as mean, rank from r where rank <= 3"
    ),
}
