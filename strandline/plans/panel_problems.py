"""Queries on the modelling panel: trailing totals, attributes as known, filled values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.keys import code_key, finite
from strandline.operators import impute
from strandline.operators.asof import version_history, with_known
from strandline.operators.trailing import Trailing, calendar, latest_per_day, others_in_group, trailing_totals
from strandline.plans.tables import table
from strandline.session import materialize

OWN = [Trailing("gdelt_protest_7d_lag", "protest_today", 7), Trailing("gdelt_strike_28d_lag", "strike_today", 28)]
REGION = [Trailing("gdelt_protest_region_14d", "protest_today", 14)]
KNOWN = ["political_stability_est", "gdp_growth"]


def _daily(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "gdelt_daily_labels").select(code_key(F.col("adm1_code")).alias("unit"), F.col("date").cast("date").alias("date"), "protest_today", "strike_today", "ingest_time")
    return latest_per_day(raw, "unit", "date", "ingest_time", ["protest_today", "strike_today"])


def _panel_totals(spark: SparkSession, d: str, panel: DataFrame, means: bool) -> DataFrame:
    """One range join for all of a unit's own periods, one for its region's."""
    daily = materialize(_daily(spark, d), "daily")
    units = table(spark, d, "adm1_units").select(code_key(F.col("adm1_code")).alias("unit"), "region_id")
    own = materialize(trailing_totals(panel, daily, "unit", "date", OWN + REGION, means=means), "totals")
    return others_in_group(own, daily, units, "unit", "region_id", "date", REGION).drop(*(f"{t.name}_mean" for t in REGION))


def _panel(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "modelling_panel_gdelt").select("panel_id", code_key(F.col("adm1_code")).alias("unit"), code_key(F.col("country_iso3")).alias("country"), F.col("date").cast("date").alias("date"), *cols)


def p2_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Totals and daily means of every panel row."""
    panel = _panel(spark, d)
    return panel.select("panel_id", "unit", "date").join(_panel_totals(spark, d, panel, True), ["unit", "date"], "left")


def p2_calendar(spark: SparkSession, d: str) -> DataFrame:
    """Totals of every unit on every calendar day."""
    daily = materialize(_daily(spark, d), "daily")
    return trailing_totals(calendar(daily, "unit", "date"), daily, "unit", "date", OWN + [Trailing("protest_30d", "protest_today", 30)], means=True)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Panel cells that are NULL or differ from the true total by more than 0.001."""
    names = [t.name for t in OWN + REGION]
    panel = _panel(spark, d, *(F.col(n).alias(f"pub_{n}") for n in names))
    both = panel.join(_panel_totals(spark, d, panel, False), ["unit", "date"], "left")
    wrong = F.filter(F.array(*(F.when(F.coalesce(F.abs(finite(F.col(f"pub_{n}")) - F.coalesce(F.col(n), F.lit(0.0))) > 0.001, F.lit(True)), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return both.select("panel_id", F.explode(wrong).alias("field"))


def _with_known(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "country_indicators").select(code_key(F.col("country_iso3")).alias("country"), F.lower(F.trim("indicator")).alias("indicator"), "year", "revision", "value", "released_at")
    versions = version_history(r, "country", "indicator", "year", "released_at", "value", KNOWN, ["revision"])
    panel = _panel(spark, d, *(F.col(n).alias(f"pub_{n}") for n in KNOWN))
    return with_known(panel, versions, "country", "date", KNOWN)


def p3_asof(spark: SparkSession, d: str) -> DataFrame:
    """Every panel row with the figures known on its date."""
    return _with_known(spark, d).select("panel_id", "country", "date", *(F.col(f"known_{n}").alias(n) for n in KNOWN))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Panel cells whose published figure is not the one known on the row's date."""
    off = lambda n: ~F.when(F.col(f"known_{n}").isNull() | finite(F.col(f"pub_{n}")).isNull(), F.col(f"known_{n}").isNull() & finite(F.col(f"pub_{n}")).isNull()).otherwise(F.abs(F.col(f"known_{n}") - F.col(f"pub_{n}")) <= 1e-6)
    wrong = F.filter(F.array(*(F.when(off(n), F.lit(n)) for n in KNOWN)), lambda x: x.isNotNull())
    return _with_known(spark, d).select("panel_id", F.explode(wrong).alias("field"))


#: Codes that stand for "no figure" in such series.
NO_FIGURE = (-9999.0, -999.0, -99.0, -1.0, 99.9, 999.0, 9999.0)
FIGURES = [
    impute.Figure("gini_coef", low=1e-9, high=100.0, codes=NO_FIGURE, percent=True),
    impute.Figure("inflation_cpi_yoy", low=-95.0, high=9000.0, codes=tuple(x for x in NO_FIGURE if x not in (-1.0, 99.9))),
    impute.Figure("unemployment_rate", low=0.0, high=99.0, codes=NO_FIGURE),
]
HELPERS = ["unemployment_total", "food_cpi_inflation", "political_stability_est", "gdp_growth"]
#: From the row's own unit and year within its cluster to their parents; of several orders the one that brings hidden figures back best (p5_holdout).
LEVELS = [["cluster", "unit", "year"], ["unit", "year"], ["unit"], ["cluster", "country", "year"], ["country"], ["cluster"], []]


FILLED = [f.name for f in FIGURES]


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """The panel's rows with their real figures."""
    panel = _panel(spark, d, *(f.clean(F.col(f.name)).alias(f.name) for f in FIGURES), *(finite(F.col(c)).alias(c) for c in HELPERS))
    return panel.withColumn("year", F.year("date").cast("string"))


def _filled(panel: DataFrame) -> DataFrame:
    panel = materialize(panel, "panel")
    model = impute.fit(panel, FILLED + HELPERS, ["country", "unit", "year"])
    return impute.fill(impute.assign(panel, model), LEVELS, FILLED)


def p5_filled(spark: SparkSession, d: str) -> DataFrame:
    """Every panel row with the three fields filled, and a mark and the method per field."""
    return _filled(_figures(spark, d)).select("panel_id", "unit", "date", *(c for f in FILLED for c in (f, f"{f}_filled", f"{f}_method")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The cells that held no real figure and were filled."""
    cells = F.filter(F.array(*(F.when(F.col(f"{f}_filled"), F.lit(f)) for f in FILLED)), lambda x: x.isNotNull())
    return p5_filled(spark, d).select("panel_id", F.explode(cells).alias("field"))


def p5_holdout(spark: SparkSession, d: str) -> DataFrame:
    """How well the filling does: a tenth of the real figures is hidden and filled; mean absolute errors beside those of the field's median."""
    real = _figures(spark, d)
    hidden = lambda f: F.pmod(F.xxhash64("panel_id", F.lit(f)), F.lit(10)) == 0
    masked = real.withColumns({f"was_{f}": F.when(hidden(f), F.col(f)) for f in FILLED} | {f: F.when(~hidden(f), F.col(f)) for f in FILLED})
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"was_{f}").alias("was"), F.col(f).alias("got"), F.col(f"{f}_filled").alias("filled")) for f in FILLED))
    each = _filled(masked).select(F.explode(rows).alias("x")).select("x.*").where("was is not null")
    middle = F.percentile_approx("was", 0.5, 10_000)
    usual = each.groupBy("field").agg(middle.alias("m")).withColumnRenamed("field", "__f")
    out = each.join(usual, F.col("field") == F.col("__f")).groupBy("field")
    return out.agg(F.count("*").alias("n"), F.count_if("filled").alias("n_filled"), F.avg(F.abs(F.col("got") - F.col("was"))).alias("error"), F.avg(F.abs(F.col("m") - F.col("was"))).alias("error_of_median"))


CATEGORIES = ["sector", "issue", "protest_type"]


def p5_categories(spark: SparkSession, d: str) -> DataFrame:
    """Categories of articles filled with modes: of the article's duplicate group, of similar articles, of all."""
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.lower(c), r"[\s_\u00a0.]+", " ")), F.lit(""))
    a = table(spark, d, "source_articles").select("article_id", F.col("cluster_id").alias("group"), *(plain(F.col(c)).alias(c) for c in CATEGORIES), finite(F.col("confidence")).alias("confidence"), finite(F.col("num_articles").cast("double")).alias("num_articles"))
    a = materialize(a, "articles")
    model = impute.fit(a, ["confidence", "num_articles"], CATEGORIES, k=16)
    out = impute.fill(impute.assign(a, model), [["group"], ["cluster"], []], [], CATEGORIES, least=1)
    return out.select("article_id", "group", *(c for f in CATEGORIES for c in (f, f"{f}_filled", f"{f}_method")))


QUERIES = {"p5_found": p5_found, "p5_filled": p5_filled, "p5_holdout": p5_holdout, "p5_categories": p5_categories, "p2_found": p2_found, "p2_rolling": p2_rolling, "p2_calendar": p2_calendar, "p3_found": p3_found, "p3_asof": p3_asof}

_UNIT = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_DAILY = f"""daily as (select unit, date, arg_max(coalesce(protest_today, 0), ingest_time) as p, arg_max(coalesce(strike_today, 0), ingest_time) as s
 from (select {_UNIT.format('adm1_code')} as unit, * from gdelt_daily_labels) where unit is not null and date is not null group by 1, 2),
units as (select {_UNIT.format('adm1_code')} as unit, region_id from adm1_units),
panel as (select *, {_UNIT.format('adm1_code')} as unit from modelling_panel_gdelt),
t as (select panel_id, unit, date,
 coalesce((select sum(p) from daily x where x.unit = panel.unit and x.date between panel.date - 7 and panel.date - 1), 0) as a,
 coalesce((select sum(s) from daily x where x.unit = panel.unit and x.date between panel.date - 28 and panel.date - 1), 0) as b,
 coalesce((select sum(p) from daily x join units y on x.unit = y.unit join units z on y.region_id = z.region_id where z.unit = panel.unit and y.unit <> panel.unit and x.date between panel.date - 14 and panel.date - 1), 0) as c,
 gdelt_protest_7d_lag as pa, gdelt_strike_28d_lag as pb, gdelt_protest_region_14d as pc from panel)"""
_KNOWN_SQL = f"""r as (select {_UNIT.format('country_iso3')} as country, lower(trim(indicator)) as indicator, year, revision, value, released_at from country_indicators where value is not null),
k as (select p.panel_id, i.indicator, arg_max(r.value, (r.year, r.released_at, r.revision)) filter (r.value is not null) as known
 from modelling_panel_gdelt p cross join (values ('political_stability_est'), ('gdp_growth')) i(indicator)
 left join r on r.country = {_UNIT.format('p.country_iso3')} and r.indicator = i.indicator and cast(r.released_at as date) <= p.date group by 1, 2),
w as (select panel_id, max(known) filter (indicator = 'political_stability_est') as ps, max(known) filter (indicator = 'gdp_growth') as gg from k group by 1)"""

_CALENDAR = f"""{_DAILY}, s as (select unit, min(date) as lo, max(date) as hi from daily group by 1), c as (select unit, cast(unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day)) as date) as date from s),
z as (select unit, date, coalesce(p, 0) as p, coalesce(s, 0) as s from c left join daily using (unit, date)),
v as (select unit, date, coalesce(sum(p) over (w rows between 7 preceding and 1 preceding), 0) as a, coalesce(sum(s) over (w rows between 28 preceding and 1 preceding), 0) as b,
 coalesce(sum(p) over (w rows between 30 preceding and 1 preceding), 0) as c from z window w as (partition by unit order by date))"""

SQL = {
    "p2_calendar": f"with {_CALENDAR} select unit, date, a as gdelt_protest_7d_lag, b as gdelt_strike_28d_lag, c as protest_30d, a / 7 as gdelt_protest_7d_lag_mean, b / 28 as gdelt_strike_28d_lag_mean, c / 30 as protest_30d_mean from v",
    "p5_found": (
        "select panel_id, field from (select panel_id, unnest([case when gini_coef is null or isnan(gini_coef) or gini_coef <= 0 or gini_coef > 100 or gini_coef = 99.9 then 'gini_coef' end, case when inflation_cpi_yoy "
        "is null or not isfinite(inflation_cpi_yoy) or inflation_cpi_yoy < -95 or inflation_cpi_yoy in (999, 9999) or inflation_cpi_yoy > 9000 then 'inflation_cpi_yoy' end, case when unemployment_rate is null "
        "or isnan(unemployment_rate) or unemployment_rate < 0 or unemployment_rate > 99 then 'unemployment_rate' end]) as field from modelling_panel_gdelt) where field is not null"
    ),
    "p2_found": (
        f"with {_DAILY} select panel_id, field from (select panel_id, unnest([case when pa is null or abs(pa - a) > 0.001 then 'gdelt_protest_7d_lag' end, case when pb is null or abs(pb - b) > 0.001 then 'gdelt_strike_28d_lag' "
        f"end, case when pc is null or abs(pc - c) > 0.001 then 'gdelt_protest_region_14d' end]) as field from t) where field is not null"
    ),
    "p2_rolling": f"with {_DAILY} select unit, date, panel_id, a as gdelt_protest_7d_lag, b as gdelt_strike_28d_lag, a / 7 as gdelt_protest_7d_lag_mean, b / 28 as gdelt_strike_28d_lag_mean, c as gdelt_protest_region_14d from t",
    "p3_asof": f"with {_KNOWN_SQL} select p.panel_id, {_UNIT.format('p.country_iso3')} as country, p.date, w.ps as political_stability_est, w.gg as gdp_growth from modelling_panel_gdelt p join w using (panel_id)",
    "p3_found": (
        f"with {_KNOWN_SQL}, f as (select p.panel_id, unnest([case when w.ps is distinct from p.political_stability_est then 'political_stability_est' end, case when w.gg is distinct from p.gdp_growth then 'gdp_growth' "
        f"end]) as field from modelling_panel_gdelt p join w using (panel_id)) select * from f where field is not null"
    ),
}
