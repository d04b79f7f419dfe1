"""Dense entity-by-day panels and their per-entity window features.

Frames follow the usual rules of such panels: ``n`` counts rows of a dense grid; a
minimum of observations gates a value to NULL; standard deviations are of the sample, and zero ones make a
z-score NULL. Each function returns column expressions for ``Window.partitionBy(entity).orderBy(order)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Keys = list[str]


def spine(df: DataFrame, keys: Keys, date: str, low: str | None = None, high: str | None = None) -> DataFrame:
    """Every (keys, day) from the first to the last day of the whole table, or of ``low`` to ``high``.

    One narrow aggregation finds the bounds; the days are then generated per entity, without a cross join.
    """
    lo, hi = (low, high) if low and high else df.agg(F.min(date).cast("date"), F.max(date).cast("date")).first()
    entities = df.select(*keys).dropna().distinct()
    if lo is None:
        return entities.withColumn(date, F.lit(None).cast("date")).limit(0)
    return entities.withColumn(date, F.explode(F.sequence(F.lit(lo).cast("date"), F.lit(hi).cast("date"))))


def dense(df: DataFrame, keys: Keys, date: str, fill: dict[str, float]) -> DataFrame:
    """``df`` (a row per keys and day) on the whole grid, with ``fill`` on days without a row."""
    out = spine(df, keys, date).join(df, [*keys, date], "left")
    return out.fillna(fill) if fill else out


def expand_days(df: DataFrame, start: str, end: str, to: str, most: int | None = None) -> DataFrame:
    """A row per day of each interval; a missing end is the start, an end before the start gives none."""
    last = F.coalesce(F.col(end), F.col(start)).cast("date")
    if most:
        last = F.least(last, F.date_add(F.col(start).cast("date"), most - 1))
    ok = F.col(start).isNotNull() & (last >= F.col(start).cast("date"))
    return df.where(ok).withColumn(to, F.explode(F.sequence(F.col(start).cast("date"), last)))


def month_spine(df: DataFrame, date: str, to: str) -> DataFrame:
    """A row per day of the month of ``date``: monthly figures on daily rows."""
    first = F.trunc(date, "MM")
    return df.withColumn(to, F.explode(F.sequence(first, F.last_day(date))))


def year_spine(df: DataFrame, year: str, to: str) -> DataFrame:
    """A row per day of the year in column ``year``: yearly figures on daily rows; rows without a year give none."""
    first = F.make_date(F.col(year).cast("int"), F.lit(1), F.lit(1))
    return df.where(F.col(year).isNotNull()).withColumn(to, F.explode(F.sequence(first, F.make_date(F.col(year).cast("int"), F.lit(12), F.lit(31)))))


def by(keys: Keys, order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def lagged_sum(x: Column, w: WindowSpec, n: int) -> Column:
    """Sum of the n rows before; the first row of an entity has none and is NULL."""
    return F.sum(x).over(w.rowsBetween(-n, -1))


def trailing_sum(x: Column, w: WindowSpec, n: int) -> Column:
    """Sum of the last n rows, this one included."""
    return F.sum(x).over(w.rowsBetween(-(n - 1), 0))


def _gated(agg: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    return F.when(F.count(x).over(frame) >= least, agg)


def rolling_mean(x: Column, w: WindowSpec, n: int, least: int = 1) -> Column:
    f = w.rowsBetween(-(n - 1), 0)
    return _gated(F.avg(x).over(f), x, f, least)


def rolling_std(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    f = w.rowsBetween(-(n - 1), 0)
    return _gated(F.stddev_samp(x).over(f), x, f, least or max(2, n // 2))


def _z(x: Column, f: WindowSpec, least: int) -> Column:
    s = F.stddev_samp(x).over(f)
    return F.when((F.count(x).over(f) >= least) & (s > 1e-12), (x - F.avg(x).over(f)) / s)


def rolling_z(x: Column, w: WindowSpec, n: int = 12, least: int = 6) -> Column:
    return _z(x, w.rowsBetween(-(n - 1), 0), least)


def expanding_z(x: Column, w: WindowSpec, least: int = 3) -> Column:
    """Against all rows so far, this one included."""
    return _z(x, w.rowsBetween(Window.unboundedPreceding, 0), least)


def above_expanding(x: Column, w: WindowSpec, q: float = 0.9, least: int = 12) -> Column:
    """1 if the value exceeds the q-quantile of all rows so far (linear interpolation), else 0."""
    f = w.rowsBetween(Window.unboundedPreceding, 0)
    return F.coalesce((F.count(x).over(f) >= least) & (x > F.percentile(x, q).over(f)), F.lit(False)).cast("int")


def ffill(x: Column, w: WindowSpec, limit: int | None = None) -> Column:
    """The last known value, at most ``limit`` rows old."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit if limit else Window.unboundedPreceding, 0))


def impute(x: Column, w: WindowSpec, default: Column) -> Column:
    """Forward, then backward within the entity, then the default."""
    return F.coalesce(ffill(x, w), F.first(x, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), default)


def pct_change(x: Column, w: WindowSpec, n: int) -> Column:
    """Percent against n rows before, without padding over gaps."""
    return (F.try_divide(x, F.lag(x, n).over(w)) - 1) * 100


def log_return(x: Column, w: WindowSpec) -> Column:
    before = F.lag(x, 1).over(w)
    return F.when((x > 0) & (before > 0), F.ln(x / before))


def diff(x: Column, w: WindowSpec, n: int) -> Column:
    return x - F.lag(x, n).over(w)


def annual_volatility(x: Column, w: WindowSpec, n: int) -> Column:
    """Standard deviation of log returns, of 252 days a year, in percent."""
    return rolling_std(x, w, n) * F.sqrt(F.lit(252.0)) * 100


def forward_label(flag: Column, w: WindowSpec, h: int) -> Column:
    """1 if the flag is up on any of the next h rows; rows whose horizon is not complete get 0."""
    f = w.rowsBetween(1, h)
    return F.when(F.count(F.lit(1)).over(f) < h, 0).otherwise(F.coalesce(F.max(flag).over(f), F.lit(0)))


def forward_any(flag: Column, w: WindowSpec, h: int) -> Column:
    """The same, NULL where the horizon is not complete."""
    f = w.rowsBetween(1, h)
    return F.when(F.count(F.lit(1)).over(f) == h, (F.sum(flag).over(f) >= 1).cast("int"))


def elevated(x: Column, w: WindowSpec, h: int, baseline: int = 90, factor: float = 1.5, least: int = 3) -> Column:
    """1 if the next h rows exceed ``factor`` times what the lagged baseline lets expect, and reach ``least``."""
    ahead = F.sum(x).over(w.rowsBetween(1, h))
    usual = F.avg(x).over(w.rowsBetween(-baseline, -1))
    return F.coalesce((ahead > factor * usual * h) & (ahead >= least), F.lit(False)).cast("int")


def shifted_max_label(flag: Column, w: WindowSpec, h: int) -> Column:
    """Maximum over h rows of the series shifted h rows ahead.

    Its window starts with the series, so an entity's first h - 1 rows see only the rows
    from h + 1 on, and its last rows what is left.
    """
    numbered = F.struct(F.row_number().over(w).alias("n"), flag.alias("f"))
    ahead = F.collect_list(numbered).over(w.rowsBetween(1, h))  # h entries at most
    return F.array_max(F.transform(F.filter(ahead, lambda x: x["n"] > h), lambda x: x["f"]))


def next_label(flag: Column, w: WindowSpec) -> Column:
    return F.coalesce(F.lead(flag, 1).over(w), F.lit(0))


def spillover(x: Column, group: Keys, date: str) -> Column:
    """What all other entities of the group have on the day, never below 0."""
    w = Window.partitionBy(*group, date)
    return F.greatest(F.sum(x).over(w) - F.coalesce(x, F.lit(0)), F.lit(0))


def islands(df: DataFrame, keys: Keys, order: str, condition: Column) -> DataFrame:
    """(keys, start, end, length): the longest runs of rows on which ``condition`` holds."""
    w = by(keys, order)
    on = F.coalesce(condition, F.lit(False))
    x = df.select(*keys, order, on.alias("__on")).withColumn("__n", F.row_number().over(w))
    x = x.where("__on").withColumn("__g", F.col("__n") - F.row_number().over(w))
    return x.groupBy(*keys, "__g").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("length")).drop("__g")


def cyclic_targets(df: DataFrame, date: str, flag: str, h: int) -> DataFrame:
    """Labels of the last ``h`` days of the whole table become NULL: their horizon is not over for any entity."""
    last = df.agg(F.max(date)).first()[0]
    return df if last is None else df.withColumn(flag, F.when(F.col(date) <= F.date_sub(F.lit(last), h), F.col(flag)))
