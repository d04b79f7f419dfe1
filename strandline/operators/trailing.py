"""Rolling totals over trailing periods, days without activity included."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.keys import days


@dataclass(frozen=True)
class Trailing:
    """``name``: total of ``value`` over the ``window`` days before a date, that date excluded."""

    name: str
    value: str
    window: int


def latest_per_day(deliveries: DataFrame, entity: str, date: str, version: str, values: list[str]) -> DataFrame:
    """One row per entity and day: the values of the latest delivery.

    Deliveries of the same instant resolve to the largest values, NULL last, so the result
    never depends on row order. A NULL version is older than any other. Rows without
    entity or date belong to no day and are left out.
    """
    pick = F.max_by(F.struct(*values), F.struct(version, *values))
    out = deliveries.where(F.col(entity).isNotNull() & F.col(date).isNotNull()).groupBy(entity, date).agg(pick.alias("__v"))
    return out.select(entity, date, *(F.col(f"__v.{v}").alias(v) for v in values))


def trailing_totals(dates: DataFrame, daily: DataFrame, entity: str, date: str, wanted: list[Trailing], means: bool = False) -> DataFrame:
    """For every (entity, date) of ``dates``, the totals of ``daily`` over trailing periods.

    Range join: each date is sent to the one or two coarse buckets its longest period
    touches and meets there only the days of the same entity and bucket; the bounds are
    then checked exactly and the candidates aggregated. The bucket is as wide as the
    longest period. ``daily`` has at most one row per entity and day, so no bucket outgrows its
    width in rows, however large the entity.

    Days without a row, and NULL values, count as 0; a date with no activity at all gets 0.
    ``means=True`` adds ``<name>_mean`` per calendar day of the period. Repeated dates give
    one row; rows of ``dates`` without entity or date give none; further columns of either
    input are ignored.
    """
    width = max(t.window for t in wanted)
    q = dates.select(F.col(entity).alias("__e"), days(F.col(date)).alias("__d")).where("__e is not null and __d is not null").distinct()
    first, last = F.floor((F.col("__d") - width) / width), F.floor((F.col("__d") - 1) / width)
    q = q.withColumn("__b", F.explode(F.array_distinct(F.array(first, last))))
    values = sorted({t.value for t in wanted})
    busy = daily.select(F.col(entity).alias("__e2"), days(F.col(date)).alias("__d2"), *(F.col(v).cast("double").alias(f"__v_{v}") for v in values))
    idle = [F.coalesce(F.col(f"__v_{v}"), F.lit(0.0)) != 0 for v in values]
    some: Column = idle[0]
    for c in idle[1:]:
        some = some | c
    busy = busy.where(some).withColumn("__b2", F.floor(F.col("__d2") / width))
    near = (F.col("__e") == F.col("__e2")) & (F.col("__b") == F.col("__b2")) & F.col("__d2").between(F.col("__d") - width, F.col("__d") - 1)
    total = lambda t: F.coalesce(F.sum(F.when(F.col("__d2") >= F.col("__d") - t.window, F.col(f"__v_{t.value}"))), F.lit(0.0))
    out = q.join(busy, near, "left").groupBy("__e", "__d").agg(*(total(t).alias(t.name) for t in wanted))
    if means:
        out = out.withColumns({f"{t.name}_mean": F.col(t.name) / t.window for t in wanted})
    return out.withColumn(date, F.date_from_unix_date("__d")).withColumnRenamed("__e", entity).drop("__d")


def others_in_group(own: DataFrame, daily: DataFrame, groups: DataFrame, entity: str, group: str, date: str, wanted: list[Trailing]) -> DataFrame:
    """Trailing totals over all *other* entities of the same group, in place of the entity's own.

    ``own`` is what :func:`trailing_totals` gives for the same periods, with or without more of them; its other columns stay.
    The group's daily totals are built once, range-joined like an entity's, and the
    entity's own total is taken off, so no pair of entities is ever formed. An entity
    of no group, or alone in it, gets 0.
    """
    g = groups.select(F.col(entity).alias("__ge"), F.col(group).alias("__g")).where("__ge is not null and __g is not null").dropDuplicates(["__ge"])
    values = sorted({t.value for t in wanted})
    of_group = daily.join(g, F.col(entity) == F.col("__ge")).groupBy("__g", date).agg(*(F.sum(F.col(v).cast("double")).alias(v) for v in values))
    placed = own.join(g, F.col(entity) == F.col("__ge"), "left")
    whole = trailing_totals(placed.select("__g", date), of_group, "__g", date, wanted).select(F.col("__g").alias("__g2"), F.col(date).alias("__date2"), *(F.col(t.name).alias(f"__all_{t.name}") for t in wanted))
    out = placed.join(whole, (F.col("__g") == F.col("__g2")) & (F.col(date) == F.col("__date2")), "left")
    rest = {t.name: F.when(F.col("__g").isNull(), 0.0).otherwise(F.col(f"__all_{t.name}") - F.col(t.name)).alias(t.name) for t in wanted}
    return out.select(*(rest.get(c, F.col(c)) for c in own.columns))


def calendar(daily: DataFrame, entity: str, date: str) -> DataFrame:
    """Every day from an entity's first to its last row."""
    span = daily.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(date).alias("__lo"), F.max(date).alias("__hi"))
    return span.where("__lo is not null").select(entity, F.explode(F.sequence("__lo", "__hi")).alias(date))
