"""Long to wide and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pivot_first(df: DataFrame, keys: list[str], names: str, value: str, order: str, columns: list[str]) -> DataFrame:
    """One column per name with the first value by ``order``. Names are given, so no pass looks for them."""
    return df.groupBy(*keys).agg(*(F.min_by(value, F.when(F.col(names) == n, F.col(order))).alias(n) for n in columns))


def pivot_agg(df: DataFrame, keys: list[str], names: str, value: Column, how, columns: list, fill=None, total: str | None = None) -> DataFrame:
    """One column per name, which may be a number, with ``how`` (sum, avg, count) of its values; ``total`` adds the row's sum."""
    to = [str(n) for n in columns]
    out = df.groupBy(*keys).agg(*(how(F.when(F.col(names) == n, value)).alias(c) for n, c in zip(columns, to, strict=True)))
    if fill is not None:
        out = out.withColumns({c: F.coalesce(F.col(f"`{c}`"), F.lit(fill)) for c in to})
    return out.withColumn(total, sum((F.col(f"`{c}`") for c in to[1:]), F.col(f"`{to[0]}`"))) if total else out


def crosstab_percent(df: DataFrame, row: str, names: str, columns: list[str]) -> DataFrame:
    """Counts per row value as percent of the row's total; rows of none give 0."""
    n = pivot_agg(df, [row], names, F.lit(1), F.count, columns, 0)
    whole = F.greatest(sum((F.col(c) for c in columns[1:]), F.col(columns[0])), F.lit(1))
    return n.select(row, *((100.0 * F.col(c) / whole).alias(c) for c in columns))


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str = "variable", value: str = "value", drop_null: bool = True) -> DataFrame:
    """A row per key and column."""
    out = df.unpivot(keys, columns, name, value)
    return out.where(F.col(value).isNotNull()) if drop_null else out


def grid_mean(df: DataFrame, lat: str, lon: str, value: str, step: float) -> DataFrame:
    """(lat_cell, lon_cell, mean, n) over cells of ``step`` degrees."""
    return df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).groupBy((F.floor(F.col(lat) / step) * step).alias("lat_cell"), (F.floor(F.col(lon) / step) * step).alias("lon_cell")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def full_outer(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All keys of either side once, with both sides' columns."""
    return left.join(right, keys, "full")
