"""Running totals that stay parallel inside one entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


_AGG = {"sum": F.sum, "max": F.max}
_JOIN = {"sum": _plus, "max": F.greatest}


def running(df: DataFrame, keys: list[str], order: list[str], bucket: Column, aggs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates (``sum`` or ``max``) over ``order`` within ``keys``.

    ``bucket`` must not decrease along ``order``. Rows are summed within (keys, bucket);
    the carry of earlier buckets comes from their totals, one row per bucket, so an entity
    that holds a third of all rows is still spread over its buckets. Rows that tie on
    ``order`` all see each other (a RANGE frame). NULL inputs are skipped; a running
    ``sum`` of nothing is 0, a ``max`` of nothing NULL. NULL keys form their own group.
    """
    b = "__bucket"
    df = df.withColumn(b, bucket)
    inputs = {f"__in_{n}": e for n, (_, e) in aggs.items()}
    df = df.withColumns(inputs)
    totals = df.groupBy(*keys, b).agg(*(_AGG[k](f"__in_{n}").alias(f"__tot_{n}") for n, (k, _) in aggs.items()))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)), F.col(b).alias("__b"),
        *(_AGG[k](f"__tot_{n}").over(before).alias(f"__carry_{n}") for n, (k, _) in aggs.items()),
    )
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)] + [F.col(b).eqNullSafe(F.col("__b"))])
    here = Window.partitionBy(*keys, b).orderBy(*order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({f"__here_{n}": _AGG[k](f"__in_{n}").over(here) for n, (k, _) in aggs.items()}).join(carry, on, "left")
    out = out.withColumns({n: _JOIN[k](F.col(f"__here_{n}"), F.col(f"__carry_{n}")) for n, (k, _) in aggs.items()})
    drop = [b, "__b", *inputs, *(f"__k_{i}" for i in range(len(keys))), *(f"__{p}_{n}" for p in ("here", "carry") for n in aggs)]
    return out.drop(*drop)
