"""Keeping one row per key, modes and tops within groups. Order is always explicit, so results never depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _one(df: DataFrame, keys: list[str], rank: Column, first: bool) -> DataFrame:
    """The row of the smallest or largest ``rank`` per key: a partial aggregation, no sort, no hot window."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*(F.col(f"`{c}`") for c in rest)) if rest else F.struct(F.lit(1).alias("__one"))
    out = df.groupBy(*keys).agg((F.min_by if first else F.max_by)(row, rank).alias("__row"))
    return out.select(*keys, *(F.col(f"__row.`{c}`").alias(c) for c in rest)).select(*df.columns)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes first by ``order``; rows that tie are resolved by content. NULL keys are a key."""
    return _one(df, keys, F.struct(*order, *(c for c in df.columns if c not in order and c not in keys)), True)


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last write wins."""
    return _one(df, keys, F.struct(*order, *(c for c in df.columns if c not in order and c not in keys)), False)


def keep_max(df: DataFrame, keys: list[str], metric: str, order: list[str]) -> DataFrame:
    """The row of the largest ``metric``, of equals the first by ``order``. A NULL metric loses to any other."""
    known = F.col(metric).isNull().cast("int")
    return _one(df, keys, F.struct(known, -F.col(metric), *order), True)


def stable_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, mode, n, conflict): the most frequent non-NULL value, of equals the one seen first by ``order``.

    ``conflict`` tells whether a group holds more than one value. Groups without values give no row.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = F.min_by(F.struct(F.col(value).alias("mode"), "n"), F.struct(-F.col("n"), "__first", value))
    return n.groupBy(*keys).agg(best.alias("b"), (F.count("*") > 1).alias("conflict")).select(*keys, "b.mode", "b.n", "conflict")


def first_value(value: Column, order: Column) -> Column:
    """Aggregate: the non-NULL value that comes first."""
    return F.min_by(value, F.when(value.isNotNull(), order))


def longest(value: Column, order: Column) -> Column:
    """Aggregate: the longest text, of equals the first."""
    return F.min_by(value, F.when(value.isNotNull(), F.struct(-F.length(value), order)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group with their ``rank`` (1 is first)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` without the keys of ``new``, plus ``new``. NULL keys match NULL keys."""
    gone = new.select(*(F.col(k).alias(f"__n_{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"__n_{k}")) for k in keys]
    kept = existing.join(gone, on=_all(on), how="left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def append_new(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``existing`` plus the rows of ``new`` whose keys it lacks. NULL keys match NULL keys; repeats within ``new`` stay."""
    have = existing.select(*(F.col(k).alias(f"__h_{k}") for k in keys)).distinct()
    lacking = new.join(have, _all([F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys]), "left_anti")
    return existing.unionByName(lacking, allowMissingColumns=True)


def prepend_history(current: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """A series with older rows put before it: of a key that both have the current row is kept."""
    return append_new(current, history, keys)


def ordinal_ids(df: DataFrame, size: str, tie: str, to: str, buckets: int = 1000) -> DataFrame:
    """Number rows 1, 2, ... by size, largest first, ties by ``tie``: exact, and no task holds all rows.

    Rows are counted per size; within a size and a range of ``tie``'s order they are numbered apart, on top of the counts before.
    """
    bounds = df.approxQuantile(tie, [i / buckets for i in range(1, buckets)], 1 / (2 * buckets)) if dict(df.dtypes)[tie] in ("int", "bigint", "double") else []
    part = F.size(F.filter(F.lit(sorted(set(bounds))), lambda b: b <= F.col(tie))) if bounds else F.lit(0)
    x = df.withColumn("__part", part)
    n = x.groupBy(F.col(size).alias("__size"), F.col("__part").alias("__p")).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc("__size"), "__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per size and range
    n = n.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    within = Window.partitionBy(size, "__part").orderBy(tie)
    out = x.withColumn("__i", F.row_number().over(within)).join(n, F.col(size).eqNullSafe(F.col("__size")) & (F.col("__part") == F.col("__p")))
    return out.withColumn(to, F.col("__before") + F.col("__i")).drop("__size", "__p", "__before", "__i", "__part")


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows, or all where there are fewer, the same on any cluster: those of the smallest seeded digests of their keys."""
    return df.withColumn("__d", F.xxhash64(F.lit(seed), *keys)).orderBy("__d", *keys).limit(n).drop("__d")


def in_order(c: Column, order: list[str]) -> Column:
    """Place of a category in a given order; others come last."""
    at = F.array_position(F.array(*(F.lit(x) for x in order)), c)
    return F.when(at > 0, at).otherwise(len(order) + 1)


def dated_last(c: Column) -> Column:
    """ISO dates as text to sort by, unknown ones last."""
    return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("9999"))
