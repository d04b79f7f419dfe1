"""Weighted similarities, and the one-to-one assignment of matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.components import components
from strandline.operators.assignment import IN_TASK, assign_rooted
from strandline.session import materialize


def weighted(parts: list[tuple[float, Column]]) -> Column:
    """Mean of the similarities that are known, by weight."""
    known = lambda w, c: F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0)
    total = sum((known(w, c) for w, c in parts[1:]), known(*parts[0]))
    return F.try_divide(sum((F.coalesce(c, F.lit(0.0)) * w for w, c in parts[1:]), F.coalesce(parts[0][1], F.lit(0.0)) * parts[0][0]), total)


def one_to_one(pairs: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """(l, r, w): the one-to-one assignment of largest total weight over pairs(l long, r long, w > 0).

    Components of the pairs are independent: each is solved exactly, in one task up to ``in_task`` pairs and by rounds over all tasks beyond.
    Repeated pairs count once with their largest weight; pairs with
    NULLs or without positive weight are left out; no pairs give no rows.
    """
    p = pairs.where("l is not null and r is not null and w > 0").groupBy(F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r")).agg(F.max("w").cast("double").alias("w"))
    p = materialize(p, "pairs")
    node = lambda c, side: F.col(c) * 2 + side
    roots = components(p.select(node("l", 0).alias("src"), node("r", 1).alias("dst"))).withColumnRenamed("id", "__n")
    return assign_rooted(materialize(p.join(roots, node("r", 1) == F.col("__n")).select("root", "l", "r", "w"), "rooted"), in_task)
