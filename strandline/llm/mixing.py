"""Mixing sources to target weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_key(c: Column) -> Column:
    """Lower case, trimmed; blank is NULL."""
    return F.nullif(F.regexp_replace(F.lower(c), r"^[\s\u00a0]+|[\s\u00a0]+$", ""), F.lit(""))


def rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, size, rate) for sizes(source, size) and targets(source, target_share, max_repeats).

    The total is the largest at which every source that has anything reaches its share with
    no more than ``max_repeats`` copies of a document, so rate = share x total / size <= max_repeats
    and the scarcest source sets the total. Sources without documents, without a positive
    share or a positive cap get rate 0 and leave their share to the rest. Documents of sources that
    have no target, or of none, are not drawn. Repeated targets of a source count once.
    """
    t = targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats")).where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    have = sizes.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("size"))
    x = t.join(have, "source", "left").fillna(0, ["docs", "size"])
    usable = (F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    total = x.agg(F.min(F.when(usable, F.col("max_repeats") * F.col("size") / F.col("target_share")))).first()[0]
    rate = F.when(usable, F.least(F.col("max_repeats"), F.col("target_share") * F.lit(total) / F.col("size"))).otherwise(0.0)
    return x.select("source", "target_share", F.col("max_repeats").cast("int").alias("max_repeats"), "docs", "size", rate.alias("rate"))


def mix(docs: DataFrame, rate: DataFrame, seed: int = 7) -> DataFrame:
    """docs(id, source, ...) with ``copy``: each document floor(rate) times, and once more by a seeded coin.

    The coin shows heads with the rate's fraction as probability and depends on id and
    seed only, so the draw is the same on any cluster. The table of rates has a row per
    source. A NULL id draws like any other; documents without a rate are not drawn; a column ``copy`` is replaced.
    """
    coin = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 52)) / float(1 << 52)
    r = F.col("__rate")
    drawn = docs.join(rate.where("rate > 0").select(F.col("source").alias("__source"), F.col("rate").alias("__rate")), F.col("source") == F.col("__source"))
    drawn = drawn.withColumn("__n", (F.floor(r) + (coin < r - F.floor(r)).cast("int")).cast("int")).where("__n > 0")
    kept = [c for c in docs.columns if c != "copy"]
    return drawn.select(*kept, F.explode(F.sequence(F.lit(1), F.col("__n"))).alias("copy"))


def shares(mixed: DataFrame, rate: DataFrame) -> DataFrame:
    """Per source: what was available and drawn, and the share reached beside the target."""
    drawn = mixed.groupBy("source").agg(F.count("*").alias("copies"), F.max("copy").alias("most_repeats"), F.sum("size").alias("tokens_drawn"))
    whole = F.sum("tokens_drawn").over(Window.partitionBy(F.lit(1)))  # over a row per source
    out = rate.join(drawn, "source", "left").withColumn("whole", whole)
    return out.select("source", "target_share", "max_repeats", "docs", F.col("size").alias("tokens"), "rate", F.coalesce("copies", F.lit(0)).alias("copies"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"), F.coalesce(F.try_divide("tokens_drawn", "whole"), F.lit(0.0)).alias("actual_share"))
