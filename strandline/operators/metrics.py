"""Scores of binary predictions, calibration and quality figures, as aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.cumulative import running


def _by_score(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Positives and negatives per distinct score: what ranking metrics need, aggregated first."""
    ok = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    return ok.groupBy(*keys, p).agg(F.sum(F.col(y).cast("double")).alias("pos"), F.sum(1 - F.col(y).cast("double")).alias("neg"))


def ranking_scores(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """(keys, n, n_pos, roc_auc, average_precision, brier, brier_skill).

    ROC-AUC counts ties half; average precision sums recall steps times precision over
    distinct thresholds, without interpolation; skill is against the base rate. One class
    alone gives NULL for what it leaves undefined.
    """
    s = _by_score(df, keys, y, p)
    down = Window.partitionBy(*keys).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    s = s.withColumns({"tp": F.sum("pos").over(down), "fp": F.sum("neg").over(down), "n1": F.sum("pos").over(whole), "n0": F.sum("neg").over(whole)})
    steps = s.groupBy(*keys).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos")) + F.col("pos") * F.col("neg") / 2).alias("wins"), F.max("n1").alias("n1"), F.max("n0").alias("n0"),
        F.sum(F.try_divide("pos", "n1") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"),
        F.sum(F.col("pos") * (F.col(p) - 1) * (F.col(p) - 1) + F.col("neg") * F.col(p) * F.col(p)).alias("se"),
    )
    n, rate = F.col("n1") + F.col("n0"), F.try_divide(F.col("n1"), F.col("n1") + F.col("n0"))
    out = steps.withColumns({"n": n.cast("long"), "n_pos": F.col("n1").cast("long"), "roc_auc": F.try_divide("wins", F.col("n1") * F.col("n0")), "brier": F.try_divide("se", n)})
    return out.withColumn("brier_skill", 1 - F.try_divide("brier", rate * (1 - rate))).select(*keys, "n", "n_pos", "roc_auc", "average_precision", "brier", "brier_skill")


def threshold_sweep(df: DataFrame, y: str, p: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) for scores >= threshold, in one pass over the rows."""
    aggs = []
    for i, t in enumerate(thresholds):
        up = F.col(p) >= t
        aggs += [F.count_if(up & (F.col(y) == 1)).alias(f"tp{i}"), F.count_if(up & (F.col(y) == 0)).alias(f"fp{i}"), F.count_if(~up & (F.col(y) == 1)).alias(f"fn{i}"), F.count_if(~up & (F.col(y) == 0)).alias(f"tn{i}")]
    one = df.agg(*aggs)
    rows = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), *(F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn"))) for i, t in enumerate(thresholds)))
    x = one.select(F.explode(rows).alias("r")).select("r.*")
    x = x.withColumns({"precision": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), "recall": F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))})
    return x.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def calibration(df: DataFrame, y: str, p: str, bins: int, right_closed: bool) -> DataFrame:
    """(bin, mean_pred, mean_actual, n) over equal bins: (a, b] with 0 in the first, or [a, b) with 1 in the last."""
    b = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)) if right_closed else F.floor(F.col(p) * bins)
    return df.where(F.col(p).isNotNull()).groupBy(F.least(b, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.avg(p).alias("mean_pred"), F.avg(F.col(y).cast("double")).alias("mean_actual"), F.count("*").alias("n"))


def gain_curve(df: DataFrame, y: str, p: str, points: int, buckets: int = 1000) -> DataFrame:
    """(share, gain, lift): of the rows in order of score, what share of positives the first ones hold.

    The curve is taken at ``points`` equal steps of distinct scores' cumulative counts. Scores are summed per distinct value, then within ``buckets``
    ranges of the scores, so that no task orders them all.
    """
    s = _by_score(df, [], y, p).withColumns({"__all": F.lit(1), "__n": F.col("pos") + F.col("neg")})
    low, high, n, hits = s.agg(F.min(p), F.max(p), F.sum("__n"), F.sum("pos")).first()
    width = ((high - low) / buckets if low is not None else 0) or 1.0
    c = running(s.withColumn("__down", -F.col(p)), ["__all"], ["__down"], -F.floor((F.col(p) - F.lit(low)) / width), {"at": ("sum", F.col("__n")), "got": ("sum", F.col("pos"))})
    c = c.select((F.col("at") / F.lit(n)).alias("at"), F.try_divide(F.col("got"), F.lit(hits)).alias("gain"))
    c = c.withColumn("step", F.ceil(F.col("at") * points).cast("int")).groupBy("step").agg(F.max("at").alias("share"), F.max("gain").alias("gain"))
    return c.withColumn("lift", F.col("gain") / F.col("share"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval within [0, 1]; NULL for n = 0."""
    rate = F.try_divide(successes, n)
    mid = (rate + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(mid - half, F.lit(0.0))), F.when(ok, F.least(mid + half, F.lit(1.0)))


def match_rates(df: DataFrame, flag: str, sets: list[list[str]]) -> DataFrame:
    """Rows, resolved rows, matches and rate for several groupings in one pass; NULL flags count in neither part of the rate."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(F.count("*").alias("n"), F.count(flag).alias("resolved"), F.count_if(F.col(flag)).alias("matched"), F.grouping_id().cast("int").alias("level"))
    return out.withColumn("rate", F.try_divide("matched", "resolved"))


def missingness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_missing, pct_missing): NULL and NaN count."""
    kinds = dict(df.dtypes)
    gone = lambda c: F.col(c).isNull() | (F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False))
    one = df.agg(F.count("*").alias("__n"), *(F.count_if(gone(c)).alias(c) for c in columns))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing"), F.coalesce(F.try_divide(100.0 * F.col(c), F.col("__n")), F.lit(0.0)).alias("pct_missing")) for c in columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r): Pearson's r of each pair of columns over the rows that have both, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*(F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)))).alias("x")).select("x.*")


def fill_rate(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Per entity the share of rows on which any of the columns is known, in percent."""
    known = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])
    return df.groupBy(key).agg((100.0 * F.count_if(known) / F.count("*")).alias("fill_pct"), F.count("*").alias("n"))


def positive_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, total, low, q1, q2, q3, high) of the positive values; quartiles are the values at indexes n//4, n//2, 3n//4.

    Values are counted first, so a group is as long as its distinct values; the quartile is the first whose
    cumulative count passes the index.
    """
    n = df.where(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    part = Window.partitionBy(*keys)
    n = n.withColumns({"__upto": F.sum("__c").over(part.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), "__n": F.sum("__c").over(part)})
    at = lambda k: F.min(F.when(F.col("__upto") > F.floor(F.col("__n") * k / 4), F.col(value)))
    return n.groupBy(*keys).agg(F.sum("__c").alias("n"), F.sum(F.col(value) * F.col("__c")).alias("total"), F.min(value).alias("low"), at(1).alias("q1"), at(2).alias("q2"), at(3).alias("q3"), F.max(value).alias("high"))


def reliable_entities(df: DataFrame, key: str, events: str, articles: str, least: float = 2.0) -> DataFrame:
    """Entities whose median of articles per event, on days with events, is at least ``least``; all, where none is."""
    med = df.where(F.col(events) > 0).groupBy(key).agg(F.median(F.col(articles) / F.col(events)).alias("m")).where(F.col("m") >= least).select(key)
    return med if not med.isEmpty() else df.select(key).distinct()
