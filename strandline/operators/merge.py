"""Records of one event merged into one row."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.geo import haversine_km
from strandline.operators.dedupe import first_value, longest


def union_array(c: str) -> Column:
    """All distinct elements of a group's arrays, sorted."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.col(c)))))


def richness(columns: list[str]) -> Column:
    """How many of the columns are known."""
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))


def merge_articles(df: DataFrame, key: str, order: str) -> DataFrame:
    """Per event: date span, longest place and title, distinct urls, first duration, highest confidence, median position.

    ``df`` has event_date, location_name, source_title, url, duration_hours, confidence, lat, lon. The order column breaks all ties.
    """
    o = F.col(order)
    return df.groupBy(key).agg(
        F.min("event_date").alias("event_date"), F.max("event_date").alias("event_end_date"), longest(F.col("location_name"), o).alias("location_name"), longest(F.col("source_title"), o).alias("source_title"),
        F.count_distinct("url").alias("n_urls"), F.count("*").alias("n_articles"), first_value(F.col("duration_hours"), o).alias("duration_hours"), F.max("confidence").alias("confidence"),
        F.percentile("lat", 0.5).alias("lat"), F.percentile("lon", 0.5).alias("lon"),
    )


def merge_maps(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, merged): for each map key of a group all distinct non-NULL values, sorted."""
    each = df.select(key, F.explode(column).alias("__k", "__v")).where("__v is not null")
    lists = each.groupBy(key, "__k").agg(F.array_sort(F.collect_set("__v")).alias("__vs"))
    return lists.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("__k", "__vs")))).alias("merged"))


def richest(df: DataFrame, key: str, columns: list[str], order: str) -> DataFrame:
    """Per group the row with most of ``columns`` known; ties go to the first by ``order``."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), F.struct(richness(columns), -F.col(order)))
    return df.groupBy(key).agg(row.alias("__r")).select(key, "__r.*")


def duration_days(explicit: Column, day_number: Column, start_reference: Column, span: Column) -> Column:
    """(days, source): the longest candidate; of equals explicit, then day number, start reference, date range."""
    c = [F.struct(x.cast("double").alias("days"), F.lit(p).alias("priority"), F.lit(n).alias("source")) for x, p, n in ((explicit, 4, "explicit"), (day_number, 3, "day_number"), (start_reference, 2, "start_reference"), (span, 1, "range"))]
    best = F.array_max(F.filter(F.array(*c), lambda s: s["days"].isNotNull()))
    return F.struct(best["days"].alias("days"), best["source"].alias("source"))


def internal_weight(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, size, mean_weight): mean weight of edges inside each cluster; 1 for singletons, 0 without edges."""
    m = membership.select(F.col("id").alias("src"), F.col("cluster"))
    inside = edges.join(m, "src").join(m.select(F.col("src").alias("dst"), F.col("cluster").alias("c2")), "dst").where("cluster = c2").groupBy("cluster").agg(F.avg("weight").alias("w"))
    size = membership.groupBy("cluster").agg(F.count("*").alias("size"))
    return size.join(inside, "cluster", "left").select("cluster", "size", F.when(F.col("size") == 1, 1.0).otherwise(F.coalesce("w", F.lit(0.0))).alias("mean_weight"))


def cluster_quality(membership: DataFrame) -> DataFrame:
    """One row: records, clusters, singleton rate, reduction, largest and mean size."""
    s = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    return s.agg(F.sum("n").alias("records"), F.count("*").alias("clusters"), (F.count_if(F.col("n") == 1) / F.count("*")).alias("singleton_rate"), (1 - F.count("*") / F.sum("n")).alias("reduction"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"))


def canonical_events(df: DataFrame, key: str, date: str, day_number: str, participants: str) -> DataFrame:
    """Per event: first and last report, the end that its latest day number implies, duration and most participants."""
    end = F.greatest("latest", F.date_add("start", F.coalesce("days", F.lit(1)).cast("int") - 1))
    x = df.groupBy(key).agg(F.min(date).alias("start"), F.max(date).alias("latest"), F.max(day_number).alias("days"), F.max(participants).alias("participants"), F.count("*").alias("n_articles"))
    return x.withColumn("estimated_end", end).withColumn("duration", F.datediff("estimated_end", "start") + 1).drop("days")


def chosen_type(expert: Column, probability: Column, other: Column, least: float = 0.6) -> Column:
    """(type, source): the expert's type where its probability is high enough, else the other's, else unknown."""
    sure = F.coalesce((probability >= least) & expert.isNotNull(), F.lit(False))
    return F.struct(F.when(sure, expert).otherwise(F.coalesce(other, F.lit("unknown"))).alias("type"), F.when(sure, "expert").otherwise("llm").alias("source"))


def merge_clusters(df: DataFrame, keys: list[str], fields: list[str], order: str, date: str, size: str, impact: list[str]) -> DataFrame:
    """Per group of clusters: the richest one's ``fields``, the first date, all articles, the largest of each impact field, how many merged."""
    anchor = F.max_by(F.struct(*fields), F.struct(richness(fields), F.coalesce(F.col(size), F.lit(0)), order)).alias("__a")
    out = df.groupBy(*keys).agg(anchor, F.min(date).alias(date), F.sum(size).alias(size), *(F.max(c).alias(c) for c in impact), F.count("*").alias("merged"))
    return out.select(*keys, *(F.col(f"__a.{f}").alias(f) for f in fields), date, size, *impact, "merged")


def movements(clusters: DataFrame, edges: DataFrame, members: DataFrame, least_multi: int = 1) -> DataFrame:
    """(root, start, end, n_clusters, n_articles, mean_weight, children): linked clusters of which ``least_multi`` or more have several articles.

    clusters(id, cluster_id, start, end, n_articles), edges(src, dst, weight), members(id, root). Clusters without an edge are no movement.
    """
    m = members.join(clusters, "id")
    out = m.groupBy("root").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_clusters"), F.sum("n_articles").alias("n_articles"), F.count_if(F.col("n_articles") > 1).alias("__multi"), F.array_sort(F.collect_list("cluster_id")).alias("children")
    )
    w = edges.join(members.select(F.col("id").alias("src"), "root"), "src").groupBy("root").agg(F.round(F.avg("weight"), 4).alias("mean_weight"))
    return out.where((F.col("n_clusters") > 1) & (F.col("__multi") >= least_multi)).drop("__multi").join(w, "root")


def top_values(df: DataFrame, key: str, arrays: list[Column], order: str, k: int = 5) -> DataFrame:
    """(key, top): each group's ``k`` most frequent elements over several arrays, joined by commas; ties go to the one seen first."""
    each = df.select(key, order, F.posexplode(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays))).alias("__i", "__v")).where("__v is not null and trim(__v) <> ''")
    n = each.groupBy(key, "__v").agg(F.count("*").alias("__n"), F.min(F.struct(order, "__i")).alias("__first"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("__n"), "__first"))  # a row per distinct value
    return n.withColumn("__r", first).where(F.col("__r") <= k).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__v"))), lambda x: x["__v"]), ", ").alias("top"))


def quality_by(clusters: DataFrame, by: str, size: str, score: str, start: str, end: str) -> DataFrame:
    """Per group: clusters, records, singleton rate, reduction, cohesion of the multi-article ones, longest and mean span in days."""
    many, span = F.col(size) > 1, F.datediff(end, start) + 1
    return clusters.groupBy(by).agg(
        F.count("*").alias("clusters"), F.sum(size).alias("records"), (F.count_if(F.col(size) == 1) / F.count("*")).alias("singleton_rate"), (1 - F.count("*") / F.sum(size)).alias("reduction"),
        F.avg(F.when(many, F.col(score))).alias("cohesion"), F.max(span).alias("longest"), F.avg(span).alias("mean_span"),
    )


def differences(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Figures of two runs side by side: for each, b less a."""
    figures = [c for c in a.columns if c != by]
    x = a.select(F.col(by), *(F.col(c).alias(f"__a_{c}") for c in figures)).join(b, by, "full")
    return x.select(by, *((F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"__a_{c}"), F.lit(0))).alias(c) for c in figures))


def arbitrated_position(own: tuple[Column, Column], named: tuple[Column, Column], span_km: Column, same_country: Column, confidence: Column, least: float = 0.7, most_span: float = 500.0, most_off: float = 500.0) -> Column:
    """(lat, lon, source, verified, rejected_km): which of two positions of a record counts.

    That of the place named, where the place is certain enough, its box is no wider than ``most_span`` and its country is the expected one; else its
    own, which the place named confirms if no more than ``most_off`` away, and rejects beyond. An own position that nothing can confirm stays, unverified.
    """
    known = named[0].isNotNull() & named[1].isNotNull()
    has_own = own[0].isNotNull() & own[1].isNotNull()
    by_name = F.coalesce(known & (confidence >= least) & (span_km <= most_span) & same_country, F.lit(False))
    off = F.when(known & has_own, haversine_km(*own, *named))
    far = F.coalesce(~by_name & (off > most_off), F.lit(False))
    pick = lambda i: F.when(by_name, named[i]).when(has_own & ~far, own[i])
    source = F.when(by_name, "named").when(has_own & ~far, "own")
    return F.struct(pick(0).alias("lat"), pick(1).alias("lon"), source.alias("source"), (by_name | F.coalesce(off <= most_off, F.lit(False))).alias("verified"), F.when(far, F.round(off, 1)).alias("rejected_km"))


def stitch(df: DataFrame, key: str, batch: str, date: str, value: str, least: int = 3) -> DataFrame:
    """(key, date, value): overlapping batches of a series joined into one.

    In order of ``batch`` each is scaled by the ratio of means on the days it shares with what is there, if
    ``least`` or more, else taken as it is; shared days are averaged, new ones appended. Sequential within a series, so
    a series is one task's group; series are independent.
    """
    kinds = dict(df.dtypes)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        whole: pd.Series | None = None
        for _, part in pdf.dropna(subset=[date, value]).groupby(batch, sort=True):
            s = part.groupby(date)[value].mean().sort_index()
            if whole is not None:
                both = whole.index.intersection(s.index)
                if len(both) >= least and s[both].mean():
                    s = s * (whole[both].mean() / s[both].mean())
                whole = pd.concat([whole[whole.index.difference(both)], (whole[both] + s[both]) / 2, s[s.index.difference(both)]]).sort_index()
            else:
                whole = s
        whole = whole if whole is not None else pd.Series(dtype=float)
        return pd.DataFrame({key: pd.Series([pdf[key].iloc[0]] * len(whole), dtype=object), date: pd.Series(list(whole.index), dtype=object), value: whole.to_numpy(float)})

    return df.select(key, batch, date, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(fold, f"`{key}` {kinds[key]}, `{date}` {kinds[date]}, `{value}` double")
