"""Queries on graphs, vectors and likelihood models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import vectors as V
from strandline.functions.keys import code_key, finite
from strandline.operators import assignment, dedupe, graph, joins, merge, metrics, models
from strandline.plans.tables import table
from strandline.session import materialize

THRESHOLDS = [round(0.05 * i, 2) for i in range(1, 20)]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), "label", "embedding")


def _edges(spark: SparkSession, d: str, least: float = 0.2) -> DataFrame:
    """Near vectors of one label within 100 ids, as an edge table with weights.

    Ids stand for days: nearness is windowed, as the reference pairs events within a window of dates
    only. Vectors of one label further apart get no edge, however similar; all graph queries below rest on these edges.
    """
    v = _vectors(spark, d).select("id", "label", V.unit(F.col("embedding")).alias("u"), F.date_from_unix_date(F.col("id").cast("int")).alias("day"))
    return materialize(joins.window_cosines(v, "label", "id", "day", "u", 100, least), "edges")  # read several times by what rests on it


def embedding_edges(spark, d):
    return _edges(spark, d).withColumn("weight", F.round("weight", 6))


def label_centroids(spark, d):
    c = V.centroid(_vectors(spark, d), "label", "embedding")
    return c.select("label", F.round(V.norm(F.col("centroid")), 6).alias("length"), F.round(F.element_at("centroid", 1), 6).alias("first"))


def connected_components(spark, d):
    return graph.connected_components(_edges(spark, d))


def dbscan_roles(spark, d):
    """Core, border and noise vectors, neighbours being those within 100 ids."""
    return graph.dbscan(_edges(spark, d), _vectors(spark, d), 3)


def cluster_quality(spark, d):
    """Figures of the components, singletons included."""
    e = _edges(spark, d)
    m = _vectors(spark, d).select("id").join(graph.connected_components(e), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    return merge.cluster_quality(m).select("records", "clusters", F.round("singleton_rate", 6).alias("singleton_rate"), F.round("reduction", 6).alias("reduction"), "largest", F.round("mean_size", 6).alias("mean_size"))


def internal_weights(spark, d):
    e = _edges(spark, d)
    m = _vectors(spark, d).select("id").join(graph.connected_components(e), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))
    return merge.internal_weight(e, m).withColumn("mean_weight", F.round("mean_weight", 6))


def louvain_communities(spark, d):
    return graph.louvain(_edges(spark, d))


def greedy_dedupe(spark, d):
    """In order of id, each vector joins the first earlier representative of its label within 100 ids that it is near to."""
    e = _edges(spark, d)
    return graph.greedy_clusters(_vectors(spark, d), e.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def best_assignment(spark, d):
    """Errors and purchases of the same user within a day paired one to one with the largest total weight."""
    of = lambda k: table(spark, d, "events").where(F.col("event_type") == k).select("event_id", "user_id", F.col("ts").cast("date").alias("d"), "value")
    p = joins.within_days(of("error"), of("purchase"), ["user_id"], "d", "d", 1, 1)
    w = p.select(F.col("event_id").alias("l"), F.col("r_event_id").alias("r"), (1 - F.abs(F.col("value") - F.col("r_value")) / 500).alias("w"))
    return assignment.assign(w, 0.35)


def _scores(spark: SparkSession, d: str) -> DataFrame:
    """Panel rows with an outcome and a score in [0, 1] that knows something of it."""
    p = table(spark, d, "modelling_panel_gdelt").where("protest_7d is not null")
    s = (F.pmod(F.col("panel_id") * 7919, F.lit(1000)) / 1000 + F.col("protest_7d") * 0.3) / 1.3
    return p.select("panel_id", code_key(F.col("country_iso3")).alias("iso3"), F.col("protest_7d").cast("int").alias("y"), F.round(s, 3).alias("p"))


def threshold_sweep(spark, d):
    x = metrics.threshold_sweep(_scores(spark, d), "y", "p", THRESHOLDS)
    return x.select("threshold", "tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def ranking_scores(spark, d):
    x = metrics.ranking_scores(_scores(spark, d), ["iso3"], "y", "p")
    return x.select("iso3", "n", "n_pos", *(F.round(c, 6).alias(c) for c in ("roc_auc", "average_precision", "brier", "brier_skill")))


def calibration_bins(spark, d):
    x = metrics.calibration(_scores(spark, d), "y", "p", 5, True)
    return x.select("bin", F.round("mean_pred", 6).alias("mean_pred"), F.round("mean_actual", 6).alias("mean_actual"), "n")


def reliability_bins(spark, d):
    x = metrics.calibration(_scores(spark, d), "y", "p", 10, False)
    return x.select("bin", F.round("mean_pred", 6).alias("mean_pred"), F.round("mean_actual", 6).alias("mean_actual"), "n")


def gain_curve(spark, d):
    x = metrics.gain_curve(_scores(spark, d), "y", "p", 10)
    return x.select("step", *(F.round(c, 6).alias(c) for c in ("share", "gain", "lift")))


FEATURES = ["unemployment_total", "food_cpi_inflation", "political_stability_est", "gdp_growth", "fx_pct_30d", "oil_brent_pct_30d", "gdelt_protest_7d_lag", "gdelt_strike_28d_lag"]


def _panel(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "modelling_panel_gdelt")
    return p.select("panel_id", code_key(F.col("adm1_code")).alias("unit"), F.col("date").cast("date").alias("date"), F.col("protest_7d").cast("int").alias("y"), *(finite(F.col(c)).alias(c) for c in FEATURES))


def lr_backtest(spark, d):
    """Walk-forward scores of a logistic model for the last two years."""
    pred = models.walk_forward(_panel(spark, d), "date", FEATURES, [2020, 2021], lambda f, n: models.logistic(f, 1.0, n), "sigmoid")
    return models.fold_scores(pred, ["fold"], "p_cal")


def gbt_backtest(spark, d):
    """Walk-forward scores of boosted trees for the last two years."""
    pred = models.walk_forward(_panel(spark, d), "date", FEATURES, [2020, 2021], lambda f, n: models.boosted(f), "isotonic")
    return models.fold_scores(pred, ["fold"], "p_cal")


def two_stage_scores(spark, d):
    return models.two_stage(_panel(spark, d), "unit", FEATURES[:4], FEATURES[4:]).select("panel_id", "y", F.round("risk", 6).alias("risk"), F.round("p", 6).alias("p"))


def vif_features(spark, d):
    """The features left by the variance inflation filter."""
    keep = models.vif_filter(_panel(spark, d), FEATURES)
    return spark.createDataFrame([(c,) for c in keep], "feature string")  # a list of names


def best_models(spark, d):
    """The best of several constant scorers per country by average precision."""
    s = _scores(spark, d)
    both = s.select("iso3", "y", "p", F.lit("score").alias("model")).unionByName(s.select("iso3", "y", (1 - F.col("p")).alias("p"), F.lit("inverse").alias("model")))
    r = metrics.ranking_scores(both, ["iso3", "model"], "y", "p").select("iso3", "model", F.round("average_precision", 6).alias("ap"))
    return dedupe.keep_max(r, ["iso3"], "ap", ["model"])


QUERIES = {f.__name__: f for f in (embedding_edges, label_centroids, connected_components, dbscan_roles, cluster_quality, internal_weights, louvain_communities, greedy_dedupe, best_assignment, threshold_sweep, ranking_scores, calibration_bins, reliability_bins, gain_curve, lr_backtest, gbt_backtest, two_stage_scores, vif_features, best_models)}

_COS = "round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9)"
_EDGES = f"e as (select a.vec_id as src, b.vec_id as dst, {_COS} as weight from embeddings a join embeddings b on a.label = b.label and a.vec_id < b.vec_id and b.vec_id - a.vec_id <= 100 where {_COS} >= 0.2)"
_CC = f"{_EDGES}, u as (select src, dst from e union select dst, src from e union select src, src from e union select dst, dst from e), r(id, o) as (select src, dst from u union select r.id, u.dst from r join u on r.o = u.src), c as (select id, min(o) as root from r group by 1)"
_M = f"{_CC}, m as (select vec_id as id, coalesce(root, vec_id) as cluster from embeddings left join c on c.id = vec_id)"
_SC = "s as (select panel_id, nullif(regexp_replace(upper(country_iso3), '[^A-Z0-9-]', '', 'g'), '') as iso3, protest_7d::int as y, round(((panel_id * 7919) % 1000 / 1000.0 + protest_7d * 0.3) / 1.3, 3) as p from modelling_panel_gdelt where protest_7d is not null)"
_RANK = "g as (select {k}, p, sum(y)::double as pos, sum(1 - y)::double as neg from {t} group by all), h as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by {k}) as pp, sum(neg) over (partition by {k}) as nn from g window w as (partition by {k} order by p desc))"
SQL = {
    "embedding_edges": f"with {_EDGES} select src, dst, round(weight, 6) as weight from e",
    "label_centroids": (
        "with x as (select label, unnest(embedding)::double as x, generate_subscripts(embedding, 1) as i from embeddings), m as (select label, i, avg(x) as m from x group by all), n as (select label, sqrt(sum(m "
        "* m)) as n from m group by 1) select label, 1.0 as length, round(m / n, 6) as first from m join n using (label) where i = 1"
    ),
    "connected_components": f"with recursive {_CC} select id, root from c",
    "dbscan_roles": f"""with recursive {_EDGES}, y as (select src, dst from e union select dst, src from e), g as (select vec_id as id, 1 + count(y.dst) as n from embeddings left join y on y.src = vec_id group by 1), k as (select id from g where n >= 3),
 z as (select y.src, y.dst from y join k a on a.id = src join k b on b.id = dst), r(id, o) as (select id, id from k union select r.id, z.dst from r join z on r.o = z.src), c as (select id, min(o) as cluster from r group by 1),
 b as (select y.src as id, min(cluster) as near from y join c on c.id = y.dst group by 1) select g.id, coalesce(c.cluster, b.near, g.id) as cluster, case when c.cluster is not null then 'core' when b.near is not null
  then 'border' else 'noise' end as role from g left join c using (id) left join b using (id)""",
    "greedy_dedupe": f"""with recursive {_EDGES}, n as (select vec_id as id, row_number() over (order by vec_id) as i, coalesce(list(src) filter (src is not null), []) as near from embeddings left join e on dst = vec_id group by vec_id),
 r(i, reps) as (select 0::bigint, []::bigint[] union all select n.i, case when list_has_any(near, reps) then reps else list_append(reps, id) end from r join n on n.i = r.i + 1), f as (select arg_max(reps, i) as reps from r)
 select id, coalesce(list_min(list_intersect(near, reps)), id) as representative from n, f""",
    "cluster_quality": (
        f"with recursive {_M}, z as (select count(*) as n from m group by cluster) select sum(n) as records, count(*) as clusters, round(count(*) filter (n = 1) / count(*), 6) as singleton_rate, round(1 - count(*) "
        f"/ sum(n), 6) as reduction, max(n) as largest, round(avg(n), 6) as mean_size from z"
    ),
    "internal_weights": (
        f"with recursive {_M}, z as (select cluster, count(*) as size from m group by 1), w as (select a.cluster, avg(weight) as w from e join m a on a.id = src join m b on b.id = dst where a.cluster = b.cluster "
        f"group by 1) select cluster, size, round(case when size = 1 then 1 else coalesce(w, 0) end, 6) as mean_weight from z left join w using (cluster)"
    ),
    "threshold_sweep": (
        f"with {_SC}, t as (select unnest([{', '.join(map(str, THRESHOLDS))}])::double as threshold), x as (select threshold, count(*) filter (p >= threshold and y = 1) as tp, count(*) filter (p >= threshold and "
        f"y = 0) as fp, count(*) filter (p < threshold and y = 1) as fn, count(*) filter (p < threshold and y = 0) as tn from s cross join t group by 1) select *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) "
        f"as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from x"
    ),
    "ranking_scores": (
        f"with {_SC}, {_RANK.format(k='iso3', t='s')} select iso3, (max(pp) + max(nn))::bigint as n, max(pp)::bigint as n_pos, round(sum(neg * (tp - pos) + pos * neg / 2) / (max(pp) * max(nn)), 6) as roc_auc, round(sum(pos "
        f"/ pp * tp / (tp + fp)), 6) as average_precision, round(sum(pos * (p - 1) * (p - 1) + neg * p * p) / (max(pp) + max(nn)), 6) as brier, round(1 - sum(pos * (p - 1) * (p - 1) + neg * p * p) / (max(pp) + "
        f"max(nn)) / (max(pp) / (max(pp) + max(nn)) * (1 - max(pp) / (max(pp) + max(nn)))), 6) as brier_skill from h group by 1"
    ),
    "calibration_bins": f"with {_SC} select least(greatest(ceil(p * 5) - 1, 0), 4)::int as bin, round(avg(p), 6) as mean_pred, round(avg(y), 6) as mean_actual, count(*) as n from s group by 1",
    "reliability_bins": f"with {_SC} select least(floor(p * 10), 9)::int as bin, round(avg(p), 6) as mean_pred, round(avg(y), 6) as mean_actual, count(*) as n from s group by 1",
    "gain_curve": (
        f"with {_SC}, g as (select p, sum(y)::double as pos, count(*)::double as n from s group by 1), h as (select sum(n) over w / sum(n) over () as upto, sum(pos) over w / sum(pos) over () as gain from g window "
        f"w as (order by p desc)) select ceil(upto * 10)::int as step, round(max(upto), 6) as share, round(max(gain), 6) as gain, round(max(gain) / max(upto), 6) as lift from h group by 1"
    ),
    "best_models": (
        f"with {_SC}, b as (select iso3 || '/score' as k, y, p from s union all select iso3 || '/inverse', y, 1 - p from s), {_RANK.format(k='k', t='b')}, r as (select k, round(sum(pos / pp * tp / (tp + fp)), 6) "
        f"as ap from h group by 1) select split_part(k, '/', 1) as iso3, arg_min(split_part(k, '/', 2), (-ap, k)) as model, max(ap) as ap from r group by 1"
    ),
}
