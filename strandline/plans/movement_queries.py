"""Queries that link clusters into movements, place records, and merge layers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.dates import asymmetric_tolerance
from strandline.functions.geo import haversine_km, usable_position
from strandline.functions.keys import code_key, finite
from strandline.functions.places import location_pieces, name_places
from strandline.functions.strings import location_tokens
from strandline.operators import dedupe, graph, joins, merge
from strandline.operators.spatial import nearest_point
from strandline.plans.place_problems import _POSITIONS
from strandline.plans.tables import table
from strandline.session import materialize


def _articles(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "source_articles").select("article_id", "cluster_id", F.col("event_date").cast("date").alias("day"), "subloc", "sector", "issue", "protest_type", "ingest_time")
    return dedupe.keep_last(a, ["article_id", "cluster_id"], ["ingest_time"])


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "event_clusters")
    return c.select(
        F.xxhash64("cluster_id").alias("id"), "cluster_id", "disruption_type", code_key(F.col("iso3")).alias("iso3"), F.col("event_date").cast("date").alias("start"), F.coalesce("event_end_date", "event_date").cast("date").alias("end"),
        "n_articles", finite(F.col("mean_internal_score")).alias("score"), finite(F.col("confidence_max")).alias("confidence"), location_tokens(F.col("location_name")).alias("t"), "location_name", finite(F.col("lat")).alias("lat"), finite(F.col("lon")).alias("lon"),
    )


def block_pairs(spark, d):
    """Articles of the same place, or the same sector and issue, at most a fortnight apart."""
    a = _articles(spark, d)
    low = lambda c: F.lower(F.trim(c))
    both = F.when(F.col("sector").isNotNull() & F.col("issue").isNotNull(), F.concat_ws("/", low("sector"), low("issue")))
    return joins.blocked_pairs(a, "article_id", "day", {"place": F.array(low("subloc")), "topic": F.array(both)}, 14)


def post_hoc_edges(spark, d):
    """Clusters of one type and country whose places share words: dates within a tolerance, in weeks, and near, or alike where a position is missing."""
    c = _clusters(spark, d)
    side = lambda p: c.select(F.col("cluster_id").alias(p), *(F.col(x).alias(f"{p}_{x}") for x in ("start", "lat", "lon", "n_articles")))
    p = joins.token_pairs(c, "cluster_id", "t", ["iso3", "disruption_type"], 0.3).join(side("a"), "a").join(side("b"), "b")
    kind = lambda n: F.when(F.col(n) > 2, "event").otherwise("publish")
    km = haversine_km(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    near = F.coalesce(km <= 50, F.lit(True))
    return p.where((F.abs(F.datediff("a_start", "b_start")) <= 7 * asymmetric_tolerance(kind("a_n_articles"), kind("b_n_articles"))) & near).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


def _links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Clusters, and edges between those of one country and type at most 30 days apart whose places are alike."""
    c = materialize(_clusters(spark, d), "clusters")
    p = joins.token_pairs(c, "id", "t", ["iso3", "disruption_type"], 0.6)
    day = lambda p: c.select(F.col("id").alias(p), F.col("start").alias(f"{p}_day"))
    near = p.join(day("a"), "a").join(day("b"), "b").where(F.abs(F.datediff("a_day", "b_day")) <= 30)
    return c, materialize(near.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.round("jaccard", 6).alias("weight")), "links")


def linked_movements(spark, d):
    """Movements of linked clusters with several articles, numbered by size."""
    c, e = _links(spark, d)
    m = merge.movements(c, e, graph.connected_components(e))
    name = m.join(c.select(F.col("cluster_id").alias("__c"), "iso3", "disruption_type"), F.element_at("children", 1) == F.col("__c"))
    out = dedupe.ordinal_ids(name.select("iso3", "disruption_type", "start", "end", "n_clusters", "n_articles", "mean_weight", F.array_join("children", ";").alias("children")), "n_clusters", "children", "ordinal")
    return out.withColumn("movement_id", F.concat_ws("_", "iso3", "disruption_type", F.lit("movement"), F.date_format("start", "yyyyMMdd"), F.lpad(F.col("ordinal").cast("string"), 4, "0")))


def movement_flags(spark, d):
    """Which clusters belong to a movement: membership of a list as a flag."""
    c, e = _links(spark, d)
    m = merge.movements(c, e, graph.connected_components(e))
    child = m.select(F.explode("children").alias("cluster_id")).distinct().withColumn("__in", F.lit(1))
    return c.select("cluster_id").join(child, "cluster_id", "left").select("cluster_id", F.coalesce("__in", F.lit(0)).alias("has_movement"))


def top_actors(spark, d):
    """Each cluster's five most frequent topics over several fields."""
    return merge.top_values(_articles(spark, d).where("cluster_id is not null"), "cluster_id", [F.array(F.lower(F.trim("issue")), F.lower(F.trim("sector"))), F.array(F.lower(F.trim("protest_type")))], "article_id")


def first_places(spark, d):
    """The place that the first naming piece of a record's location stands for."""
    r = table(spark, d, "extract_records").select("record_id", location_pieces(F.col("location_name")).alias("pieces"))
    g = table(spark, d, "gazetteer").select(F.lower(F.trim("place_name")).alias("name"), "place_id")
    return joins.first_match(r, "record_id", "pieces", g, "name", "place_id")


def layered_places(spark, d):
    """Places with figures of two layers that name them by the same set of names."""
    g = table(spark, d, "gazetteer").where("alt_names is not null").select("place_id", "alt_names", "admin1", F.round("latitude", 5).alias("latitude"))
    north = g.where("latitude > 0").select(F.reverse("alt_names").alias("alt_names"), (F.col("latitude") * 2).alias("north"), F.lit("x").alias("admin1"))
    even = g.where("place_id % 2 = 0").select("alt_names", F.col("place_id").alias("even"), F.upper("admin1").alias("admin1"))
    return joins.merge_layers(g, [(north, ["north"]), (even, ["even", "admin1"])], "alt_names").select("place_id", "north", "even", "admin1")


def asset_distances(spark, d):
    """The nearest port and the nearest mine of each verified event, and whether either lies within 50 km."""
    e = table(spark, d, "verified_events").groupBy("event_id_cnty").agg(F.max("latitude").alias("lat"), F.max("longitude").alias("lon"))
    e = materialize(e.where(usable_position(F.col("lat"), F.col("lon"))).withColumn("id", F.monotonically_increasing_id()), "events")
    s = table(spark, d, "sites").select(F.col("site_id").alias("id"), "asset_type", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    near = lambda kind: nearest_point(e, s.where(F.col("asset_type") == kind)).select(F.col("left_id").alias("id"), F.col("right_id").alias(kind), F.round("km", 4).alias(f"{kind}_km"))
    out = e.select("id", "event_id_cnty").join(near("port"), "id", "left").join(near("mine"), "id", "left")
    return out.select("event_id_cnty", "port", "port_km", "mine", "mine_km", F.coalesce(F.least("port_km", "mine_km") <= 50, F.lit(False)).alias("near_asset"))


def site_neighbours(spark, d):
    """Each site's nearest other site."""
    s = table(spark, d, "sites").select(F.col("site_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return nearest_point(s, s, apart=True).select(F.col("left_id").alias("site_id"), F.col("right_id").alias("neighbour"), F.round("km", 4).alias("km"))


def merged_clusters(spark, d):
    """Clusters of one country, type and month merged into the richest one's record."""
    c = _clusters(spark, d).withColumn("month", F.date_format("start", "yyyy-MM"))
    return merge.merge_clusters(c, ["iso3", "disruption_type", "month"], ["location_name", "score", "lat", "lon"], "cluster_id", "start", "n_articles", ["confidence"]).select("iso3", "disruption_type", "month", "location_name", "start", "n_articles", "confidence", "merged")


FIGURES = ["clusters", "records", "singleton_rate", "reduction", "cohesion", "longest", "mean_span"]


def cluster_figures(spark, d):
    """Quality of the clusters by type."""
    q = merge.quality_by(_clusters(spark, d), "disruption_type", "n_articles", "score", "start", "end")
    return q.select("disruption_type", *(F.round(c, 6).alias(c) for c in FIGURES))


def run_differences(spark, d):
    """How the figures change if only clusters of several articles are kept."""
    c = _clusters(spark, d)
    q = lambda x: merge.quality_by(x, "disruption_type", "n_articles", "score", "start", "end")
    return merge.differences(q(c), q(c.where("n_articles > 1")), "disruption_type").select("disruption_type", *(F.round(x, 6).alias(x) for x in FIGURES))


def arbitrated_positions(spark, d):
    """Which position of each record counts: its own, or that of the place it names."""
    r = table(spark, d, "extract_records").select("record_id", code_key(F.col("iso3")).alias("iso3"), location_pieces(F.col("location_name")).alias("pieces"), "lat", "lon", finite(F.col("confidence")).alias("confidence"))
    named = name_places(r, "record_id", "pieces", "iso3", table(spark, d, "gazetteer")).select("record_id", "g_iso3", "g_lat", "g_lon")
    ok = usable_position(F.col("lat"), F.col("lon"))
    x = r.join(named, "record_id", "left").withColumns({"lat": F.when(ok, F.col("lat")), "lon": F.when(ok, F.col("lon"))})
    p = merge.arbitrated_position((F.col("lat"), F.col("lon")), (F.col("g_lat"), F.col("g_lon")), F.lit(30.0), F.col("iso3") == F.col("g_iso3"), F.col("confidence"))
    return x.select("record_id", p.alias("p")).select("record_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"), "p.source", "p.verified", "p.rejected_km")


QUERIES = {f.__name__: f for f in (block_pairs, post_hoc_edges, linked_movements, movement_flags, top_actors, first_places, layered_places, asset_distances, site_neighbours, merged_clusters, cluster_figures, run_differences, arbitrated_positions)}

_F = lambda c: f"(case when isfinite({c}) then {c} end)"
_K = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_A = "a as (select article_id, cluster_id, r[1] as day, r[2] as subloc, r[3] as sector, r[4] as issue, r[5] as protest_type from (select article_id, cluster_id, arg_max((event_date::date, subloc, sector, issue, protest_type), ingest_time) as r from source_articles group by all))"
_TOK = r"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(location_name), '\([^)]*\)', ' ', 'g'), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) > 2))"
_C = f"c as (select cluster_id, disruption_type, {_K.format('iso3')} as iso3, event_date::date as start, coalesce(event_end_date, event_date)::date as \"end\", n_articles, {_F('mean_internal_score')} as score, {_F('confidence_max')} as confidence, {_TOK} as t, location_name, {_F('lat')} as lat, {_F('lon')} as lon from event_clusters)"
_J = "len(list_intersect(a.t, b.t)) / (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"
_L = f"""{_C}, e as (select a.cluster_id as src, b.cluster_id as dst, round({_J}, 6) as weight from c a join c b on a.iso3 = b.iso3 and a.disruption_type = b.disruption_type and a.cluster_id < b.cluster_id and abs(date_diff('day', a.start, b.start)) <= 30 where {_J} >= 0.6 - 1e-12),
u as (select src, dst from e union select dst, src from e), r(id, o) as (select src, src from u union select r.id, u.dst from r join u on r.o = u.src), k as (select id, min(o) as root from r group by 1),
m as (select root, min(start) as start, max("end") as "end", count(*) as n_clusters, sum(n_articles) as n_articles, count(*) filter (n_articles > 1) as multi, list_sort(list(cluster_id)) as children, min(iso3)
  as iso3, min(disruption_type) as disruption_type from k join c on id = cluster_id group by 1),
w as (select root, round(avg(weight), 4) as mean_weight from e join k on src = id group by 1), v as (select * from m join w using (root) where multi >= 1)"""
_HAV = "2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_Q = "count(*) as clusters, sum(n_articles) as records, count(*) filter (n_articles = 1) / count(*) as singleton_rate, 1 - count(*) / sum(n_articles) as reduction, avg(score) filter (n_articles > 1) as cohesion, max(date_diff('day', start, \"end\") + 1) as longest, avg(date_diff('day', start, \"end\") + 1) as mean_span"
_E = "e as (select event_id_cnty, max(latitude) as lat, max(longitude) as lon from verified_events group by 1), f as (select * from e where isfinite(lat) and isfinite(lon) and not (abs(lat) < 0.01 and abs(lon) < 0.01))"
SQL = {
    "block_pairs": (
        f"with {_A}, k as (select article_id, day, 'p' || lower(trim(subloc)) as key from a where trim(subloc) <> '' union select article_id, day, 't' || lower(trim(sector)) || '/' || lower(trim(issue)) from a "
        f"where sector is not null and issue is not null) select distinct x.article_id as a, y.article_id as b, abs(date_diff('day', x.day, y.day)) as gap from k x join k y on x.key = y.key and x.article_id < y.article_id "
        f"and abs(date_diff('day', x.day, y.day)) <= 14"
    ),
    "post_hoc_edges": (
        f"with {_C} select a.cluster_id as a, b.cluster_id as b, round({_J}, 6) as jaccard from c a join c b on a.iso3 = b.iso3 and a.disruption_type = b.disruption_type and a.cluster_id < b.cluster_id where {_J} "
        f">= 0.3 - 1e-12 and abs(date_diff('day', a.start, b.start)) <= 7 * case when a.n_articles > 2 and b.n_articles > 2 then 1 when a.n_articles > 2 or b.n_articles > 2 then 2 else 3 end and (a.lat + a.lon "
        f"+ b.lat + b.lon is null or {_HAV.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 50)"
    ),
    "linked_movements": (
        f"with recursive {_L}, o as (select *, row_number() over (order by n_clusters desc, array_to_string(children, ';')) as ordinal from v) select iso3, disruption_type, start, \"end\", n_clusters, n_articles, "
        f"mean_weight, array_to_string(children, ';') as children, ordinal, iso3 || '_' || disruption_type || '_movement_' || strftime(start, '%Y%m%d') || '_' || lpad(ordinal::varchar, 4, '0') as movement_id from "
        f"o"
    ),
    "movement_flags": f"with recursive {_L} select cluster_id, (cluster_id in (select unnest(children) from v))::int as has_movement from c",
    "top_actors": (
        f"with {_A}, x as (select cluster_id, article_id, unnest([lower(trim(issue)), lower(trim(sector)), lower(trim(protest_type))]) as v, unnest([0, 1, 2]) as i from a where cluster_id is not null), n as (select "
        f"cluster_id, v, count(*) as n, min((article_id, i)) as f from x where trim(v) <> '' group by all), t as (select *, row_number() over (partition by cluster_id order by n desc, f) as r from n) select cluster_id, "
        f"string_agg(v, ', ' order by r) as top from t where r <= 5 group by 1"
    ),
    "first_places": (
        f"with {_POSITIONS}, x as (select record_id, unnest(ps) as piece, generate_subscripts(ps, 1) as i from r), g as (select lower(trim(place_name)) as name, min(place_id) as place_id from gazetteer group by "
        f"1) select record_id, arg_min(place_id, i) as place_id from x join g on piece = name group by 1"
    ),
    "layered_places": (
        "with g as (select place_id, admin1, round(latitude, 5) as latitude, array_to_string(list_sort(list_distinct(alt_names)), '|') as k from gazetteer where alt_names is not null), n as (select k, max(latitude "
        "* 2) as north from g where latitude > 0 group by 1), e as (select k, max((place_id, upper(admin1))) as e from g where place_id % 2 = 0 group by 1) select g.place_id, north, e[1] as even, case when e is "
        "not null then e[2] else admin1 end as admin1 from g left join n using (k) left join e using (k)"
    ),
    "asset_distances": (
        f"with {_E}, x as (select event_id_cnty, asset_type, site_id, {_HAV.format('f.lat', 'f.lon', 's.latitude', 's.longitude')} as km from f cross join sites s), n as (select event_id_cnty, asset_type, arg_min(site_id, "
        f"(km, site_id)) as site, round(min(km), 4) as km from x group by all) select event_id_cnty, max(site) filter (asset_type = 'port') as port, max(km) filter (asset_type = 'port') as port_km, max(site) filter "
        f"(asset_type = 'mine') as mine, max(km) filter (asset_type = 'mine') as mine_km, coalesce(min(km) <= 50, false) as near_asset from n group by 1"
    ),
    "site_neighbours": (
        f"with x as (select a.site_id, b.site_id as neighbour, {_HAV.format('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} as km from sites a join sites b on a.site_id <> b.site_id) select site_id, "
        f"arg_min(neighbour, (km, neighbour)) as neighbour, round(min(km), 4) as km from x group by 1"
    ),
    "merged_clusters": (
        f"with {_C} select iso3, disruption_type, strftime(start, '%Y-%m') as month, arg_max(coalesce(location_name, '~'), ((location_name is not null)::int + (score is not null)::int + (lat is not null)::int + "
        f"(lon is not null)::int, coalesce(n_articles, 0), cluster_id)) as location_name, min(start) as start, sum(n_articles) as n_articles, max(confidence) as confidence, count(*) as merged from c group by 1, "
        f"2, 3"
    ),
    "cluster_figures": f"with {_C}, q as (select disruption_type, {_Q} from c group by 1) select disruption_type, {', '.join(f'round({x}, 6) as {x}' for x in FIGURES)} from q",
    "run_differences": (
        f"with {_C}, p as (select disruption_type, {_Q} from c group by 1), q as (select disruption_type, {_Q} from c where n_articles > 1 group by 1) select disruption_type, {', '.join(f'round(coalesce(q.{x}, 0) - coalesce(p.{x}, 0), 6) as {x}' for x in FIGURES)} "
        f"from p full join q using (disruption_type)"
    ),
    "arbitrated_positions": f"""with {_POSITIONS}, h2 as (select e.record_id, arg_max((n.latitude, n.longitude, n.iso3), (4 * coalesce((e.iso3 = n.iso3)::int, 0) + 2 * coalesce(list_contains(ps, n.country)::int, 0) +
  coalesce((len(list_filter(ps, lambda x: starts_with(x, n.admin1))) > 0)::int, 0), -n.place_id)) as g
  from (select record_id, iso3, ps, unnest(list_distinct(ps)) as piece from r) e join n on e.piece = n.name group by 1),
 x as (select record_id, case when ok then r.lat end as lat, case when ok then r.lon end as lon, g[1] as nlat, g[2] as nlon, coalesce(g[1] is not null and {_F('confidence')} >= 0.7 and {_K.format('r.iso3')} = g[3], false)
  as named from r left join h2 using (record_id) join (select record_id, confidence from extract_records) using (record_id)),
 y as (select *, case when lat is not null and nlat is not null then {_HAV.format('lat', 'lon', 'nlat', 'nlon')} end as off from x), z as (select *, coalesce(not named and off > 500, false) as far from y)
 select record_id, round(case when named then nlat when not far then lat end, 6) as lat, round(case when named then nlon when not far then lon end, 6) as lon, case when named then 'named' when lat is not null
  and not far then 'own' end as source, named or coalesce(off <= 500, false) as verified, case when far then round(off, 1) end as rejected_km from z""",
}
