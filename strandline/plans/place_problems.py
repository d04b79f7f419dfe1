"""Queries on positions: sites near records, regions around records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.geo import usable_position
from strandline.functions.places import country_codes, location_pieces, name_places, sublocation
from strandline.operators.spatial import in_regions, near_points, nearest_point
from strandline.plans.tables import table
from strandline.session import materialize

NEAR_KM = 25.0


def positions(spark: SparkSession, d: str) -> DataFrame:
    """(id, lat, lon) of each record: its own usable coordinates, else those of the place it names."""
    r = table(spark, d, "extract_records").select("record_id", "lat", "lon", "location_name", "iso3")
    ok = usable_position(F.col("lat"), F.col("lon"))
    own = r.where(ok).select(F.col("record_id").alias("id"), "lat", "lon")
    named = r.where(~ok).select("record_id", location_pieces(F.col("location_name")).alias("pieces"), "iso3")
    placed = name_places(named, "record_id", "pieces", "iso3", table(spark, d, "gazetteer"))
    return own.unionByName(placed.select(F.col("record_id").alias("id"), F.col("g_lat").alias("lat"), F.col("g_lon").alias("lon")))


def p4_near(spark: SparkSession, d: str) -> DataFrame:
    """Sites at most 25 km from each record, with the distance."""
    sites = table(spark, d, "sites").select(F.col("site_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    return near_points(materialize(positions(spark, d), "positions"), sites, NEAR_KM).select(F.col("left_id").alias("record_id"), F.col("right_id").alias("site_id"), "km")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_near(spark, d).select("record_id", "site_id")


def p4_regions(spark: SparkSession, d: str) -> DataFrame:
    """Records inside the box, half a degree wider than its places, of each province."""
    g = table(spark, d, "gazetteer").groupBy("iso3", "admin1").agg(
        F.min("place_id").alias("id"), (F.min("latitude") - 0.5).alias("a"), (F.max("latitude") + 0.5).alias("b"), (F.min("longitude") - 0.5).alias("c"), (F.max("longitude") + 0.5).alias("e")
    )
    rings = g.select("id", F.array("a", "a", "b", "b").alias("lats"), F.array("c", "e", "e", "c").alias("lons"))
    return in_regions(materialize(positions(spark, d), "positions"), rings).select(F.col("left_id").alias("record_id"), F.col("right_id").alias("region_id"))


def nearest_sites(spark: SparkSession, d: str) -> DataFrame:
    """The nearest site of each verified event, however far."""
    e = table(spark, d, "verified_events").groupBy("event_id_cnty").agg(F.max("latitude").alias("lat"), F.max("longitude").alias("lon"))
    e = materialize(e.where(usable_position(F.col("lat"), F.col("lon"))).withColumn("id", F.monotonically_increasing_id()), "events")
    sites = table(spark, d, "sites").select(F.col("site_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    near = nearest_point(e, sites)
    return near.join(e, F.col("left_id") == F.col("id")).select("event_id_cnty", F.col("right_id").alias("site_id"), F.round("km", 4).alias("km"))


def record_countries(spark: SparkSession, d: str) -> DataFrame:
    """Country and sub-location that a record's place name gives."""
    r = table(spark, d, "extract_records").select("record_id", location_pieces(F.col("location_name")).alias("pieces"))
    codes = country_codes(r, "record_id", "pieces", table(spark, d, "gazetteer"))
    return r.join(codes, "record_id", "left").select("record_id", "iso3", sublocation(F.col("pieces")).alias("subloc"))


QUERIES = {"nearest_sites": nearest_sites, "record_countries": record_countries, "p4_found": p4_found, "p4_near": p4_near, "p4_regions": p4_regions}

_POSITIONS = r"""r as (select record_id, upper(trim(iso3)) as iso3, coalesce(isfinite(lat) and isfinite(lon) and lat between -90 and 90 and lon between -180 and 180 and not (abs(lat) < 0.01 and abs(lon) < 0.01), false) as ok, lat, lon,
 list_transform(list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(location_name), '[\[\]"\s_]+', ' ', 'g'), '[,();]| - '), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), '^near ', '')), lambda x: x <> ''), lambda x: x)
  as ps from extract_records),
n as (select place_id, upper(trim(iso3)) as iso3, lower(trim(country)) as country, lower(trim(admin1)) as admin1, latitude, longitude, unnest(list_distinct(list_transform(list_prepend(place_name, coalesce(alt_names, [])), lambda x: lower(trim(x))))) as name from gazetteer),
e as (select record_id, iso3, ps, unnest(list_distinct(ps)) as piece from r where not ok),
h as (select e.record_id, arg_max((n.latitude, n.longitude), (4 * coalesce((e.iso3 = n.iso3)::int, 0) + 2 * coalesce(list_contains(ps, n.country)::int, 0) + coalesce((len(list_filter(ps, lambda x: starts_with(x, n.admin1))) > 0)::int, 0), -n.place_id))
  as g from e join n on e.piece = n.name group by 1),
pos as (select record_id, lat, lon from r where ok union all select record_id, g[1], g[2] from h)"""
_LOC = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(lower(location_name), '[\[\]\"\s_]+', ' ', 'g'), '[,();]| - '), lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), '^near ', '')), lambda x: x <> '')"
SQL = {
    "nearest_sites": (
        "with e as (select event_id_cnty, max(latitude) as lat, max(longitude) as lon from verified_events group by 1), x as (select event_id_cnty, site_id, 2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(latitude "
        "- lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2)))) as km from e cross join sites where isfinite(lat) and isfinite(lon)) select event_id_cnty, arg_min(site_id, "
        "(km, site_id)) as site_id, round(min(km), 4) as km from x group by 1"
    ),
    "record_countries": (
        f"with r as (select record_id, {_LOC} as ps from extract_records), e as (select record_id, unnest(ps) as piece, generate_subscripts(ps, 1) as i from r), n as (select lower(trim(country)) as name, min(upper(trim(iso3))) "
        f"as iso3 from gazetteer where country is not null group by 1), c as (select record_id, arg_max(iso3, i) as iso3 from e join n on piece = name group by 1) select record_id, iso3, case when len(ps) >= 3 "
        f"then ps[3] else ps[2] end as subloc from r left join c using (record_id)"
    ),
    "p4_found": f"with {_POSITIONS} select record_id, site_id from pos join sites on 2 * 6371 * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))) <= 25",
    "p4_near": (
        f"with {_POSITIONS} select record_id, site_id, 2 * 6371 * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))) as "
        f"km from pos join sites on 2 * 6371 * asin(sqrt(pow(sin(radians(latitude - lat) / 2), 2) + cos(radians(lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - lon) / 2), 2))) <= 25"
    ),
    "p4_regions": (
        f"with {_POSITIONS}, g as (select min(place_id) as region_id, min(latitude) - 0.5 as a, max(latitude) + 0.5 as b, min(longitude) - 0.5 as c, max(longitude) + 0.5 as e from gazetteer group by iso3, admin1) "
        f"select record_id, region_id from pos join g on lat between a and b and lon between c and e"
    ),
}
