"""Free-form place names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def location_pieces(c: Column) -> Column:
    """The parts of a free-form or JSON-list place name: lower case, single spaces, in order."""
    flat = F.regexp_replace(F.lower(c), r'[\[\]"\s_\u00a0]+', " ")
    parts = F.split(flat, r"[,();]| - ")
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"^[ .]+|[ .]+$", ""), r"^near ", ""))
    return F.filter(clean, lambda p: p != "")


def gazetteer_names(gazetteer: DataFrame) -> DataFrame:
    """(name, place_id, iso3, country, admin1, latitude, longitude): a row per name of each place."""
    names = F.array_distinct(F.transform(F.concat(F.array("place_name"), F.coalesce("alt_names", F.array().cast("array<string>"))), lambda n: F.lower(F.trim(n))))
    return gazetteer.select(
        F.explode(names).alias("name"), "place_id", F.upper(F.trim("iso3")).alias("g_iso3"), F.lower(F.trim("country")).alias("g_country"),
        F.lower(F.trim("admin1")).alias("g_admin1"), F.col("latitude").alias("g_lat"), F.col("longitude").alias("g_lon"),
    ).where("name is not null and name <> ''")


def name_places(rows: DataFrame, key: str, pieces: str, iso3: str | None, gazetteer: DataFrame) -> DataFrame:
    """(key, place_id, g_*): the gazetteer place that a row's pieces name.

    A name of several places goes to the one whose country code, country or province the row also
    gives; what remains level goes to the smallest place_id. Rows that name no place give no row.
    """
    code = F.upper(F.trim(F.col(iso3))) if iso3 else F.lit(None).cast("string")
    each = rows.select(F.col(key).alias("__key"), F.col(pieces).alias("__all"), code.alias("__iso3"), F.explode(F.array_distinct(pieces)).alias("__piece"))
    hit = each.join(gazetteer_names(gazetteer), F.col("__piece") == F.col("name"))
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    score = 4 * yes(F.col("__iso3") == F.col("g_iso3")) + 2 * yes(F.array_contains("__all", F.col("g_country"))) + yes(F.exists("__all", lambda p: F.col("g_admin1").isNotNull() & p.startswith(F.col("g_admin1"))))
    best = F.max_by(F.struct("place_id", "g_iso3", "g_country", "g_admin1", "g_lat", "g_lon"), F.struct(score, -F.col("place_id"))).alias("g")
    return hit.groupBy("__key").agg(best).select(F.col("__key").alias(key), "g.*")


def sublocation(pieces: Column) -> Column:
    """The third piece where there are three or more, else the second; NULL for a single one."""
    return F.when(F.size(pieces) >= 3, F.try_element_at(pieces, F.lit(3))).otherwise(F.try_element_at(pieces, F.lit(2)))


def country_codes(rows: DataFrame, key: str, pieces: str, gazetteer: DataFrame) -> DataFrame:
    """(key, iso3): the country of the last piece, from the right, that names one."""
    names = gazetteer.select(F.lower(F.trim("country")).alias("name"), F.upper(F.trim("iso3")).alias("iso3")).where("name is not null").groupBy("name").agg(F.min("iso3").alias("iso3"))
    each = rows.select(F.col(key).alias("__key"), F.posexplode(pieces).alias("__pos", "__piece"))
    return each.join(names, F.col("__piece") == F.col("name")).groupBy("__key").agg(F.max_by("iso3", "__pos").alias("iso3")).withColumnRenamed("__key", key)
