"""Records and verified events that are the same happening."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.dates import read_date
from strandline.functions.geo import haversine_km, usable_position
from strandline.functions.keys import code_key, days
from strandline.functions.places import gazetteer_names, location_pieces, name_places
from strandline.llm.matching import weighted
from strandline.llm.neighbourhood import sorted_neighbours
from strandline.llm.slips import Names, similarity
from strandline.llm.spots import KINDS, spot_kind, spot_name, spot_piece
from strandline.session import materialize

DAYS = 3
#: Least similarity of two names of one spot: three letters in ten may be slips. Kilometres within one town, letters two spellings of a province may differ by.
NAME_LEAST, TOWN_KM, PROVINCE_SLIPS = 0.7, 80.0, 2
#: Weights of the similarities of name, kind, town and date.
WEIGHTS = (0.55, 0.1, 0.2, 0.15)
# Words that follow the name of a province.
PROVINCE_WORDS = ["state", "region", "province", "district", "county", "department", "governorate"]


def _keys(left: bool) -> Column:
    """Composite sort keys, so that every two rows of one country meet unless both name towns, none in common.

    Rows that name towns meet under (country, town). Where either names none they meet under (country, kind), and where
    also a kind is unknown under the country alone, or under every kind. A digit tells which side lacks what, so that two rows meet in one way only.
    """
    c, town, kind = F.col, F.size("towns") > 0, F.col("kind").isNotNull()
    key = lambda n, *more: F.concat_ws("|", c("iso3"), F.lit(str(n)), *more)
    towns = F.transform("towns", lambda t: key(0, t.cast("string")))
    if left:
        rest = F.when(town & kind, F.array(key(2, c("kind")))).when(town, F.array(key(5))).when(kind, F.array(key(1, c("kind")), key(4))).otherwise(F.array(key(3)))
    else:
        every = F.array(*(key(2, F.lit(k)) for k in KINDS), key(5))
        townless = F.when(town, F.array().cast("array<string>")).when(kind, F.array(key(2, c("kind")), key(5))).otherwise(every)
        rest = F.concat(F.when(kind, F.array(key(1, c("kind")), key(3))).otherwise(F.array(key(3), key(4))), townless)
    return F.when(c("iso3").isNotNull(), F.concat(towns, rest))


def _spots(rows: DataFrame, left: bool) -> DataFrame:
    """id, day, name, kind, keys and near of rows(id, iso3, day, towns, piece, near) whose piece names a spot."""
    s = rows.where("piece is not null").select("id", "iso3", "day", "towns", "near", spot_name(F.col("piece")).alias("name"), spot_kind(F.col("piece")).alias("kind")).where("name is not null")
    return s.select("id", "day", "name", "near", F.when(F.col("kind").isNull(), 0).otherwise(F.xxhash64("kind")).alias("sort"), _keys(left).alias("keys"))


def _records(records: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Spots of the records. One pass over their pieces finds the towns they name, the country where no code is given,
    and, where no piece has a word for a kind, the first that is the name of no place, province or country.
    """
    c = F.col
    r = records.select(
        c("record_id").alias("id"), code_key(c("iso3")).alias("iso3"), location_pieces(c("location_name")).alias("pieces"),
        days(F.coalesce(read_date(c("event_date")), read_date(c("publish_date")))).alias("day"), F.coalesce(F.contains(F.lower("location_name"), F.lit("near ")), F.lit(False)).alias("near"),
    ).where("id is not null and day is not null")
    each = r.select("id", "iso3", "day", "near", spot_piece(c("pieces")).alias("spot"), F.when(c("iso3").isNull(), c("pieces")).alias("all"), F.posexplode("pieces").alias("at", "piece"))
    names = gazetteer_names(gazetteer)
    none = [F.lit(None).cast(t).alias(n) for n, t in names.dtypes if n not in ("name", "g_country", "g_admin1")]
    wide = F.explode(F.concat(F.array("g_country", "g_admin1"), *(F.array(F.concat("g_admin1", F.lit(f" {w}"))) for w in PROVINCE_WORDS))).alias("name")
    other = names.select(wide).where("name is not null").distinct().select("name", *none, F.lit(None).cast("string").alias("g_country"), F.lit(None).cast("string").alias("g_admin1"))
    hit = each.join(names.unionByName(other), c("piece") == c("name"), "left")
    yes = lambda x: F.coalesce(x.cast("int"), F.lit(0))
    score = 2 * yes(F.array_contains("all", c("g_country"))) + yes(F.exists("all", lambda p: c("g_admin1").isNotNull() & p.startswith(c("g_admin1"))))
    found = hit.groupBy("id", "iso3", "day", "near", "spot").agg(
        F.collect_set("place_id").alias("towns"), F.max_by("g_iso3", F.when(c("place_id").isNotNull(), F.struct(score, -c("place_id")))).alias("named"), F.min_by("piece", F.when(c("name").isNull(), c("at"))).alias("free")
    )
    return _spots(found.select("id", F.coalesce("iso3", "named").alias("iso3"), "day", "towns", "near", F.coalesce("spot", "free").alias("piece")), True)


def _events(events: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Each id once, in its latest delivery, with all names of its town where it names one."""
    cols = ["event_date", "iso3", "admin1", "admin2", "location", "latitude", "longitude"]
    e = events.where("event_id_cnty is not null").groupBy("event_id_cnty").agg(F.max_by(F.struct(*cols), F.struct("ingest_time", *cols)).alias("e")).select(F.col("event_id_cnty").alias("id"), "e.*")
    own = location_pieces(F.col("location"))
    none = F.array().cast("array<string>")
    e = e.select(
        "id", days(F.col("event_date")).alias("day"), code_key(F.col("iso3")).alias("iso3"), F.lower("admin1").alias("admin1"), own.alias("own"),
        F.concat(F.coalesce(own, none), F.coalesce(location_pieces(F.col("admin2")), none)).alias("pieces"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
    )
    e = materialize(e, "events")
    towns = name_places(e, "id", "pieces", "iso3", gazetteer).select("id", "place_id")
    names = gazetteer_names(gazetteer).groupBy("place_id").agg(F.collect_set("name").alias("town"))
    return materialize(e.join(towns, "id", "left").join(names, "place_id", "left").drop("pieces"), "towns")


def _compare(l: pd.DataFrame, r: pd.DataFrame):
    """Similarity of the names, unless both kinds are known and differ.

    A word "near" before a place is no part of its name as a rule, but may be a slip of a name's first word: rows with one are compared both ways.
    """
    a, b, ls, rs = Names(l.name.tolist()), Names(r.name.tolist()), l["sort"].to_numpy(), r["sort"].to_numpy()
    near = l["near"].to_numpy(bool)
    whole = Names([f"near{n}" if k else "" for n, k in zip(l.name, near, strict=True)])

    def similar(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i))
        ok = np.flatnonzero((ls[i] == rs[j]) | (ls[i] == 0) | (rs[j] == 0))
        out[ok] = similarity(a, b, i[ok], j[ok], NAME_LEAST)
        two = ok[near[i[ok]]]
        out[two] = np.maximum(out[two], similarity(whole, b, i[two], j[two], NAME_LEAST))
        return out

    return similar


def same_happenings(records: DataFrame, events: DataFrame, gazetteer: DataFrame, days: int = DAYS) -> DataFrame:
    """(record_id, event_id_cnty, confidence): records and events at the same spot of the same town within ``days``.

    Sorted neighbourhood over the composite keys (country, town, date), (country, kind of spot, date) and (country, date): the
    coarser ones for rows that name no town, or a spot of no known kind. No letters of the name are in a key, so slips anywhere in both
    names lose no pair. Compared are name (letters changed, added, dropped or swapped), kind, town and date. Kinds or towns that contradict each
    other rule a pair out; where a side names no town, distance decides; without
    positions an equal province speaks for a pair, a missing one not against it. Only narrow rows are sorted; the
    places' text joins the few pairs left. Records without any date or country, or whose
    place names no spot, match nothing. A repeated record_id counts as all its rows, and a pair comes out once, with its largest confidence.
    """
    c = F.col
    e = _events(events, gazetteer)
    other = F.try_element_at(F.filter("own", lambda p: ~F.coalesce(F.array_contains("town", p), F.lit(False))), F.lit(1))
    towns = F.when(c("place_id").isNotNull(), F.array("place_id")).otherwise(F.array().cast("array<long>"))
    right = _spots(e.select("id", "iso3", "day", F.lit(False).alias("near"), towns.alias("towns"), F.coalesce(spot_piece(c("own")), other).alias("piece")), False)
    near = sorted_neighbours(_records(records, gazetteer), right, days, _compare)
    near = near.join(e.select(c("id").alias("r_id"), "own", "town", "admin1", "lat", "lon"), "r_id")
    near = near.join(records.select(c("record_id").alias("l_id"), "location_name", c("lat").alias("l_lat"), c("lon").alias("l_lon")), "l_id").withColumn("l_pieces", location_pieces(c("location_name")))
    both = usable_position(c("l_lat"), c("l_lon")) & usable_position(c("lat"), c("lon"))
    slips = lambda p: F.levenshtein(p, c("admin1"), PROVINCE_SLIPS)  # -1 beyond
    province = F.when(c("admin1").isNotNull(), F.exists("l_pieces", lambda p: slips(p) >= 0))
    named = F.coalesce(F.arrays_overlap("l_pieces", "town"), F.lit(False))
    town = F.when(named, F.lit(1.0)).when(both, (haversine_km(c("l_lat"), c("l_lon"), c("lat"), c("lon")) <= TOWN_KM).cast("double")).when(province, F.lit(1.0))
    kind = lambda pieces: spot_kind(spot_piece(pieces))
    near = near.withColumns({"l_kind": kind(c("l_pieces")), "r_kind": kind(c("own"))})
    s_kind = F.when(c("l_kind").isNotNull() & c("r_kind").isNotNull(), (c("l_kind") == c("r_kind")).cast("double"))
    scored = near.withColumns({"s_kind": s_kind, "s_town": town, "s_date": 1 - F.abs("gap") / (days + 1)}).where(F.coalesce(c("s_town") > 0, F.lit(True)))
    sims = [c("similarity"), c("s_kind"), c("s_town"), c("s_date")]
    out = scored.select(c("l_id").alias("record_id"), c("r_id").alias("event_id_cnty"), weighted(list(zip(WEIGHTS, sims, strict=True))).alias("confidence"))
    return out.groupBy("record_id", "event_id_cnty").agg(F.max("confidence").alias("confidence"))
