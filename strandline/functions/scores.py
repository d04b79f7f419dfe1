"""Scores of pairs and records, as column expressions. A component that can't be told is NULL and leaves its weight to the rest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.geo import haversine_km

# How far a type of one list agrees with a type of the other; any other pair does not.
TYPE_AGREEMENT = {
    ("protests", "Protests"): 1.0, ("protests", "Riots"): 0.6, ("protests", "Violence against civilians"): 0.2, ("protests", "Strategic developments"): 0.1,
    ("labour_strike", "Protests"): 0.8, ("labour_strike", "Riots"): 0.4, ("labour_strike", "Strategic developments"): 0.2,
}


def known_mean(parts: list[tuple[float, Column]]) -> Column:
    """Mean by weight over the components that are known; NULL where none is."""
    on = [F.when(c.isNotNull(), F.lit(float(w))).otherwise(0.0) for w, c in parts]
    got = [F.coalesce(c.cast("double"), F.lit(0.0)) * w for w, c in parts]
    return F.try_divide(sum(got[1:], got[0]), sum(on[1:], on[0]))


def decay(gap: Column, most: float) -> Column:
    """1 at no gap, 0 from ``most`` on; NULL for an unknown gap."""
    return F.when(gap.isNotNull(), F.greatest(F.lit(0.0), 1 - F.abs(gap) / most))


def place_credit(own: Column, similarities: list[Column], missing: float = 0.3) -> Column:
    """The best similarity; a flat credit where the own place is unknown, so that time and type must carry the pair."""
    best = F.greatest(*(F.coalesce(s, F.lit(0.0)) for s in similarities)) if len(similarities) > 1 else F.coalesce(similarities[0], F.lit(0.0))
    return F.when(own.isNull() | (F.trim(own) == ""), missing).otherwise(best)


def type_agreement(own: Column, other: Column, table: dict[tuple[str, str], float] | None = None) -> Column:
    """From a table of pairs; 0 for pairs it lacks."""
    pairs = [F.lit(x) for (a, b), w in (table or TYPE_AGREEMENT).items() for x in (f"{a}\t{b}", w)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("\t", own, other)), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    """The smaller of two positive numbers by the larger; NULL where either is none."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when((x > 0) & (y > 0), F.least(x, y) / F.greatest(x, y))


def place_tier(city: tuple[Column, Column], spot: tuple[Column, Column], region: tuple[Column, Column]) -> Column:
    """1 for the same city, 0.8 for spots one of which names the other, 0.5 for the same region, else 0."""
    low = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    same = lambda p: F.coalesce(low(p[0]) == low(p[1]), F.lit(False))
    a, b = low(spot[0]), low(spot[1])
    inside = F.coalesce(F.contains(a, b) | F.contains(b, a), F.lit(False))
    return F.when(same(city), 1.0).when(inside, 0.8).when(same(region), 0.5).otherwise(0.0)


def with_day_bonus(score: Column, day_a: Column, day_b: Column, gap: Column, bonus: float = 0.1) -> Column:
    """More, up to 1, where the day numbers two reports give differ by what their dates differ, give or take a day."""
    fits = F.coalesce(F.abs(F.abs(day_a - day_b) - F.abs(gap)) <= 1, F.lit(False))
    return F.when(fits & score.isNotNull(), F.least(F.lit(1.0), score + bonus)).otherwise(score)


def trusted_edge(similarity: Column, trust_a: Column, trust_b: Column) -> Column:
    """Similarity times the root of the smaller trust."""
    return F.round(similarity * F.sqrt(F.least(F.coalesce(trust_a, F.lit(0.0)), F.coalesce(trust_b, F.lit(0.0)))), 4)


def box_span_km(lat_low: Column, lat_high: Column, lon_low: Column, lon_high: Column) -> Column:
    """Length of a bounding box's diagonal."""
    return haversine_km(lat_low, lon_low, lat_high, lon_high)


def count_yes(columns: list[str], yes: str = "yes") -> Column:
    """How many of the columns say yes, in any case."""
    on = [F.coalesce(F.lower(F.trim(c)) == yes, F.lit(False)).cast("int") for c in columns]
    return sum(on[1:], on[0])


def weighted_score(weights: dict[str, float], scale: float = 20.0) -> Column:
    """Weighted sum of columns on a common scale; a missing one counts 0."""
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()]
    return sum(parts[1:], parts[0]) * scale
