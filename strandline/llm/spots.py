"""Names of spots within a town: a proper name and, as a rule, a kind, in any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common kinds of spots with their usual abbreviations. A kind helps to tell a spot from a town; it is no condition.
KINDS = {
    "airport": ["airport", "apt"], "avenue": ["avenue", "ave"], "boulevard": ["boulevard", "blvd"], "bridge": ["bridge", "brdg"], "building": ["building", "bldg"], "campus": ["campus"],
    "court": ["court"], "dam": ["dam"], "depot": ["depot", "dep"], "embassy": ["embassy"], "factory": ["factory"], "harbour": ["harbour", "harbor"], "highway": ["highway", "hwy"],
    "hospital": ["hospital", "hosp"], "junction": ["junction", "jct"], "market": ["market", "mkt"], "mine": ["mine"], "mosque": ["mosque"], "park": ["park"], "plant": ["plant"], "plaza": ["plaza"],
    "prison": ["prison"], "refinery": ["refinery", "refin"], "road": ["road", "rd"], "school": ["school"], "square": ["square", "sq"], "stadium": ["stadium"], "station": ["station", "stn"],
    "street": ["street", "st"], "temple": ["temple"], "terminal": ["terminal", "term"], "university": ["university", "univ"],
}
WORDS = {w: kind for kind, words in KINDS.items() for w in words}


def _end(piece: Column, n: int) -> Column:
    """The first (1) or last (-1) word, without a point at its end."""
    return F.rtrim(F.substring_index(piece, " ", n), F.lit("."))


def spot_piece(pieces: Column) -> Column:
    """The first piece of two words or more that ends, or begins, with a kind of spot."""
    kinds = list(WORDS)
    return F.try_element_at(F.filter(pieces, lambda p: F.contains(p, F.lit(" ")) & (_end(p, -1).isin(kinds) | _end(p, 1).isin(kinds))), F.lit(1))


def spot_kind(piece: Column) -> Column:
    """The kind that a piece's last word, else its first, stands for; NULL where there is none, or no other word."""
    table = F.create_map(*(F.lit(x) for kv in WORDS.items() for x in kv))
    kind = F.coalesce(F.try_element_at(table, _end(piece, -1)), F.try_element_at(table, _end(piece, 1)))
    return F.when(F.contains(piece, F.lit(" ")), kind)


def spot_name(piece: Column) -> Column:
    """The proper name without its kind, letters and digits only."""
    kinds, last, first = list(WORDS), F.substring_index(piece, " ", -1), F.substring_index(piece, " ", 1)
    n = F.length(piece)
    bare = F.when(~F.contains(piece, F.lit(" ")), piece).when(_end(piece, -1).isin(kinds), F.substring(piece, F.lit(1), n - F.length(last)))
    bare = bare.when(_end(piece, 1).isin(kinds), F.substring(piece, F.length(first) + 1, n)).otherwise(piece)
    return F.nullif(F.regexp_replace(bare, r"[^\p{L}\p{N}]", ""), F.lit(""))
