"""Text column expressions: trimming, HTML heads, phrases of duration, lenient flags."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words of phrases.
CARDINALS = dict(zip("one two three four five six seven eight nine ten eleven twelve".split(), range(1, 13), strict=True)) | {"a": 1, "an": 1}
ORDINALS = dict(zip("first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth".split(), range(1, 13), strict=True))
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def truncate(c: Column, n: int) -> Column:
    return F.substring(F.trim(c), 1, n)


def ellipsis(c: Column, n: int) -> Column:
    """At most n characters; what is cut ends in three points."""
    return F.when(F.length(c) > n, F.concat(F.rtrim(F.substring(c, 1, n - 3)), F.lit("..."))).otherwise(c)


def squeezed(c: Column) -> Column:
    """Any run of white space, no-break spaces included, as one space."""
    return F.trim(F.regexp_replace(c, r"[\s\u00a0]+", " "))


def html_title(html: Column) -> Column:
    return F.nullif(squeezed(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_meta(html: Column, names: list[str]) -> Column:
    """The first non-blank content of the meta tags in order of ``names``, attributes in either order."""
    found = []
    for n in names:
        for p in (rf"(?is)<meta[^>]+(?:name|property)\s*=\s*[\"']{n}[\"'][^>]*content\s*=\s*[\"']([^\"']*)", rf"(?is)<meta[^>]+content\s*=\s*[\"']([^\"']*)[\"'][^>]*(?:name|property)\s*=\s*[\"']{n}[\"']"):
            found.append(F.nullif(squeezed(F.regexp_extract(html, p, 1)), F.lit("")))
    return F.coalesce(*found)


def meta_description(html: Column) -> Column:
    return html_meta(html, ["description", "og:description", "twitter:description"])


def html_text(html: Column) -> Column:
    """Text without scripts, styles and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return squeezed(F.regexp_replace(bare, r"(?s)<[^>]*>", " "))


def looks_like_xml(content_type: Column, head: Column) -> Column:
    """By the content type it is served as, or by how it begins."""
    said = F.coalesce(F.lower(content_type).rlike("xml|rss|atom"), F.lit(False))
    return said | F.coalesce(F.substring(head, 1, 300).rlike(r"(?i)^\s*<(\?xml|rss|feed|sitemapindex|urlset)"), F.lit(False))


def garbage(c: Column, patterns: list[str], least: int = 15) -> Column:
    """NULL, shorter than ``least`` or holding any of the patterns (lower-case literals)."""
    low = F.trim(F.lower(c))
    bad = F.coalesce(F.length(low) < least, F.lit(True))
    for p in patterns:
        bad = bad | F.coalesce(F.contains(low, F.lit(p.lower())), F.lit(True))
    return bad


def build_text(title: Column, description: Column, fallback: Column, patterns: list[str]) -> Column:
    """"Title. Description", or the fallback where that is garbage."""
    both = squeezed(F.concat_ws(". ", F.nullif(F.trim(title), F.lit("")), F.nullif(F.trim(description), F.lit(""))))
    return F.when(garbage(both, patterns), fallback).otherwise(both)


def location_tokens(c: Column) -> Column:
    """Distinct words of letters longer than two, without what is in parentheses."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(c), r"\([^)]*\)", " "), r"[^a-z]+", " ")
    return F.array_distinct(F.filter(F.split(flat, " "), lambda t: F.length(t) > 2))


def words_without(c: Column, stop: list[str]) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1)), F.array(*(F.lit(s) for s in stop)))


def in_parentheses(c: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(c, r"\(([^)]+)\)", 1)), F.lit(""))


def last_part(c: Column, sep: str = ";") -> Column:
    return F.trim(F.element_at(F.split(c, sep), -1))


def to_flag(c: Column) -> Column:
    """1 for true, 1, yes, y, t in any case; 0 for anything else, NULL included."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("true", "1", "1.0", "yes", "y", "t"), F.lit(False)).cast("int")


def _number(word: Column, table: dict[str, int]) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    digits = F.regexp_extract(word, r"^(\d{1,6})", 1)
    return F.coalesce(F.try_element_at(F.create_map(*pairs), word), F.nullif(digits, F.lit("")).cast("int"))


def explicit_days(c: Column) -> Column:
    """Days of a phrase such as "10-day", "two weeks", "for a month"; NULL where there is none."""
    p = rf"\b(\d{{1,4}}|{'|'.join(CARDINALS)})[\s-]+(day|week|month|year)s?\b"
    low = F.lower(c)
    n, unit = _number(F.regexp_extract(low, p, 1), CARDINALS), F.regexp_extract(low, p, 2)
    return n * F.try_element_at(F.create_map(*(F.lit(x) for kv in UNIT_DAYS.items() for x in kv)), unit)


def day_number(c: Column) -> Column:
    """Which day of an event a text reports: "entered its Nth day", then "day N", "Nth day", "Nth week" (times seven)."""
    nth = rf"(\d{{1,3}}(?:st|nd|rd|th)|{'|'.join(ORDINALS)})"
    low = F.lower(c)
    entered = _number(F.regexp_extract(low, rf"entered (?:its|their|the) {nth} day", 1), ORDINALS)
    bare = F.nullif(F.regexp_extract(low, r"\bday (\d{1,3})\b", 1), F.lit("")).cast("int")
    day = _number(F.regexp_extract(low, rf"\b{nth} day\b", 1), ORDINALS)
    week = _number(F.regexp_extract(low, rf"\b{nth} (?:straight |consecutive )?week\b", 1), ORDINALS) * 7
    return F.coalesce(entered, bare, day, week)


def json_object(c: Column) -> Column:
    """From the first brace to the last, whatever fences stand around."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def joined_text(*parts: Column) -> Column:
    """The non-blank parts with bars between them."""
    return F.array_join(F.filter(F.array(*(F.trim(p) for p in parts)), lambda p: p.isNotNull() & (p != "")), " | ")


# Frequent pairs of UTF-8 read as Windows-1252, and what they stand for.
MOJIBAKE = {"â€™": "’", "â€œ": "“", "â€“": "–", "Ã©": "é", "Ã¨": "è", "Ã¡": "á", "Ã³": "ó", "Ã±": "ñ", "Ã§": "ç", "Ã£": "ã", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Ãª": "ê", "Ã´": "ô", "Ãº": "ú", "Ã­": "í"}


def demojibake(c: Column) -> Column:
    """The known pairs replaced."""
    for bad, good in MOJIBAKE.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return c


def _indel(a: str, b: str) -> float:
    """2 x longest common subsequence / lengths, by bit-parallel steps."""
    if not a and not b:
        return 1.0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | 1 << i
    s = (1 << len(a)) - 1
    for ch in b:
        u = s & masks.get(ch, 0)
        s = (s + u | s - u) & (1 << len(a)) - 1
    return 2 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Similarity of two texts as sets of words, 0 to 1; 0 if either has none."""
    x, y = set((a or "").lower().split()), set((b or "").lower().split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    only_x, only_y = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not only_x or not only_y):
        return 1.0
    left, right = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    return max(_indel(left, right), *((_indel(both, left), _indel(both, right)) if both else (0.0,)))


def fuzzy_similarity(a: Column, b: Column) -> Column:
    """token_set_ratio in Arrow batches."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in parts:
            yield pd.Series([token_set_ratio(p, q) for p, q in zip(x, y, strict=True)])

    return run(a, b)


# Short names of countries in free text, and what they stand for, in the order they are replaced.
COUNTRY_NAMES = [
    (r"\bU\.S\.A\.?\b", "United States"), (r"\bUSA\b", "United States"), (r"\bU\.S\.\b", "United States"), (r"\bUS\b(?!\s+[A-Z]{2}\b)", "United States"),
    (r"\bU\.K\.?\b", "United Kingdom"), (r"\bUK\b", "United Kingdom"), (r"\bDR\.?\s*Congo\b", "Democratic Republic of the Congo"), (r"\bDRC\b", "Democratic Republic of the Congo"),
]


def country_names(c: Column) -> Column:
    """Short names of countries written out."""
    for pattern, name in COUNTRY_NAMES:
        c = F.regexp_replace(c, f"(?i){pattern}", name)
    return c


def slug(c: Column) -> Column:
    """A keyword as a column's name: lower case, runs of anything else as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def feature_name(c: Column) -> Column:
    """A model's feature without the prefix of its transformer."""
    return F.regexp_replace(c, r"^(num|fe|cat|remainder)__", "")


# Named character references and what they stand for; the ampersand comes last, so nothing is read twice.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "hellip": "…", "eacute": "é", "amp": "&"}


def unescape(c: Column) -> Column:
    """Character references as characters: decimal and hexadecimal numbers, and the common names. Others stay."""

    def number(part: Column) -> Column:
        decimal, hexa = F.regexp_extract(part, r"^(\d{1,6});", 1), F.regexp_extract(part, r"^[xX]([0-9A-Fa-f]{1,5});", 1)
        code = F.when(decimal != "", F.conv(decimal, 10, 16)).when(hexa != "", F.upper(hexa))
        known = F.when(F.conv(code, 16, 10).cast("long").between(9, 0xD7FF), code)
        char = F.decode(F.unhex(F.lpad(known, 8, "0")), "UTF-32")
        return F.when(known.isNull(), F.concat(F.lit("&#"), part)).otherwise(F.concat(char, F.regexp_replace(part, r"^[xX]?[0-9A-Fa-f]{1,6};", "")))

    parts = F.split(c, "&#")
    out = F.when(F.contains(c, F.lit("&#")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, 1_000_000), number), ""))).otherwise(c)
    for name, char in ENTITIES.items():
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def redecoded(c: Column) -> Column:
    """UTF-8 that was read as Latin-1, where the whole text can be read as such; other text stays."""
    broken = c.rlike("[\u00c2\u00c3][\u0080-\u00bf]") & ~c.rlike("[^\u0000-\u00ff]")
    return F.when(broken, F.coalesce(F.try_validate_utf8(F.encode(F.when(broken, c), "ISO-8859-1").cast("string")), c)).otherwise(c)


def fixed_text(c: Column) -> Column:
    """A title or description as meant: references, then encodings, then white space."""
    return squeezed(demojibake(redecoded(unescape(c))))
