"""Predicates with reasons."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import urls as U
from strandline.functions.keys import let


def first_hit(text: Column, words: list[str]) -> Column:
    """The first word of the list, in the list's order, that occurs anywhere in the text."""
    return F.try_element_at(F.filter(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w)), F.lit(1))


def url_reason(url: Column, extensions: list[str], sections: list[str], keywords: list[str], strict_tokens: bool = False) -> Column:
    """Why a URL is not relevant, or NULL: no http address, bad extension, section, keyword, in this order.

    Keywords match anywhere in the decoded address with hyphens as spaces, so short ones also match inside words;
    ``strict_tokens`` asks for whole words. NULL URLs are not relevant either; what cannot be parsed is kept.
    """
    def reason(u: Column) -> Column:
        path, text = F.lower(U.unquote(U.url_path(u))), U.search_text(u)
        ext = F.lit(False) if not extensions else path.rlike(rf"\.({'|'.join(map(re.escape, extensions))})$")
        sec = F.lit(False) if not sections else path.rlike(rf"/({'|'.join(map(re.escape, sections))})(/|$)")
        pad = F.concat(F.lit(" "), F.regexp_replace(text, r"[^a-z0-9]+", " "), F.lit(" "))
        hit = let(pad, lambda t: first_hit(t, [f" {w} " for w in keywords])) if strict_tokens else let(text, lambda t: first_hit(t, keywords))
        no_http = ~F.coalesce(u.rlike(r"^(?i)https?://"), F.lit(False))
        return F.when(no_http, "not http").when(ext, "extension").when(sec, "section").otherwise(F.concat(F.lit("keyword: "), F.trim(hit)))

    return let(U.stripped(url), reason)


def matches_list(c: Column, patterns: list[str]) -> Column:
    """Equal to a pattern, or starting with one that ends in ``*``."""
    out = F.lit(False)
    for p in patterns:
        out = out | (F.startswith(c, F.lit(p[:-1])) if p.endswith("*") else c == p)
    return out


def selected(c: Column, text: Column, allow: list[str], deny: list[str], keywords: list[str]) -> Column:
    """Allowed by name or by a keyword in the text, and not denied."""
    word = text.rlike("(?i)" + "|".join(map(re.escape, keywords))) if keywords else F.lit(False)
    return ~matches_list(c, deny) & (c.isin(allow) | F.coalesce(word, F.lit(False)))


def level(c: Column, bounds: list[float], names: list[str]) -> Column:
    """The name of the first bound a number lies below, else the last name."""
    out = F.when(c < bounds[0], names[0])
    for b, n in zip(bounds[1:], names[1:], strict=False):
        out = out.when(c < b, n)
    return out.otherwise(names[-1])


def date_between(c: Column, low: str, high: str) -> Column:
    """Closed range of ISO dates as text, compared as text: NULL and blank are outside."""
    return F.coalesce(c.between(low, high), F.lit(False))


def within_buffer(c: Column, low: str, high: str, days: int = 21) -> Column:
    """Whether a date lies in the closed range, or up to ``days`` days outside it."""
    return F.coalesce(c.between(F.date_sub(F.lit(low).cast("date"), days), F.date_add(F.lit(high).cast("date"), days)), F.lit(False))


def confident(c: Column, least: float = 0.6) -> Column:
    """NULL and NaN count as 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)) >= least


def without_any(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Rows of the groups in which ``column`` is NULL throughout. NULL keys are a group."""
    empty = df.groupBy(*(F.col(k).alias(f"__e_{k}") for k in keys)).agg(F.count(column).alias("__n")).where("__n = 0").drop("__n")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__e_{k}"))
    return df.join(empty, on, "left_semi")


def agreement(a: Column, b: Column) -> Column:
    """Whether two sources agree; a missing one disagrees."""
    return F.coalesce(a == b, F.lit(False))


def columns_like(df: DataFrame, prefix: str = "", suffix: str = "", pattern: str = "") -> list[str]:
    """Names of the columns that begin, end and match so."""
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix) and re.search(pattern, c)]


def renamed(df: DataFrame, names: dict[str, str] | None = None, suffix: str = "", keep: list[str] | None = None) -> DataFrame:
    """Columns trimmed and in lower case, then renamed by ``names``, then with a suffix, those to ``keep`` aside."""
    low = [c.strip().lower() for c in df.columns]
    new = [(names or {}).get(c, c) for c in low]
    return df.toDF(*(c if c in (keep or []) else c + suffix for c in new))


def interaction(a: Column, b: Column) -> Column:
    return a * b


def damped(a: Column, b: Column, bound: float = 3.0) -> Column:
    """a x (1 - b), with b held within +-``bound``; NULL where either is."""
    return F.when(b.isNotNull(), a * (1 - F.greatest(F.lit(-bound), F.least(F.lit(bound), b))))


def size_bucket(n: Column, bounds: list[int] | None = None) -> Column:
    """``1``, ``2-3``, ``4-5``, ``6+`` for the default bounds, which are the first number of each bucket but the first."""
    lows = [1, *(bounds or [2, 4, 6])]
    name = lambda a, b: str(a) if b == a + 1 else f"{a}-{b - 1}"
    out = F.when(n < lows[1], name(lows[0], lows[1]))
    for a, b in zip(lows[1:], lows[2:], strict=False):
        out = out.when(n < b, name(a, b))
    return F.when(n >= 1, out.otherwise(f"{lows[-1]}+"))
