"""URL column expressions. None of them fails on malformed text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.keys import let

# Query parameters that track a visit and do not select a page.
TRACKING = ["gclid", "fbclid", "mc_cid", "mc_eid", "igshid", "spm", "ref", "ref_src"]
TRACKING_PREFIX = "utm_"

#: Percent codes of the characters that mean the same undecoded: letters, digits, - . _ ~
_UNRESERVED = "2[DEde]|3[0-9]|4[1-9A-Fa-f]|5[0-9AFaf]|6[1-9A-Fa-f]|7[0-9AEae]"


def decode_unreserved(c: Column) -> Column:
    """Percent codes of letters, digits and ``-._~`` as characters; all others stay as they are."""
    kept = F.regexp_replace(F.regexp_replace(c, r"\+", "%2B"), f"%(?!2B|{_UNRESERVED})", "%25")
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(kept), c)).otherwise(c)


def unquote(c: Column) -> Column:
    """All percent codes decoded, ``+`` kept; text that is no valid encoding stays as it is."""
    return F.when(F.contains(c, F.lit("%")), F.coalesce(F.try_url_decode(F.regexp_replace(c, r"\+", "%2B")), c)).otherwise(c)


def stripped(c: Column) -> Column:
    """Without white space around; blank is NULL."""
    return F.nullif(F.regexp_replace(c, r"^[\s\u00a0]+|[\s\u00a0]+$", ""), F.lit(""))


def url_scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_host(c: Column) -> Column:
    """Authority as written, without scheme."""
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def url_path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_query(c: Column) -> Column:
    return F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)


def selecting_parameters(query: Column) -> Column:
    """The parameters that are not tracking, in order, blank values kept."""
    name = lambda kv: F.lower(F.regexp_extract(kv, r"^([^=]*)", 1))
    return F.filter(F.split(query, "&"), lambda kv: (kv != "") & ~name(kv).isin(TRACKING) & ~F.startswith(name(kv), F.lit(TRACKING_PREFIX)))


def _reencoded(parameter: Column) -> Column:
    """A parameter decoded and encoded again, so that one value has one spelling; what can't be decoded stays."""
    again = lambda t: F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(t), t)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))
    name = F.substring_index(parameter, "=", 1)
    return F.concat(again(name), F.lit("="), again(F.substring(parameter, F.length(name) + 2, F.length(parameter))))


def normalize_url(c: Column, reencode: bool = False) -> Column:
    """Trimmed, default scheme http, host in lower case, tracking parameters and fragment dropped.

    NULL and blank give NULL. The other parameters keep their order, and their spelling unless ``reencode`` gives each value its one form.
    """
    u = stripped(c)
    u = F.when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), u).otherwise(F.concat(F.lit("http://"), u))
    kept = selecting_parameters(url_query(u))
    q = F.array_join(F.transform(kept, _reencoded) if reencode else kept, "&")
    return F.concat(url_scheme(u), F.lit("://"), F.lower(url_host(u)), url_path(u), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def search_text(c: Column) -> Column:
    """Host, path and query decoded, in lower case, with ``-``, ``_`` and ``/`` as spaces."""
    u = stripped(c)
    flat = F.lower(unquote(F.concat_ws(" ", url_host(u), url_path(u), F.nullif(url_query(u), F.lit("")))))
    return F.when(u.isNotNull(), F.trim(F.regexp_replace(F.regexp_replace(flat, r"[-_/]+", " "), r"\s+", " ")))


def tokens(c: Column) -> Column:
    """Distinct runs of ``a-z0-9`` in lower case, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda t: t != ""))


def slug_text(c: Column) -> Column:
    """The words of a path: extension and bare numbers dropped, separators as spaces, lower case."""
    p = F.regexp_replace(unquote(url_path(stripped(c))), r"\.[A-Za-z0-9]{1,5}$", "")
    p = F.regexp_replace(F.regexp_replace(p, r"[-_/.+]+", " "), r"(?<= |^)\d+(?= |$)", " ")
    return F.lower(F.trim(F.regexp_replace(p, r"\s+", " ")))


def path_tokens(c: Column, least: int = 3) -> Column:
    """Path tokens of at least ``least`` characters that are no bare numbers."""
    return F.filter(F.split(F.lower(unquote(url_path(stripped(c)))), r"[/\-_.]+"), lambda t: (F.length(t) >= least) & ~t.rlike(r"^\d+$"))


def domain(c: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(stripped(c), r"^(?i)https?://(?:www\.)?([^/:?#]+)", 1)), F.lit(""))


def date_from_url(c: Column) -> Column:
    """The date in a path such as /2019/05/24/, /2019-05-24, /20190524 or /2019/05/ (then day 01).

    The first pattern whose year lies in 2000-2035 and whose month and day are possible wins.
    """
    def of(pattern: str, day: bool) -> Column:
        y, m = F.regexp_extract(c, pattern, 1), F.regexp_extract(c, pattern, 2)
        d = F.regexp_extract(c, pattern, 3) if day else F.lit("01")
        ok = F.try_to_number(y, F.lit("9999")).between(2000, 2035)
        return F.when((y != "") & ok, F.to_date(F.try_to_timestamp(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd"))))

    return F.coalesce(
        of(r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$|-)", True), of(r"(\d{4})-(\d{2})-(\d{2})", True), of(r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", True),
        of(r"/(\d{4})-(\d{1,2})(?:/|$)", False), of(r"/(\d{4})/(\d{1,2})(?:/|$)", False),
    )
