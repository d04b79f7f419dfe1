"""What HTML pages tell about themselves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.dates import read_date
from strandline.functions.strings import squeezed

# Meta tags that tell when a page was published, as (attribute, name), in order of precedence.
DATE_TAGS = [
    ("property", "article:published_time"), ("property", "article:modified_time"), ("name", "pubdate"), ("name", "publish-date"), ("name", "publication_date"), ("itemprop", "datePublished"), ("itemprop", "dateModified"),
]


def _tag(html: Column, attribute: str, name: str) -> list[Column]:
    """Content of the first such meta tag, whichever attribute comes first."""
    key, content = rf"{attribute}\s*=\s*[\"']{name}[\"']", r"content\s*=\s*[\"']([^\"'<>]*)[\"']"
    return [F.regexp_extract(html, rf"(?is)<meta\b[^<>]*?{a}[^<>]*?{b}", 1) for a, b in ((key, content), (content, key))]


def publish_date(html: Column, fallback: Column | None = None) -> Column:
    """The first date that can be read: of seven meta tags in their order, a time tag, linked data, then the fallback."""
    found = [read_date(x) for attribute, name in DATE_TAGS for x in _tag(html, attribute, name)]
    found.append(read_date(F.regexp_extract(html, r"(?is)<time\b[^<>]*?datetime\s*=\s*[\"']([^\"'<>]*)", 1)))
    data = F.regexp_extract(html, r"(?is)<script[^<>]*application/ld\+json[^<>]*>(.*?)</script>", 1)
    found += [read_date(F.get_json_object(data, f"$.{k}")) for k in ("datePublished", "dateModified")]
    return F.coalesce(*found, *([fallback] if fallback is not None else []))


def main_text(html: Column, least: int = 60) -> Column:
    """The page's paragraphs, without navigation, forms, scripts and other short or linked pieces; the whole text where none is long enough."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|nav|header|footer|aside|form|figure)\b[^>]*>.*?</\1>", " ")
    inner = F.regexp_extract_all(bare, F.lit(r"(?is)<(?:p|h1|h2|li|blockquote)\b[^>]*>(.*?)</(?:p|h1|h2|li|blockquote)>"), F.lit(1))
    text = F.transform(inner, lambda x: squeezed(F.regexp_replace(x, r"(?s)<[^>]*>", " ")))
    links = F.transform(inner, lambda x: squeezed(F.array_join(F.regexp_extract_all(x, F.lit(r"(?is)<a\b[^>]*>(.*?)</a>"), F.lit(1)), " ")))
    good = F.filter(F.arrays_zip(text.alias("t"), links.alias("l")), lambda z: (F.length(z["t"]) >= least) & (F.length(z["l"]) * 2 <= F.length(z["t"])))
    joined = F.array_join(F.transform(good, lambda z: z["t"]), "\n")
    return F.when(joined != "", joined).otherwise(F.nullif(squeezed(F.regexp_replace(bare, r"(?s)<[^>]*>", " ")), F.lit("")))


def html_head(content: Column, most: int = 256 * 1024) -> Column:
    """A page's head as text, from its bytes: up to </head>, ``most`` bytes at most, by the charset it names, else UTF-8."""
    raw = F.substring(content, 1, most)
    probe = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    charset = F.regexp_extract(probe, r"charset\s*=\s*[\"']?([a-z0-9_-]+)", 1)
    latin = F.decode(raw, "ISO-8859-1")
    text = F.when(charset.isin("iso-8859-1", "latin-1", "latin1", "windows-1252"), latin).otherwise(F.coalesce(F.try_validate_utf8(raw.cast("string")), latin))
    return F.regexp_replace(text, r"(?is)</head>.*$", "</head>")
