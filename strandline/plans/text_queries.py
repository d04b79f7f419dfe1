"""Queries on URLs, texts and scalar parsers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from strandline.functions import strings as S
from strandline.functions import urls as U
from strandline.functions.dates import compact_to_iso, read_date
from strandline.functions.vectors import hashed_vectors
from strandline.operators.filters import first_hit, url_reason
from strandline.plans.tables import table

#: Parameters of the URL filter; callers bring their own lists.
EXTENSIONS, SECTIONS, KEYWORDS = ["jpg", "png", "pdf", "mp4"], ["sport", "video", "weather"], ["flood", "pension reform", "school fees"]
BAD_TEXT = ["access denied", "just a moment", "404 not found", "MSN"]


def _urls(spark, d):
    return table(spark, d, "extract_records").select("record_id", "url", "source_title", "event_description")


def url_normalize(spark, d):
    return _urls(spark, d).select("record_id", U.normalize_url(F.col("url")).alias("url_normalized"))


def url_parts(spark, d):
    u = F.col("url")
    return _urls(spark, d).select("record_id", U.search_text(u).alias("search_text"), U.slug_text(u).alias("slug"), U.domain(u).alias("domain"))


def url_filter(spark, d):
    """Which rule drops a URL, by reason."""
    r = url_reason(F.col("url"), EXTENSIONS, SECTIONS, KEYWORDS)
    return _urls(spark, d).where("trim(url) <> ''").groupBy(r.alias("reason")).agg(F.count("*").alias("n"))


def url_filter_daily(spark, d):
    """Distinct URLs per day, and how many pass the filter."""
    x = table(spark, d, "extract_records").select(U.normalize_url(F.col("url")).alias("u"), "ingest_time").where("u is not null")
    first = x.groupBy("u").agg(F.min("ingest_time").alias("t"))
    return first.groupBy(F.col("t").cast("date").alias("day")).agg(F.count("*").alias("urls"), F.count_if(url_reason(F.col("u"), EXTENSIONS, SECTIONS, KEYWORDS).isNull()).alias("kept"))


def url_tokens(spark, d):
    """Path tokens, in how many records and on how many days."""
    x = table(spark, d, "extract_records").select("record_id", F.col("ingest_time").cast("date").alias("day"), F.explode(F.array_distinct(U.path_tokens(F.col("url")))).alias("token"))
    return x.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days")).where("n >= 3")


def url_dates(spark, d):
    """Dates in the records' addresses, and in addresses of five notations made of their dates."""
    day, k = read_date(F.col("publish_date")), F.col("record_id") % 6
    made = F.when(k == 0, F.date_format(day, "'x/'yyyy'/'M'/'d")).when(k == 1, F.date_format(day, "'a-'yyyy-MM-dd'-b'")).when(k == 2, F.date_format(day, "'n'yyyyMMdd'.html'")).when(k == 3, F.date_format(day, "yyyy-M'/story'"))
    made = F.concat(F.lit("http://h.example/"), made.when(k == 4, F.date_format(day, "yyyy'/'MM'/story'")).otherwise(F.lit("1850/01/02/20201399/x")))
    x = table(spark, d, "extract_records")
    return x.select("record_id", U.date_from_url(F.col("url")).alias("url_date"), U.date_from_url(made).alias("made_date"))


def read_dates(spark, d):
    """Event dates in one notation, and where they came from."""
    e, p = read_date(F.col("event_date")), read_date(F.col("publish_date"))
    tag = F.when(e.isNotNull(), "event").when(p.isNotNull(), "publish")
    return table(spark, d, "extract_records").select("record_id", F.coalesce(e, p).alias("date"), tag.alias("source"), compact_to_iso(F.col("publish_date")).alias("compact"))


def garbage_titles(spark, d):
    t = S.build_text(F.col("source_title"), F.col("event_description"), U.slug_text(F.col("url")), BAD_TEXT)
    return _urls(spark, d).select("record_id", S.garbage(F.col("source_title"), BAD_TEXT, 30).alias("garbage"), t.alias("text"))


def html_heads(spark, d):
    """Title and description of pages made from the records' titles."""
    page = F.concat(F.lit("<html><head>\n<TITLE>"), F.col("source_title"), F.lit("</title><meta content='"), F.coalesce("event_description", F.lit(" ")), F.lit("' property='og:description'><script>x = 1</script></head><body><p>"), F.col("source_title"), F.lit("</p></body>"))
    p = _urls(spark, d).select("record_id", page.alias("html"))
    return p.select("record_id", S.html_title(F.col("html")).alias("title"), S.meta_description(F.col("html")).alias("description"), S.html_text(F.col("html")).alias("text"), S.looks_like_xml(F.lit("text/html"), F.col("html")).alias("xml"))


def truncations(spark, d):
    """How many texts each cap cuts, and what remains of them on average."""
    docs = table(spark, d, "documents").where("text is not null").select(F.length("text").alias("n"))
    caps = [300, 800, 3200]
    one = docs.agg(*(F.count_if(F.col("n") > c).alias(f"cut{c}") for c in caps), *(F.avg(F.least(F.col("n"), F.lit(c))).alias(f"avg{c}") for c in caps))
    rows = F.array(*(F.struct(F.lit(c).alias("cap"), F.col(f"cut{c}").alias("n_cut"), F.round(f"avg{c}", 4).alias("mean_chars")) for c in caps))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def shortened(spark, d):
    return _urls(spark, d).select("record_id", S.ellipsis(F.col("source_title"), 30).alias("short"), S.truncate(F.col("source_title"), 12).alias("head"), S.joined_text(F.col("source_title"), F.col("event_description")).alias("joined"))


def location_parts(spark, d):
    loc = F.col("location_name")
    return table(spark, d, "extract_records").select("record_id", F.array_join(F.array_sort(S.location_tokens(loc)), " ").alias("tokens"), S.in_parentheses(loc).alias("inside"), S.last_part(loc, ",").alias("last"))


def phrases(spark, d):
    """Durations and day numbers that phrases built from the records tell."""
    n = F.element_at(F.array(*(F.lit(w) for w in ("two", "three", "ten", "a"))), (F.col("record_id") % 4 + 1).cast("int"))
    o = F.element_at(F.array(*(F.lit(w) for w in ("second", "third", "10th", "21st"))), (F.col("record_id") % 4 + 1).cast("int"))
    x = table(spark, d, "extract_records").select("record_id", F.concat(F.lit("The strike lasts "), n, F.lit(" weeks")).alias("a"), F.concat(F.lit("It entered its "), o, F.lit(" day")).alias("b"), F.concat(F.lit("now in the "), o, F.lit(" week")).alias("c"))
    return x.select("record_id", S.explicit_days(F.col("a")).alias("explicit"), S.day_number(F.col("b")).alias("day"), S.day_number(F.col("c")).alias("week_day"))


def flags(spark, d):
    """Lenient truth of several texts, and the first keyword of a list that occurs."""
    x = _urls(spark, d)
    return x.select("record_id", S.to_flag((F.col("record_id") % 2).cast("string")).alias("flag"), first_hit(U.search_text(F.col("url")), KEYWORDS).alias("keyword"), S.json_object(F.concat(F.lit("```json\n{\"a\": "), F.col("record_id"), F.lit("}\n```"))).alias("object"))


def mojibake(spark, d):
    """Documents in which the known broken pairs occur, repaired."""
    t = table(spark, d, "documents").select("doc_id", "text", S.demojibake(F.col("text")).alias("fixed"))
    return t.where("text <> fixed").select("doc_id", F.md5("fixed").alias("digest"))


def fuzzy_titles(spark, d):
    """Similarity of a record's two texts as sets of words."""
    return _urls(spark, d).select("record_id", F.round(S.fuzzy_similarity(F.col("source_title"), F.col("event_description")), 6).alias("similarity"))


def tone_words(spark, d):
    """The most frequent words of titles besides stop words."""
    w = _urls(spark, d).select(F.explode(S.words_without(F.col("source_title"), ["over", "in", "on", "the", "near", "after"])).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n"))


def text_similarity(spark, d):
    """Cosine of a record's title and description as hashed vectors."""
    r = table(spark, d, "extract_records")
    side = lambda k, c: r.select((F.col("record_id") * 2 + k).alias("id"), F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+").alias("t"))
    v = hashed_vectors(side(0, "source_title").unionByName(side(1, "event_description")), "id", "t")
    a = v.where("id % 2 = 0").select(F.expr("id div 2").alias("record_id"), "dim", "w")
    b = v.where("id % 2 = 1").select(F.expr("id div 2").alias("r"), F.col("dim").alias("e"), F.col("w").alias("x"))
    both = a.join(b, (F.col("record_id") == F.col("r")) & (F.col("dim") == F.col("e")))
    return both.groupBy("record_id").agg(F.round(F.sum(F.col("w") * F.col("x")), 6).alias("cosine"))


def reencoded_urls(spark, d):
    """Addresses with two spellings of one parameter each, as one."""
    more = F.when(F.col("record_id") % 2 == 0, "q=a%20b%c3%a9&utm_source=x&z=~*").otherwise("q=a+b%C3%A9&z=%7E%2a#top")
    return table(spark, d, "extract_records").select("record_id", U.normalize_url(F.concat(F.lit("HTTP://H.example/x?id="), F.col("record_id"), F.lit("&"), more), True).alias("u"))


def fixed_titles(spark, d):
    """Titles after character references, broken encodings and odd spaces were put around them."""
    k = F.col("record_id") % 3
    pre = F.when(k == 0, "caf&#233; &amp;amp; &quot;x&quot; ").when(k == 1, "&#x20AC;5&nbsp;&hellip; &#99999999; ").otherwise("policÃ\u00ada ")
    clean = F.regexp_replace("source_title", "[^A-Za-z ]+", "")
    return table(spark, d, "extract_records").select("record_id", S.fixed_text(F.concat(pre, clean)).alias("title"))


QUERIES = {f.__name__: f for f in (reencoded_urls, fixed_titles, text_similarity, url_normalize, url_parts, url_filter, url_filter_daily, url_tokens, url_dates, read_dates, garbage_titles, html_heads, truncations, shortened, location_parts, phrases, flags, mojibake, fuzzy_titles, tone_words)}

_T = r"regexp_replace(url, '^\s+|\s+$', '', 'g')"
_HOST = rf"regexp_extract({_T}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
_PATH = rf"regexp_extract({_T}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_QUERY = rf"regexp_extract({_T}, '^[^?#]*\?([^#]*)', 1)"
_UNQ = "regexp_replace({}, '%2[Dd]', '-', 'g')"
_KEPT = rf"array_to_string(list_filter(string_split({_QUERY}, '&'), lambda kv: kv <> '' and not regexp_matches(lower(kv), '^(utm_[^=]*|gclid|fbclid|mc_cid|mc_eid|igshid|spm|ref|ref_src)(=|$)')), '&')"
_NORM = rf"case when {_T} = '' or url is null then null else lower(regexp_extract({_T}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower({_HOST}) || {_PATH} || case when {_KEPT} <> '' then '?' || {_KEPT} else '' end end"
_SEARCH = rf"trim(regexp_replace(regexp_replace(lower(concat_ws(' ', {_HOST}, {_UNQ.format(_PATH)}, nullif({_QUERY}, ''))), '[-_/]+', ' ', 'g'), '\s+', ' ', 'g'))"
_SLUG = rf"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_UNQ.format(_PATH)}, '\.[A-Za-z0-9]{{1,5}}$', ''), '[-_/.+]+', '  ', 'g'), '(^| )\d+( |$)', ' ', 'g'), '\s+', ' ', 'g')))"
_ISO = r"case when regexp_matches({0}, '^\d{{4}}-\d\d-\d\d') then substr({0}, 1, 10)::date when regexp_matches({0}, '^\d{{8}}$') then strptime({0}, '%Y%m%d')::date when regexp_matches({0}, '^\d{{4}}/\d\d/\d\d$') then strptime({0}, '%Y/%m/%d')::date when regexp_matches({0}, '^\d+ [A-Za-z]{{3}} \d{{4}}$') then strptime({0}, '%d %b %Y')::date when regexp_matches({0}, '^\d+ [A-Za-z]+ \d{{4}}$') then strptime({0}, '%d %B %Y')::date when regexp_matches({0}, '^[A-Za-z]{{3}} \d+, \d{{4}}$') then strptime({0}, '%b %d, %Y')::date when regexp_matches({0}, '^[A-Za-z]+ \d+, \d{{4}}$') then strptime({0}, '%B %d, %Y')::date end"
_TOK = r"list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(location_name), '\([^)]*\)', ' ', 'g'), '[^a-z]+', ' ', 'g'), ' '), lambda x: length(x) > 2))"
_YMD = "try_cast({0} || '-' || lpad({1}, 2, '0') || '-' || lpad({2}, 2, '0') as date)"
_PART = lambda p, i: f"regexp_extract(url, '{p}', {i})"
_DATED = "coalesce(" + ", ".join(
    f"case when try_cast({_PART(p, 1)} as int) between 2000 and 2035 then {_YMD.format(_PART(p, 1), _PART(p, 2), _PART(p, 3) if day else chr(39) + '01' + chr(39))} end"
    for p, day in ((r"/(\d{4})/(\d{1,2})/(\d{1,2})(?:/|$|-)", True), (r"(\d{4})-(\d{2})-(\d{2})", True), (r"(?:^|\D)(\d{4})(\d{2})(\d{2})(?:\D|$)", True), (r"/(\d{4})-(\d{1,2})(?:/|$)", False), (r"/(\d{4})/(\d{1,2})(?:/|$)", False))
) + ")"
_REPAIRED = reduce(lambda t, kv: f"replace({t}, '{kv[0]}', '{kv[1]}')", S.MOJIBAKE.items(), "text")
SQL = {
    "reencoded_urls": "select record_id, 'http://h.example/x?id=' || record_id || '&q=a+b%C3%A9&z=~%2A' as u from extract_records",
    "fixed_titles": "select record_id, trim(regexp_replace(['café &amp; \"x\" ', '€5 … &#99999999; ', 'polic\u00eda '][record_id % 3 + 1] || regexp_replace(source_title, '[^A-Za-z ]+', '', 'g'), '\\s+', ' ', 'g')) as title from extract_records",
    "text_similarity": """with d as (select record_id * 2 as id, regexp_split_to_array(lower(coalesce(source_title, '')), '[^a-z0-9]+') as t from extract_records union all select record_id * 2 + 1, regexp_split_to_array(lower(coalesce(event_description, '')), '[^a-z0-9]+') from extract_records),
 e as (select id, tok, count(*) as tf from (select id, unnest(t) as tok from d) where tok <> '' group by all), f as (select tok, count(*) as df from e group by 1),
 p as (select id, ('0x' || substr(md5(tok), 1, 8))::bigint % 256 as dim, sum(tf * ln((1.0 + (select count(*) from d)) / (1 + df))) as w from e join f using (tok) group by all), l as (select id, sqrt(sum(w * w))
  as n from p where w <> 0 group by 1), v as (select p.id, dim, w / n as w from p join l using (id) where w <> 0)
 select (a.id // 2) as record_id, round(sum(a.w * b.w), 6) as cosine from v a join v b on a.id % 2 = 0 and b.id = a.id + 1 and a.dim = b.dim group by 1""",
    "mojibake": f"select doc_id, md5({_REPAIRED}) as digest from documents where text <> {_REPAIRED}",
    "url_normalize": f"select record_id, {_NORM} as url_normalized from extract_records",
    "url_parts": (
        rf"select record_id, case when url is null or {_T} = '' then null else {_SEARCH} end as search_text, case when url is null or {_T} = '' then null else {_SLUG} end as slug, nullif(lower(regexp_extract({_T}, "
        rf"'^(?i)https?://(?:www\.)?([^/:?#]+)', 1)), '') as domain from extract_records"
    ),
    "url_filter": (
        f"with x as (select {_SEARCH} as s, lower({_PATH}) as p from extract_records where trim(url) <> '') select case when regexp_matches(p, '\\.(jpg|png|pdf|mp4)$') then 'extension' when regexp_matches(p, '/(sport|video|weather)(/|$)') "
        f"then 'section' when contains(s, 'flood') then 'keyword: flood' when contains(s, 'pension reform') then 'keyword: pension reform' when contains(s, 'school fees') then 'keyword: school fees' end as reason, "
        f"count(*) as n from x group by 1"
    ),
    "url_filter_daily": (
        f"with n as (select {_NORM} as url, min(ingest_time)::date as day from extract_records where url is not null and {_T} <> '' group by 1), x as (select day, {_SEARCH} as s, lower({_PATH}) as p from n) select "
        f"day, count(*) as urls, count(*) filter (not regexp_matches(p, '\\.(jpg|png|pdf|mp4)$') and not regexp_matches(p, '/(sport|video|weather)(/|$)') and not contains(s, 'flood') and not contains(s, 'pension "
        f"reform') and not contains(s, 'school fees')) as kept from x group by 1"
    ),
    "url_tokens": (
        rf"with x as (select record_id, ingest_time::date as day, unnest(list_distinct(list_filter(regexp_split_to_array(lower({_UNQ.format(_PATH)}), '[/\-_.]+'), lambda t: length(t) >= 3 and not regexp_matches(t, "
        rf"'^\d+$')))) as token from extract_records where url is not null and {_T} <> '') select token, count(*) as n, count(distinct day) as days from x group by 1 having count(*) >= 3"
    ),
    "url_dates": f"select record_id, {_DATED} as url_date, case when record_id % 6 < 3 then {_ISO.format('trim(publish_date)')} when record_id % 6 < 5 then date_trunc('month', {_ISO.format('trim(publish_date)')})::date end as made_date from extract_records",
    "read_dates": (
        rf"with x as (select record_id, {_ISO.format('trim(event_date)')} as e, {_ISO.format('trim(publish_date)')} as p, publish_date from extract_records) select record_id, coalesce(e, p) as date, case when e "
        rf"is not null then 'event' when p is not null then 'publish' end as source, case when regexp_matches(publish_date, '^\s*\d{{8}}\s*$') then strftime(p, '%Y-%m-%d') end as compact from x"
    ),
    "garbage_titles": (
        f"with x as (select record_id, source_title, event_description, url, trim(regexp_replace(concat_ws('. ', nullif(trim(source_title), ''), nullif(trim(event_description), '')), '\\s+', ' ', 'g')) as b, {_SLUG} "
        f"as slug from extract_records) select record_id, coalesce(length(trim(source_title)) < 30, true) or coalesce(regexp_matches(lower(source_title), 'access denied|just a moment|404 not found|msn'), true) "
        f"as garbage, case when length(b) < 15 or regexp_matches(lower(b), 'access denied|just a moment|404 not found|msn') then slug else b end as text from x"
    ),
    "html_heads": (
        r"select record_id, trim(regexp_replace(source_title, '\s+', ' ', 'g')) as title, nullif(trim(regexp_replace(coalesce(event_description, ''), '\s+', ' ', 'g')), '') as description, trim(regexp_replace(source_title "
        r"|| ' ' || source_title, '\s+', ' ', 'g')) as text, false as xml from extract_records"
    ),
    "truncations": " union all ".join(f"select {c} as cap, count(*) filter (length(text) > {c}) as n_cut, round(avg(least(length(text), {c})), 4) as mean_chars from documents where text is not null" for c in (300, 800, 3200)),
    "shortened": (
        "select record_id, case when length(source_title) > 30 then rtrim(substr(source_title, 1, 27)) || '...' else source_title end as short, substr(trim(source_title), 1, 12) as head, concat_ws(' | ', nullif(trim(source_title), "
        "''), nullif(trim(event_description), '')) as joined from extract_records"
    ),
    "location_parts": rf"select record_id, array_to_string(list_sort({_TOK}), ' ') as tokens, nullif(trim(regexp_extract(location_name, '\(([^)]+)\)', 1)), '') as inside, trim(list_last(string_split(location_name, ','))) as last from extract_records",
    "phrases": "select record_id, [2, 3, 10, 1][record_id % 4 + 1] * 7 as explicit, [2, 3, 10, 21][record_id % 4 + 1] as day, [2, 3, 10, 21][record_id % 4 + 1] * 7 as week_day from extract_records",
    "flags": (
        f"select record_id, record_id % 2 as flag, case when url is null or {_T} = '' then null when contains({_SEARCH}, 'flood') then 'flood' when contains({_SEARCH}, 'pension reform') then 'pension reform' when "
        f"contains({_SEARCH}, 'school fees') then 'school fees' end as keyword, '{{\"a\": ' || record_id || '}}' as object from extract_records"
    ),
    "tone_words": "with w as (select unnest(list_distinct(list_filter(regexp_extract_all(lower(source_title), '[a-z0-9]+'), lambda x: x not in ('over', 'in', 'on', 'the', 'near', 'after')))) as word from extract_records) select word, count(*) as n from w group by 1",
}
