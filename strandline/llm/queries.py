"""The subpackage's named queries, each a function of (spark, directory), and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm.pages import page_key
from strandline.llm import languages
from strandline.llm.encoding import decode, encode
from strandline.llm.happenings import same_happenings
from strandline.llm.linking import link_records
from strandline.llm.matching import one_to_one
from strandline.llm import spots
from strandline.llm.mixing import mix, rates, shares, source_key
from strandline.llm.survivors import canonical, field_votes, fraction, head_count, latest_delivery, survivors, tidy, winners
from strandline.plans.tables import table
from strandline.plans.text_queries import _ISO
from strandline.session import materialize


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its group's id and size."""
    r = table(spark, d, "extract_records").select(F.col("record_id").alias("id"), page_key(F.col("url")).alias("key"))
    m = table(spark, d, "url_matches").select(F.col("pair_id").alias("pair"), page_key(F.col("url_a")).alias("a"), page_key(F.col("url_b")).alias("b"))
    return link_records(r, m).select(F.col("id").alias("record_id"), "group_id", "n_members")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The records in groups of two or more."""
    return p6_groups(spark, d).where("n_members > 1").select("record_id", "group_id")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Record and event of the same happening with the confidence of the match."""
    found = same_happenings(table(spark, d, "extract_records"), table(spark, d, "verified_events"), table(spark, d, "gazetteer"))
    return found.withColumn("confidence", F.round("confidence", 9))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_pairs(spark, d).select("record_id", "event_id_cnty")


def p7_matches(spark: SparkSession, d: str) -> DataFrame:
    """The one-to-one assignment of largest total confidence: at most one record per event."""
    pairs = materialize(p7_pairs(spark, d), "happenings")
    ids = materialize(pairs.select("event_id_cnty").distinct().withColumn("r", F.monotonically_increasing_id()), "events")
    best = one_to_one(pairs.join(ids, "event_id_cnty").select(F.col("record_id").alias("l"), "r", F.col("confidence").alias("w")))
    return best.join(ids, "r").select(F.col("l").alias("record_id"), "event_id_cnty", F.col("w").alias("confidence"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The byte_bpe_50k ids of every document."""
    return encode(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The round trip: every document encoded and decoded again, as the digest of the text that comes out."""
    texts = decode(p8_ids(spark, d), "doc_id", "ids")
    return texts.select("doc_id", F.md5("text").alias("digest"))


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    """(id, source, size in tokens) of the documents of the target sources."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), source_key(F.col("source")).alias("source"), "text")
    wanted = table(spark, d, "mix_targets").select(source_key(F.col("source")).alias("source")).distinct()
    docs = docs.join(wanted, "source", "left_semi").withColumn("id", F.struct("id", "source"))
    out = encode(docs, "id", "text").select("id.id", "id.source", F.size("ids").cast("long").alias("size"))
    return materialize(out, "sizes")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The drawn documents, one row per copy."""
    sizes = _sizes(spark, d)
    return mix(sizes, rates(sizes, table(spark, d, "mix_targets"))).select(F.col("id").alias("doc_id"), "source", "copy", F.col("size").alias("n_tokens"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached, beside the targets."""
    sizes = _sizes(spark, d)
    r = rates(sizes, table(spark, d, "mix_targets"))
    return shares(mix(sizes, r), r)


FIELDS = ["sector", "estimated_participants"]


def _members(spark: SparkSession, d: str) -> DataFrame:
    """Each article of each cluster once, with comparable values."""
    a = table(spark, d, "source_articles").where("cluster_id is not null").select(
        "cluster_id", "article_id", "event_date", fraction(F.col("confidence")).alias("confidence"), tidy(F.col("sector")).alias("__sector"), head_count(F.col("estimated_participants")).alias("estimated_participants"),
        tidy(F.col("issue")).alias("issue"), tidy(F.col("protest_type")).alias("protest_type"), tidy(F.col("subloc")).alias("subloc"), "ingest_time",
    )
    a = latest_delivery(a, "cluster_id", "article_id", "ingest_time")
    names = canonical(table(spark, d, "source_articles").select(tidy(F.col("sector")).alias("s")), "s", table(spark, d, "sector_codes"), "sector", "aliases")
    return a.join(names.withColumnRenamed("canonical", "sector"), F.col("__sector") == F.col("value"), "left").drop("__sector", "value")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Surviving values, and the fields in conflict, by trust alone."""
    won = winners(field_votes(_members(spark, d), "cluster_id", FIELDS, F.col("confidence")), "cluster_id")
    one = F.struct(F.col("field").alias("field"), F.col("value").alias("value"))
    clash = F.when(F.col("n_values") > 1, F.struct(F.lit("conflicted_fields").alias("field"), F.col("field").alias("value")))
    return won.select("cluster_id", F.explode(F.filter(F.array(one, clash), lambda x: x.isNotNull())).alias("x")).select("cluster_id", "x.*")


def p1_survivors(spark: SparkSession, d: str) -> DataFrame:
    """One record per cluster, by trust and recency with a half-life of 30 days."""
    m = _members(spark, d)
    fields = [*FIELDS, "issue", "protest_type", "subloc"]
    won = winners(field_votes(m, "cluster_id", fields, F.col("confidence"), "event_date", 30.0), "cluster_id")
    top = m.groupBy("cluster_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("n_members"))
    return top.join(survivors(won, "cluster_id", fields), "cluster_id", "left").withColumn("conflicted_fields", F.array_join("conflicted_fields", ","))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return languages.classify(docs, "doc_id", "text", languages.fit(docs, "doc_id", "text", "lang"))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Language, confidence and place in the text of every run of sentences of one language; NULL where the two best are too close."""
    return _segments(spark, d)


def p10_languages(spark: SparkSession, d: str) -> DataFrame:
    """The languages of every document with language, beside its label."""
    labels = table(spark, d, "documents").select(F.col("doc_id").alias("__id"), languages.label_key(F.col("lang")).alias("label"))
    langs = languages.per_language(_segments(spark, d), "doc_id")
    return langs.join(labels, F.col("doc_id") == F.col("__id")).drop("__id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose label is missing, void or wrong, or that hold several languages: a row per language."""
    return p10_languages(spark, d).where("label is null or n_langs > 1 or label <> lang").select("doc_id", "lang")


QUERIES = {"p1_found": p1_found, "p1_survivors": p1_survivors, "p10_found": p10_found, "p10_languages": p10_languages, "p10_segments": p10_segments, "p8_ids": p8_ids, "p8_decoded": p8_decoded, "p9_mix": p9_mix, "p9_shares": p9_shares, "p7_found": p7_found, "p7_pairs": p7_pairs, "p7_matches": p7_matches, "p6_found": p6_found, "p6_groups": p6_groups}



def _key(c: str) -> str:
    """page_key for the spellings that occur: %2D is the one plain percent code."""
    u = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '^[\s\x{{00a0}}]+|[\s\x{{00a0}}]+$', '', 'g'), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '%2[Dd]', '-', 'g')"
    host = rf"regexp_replace(lower(regexp_extract({u}, '^([^/?]*)', 1)), '^www\.|(:80|:443)$', '', 'g')"
    path = rf"regexp_replace(regexp_extract({u}, '^[^/?]*([^?]*)', 1), '/+$', '')"
    params = rf"list_sort(list_filter(string_split(regexp_extract({u}, '\?(.*)$', 1), '&'), lambda kv: kv <> '' and not regexp_matches(lower(kv), '^(utm_[^=]*|gclid|fbclid|mc_cid|mc_eid|igshid|spm|ref|ref_src)(=|$)')))"
    return f"nullif({host} || {path} || case when len({params}) > 0 then '?' || array_to_string({params}, '&') else '' end, '')"


_LINKS = f"""r as (select record_id, {_key('url')} as k from extract_records), m as (select {_key('url_a')} as a, {_key('url_b')} as b from url_matches),
e as (select a, b from m where a <> b union select b, a from m where a <> b), reach(k, o) as (select distinct a, a from e union select reach.k, e.b from reach join e on reach.o = e.a),
g as (select x.record_id, coalesce(y.o, x.k) as o from r x left join reach y on x.k = y.k where x.k is not null),
j as (select g.record_id, min(z.record_id) as group_id, count(distinct z.record_id) as n_members from g join r z on z.k = g.o group by 1)"""

_W = "|".join(w for ws in spots.KINDS.values() for w in ws)
_KIND = "map {{" + ", ".join(f"'{w}': '{k}'" for k, ws in spots.KINDS.items() for w in ws) + "}}"
_CODE = "nullif(regexp_replace(upper({}), '[^A-Z0-9-]', '', 'g'), '')"
_PIECES = r"""list_filter(list_transform(regexp_split_to_array(regexp_replace(lower({}), '[\[\]\"\s_\x{{a0}}]+', ' ', 'g'), '[,();]| - '),
 lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g'), '^near ', '')), lambda x: x <> '')"""
_BARE = f"nullif(regexp_replace(case when regexp_matches({{0}}, ' ({_W})\\.?$') then regexp_replace({{0}}, ' ({_W})\\.?$', '') else regexp_replace({{0}}, '^({_W})\\.? ', '') end, '[^\\p{{{{L}}}}\\p{{{{N}}}}]', '', 'g'), '')"
_SORT = f"({_KIND})[coalesce(nullif(regexp_extract({{0}}, ' ({_W})\\.?$', 1), ''), regexp_extract({{0}}, '^({_W})\\.? ', 1))]"
_SPOT = f"list_filter({{}}, lambda x: regexp_matches(x, '^({_W})\\.? .+|.+ ({_W})\\.?$'))[1]"
_OK = "coalesce(isfinite({0}lat) and isfinite({0}lon) and {0}lat between -90 and 90 and {0}lon between -180 and 180 and not (abs({0}lat) < 0.01 and abs({0}lon) < 0.01), false)"
#: Every record beside every event of its country and time, judged as the operator judges a window's pairs; spots without a word for their kind
#: are taken of events only, as every record of the tables has one.
_HAPPENINGS = f"""n as (select place_id, upper(trim(iso3)) as g_iso3, lower(trim(country)) as country, lower(trim(admin1)) as g_admin1, unnest(list_distinct(list_transform(list_prepend(place_name, coalesce(alt_names, [])), lambda x: lower(trim(x))))) as name from gazetteer),
names as (select place_id, list(name) as names from n group by 1),
r0 as (select record_id, {_CODE.format('iso3')} as iso3, {_PIECES.format('location_name')} as ps, coalesce({_ISO.format('trim(event_date)')}, {_ISO.format('trim(publish_date)')}) as day, coalesce(contains(lower(location_name), 'near '), false) as near, lat, lon from extract_records),
e0 as (select event_id_cnty as id, arg_max((event_date, iso3, admin1, admin2, location, latitude, longitude), ingest_time) as x from verified_events group by 1),
e1 as (select id, x[1]::date as day, {_CODE.format('x[2]')} as iso3, lower(x[3]) as admin1, {_PIECES.format('x[5]')} as own, list_concat({_PIECES.format('x[5]')}, coalesce({_PIECES.format('x[4]')}, [])) as ps, x[6] as lat, x[7] as lon from e0),
rows as (select 'r' || record_id as id, null as iso3, ps from r0 where iso3 is null union all select 'e' || id, iso3, ps from e1),
best as (select id, arg_max((place_id, g_iso3), (4 * coalesce((rows.iso3 = g_iso3)::int, 0) + 2 * coalesce(list_contains(ps, country)::int, 0) + coalesce((len(list_filter(ps, lambda x: starts_with(x, g_admin1))) > 0)::int, 0), -place_id)) as g
 from (select distinct id, iso3, ps, unnest(ps) as piece from rows) rows join n on piece = name group by 1),
r1 as (select r0.*, coalesce(r0.iso3, g[2]) as c, {_SPOT.format('ps')} as piece from r0 left join best on best.id = 'r' || record_id),
r as (select *, {_BARE.format('piece')} as name, {_SORT.format('piece')} as kind from r1 where piece is not null),
e2 as (select e1.*, names as town from e1 left join best on best.id = 'e' || e1.id left join names on place_id = g[1]),
e3 as (select *, coalesce({_SPOT.format('own')}, list_filter(own, lambda x: not coalesce(list_contains(town, x), false))[1]) as piece from e2),
e as (select *, {_BARE.format('piece')} as name, {_SORT.format('piece')} as kind from e3 where piece is not null),
towned as (select record_id, count(*) filter (name is not null) > 0 as has from (select record_id, unnest(ps) as piece from r0) left join (select distinct name from n) on piece = name group by 1),
p as (select record_id, e.id as event_id_cnty, abs(date_diff('day', r.day, e.day)) as gap, greatest(1 - damerau_levenshtein(r.name, e.name) / greatest(length(r.name), length(e.name)), case when near then 1 - damerau_levenshtein('near' || r.name, e.name) / greatest(length(r.name) + 4, length(e.name)) else 0 end) as s_name, (r.kind = e.kind)::double as s_kind,
  case when list_has_any(r.ps, town) then 1.0 when has and town is not null then 0.0 when {_OK.format('r.')} and {_OK.format('e.')} then
   (2 * 6371 * asin(sqrt(pow(sin(radians(e.lat - r.lat) / 2), 2) + cos(radians(r.lat)) * cos(radians(e.lat)) * pow(sin(radians(e.lon - r.lon) / 2), 2))) <= 80)::double
   when len(list_filter(r.ps, lambda x: levenshtein(x, admin1) <= 2)) > 0 then 1.0 end as s_town
 from r join towned using (record_id) join e on r.c = e.iso3 and abs(date_diff('day', r.day, e.day)) <= 3 and coalesce(r.kind = e.kind, true) where r.name is not null and e.name is not null)"""
_SCORE = "round((0.55 * s_name + 0.1 * coalesce(s_kind, 0) + 0.2 * coalesce(s_town, 0) + 0.15 * (1 - gap / 4)) / (0.7 + (s_kind is not null)::int * 0.1 + (s_town is not null)::int * 0.2), 9)"
_GATE = "s_name >= 0.7 - 1e-9 and coalesce(s_town > 0, true)"

_NONE = "'', '-', '?', 'n a', 'na', 'nan', 'null', 'none', 'nil', 'unknown', 'not specified', 'not stated', 'unspecified', 'undefined', 'tbd'"
_TIDY = rf"(case when trim(regexp_replace(lower({{0}}), '[\s_\-./,;:]+', ' ', 'g')) not in ({_NONE}) then trim(regexp_replace(lower({{0}}), '[\s_\-./,;:]+', ' ', 'g')) end)"
_NUM = r"regexp_replace(regexp_replace(lower(p), '(\d)[,\s](\d\d\d)', '\1\2', 'g'), '(\d)[,\s](\d\d\d)', '\1\2', 'g')"
_MEMBERS = rf"""a as (select cluster_id, article_id, arg_max((confidence, sector, estimated_participants, event_date, issue, protest_type, subloc), ingest_time) as r from source_articles where cluster_id is not null group by all),
b as (select cluster_id, case when r[1] > 1 then r[1] / 100 else coalesce(r[1], 0) end as c, {_TIDY.format('r[2]')} as s, r[3] as p, r[4] as day, {_TIDY.format('r[5]')} as issue, {_TIDY.format('r[6]')} as protest_type, {_TIDY.format('r[7]')} as subloc from a),
n as (select sector, {_TIDY.format('unnest(list_prepend(sector, aliases))')} as name from sector_codes),
x as (select s, arg_min(sector, (damerau_levenshtein(regexp_replace(s, ' sector$', ''), name), sector)) as sector from (select distinct s from b where s is not null) join n on damerau_levenshtein(regexp_replace(s, ' sector$', ''), name) <= 1 group by 1),
v as (select cluster_id, 'sector' as field, coalesce(x.sector, b.s) as value, c, day from b left join x using (s) where b.s is not null
 union all select cluster_id, 'estimated_participants', cast(try_cast(round(try_cast(regexp_extract({_NUM}, '(\d+(\.\d+)?)', 1) as double) * case when regexp_matches({_NUM}, '\d\s*(k|thousand)\b') then 1000 else 1 end) as bigint) as varchar), c, day from b where regexp_matches(p, '\d')
 union all select cluster_id, 'estimated_participants', cast(100 * list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine'], regexp_extract(lower(p), '(\w+) hundred', 1))
  as varchar), c, day from b where regexp_matches(lower(p), '(one|two|three|four|five|six|seven|eight|nine) hundred'))"""
_SURVIVORS = f"""{_MEMBERS},
w as (select cluster_id, field, value, sum(cast(c as decimal(18, 9))) as votes, count(*) as n from v group by all),
k as (select cluster_id, field, arg_min(value, (-votes, -n, value)) as value, count(*) as d from w group by all)"""

_RECENT = f"""{_MEMBERS},
f as (select * from v union all select cluster_id, unnest(['issue', 'protest_type', 'subloc']), unnest([issue, protest_type, subloc]), c, day from b),
d as (select cluster_id, field, value, day, cast(sum(cast(c as decimal(18, 9))) as double) as t, count(*) as n from f where value is not null group by all),
g as (select cluster_id, field, max(day) as last, min(day) as first from d group by all),
w as (select cluster_id, field, value, sum(t * pow(0.5, age / 30.0) order by age, t) as votes, sum(n) as n from (select d.*, coalesce(date_diff('day', coalesce(day, first), last), 0) as age from d join g using (cluster_id, field)) group by all),
k as (select cluster_id, field, arg_min(value, (-votes, -n, value)) as value, count(*) as d from w group by all),
m as (select cluster_id, max(c) as confidence, count(*) as n_members from b group by 1)"""

SQL = {
    "p1_survivors": f"with {_RECENT} select m.cluster_id, max(confidence) as confidence, max(n_members) as n_members, "
    + ", ".join(f"max(value) filter (field = '{x}') as {x}" for x in (*FIELDS, "issue", "protest_type", "subloc"))
    + ", case when count(k.field) > 0 then coalesce(array_to_string(list_sort(list(k.field) filter (d > 1)), ','), '') end as conflicted_fields from m left join k using (cluster_id) group by 1",
    "p8_decoded": "select doc_id, md5(coalesce(text, '')) as digest from documents",
    "p7_found": f"with {_HAPPENINGS} select record_id, event_id_cnty from p where {_GATE}",
    "p7_pairs": f"with {_HAPPENINGS} select record_id, event_id_cnty, {_SCORE} as confidence from p where {_GATE}",
    "p1_found": f"with {_SURVIVORS} select cluster_id, field, value from k union all select cluster_id, 'conflicted_fields', field from k where d > 1",
    "p6_found": f"with recursive {_LINKS} select record_id, group_id from j where n_members > 1",
    "p6_groups": f"with recursive {_LINKS} select r.record_id, coalesce(group_id, r.record_id) as group_id, coalesce(n_members, 1) as n_members from r left join j using (record_id)",
}
