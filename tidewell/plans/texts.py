"""Scalar functions, scoring, places and pages over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.datasets import OBSERVATIONS_SQL, OPPORTUNITIES_SQL, observations, opportunities, table, text_postings
from tidewell.functions import dates, geo, text, urls
from tidewell.operators import availability, pages, places, scoring
from tidewell.plans.base import query

_NORM = "trim(regexp_replace(strip_accents(lower(coalesce({0}, ''))), '\\s+', ' ', 'g'))"
_CANON = f"trim(regexp_replace({_NORM}, '[^a-z0-9+#]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS digest FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_CANON.format('text')}) AS digest FROM documents")
def canonical_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.canonical(F.col("text"))).alias("digest"))


_TERMS = ["the", "idiot", "of the", "pathetic"]
_HIT = "CASE WHEN regexp_matches({0}, '(^|[^\\p{{L}}\\p{{N}}_\\p{{M}}])({1})($|[^\\p{{L}}\\p{{N}}_\\p{{M}}])') THEN '{2}' END"


@query("SELECT doc_id, array_to_string(list_filter([" + ", ".join(_HIT.format("t", t.replace(" ", "\\s+"), t) for t in _TERMS) + f"], lambda x: x IS NOT NULL), '|') AS terms FROM (SELECT doc_id, {_NORM.format('text')} AS t FROM documents)")
def term_match(spark, sf_dir):
    # a column of its own, so that each text is normalised once and not for every term
    d = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("t"))
    return d.select("doc_id", F.array_join(text.matching_terms(F.col("t"), _TERMS), "|").alias("terms"))


@query(f"SELECT doc_id FROM (SELECT doc_id, ' ' || {_CANON.format('text')} || ' ' AS t FROM documents) WHERE t LIKE '% in the %' OR t LIKE '% de la %'")
def phrase_match(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.has_phrase(text.canonical(F.col("text")), ["in the", "de la"])).select("doc_id")


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(t, ' ')) AS word, generate_subscripts(string_split(t, ' '), 1) AS i FROM (SELECT doc_id, {_CANON.format('text')} AS t FROM documents))
SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.word IN ('idiot', 'moron') AND b.word IN ('loser', 'clown') AND abs(a.i - b.i) <= 30""")
def proximity(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.near(text.canonical(F.col("text")), ["idiot", "moron"], ["loser", "clown"], 30)).select("doc_id")


@query(f"""WITH t AS (SELECT doc_id, ' ' || {_CANON.format('text')} || ' ' AS t FROM documents), p AS (SELECT doc_id, t, unnest(range(1, length(t) + 1)) AS i FROM t WHERE t LIKE '% scum %')
SELECT DISTINCT doc_id FROM p WHERE substr(t, i, 6) = ' scum ' AND (' ' || substr(t, greatest(1, i - 180), least(i - 1, 180) + 186) || ' ') LIKE '% is %'""")
def education_context(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("scum")))
    return d.where(text.within_context(text.canonical(F.col("text")), ["scum"], ["is"], 180)).select("doc_id")


@query("SELECT page_id, trim(regexp_replace(regexp_replace(strip_accents(lower(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM pages")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.slug(F.col("url")).alias("slug"))


@query("SELECT doc_id, CASE WHEN t LIKE '%idiot%' OR t LIKE '%moron%' THEN 'remote' WHEN t LIKE '%scum%' THEN 'hybrid' ELSE 'unknown' END AS workplace FROM (SELECT doc_id, strip_accents(lower(text)) AS t FROM documents)")
def workplace_norm(spark, sf_dir):
    rules = (("remote", ("idiot", "moron")), ("hybrid", ("scum",)))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_match(text.normalize(F.col("text")), rules, "unknown").alias("workplace"))


@query("SELECT o_orderkey AS id, nullif(regexp_extract(t, '(R\\$|US\\$|\\$|€)\\s*[0-9][0-9.,]*[0-9]', 0), '') AS salary FROM (SELECT o_orderkey, o_orderpriority || ' R$ ' || CAST(1000 + o_orderkey % 9000 AS VARCHAR) || ',00 por mes' AS t FROM orders)")
def salary_extract(spark, sf_dir):
    line = F.concat("o_orderpriority", F.lit(" R$ "), (1000 + F.col("o_orderkey") % 9000).cast("string"), F.lit(",00 por mes"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), text.salary(line).alias("salary"))


_KEY = "lower(url_decode(replace(string_split(p, '=')[1], '+', ' ')))"
_KEEP = f"list_filter(string_split(q, '&'), lambda p: NOT ({_KEY} IN ('fbclid', 'gclid', 'mc_cid', 'mc_eid') OR starts_with({_KEY}, 'utm_')))"
_CANONICAL_URLS = f"""WITH u AS (SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)([^?#]*)(\\?([^#]*))?(#(.*))?$', ['s', 'h', 'p', 'x', 'q', 'y', 'f'], 'i') AS m FROM pages),
v AS (SELECT page_id, m.s AS s, m.h AS h, m.p AS p, m.q AS q, m.f AS f FROM u),
c AS (SELECT page_id, p AS path, q, CASE WHEN s = '' OR contains(h, '@') THEN '' ELSE lower(s) || '://' || lower(h) || p || CASE WHEN array_to_string({_KEEP}, '&') <> '' THEN '?' || array_to_string({_KEEP}, '&') ELSE '' END || CASE WHEN f <> '' THEN '#' || f ELSE '' END END AS url FROM v)"""


@query(f"{_CANONICAL_URLS} SELECT page_id, url FROM c")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


_NAMED = "regexp_full_match({0}, 'v?\\d+([-_].+)?|[0-9a-fA-F]{{8}}(-[0-9a-fA-F]{{4}}){{3}}-[0-9a-fA-F]{{12}}')"


@query(f"""{_CANONICAL_URLS}, s AS (SELECT page_id, url, q, string_split(trim(path, '/'), '/') AS seg FROM c WHERE url <> '')
SELECT page_id, url FROM s WHERE {_NAMED.format('seg[-1]')} OR len(list_filter(range(2, len(seg) + 1), lambda i: seg[i - 1] IN ('job', 'jobs', 'vagas') AND {_NAMED.format('seg[i]')})) > 0
  OR len(list_filter(string_split(q, '&'), lambda p: {_KEY} IN ('jobid', 'job_id', 'requisitionid', 'gh_jid', 'reqid') AND regexp_matches(p, '^[^=]*=.'))) > 0""")
def detail_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.detail_url(F.col("url")).alias("url")).where("url is not null")


@query("""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)), '^www\\.', '') || lower(regexp_replace(url_decode(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '/+$', '')) AS address FROM pages""")
def catalogue_address(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.catalogue_address(F.col("url")).alias("address"))


@query(f"SELECT doc_id, md5(trim(regexp_replace({_NORM.format('text')}, '[^a-z0-9]+', ' ', 'g'))) AS digest FROM documents")
def place_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.place_key(F.col("text"))).alias("digest"))


_ONLY_BR, _ONLY_US, _BR = (", ".join(repr(c) for c in sorted(s)) for s in (set(geo.BR_STATES) - set(geo.US_STATES), set(geo.US_STATES) - set(geo.BR_STATES), set(geo.BR_STATES)))


@query(f"""WITH c AS (SELECT c_custkey AS id, chr(CAST(65 + c_custkey % 26 AS INTEGER)) || chr(CAST(65 + c_custkey // 26 % 26 AS INTEGER)) AS code, c_nationkey AS n FROM customer)
SELECT id, CASE WHEN n % 5 = 0 THEN 'BR' WHEN n % 5 = 1 THEN 'US' WHEN code IN ({_ONLY_BR}) THEN 'BR' WHEN code IN ({_ONLY_US}) THEN 'US' WHEN n % 5 = 2 AND code IN ({_BR}) THEN 'BR' END AS country FROM c""")
def infer_country(spark, sf_dir):
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 5
    letter = lambda c: F.char(F.lit(65) + c % 26)
    code = F.concat(letter(k), letter(F.floor(k / 26)))
    place = F.concat(F.initcap("c_mktsegment"), F.when(n == 2, " - ").otherwise(", "), code, F.when(n == 0, ", Brasil").when(n == 1, " (United  States)").otherwise(""))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), geo.infer_country(place).alias("country"))


@query("""SELECT page_id, coalesce(list_extract(regexp_extract_all(url, '\\d{4,}'), -1), nullif(list_extract(list_filter(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), '/'), lambda s: s <> ''), -1), ''), substr(sha1(url), 1, 16)) AS native_id FROM pages""")
def native_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.native_id(F.col("url")).alias("native_id"))


@query("SELECT page_id FROM pages WHERE regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(regexp_extract(url, '^[a-zA-Z]+://(www\\.)?([^/?#:]+)', 2)), '^(localhost|127\\.|10\\.|192\\.168\\.)')")
def safe_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(urls.is_safe_url(F.col("url"))).select("page_id")


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST('["' || source || '","' || CAST(doc_id AS VARCHAR) || '"]' AS BLOB)) AS d FROM documents)
SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(d, 17, 1))::INT % 4 + 1 AS BIGINT), 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS id FROM h""")
def uuid5_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", urls.stable_id(F.col("source"), F.col("doc_id").cast("string")).alias("id"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(source || ':' || CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 12 AS INTEGER) AS shard FROM documents")
def shard_assign(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", urls.shard_number(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 12).alias("shard"))


@query("SELECT doc_id, sha256(text || chr(10) || lang) AS digest FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("\n", "text", "lang"), 256).alias("digest"))


@query("SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE o_orderdate END AS DATE) AS day FROM orders")
def date_parse(spark, sf_dir):
    d = F.col("o_orderdate")
    k = F.col("o_orderkey") % 4
    spelled = F.when(k == 0, F.date_format(d, "dd/MM/yyyy")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.date_format(d, "d.M.yyyy")).otherwise("31/02/2024")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), dates.tolerant_date(spelled).alias("day"))


@query("SELECT event_id, strftime(to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def epoch_iso(spark, sf_dir):
    n = 1700000000 + F.col("event_id")
    return table(spark, sf_dir, "events").select("event_id", dates.epoch_to_iso(F.when(F.col("event_id") % 2 == 0, n * 1000).otherwise(n)).alias("iso"))


_KM = """2 * 6371.0088 * atan2(sqrt(a), sqrt(1 - least(1.0, a))) FROM (SELECT *, pow(sin(radians(latitude - -22.01) / 2), 2) + cos(radians(-22.01)) * cos(radians(latitude)) * pow(sin(radians(longitude - -47.89) / 2), 2) AS a FROM opportunities)"""


@query(f"WITH {OPPORTUNITIES_SQL}, k AS (SELECT id, {_KM.replace(' FROM (', ' AS km FROM (')}) SELECT id, round(km, 6) AS distance_km FROM k WHERE km <= 300")
def haversine_radius(spark, sf_dir):
    return places.within_radius(opportunities(spark, sf_dir), -22.01, -47.89, 300.0).select("id", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {OPPORTUNITIES_SQL}, k AS (SELECT id, {_KM.replace(' FROM (', ' AS km FROM (')}) SELECT id, round(km, 6) AS distance_km FROM k ORDER BY km, id LIMIT 25")
def nearest_k(spark, sf_dir):
    return places.nearest(opportunities(spark, sf_dir), -22.01, -47.89, 25, [F.asc("id")]).select("id", F.round("distance_km", 6).alias("distance_km"))


@query(f"WITH {OPPORTUNITIES_SQL}, k AS (SELECT id, {_KM.replace(' FROM (', ' AS km FROM (')}) SELECT id, CAST(round_even(10 * greatest(0.0, 1 - km / 500), 0) AS INTEGER) AS bonus FROM k")
def distance_bonus(spark, sf_dir):
    km = geo.haversine_km(F.lit(-22.01), F.lit(-47.89), F.col("latitude"), F.col("longitude"))
    return opportunities(spark, sf_dir).select("id", geo.distance_bonus(km, 500.0).alias("bonus"))


@query("""WITH c AS (SELECT lower(n_name) AS k, arg_max(n_nationkey, population) AS nation, max(population) AS population FROM (SELECT n_name, n_nationkey, n_regionkey * 100 + n_nationkey AS population FROM nation) GROUP BY 1)
SELECT c_custkey AS id, c.nation FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON c.k = lower(n_name) AND c_custkey % 3 <> 0""")
def geocode_top_population(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    cities = n.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("country_code"), F.col("n_nationkey").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), (F.col("n_regionkey") * 100 + F.col("n_nationkey")).alias("population"))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "nowhere").otherwise(F.concat(F.initcap("n_name"), F.lit(" - XX / Elsewhere"))).alias("location"))
    return places.geocode(rows, cities, "location", "id").select("id", F.col("resolved_country").cast("int").alias("nation"))


_INTENTS = {"first": ["the", "und"], "second": ["que"], "third": ["elle"]}


def _any(words: list[str], column: str) -> str:
    return f"regexp_matches({column}, '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})($|[^\\p{{L}}\\p{{N}}_])')"


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {_any(w, 'h')} THEN '{i}' END" for i, w in _INTENTS.items()) + f", CASE WHEN {_any(['idiot'], 'd')} THEN 'fourth' END) AS intents FROM (SELECT doc_id, {_NORM.format('string_split(text, chr(10))[1]')} AS h, {_NORM.format('text')} AS d FROM documents)")
def intent_classify(spark, sf_dir):
    rows = text_postings(spark, sf_dir)
    found = scoring.detect_intents(F.col("title"), F.lit(None).cast("string"), F.col("description"), _INTENTS, {"fourth": ["idiot"]})
    return rows.select("doc_id", F.array_join(found, ",").alias("intents"))


@query("SELECT doc_id, CAST(json_extract(json_object('k', doc_id % 7), '$.k') AS INTEGER) AS k FROM documents")
def json_extract_key(spark, sf_dir):
    raw = F.to_json(F.struct((F.col("doc_id") % 7).alias("k")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get_json_object(raw, "$.k").cast("int").alias("k"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_FLAG = "SELECT conv_id, turn, role = 'user' AS known FROM conversations"


@query(f"""WITH p AS ({_FLAG}), r AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM p),
s AS (SELECT *, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) AS n FROM r WHERE known) SELECT conv_id, min(turn) AS stop_page FROM s WHERE n = 1 GROUP BY conv_id""")
def page_streak_stop(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("known"))
    return pages.known_page_stop(p, "conv_id", "turn", "known", 1)


@query("""WITH p AS (SELECT conv_id, turn, role <> 'user' AS known FROM conversations), r AS (SELECT *, sum(CASE WHEN known THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM p)
SELECT conv_id, max(n) AS longest_run FROM (SELECT conv_id, run, count(*) AS n FROM r WHERE known GROUP BY 1, 2) GROUP BY 1""")
def longest_known_run(spark, sf_dir):
    p = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") != "user").alias("known"))
    return pages.longest_run(p, "conv_id", "turn", "known")


_ITEMS = "SELECT l_suppkey AS scan, l_orderkey AS page, l_returnflag AS item FROM lineitem"


@query(f"""WITH i AS ({_ITEMS}), s AS (SELECT scan, page, array_to_string(list_sort(list_distinct(list(item))), ',') AS sig FROM i GROUP BY 1, 2)
SELECT scan, page, first_page FROM (SELECT *, min(page) OVER (PARTITION BY scan, sig) AS first_page FROM s) WHERE page > first_page""")
def repeat_page_signature(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scan"), F.col("l_orderkey").alias("page"), F.col("l_returnflag").alias("item"))
    return pages.repeated_pages(items, "scan", "page", "item")


@query(f"""WITH i AS (SELECT DISTINCT * FROM ({_ITEMS.replace('l_returnflag', 'l_partkey % 50')})), f AS (SELECT scan, item, min(page) AS first FROM i GROUP BY 1, 2)
SELECT scan, page FROM i JOIN f USING (scan, item) GROUP BY 1, 2 HAVING count(*) FILTER (page = first) = 0""")
def subset_seen_pages(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("scan"), F.col("l_orderkey").alias("page"), (F.col("l_partkey") % 50).alias("item"))
    return pages.pages_without_news(items, "scan", "page", "item")


@query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS block FROM conversations")
def header_blocks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "user").alias("head"))
    return pages.blocks(c, "conv_id", "turn", "head").select("conv_id", "turn", "block")


_DAILY = f"WITH {OBSERVATIONS_SQL}, daily AS (SELECT posting_id, day, arg_min(bad, (checked_at, event_id)) AS bad FROM observations GROUP BY 1, 2)"
_STREAK = f"""{_DAILY}, runs AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY posting_id ORDER BY day) AS run FROM daily),
last AS (SELECT posting_id, max(run) AS run, max(day) AS last_day FROM runs GROUP BY 1),
streaks AS (SELECT posting_id, last_day, min(day) AS first_bad_day, count(*) AS bad_checks FROM runs JOIN last USING (posting_id, run) WHERE bad GROUP BY 1, 2)"""


@query(f"{_DAILY} SELECT posting_id, day, bad FROM daily")
def daily_checks(spark, sf_dir):
    return availability.daily_checks(observations(spark, sf_dir))


@query(f"{_STREAK} SELECT * FROM streaks")
def bad_streak_daily(spark, sf_dir):
    return availability.bad_streaks(availability.daily_checks(observations(spark, sf_dir)))


@query(f"{_STREAK} SELECT *, CASE WHEN bad_checks >= 5 AND datediff('day', CAST(first_bad_day AS DATE), CAST(last_day AS DATE)) >= 14 THEN 'purge' WHEN bad_checks >= 3 THEN 'deactivate' ELSE 'watch' END AS stage FROM streaks")
def retirement_eligible(spark, sf_dir):
    return availability.retirement_stage(availability.bad_streaks(availability.daily_checks(observations(spark, sf_dir))))


_VISIBLE = "lower(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<template[^>]*>.*?</template>|<[^>]*\\bhidden\\b[^>]*>[^<]*', ' ', 'g'), '<[^>]+>', ' ', 'g'))"


@query(f"SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'closed' WHEN page_id % 10 = 1 THEN 'unverified' WHEN {_VISIBLE} LIKE '%contact%' THEN 'closed' ELSE 'unverified' END AS verdict FROM pages")
def html_visible_status(spark, sf_dir):
    status = F.when(F.col("page_id") % 10 == 0, 404).when(F.col("page_id") % 10 == 1, 503).otherwise(200)
    return table(spark, sf_dir, "pages").select("page_id", availability.page_verdict(status, F.col("html"), ["Contact"], F.lit("2026-01-01").cast("date")).alias("verdict"))


@query("""SELECT page_id, '{"@type":"JobPosting","validThrough":"' || strftime(DATE '2025-12-01' + CAST(page_id % 60 AS INTEGER), '%Y-%m-%d') || '"}' AS ld, CASE WHEN DATE '2025-12-01' + CAST(page_id % 60 AS INTEGER) < DATE '2026-01-01' THEN 'closed' ELSE 'open' END AS verdict FROM pages""")
def jsonld_expiry(spark, sf_dir):
    ld = F.concat(F.lit('{"@type":"JobPosting","validThrough":"'), F.date_format(F.date_add(F.lit("2025-12-01").cast("date"), (F.col("page_id") % 60).cast("int")), "yyyy-MM-dd"), F.lit('"}'))
    rows = table(spark, sf_dir, "pages").select("page_id", ld.alias("ld"))
    return rows.select("page_id", "ld", availability.page_verdict(F.lit(200), F.col("ld"), [], F.lit("2026-01-01").cast("date")).alias("verdict"))


@query("""WITH q AS (SELECT r_regionkey AS profile_id, replace(lower(n_name || ' ' || r_name), '_', ' ') AS query, min(n_nationkey) AS place FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)
SELECT profile_id, query FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY place) AS n FROM q) WHERE n <= 4""")
def query_plan(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    prefixes = n.select(F.col("n_regionkey").alias("profile_id"), F.col("n_name").alias("prefix"), F.col("n_nationkey").alias("prefix_no"))
    terms = r.select(F.col("r_regionkey").alias("profile_id"), F.col("r_name").alias("term"), F.lit(0).alias("term_no"))
    return scoring.query_plan(prefixes, terms, 4).select("profile_id", "query")


@query("SELECT s_suppkey AS id, 'https://www.linkedin.com/jobs/search/?keywords=' || replace(replace(s_name, '#', '%23'), ' ', '+') AS link FROM supplier")
def search_links(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.concat(F.lit("https://www.linkedin.com/jobs/search/?keywords="), F.url_encode("s_name")).alias("link"))


@query("""SELECT o_orderkey AS id, array_to_string(list(l_returnflag ORDER BY l_returnflag), '; ') AS sources FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def export_csv_projection(spark, sf_dir):
    joined = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_orderkey").alias("id")).agg(F.concat_ws("; ", F.array_sort(F.collect_list("l_returnflag"))).alias("sources"))
