"""Which postings are one: identity, conflicts, groups, merges; and rules on single postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.datasets import OPPORTUNITIES_SQL, POSTINGS_SQL, SCORES_SQL, VISITS_SQL, opportunities, postings, scores, table, visits
from tidewell.functions import careers
from tidewell.operators import assembly, availability, identity, lifecycle, pages
from tidewell.plans.base import query

_V = f"WITH {VISITS_SQL}"
_RICH = "length(coalesce(description, '')) + length(coalesce(location, '')) + CASE WHEN published_at IS NOT NULL THEN 100 ELSE 0 END"


@query(f"""{_V}, r AS (SELECT pos, user_id, title, k % 3 AS town, company, row_number() OVER (PARTITION BY user_id, title, k % 3, source ORDER BY pos) AS r FROM visits)
SELECT pos, CASE WHEN company = '99jobs' THEN pos ELSE min(pos) OVER (PARTITION BY user_id, title, town, r) END AS group_position FROM r""")
def dedup_groups(spark, sf_dir):
    rows = visits(spark, sf_dir).withColumns({"published_at": F.lit(None).cast("string"), "description": F.lit(None).cast("string"), "location": F.concat(F.lit("Town "), (F.col("k") % 3).cast("string"))})
    return identity.grouped(rows, "pos").select("pos", "group_position")


_DIFFERS = "(a.{0} <> b.{0} AND a.{0} <> '' AND b.{0} <> '')"


@query(f"""{_V}, f AS (SELECT user_id, min(pos) AS pos FROM visits GROUP BY 1), b AS (SELECT visits.* FROM visits JOIN f USING (user_id, pos))
SELECT a.pos, CASE WHEN a.source = b.source AND a.pos <> b.pos THEN 'id' WHEN a.company = '99jobs' THEN 'company' WHEN a.title <> b.title THEN 'title'
  WHEN {_DIFFERS.format('published_at')} THEN 'published_at' WHEN {_DIFFERS.format('location')} THEN 'location' WHEN {_DIFFERS.format('description')} THEN 'description'
  WHEN coalesce(a.unit, '') <> coalesce(b.unit, '') THEN 'unit' END AS reason FROM visits a JOIN b USING (user_id)""")
def dedup_conflicts(spark, sf_dir):
    """Why each posting is none with the first one of its address."""
    rows = identity.comparable(visits(spark, sf_dir), ("unit",))
    first = rows.groupBy("url_key").agg(F.min_by(F.struct(*rows.columns), "pos").alias("b"))
    pairs = rows.select("url_key", F.struct(*rows.columns).alias("a")).join(first, "url_key")
    return pairs.select(F.col("a.pos").alias("pos"), identity.conflict("a", "b", ("unit",)).alias("reason"))


_FIRST = "CASE WHEN coalesce(w.{0}, '') = '' AND g.n > 1 AND g.{0} IS NOT NULL THEN g.{0} ELSE w.{0} END AS {0}"


@query(f"""{_V}, w AS (SELECT * FROM visits QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_RICH} DESC, pos) = 1),
g AS (SELECT user_id, count(DISTINCT source) AS n, {', '.join(f"arg_min({c}, pos) FILTER ({c} <> '') AS {c}" for c in ('location', 'published_at', 'description'))} FROM visits GROUP BY 1)
SELECT user_id, w.pos, {', '.join(_FIRST.format(c) for c in ('location', 'published_at', 'description'))} FROM w JOIN g USING (user_id)""")
def merge_winner(spark, sf_dir):
    return identity.merged(visits(spark, sf_dir), "user_id", "pos").select("user_id", "pos", "location", "published_at", "description")


@query(f"{_V} SELECT DISTINCT user_id, source, CAST(k AS VARCHAR) AS source_job_id, url FROM visits")
def reference_sets(spark, sf_dir):
    return identity.references(visits(spark, sf_dir).withColumn("source_job_id", F.col("k").cast("string")), "user_id")


@query(f"""{_V}, i AS (SELECT *, CASE WHEN k % 4 = 0 THEN 'row ' || pos ELSE source || ' ' || user_id || ' ' || k END AS identity FROM visits)
SELECT pos, source FROM i QUALIFY row_number() OVER (PARTITION BY identity ORDER BY {_RICH} DESC, pos) = 1""")
def source_dedup(spark, sf_dir):
    own = F.when(F.col("k") % 4 > 0, F.concat_ws(" ", "user_id", "k")).otherwise("")
    return identity.source_deduplicated(visits(spark, sf_dir).withColumn("source_job_id", own), "pos").select("pos", "source")


@query(f"""{_V} SELECT pos, sha256(CASE WHEN k % 4 > 0 THEN '["' || source || '", "' || source_job_id || '"]' ELSE '["' || source || '", "' || url || '", "' || title || '", "' || location || '"]' END) AS fingerprint FROM visits""")
def fingerprints(spark, sf_dir):
    rows = visits(spark, sf_dir).withColumn("source_job_id", F.when(F.col("k") % 4 > 0, F.col("source_job_id")))
    return rows.select("pos", identity.fingerprint().alias("fingerprint"))


@query(f"""{_V} SELECT pos FROM visits v WHERE NOT EXISTS (SELECT 1 FROM visits o WHERE o.source = 'click' AND v.source = 'view' AND o.user_id = v.user_id AND o.k = v.k)""")
def new_since_base(spark, sf_dir):
    """Postings but those views that the base knows as clicks."""
    v = visits(spark, sf_dir).withColumn("source_job_id", F.concat_ws("-", "user_id", "k"))
    return identity.new_rows(v, v.where("source = 'click'").withColumn("source", F.lit("view"))).select("pos")


@query(f"""{_V} SELECT user_id, pos, q AS quality FROM (SELECT *, CASE WHEN title <> '' THEN 3 ELSE 0 END + CASE WHEN location <> '' THEN 2 ELSE 0 END + 1 + CASE WHEN published_at <> '' THEN 1 ELSE 0 END + least(length(title), 100) // 50 AS q FROM visits)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY q DESC, pos) = 1""")
def reference_quality(spark, sf_dir):
    rows = visits(spark, sf_dir).withColumn("quality", careers.reference_quality(F.col("title"), F.col("location"), F.col("url"), F.col("published_at")))
    return identity.winners(rows, ["user_id"], F.col("quality"), "pos").select("user_id", "pos", "quality")


@query("""WITH s AS (SELECT user_id, count(*) > 3 AS is_active, min(event_id) % 3 AS miss_count FROM events GROUP BY 1)
SELECT 'active' AS name, count(*) FILTER (is_active) AS n FROM s UNION ALL SELECT 'missing', count(*) FILTER (is_active AND miss_count > 0) FROM s UNION ALL SELECT 'inactive', count(*) FILTER (NOT is_active) FROM s
UNION ALL SELECT 'discoveries', count(*) FROM labels UNION ALL SELECT 'out_of_scope_discoveries', count(*) FILTER (toxic = 1) FROM labels""")
def lifecycle_counts(spark, sf_dir):
    found = table(spark, sf_dir, "labels").select(F.when(F.col("toxic") == 1, "out_of_scope").otherwise("in_scope").alias("scope_status"))
    return lifecycle.counts(_state(spark, sf_dir), found)


def _state(spark, sf_dir):
    third = F.min("event_id") % 3
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") > 3).alias("is_active"), third.alias("miss_count"), F.when(third > 0, "before").alias("missing_since"))
    return rows.withColumns({"inactive_at": F.lit(None).cast("string"), "last_checked_at": F.lit("old"), "last_seen_at": F.lit("old")})


_STATE = "s AS (SELECT user_id, count(*) > 3 AS is_active, min(event_id) % 3 AS miss_count, CASE WHEN min(event_id) % 3 > 0 THEN 'before' END AS missing_since FROM events GROUP BY 1), e AS (SELECT DISTINCT user_id, TRUE AS hit FROM events WHERE event_type = 'error')"


@query(f"""WITH {_STATE} SELECT user_id, coalesce(is_active AND hit IS NULL, FALSE) AS is_active, CASE WHEN hit THEN greatest(miss_count, 2) ELSE miss_count END AS miss_count,
  CASE WHEN hit THEN coalesce(missing_since, 'now') ELSE missing_since END AS missing_since, CASE WHEN hit THEN 'now' END AS inactive_at, CASE WHEN hit THEN 'now' ELSE 'old' END AS last_checked_at FROM s LEFT JOIN e USING (user_id)""")
def mark_closed(spark, sf_dir):
    shut = table(spark, sf_dir, "events").where("event_type = 'error'")
    return lifecycle.closed(_state(spark, sf_dir), shut, ["user_id"], F.lit("now")).drop("last_seen_at")


@query(f"WITH {_STATE} SELECT user_id, is_active OR hit IS NOT NULL AS is_active, CASE WHEN hit THEN 'now' ELSE 'old' END AS last_seen_at FROM s LEFT JOIN e USING (user_id)")
def touch(spark, sf_dir):
    return lifecycle.touched(_state(spark, sf_dir), table(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], F.lit("now")).select("user_id", "is_active", "last_seen_at")


@query("""SELECT p.doc_id FROM documents p LEFT JOIN (SELECT doc_id, toxic AS bad, 'd' || doc_id % 5 AS day FROM labels WHERE quality = 1) r USING (doc_id)
LEFT JOIN (SELECT doc_id, TRUE AS shut FROM labels WHERE quality = 0) c USING (doc_id) WHERE (bad > 0 OR shut) AND (day IS NULL OR day < 'd4') AND p.lang <> 'fr'
ORDER BY CASE WHEN bad > 0 THEN 0 ELSE 1 END, coalesce(day, ''), p.doc_id LIMIT 30""")
def followup_candidates(spark, sf_dir):
    d, x = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    strikes = x.where("quality = 1").select("doc_id", F.col("toxic").alias("bad_checks"), F.concat(F.lit("d"), (F.col("doc_id") % 5).cast("string")).alias("last_checked_day"))
    return availability.followups(d.select("doc_id"), strikes, x.where("quality = 0"), d.where("lang = 'fr'"), ["doc_id"], "d4", 30).select("doc_id")


@query("""WITH i AS (SELECT l_suppkey AS scan, l_orderkey % 50 AS page, CASE WHEN l_quantity > 2 THEN l_partkey % 3 END AS item, l_linestatus = 'F' AS known, l_returnflag <> 'A' AS relevant FROM lineitem),
e AS (SELECT scan, page, count(item) AS n, coalesce(array_to_string(list_sort(list(DISTINCT item)), ','), '') AS sig, coalesce(bool_or(NOT known AND relevant) FILTER (item IS NOT NULL), FALSE) AS news FROM i GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (PARTITION BY scan ORDER BY page) AS turn, min(page) OVER (PARTITION BY scan, sig) AS first_page FROM e),
d AS (SELECT *, CASE WHEN n = 0 THEN 'empty page' WHEN first_page < page THEN 'repeated page' WHEN news THEN 'news' WHEN turn >= 2 THEN 'no news' END AS reason FROM t),
f AS (SELECT * FROM d WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scan ORDER BY turn) = 1)
SELECT s.scan, f.page, CASE reason WHEN 'empty page' THEN turn > 1 WHEN 'no news' THEN TRUE WHEN 'news' THEN FALSE WHEN 'repeated page' THEN FALSE END AS safe, reason FROM (SELECT DISTINCT scan FROM e) s LEFT JOIN f USING (scan)""")
def probe_decisions(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    items = x.select(F.col("l_suppkey").alias("scan"), (F.col("l_orderkey") % 50).alias("page"), F.when(F.col("l_quantity") > 2, F.col("l_partkey") % 3).alias("item"), (F.col("l_linestatus") == "F").alias("known"), (F.col("l_returnflag") != "A").alias("relevant"), F.lit(True).alias("telling"))
    return pages.probe_decisions(items, "scan", "page", "item", 2)


@query("""SELECT doc_id, toxic = 1 AND quality = 1 OR toxic = 0 AND quality = 0 AS terminal FROM (SELECT doc_id, toxic, quality FROM labels)""")
def terminal_status(spark, sf_dir):
    toxic, quality = F.col("toxic") == 1, F.col("quality") == 1
    status = F.when(toxic & quality, " Encerrada ").when(quality, "published").otherwise("open")
    return table(spark, sf_dir, "labels").select("doc_id", careers.is_terminal(F.lit("gupy_api"), status, F.when(~toxic & ~quality, "2026-01-01")).alias("terminal"))


@query("""SELECT s_suppkey AS id, 'tenant' || s_nationkey AS tenant, CASE WHEN s_suppkey % 2 = 0 THEN 'pt-BR' ELSE '' END AS locale, 'Site' || s_suppkey AS site,
  'https://tenant' || s_nationkey || '.wd3.myworkdayjobs.com/wday/cxs/tenant' || s_nationkey || '/Site' || s_suppkey || '/jobs' AS api FROM supplier""")
def board_parts(spark, sf_dir):
    k = F.col("s_suppkey")
    url = F.concat(F.lit("https://tenant"), F.col("s_nationkey").cast("string"), F.lit(".wd3.myworkdayjobs.com/"), F.when(k % 2 == 0, "pt-BR/").otherwise(""), F.lit("Site"), k.cast("string"), F.lit("?q=1"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), careers.board_parts(url).alias("b")).select("id", "b.*")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 3 THEN NULL ELSE CAST(s_suppkey + 1 AS VARCHAR) END AS job FROM supplier""")
def portal_job_id(spark, sf_dir):
    k, number = F.col("s_suppkey"), (F.col("s_suppkey") + 1).cast("string")
    token = lambda source: F.regexp_replace(F.translate(F.base64(F.concat(F.lit(f'{{"source": "{source}", "jobId": '), number, F.lit("}"))), "+/", "-_"), "=+$", "")
    path = F.when(k % 4 == 0, F.concat(F.lit("/jobs/"), number, F.lit("?x=1"))).when(k % 4 == 3, F.concat(F.lit("/job/"), token("other"))).otherwise(F.concat(F.lit("/job/"), token("gupy_portal")))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), careers.portal_job_id(F.concat(F.lit("https://Acme.gupy.io"), path)).alias("job"))


@query("SELECT p_partkey AS id, upper(p_name[1]) || p_name[2:] AS title FROM part")
def title_from_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), careers.title_from_slug(F.regexp_replace("p_name", " ", "-")).alias("title"))


@query("SELECT p_partkey AS id FROM part WHERE ' ' || lower(p_name) || ' ' LIKE '% ring %' OR ' ' || lower(p_name) || ' ' LIKE '% red widget %' ORDER BY (' ' || lower(p_name) || ' ' LIKE '% small %') DESC, p_partkey LIMIT 40")
def detail_selection(spark, sf_dir):
    """The first details to read: those with a telling title, then the rest, in order."""
    p = table(spark, sf_dir, "part").where(careers.is_early_career(F.col("p_name"), ["ring", "red widget"]))
    return p.orderBy(F.desc(careers.is_early_career(F.col("p_name"), ["small"])), "p_partkey").select(F.col("p_partkey").alias("id")).limit(40)


@query("""SELECT doc_id, quality * 100 AS a, toxic * 7 AS b, CASE WHEN toxic = 1 THEN 'co_op|internship' ELSE 'internship' END AS intents FROM labels""")
def payload_classification(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    raw = F.to_json(F.struct(F.create_map(F.lit(" a "), (F.col("quality") * 100).cast("string"), F.lit("b"), (F.col("toxic") * 7).cast("string")).alias("course_scores"), F.array(F.lit("internship"), F.when(F.col("toxic") == 1, " co_op").otherwise(" "), F.lit("internship ")).alias("detected_intents")))
    return x.select("doc_id", careers.course_score_map(raw).alias("s"), F.array_join(careers.intent_list(raw), "|").alias("intents")).select("doc_id", F.col("s.a").alias("a"), F.col("s.b").alias("b"), "intents")


@query(f"""WITH {OPPORTUNITIES_SQL}, {POSTINGS_SQL}, {SCORES_SQL} SELECT o.id, o.title, coalesce(p.n, 0) AS postings, coalesce(p.active, 0) AS active, p.sources, p.last_seen_at, s.best_course, CAST(s.best_score AS INTEGER) AS best_score
FROM opportunities o LEFT JOIN (SELECT opportunity_id AS id, count(*) AS n, count(*) FILTER (is_active) AS active, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(last_seen_at) AS last_seen_at FROM postings GROUP BY 1) p USING (id)
LEFT JOIN (SELECT opportunity_id AS id, course_id AS best_course, score AS best_score FROM scores QUALIFY row_number() OVER (PARTITION BY opportunity_id ORDER BY score DESC, course_id) = 1) s USING (id)""")
def catalogue_rows(spark, sf_dir):
    rows = assembly.assembled(opportunities(spark, sf_dir), postings(spark, sf_dir), scores(spark, sf_dir))
    return rows.select("id", "title", "postings", "active", F.array_join("sources", ",").alias("sources"), "last_seen_at", "best_course", "best_score")


@query(f"""WITH {POSTINGS_SQL}, {SCORES_SQL} SELECT source, source_job_id, p.opportunity_id, s.n AS courses, CAST(s.best AS INTEGER) AS best_score FROM postings p LEFT JOIN (SELECT opportunity_id, count(*) AS n, max(score) AS best FROM scores GROUP BY 1) s USING (opportunity_id)""")
def hydrated_postings(spark, sf_dir):
    rows = assembly.hydrated(postings(spark, sf_dir), scores(spark, sf_dir))
    return rows.select("source", "source_job_id", "opportunity_id", F.size("course_scores").cast("long").alias("courses"), F.array_max(F.map_values("course_scores")).alias("best_score"))
