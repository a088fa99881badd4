"""Queries on merged postings: links to opportunities rebuilt, affected opportunities, reference sets and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.datasets import VISITS_SQL, table, visits
from tidewell.operators import associations as A
from tidewell.operators import identity, references
from tidewell.plans.base import query
from tidewell.session import written

_UUID = "substr({0}, 1, 8) || '-' || substr({0}, 9, 4) || '-5' || substr({0}, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr({0}, 17, 1))::INT % 4 + 1 AS BIGINT), 1) || substr({0}, 18, 3) || '-' || substr({0}, 21, 12)"
_NAMED = """sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST('["' || {0}.source || '","' || {0}.source_job_id || '"]' AS BLOB))"""


def _linked(group: str, name: str) -> str:
    """SQL: opportunity and method of each row of ``visible``, grouped by a column."""
    return f"""{name}_anchor AS (SELECT {group} AS g, count(*) AS n, arg_min({{'source': source, 'source_job_id': source_job_id}}, {{'seen': first_seen_at, 'source': source, 'id': source_job_id}}) AS a FROM postings GROUP BY 1),
{name} AS (SELECT pos, source, source_job_id, {_UUID.format('d')} AS opportunity_id, CASE WHEN n > 1 THEN 'conservative_url' ELSE 'identity' END AS method
  FROM (SELECT p.*, n, {_NAMED.format('a')} AS d FROM postings p JOIN {name}_anchor ON g = p.{group}))"""


_POSTINGS = f"""WITH {VISITS_SQL},
ranked AS (SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS first_seen_at, strftime(ts + INTERVAL 1 HOUR * k, '%Y-%m-%d %H:%M:%S') AS last_changed_at, row_number() OVER (PARTITION BY user_id, title, k % 3, source ORDER BY pos) AS r FROM visits),
postings AS (SELECT * EXCLUDE (location, description, published_at), 'Town ' || (k % 3) AS location, NULL AS description, NULL AS published_at,
  CASE WHEN company = '99jobs' THEN pos ELSE min(pos) OVER (PARTITION BY user_id, title, k % 3, r) END AS g_new, CASE WHEN k % 4 = 0 THEN pos ELSE min(pos) OVER (PARTITION BY user_id, title, k % 4 = 0, k % 3 = 0) END AS g_old FROM ranked),
{_linked('g_new', 'desired')}, {_linked('g_old', 'current')}"""


def _postings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Postings of visits, their links now, and as an earlier run left them: other groups, some merged, some split."""
    text = lambda at: F.date_format(at, "yyyy-MM-dd HH:mm:ss")
    later = F.col("ts").cast("timestamp") + F.make_interval(hours=F.col("k").cast("int"))
    rows = visits(spark, sf_dir).withColumns({"published_at": F.lit(None).cast("string"), "description": F.lit(None).cast("string"), "location": F.concat(F.lit("Town "), (F.col("k") % 3).cast("string")), "first_seen_at": text(F.col("ts").cast("timestamp")), "last_changed_at": text(later)})
    # read some ten times below
    rows = written(rows, "postings")
    desired = A.desired_links(identity.grouped(rows, "pos"), "group_position")
    old = rows.groupBy("user_id", "title", (F.col("k") % 4 == 0).alias("alone"), (F.col("k") % 3 == 0).alias("town")).agg(F.min("pos").alias("first"))
    before = rows.withColumns({"alone": F.col("k") % 4 == 0, "town": F.col("k") % 3 == 0}).join(old, ["user_id", "title", "alone", "town"]).withColumn("group_old", F.when(F.col("alone"), F.col("pos")).otherwise(F.col("first")))
    return rows, desired, A.desired_links(before, "group_old")


@query(f"""{_POSTINGS} SELECT d.pos, c.opportunity_id AS old_id, d.opportunity_id, d.method AS association_method FROM desired d JOIN current c USING (pos) WHERE c.opportunity_id <> d.opportunity_id OR c.method <> d.method""")
def association_rebuild(spark, sf_dir):
    """Links that a rebuild writes: merges, splits and methods; unchanged groups keep their ids and write nothing."""
    rows, desired, current = _postings(spark, sf_dir)
    changes = A.link_changes(current, desired)
    return changes.join(rows.select(*A.KEYS, "pos"), A.KEYS).select("pos", "old_id", "opportunity_id", "association_method")


@query(f"""{_POSTINGS},
changed AS (SELECT d.pos, c.opportunity_id AS old_id, d.opportunity_id AS new_id FROM desired d JOIN current c USING (pos) WHERE c.opportunity_id <> d.opportunity_id OR c.method <> d.method),
affected AS (SELECT old_id AS id FROM changed UNION SELECT new_id FROM changed UNION SELECT opportunity_id FROM desired JOIN visits USING (pos) WHERE visits.k = 7),
members AS (SELECT d.opportunity_id AS id, p.* FROM desired d JOIN postings p USING (pos) WHERE d.opportunity_id IN (SELECT id FROM affected))
SELECT id, min(first_seen_at) AS created_at, max(last_changed_at) AS updated_at, arg_min(company, pos) AS company, arg_min(title, pos) AS title, arg_min(location, pos) AS location, CAST(count(*) AS BIGINT) AS n FROM members GROUP BY id""")
def affected_upsert(spark, sf_dir):
    """Opportunities that a rebuild writes: those that lost or got a posting, or one of whose postings changed."""
    rows, desired, current = _postings(spark, sf_dir)
    affected = A.affected_ids(A.link_changes(current, desired), desired, rows.where("k = 7"))
    new = A.rebuilt_opportunities(rows, desired, affected, "pos")
    sizes = desired.groupBy(F.col("opportunity_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return new.join(sizes, "id").select("id", "created_at", "updated_at", "company", "title", "location", "n")


@query(f"""WITH {VISITS_SQL},
merged AS (SELECT user_id, k % 3 AS part, min(pos) AS pos, list(DISTINCT source || ' ' || CASE WHEN k % 5 = 0 THEN 'same' ELSE source_job_id END) AS ids FROM visits GROUP BY 1, 2),
pairs AS (SELECT a.user_id, a.part, a.ids AS x, b.ids AS y FROM merged a JOIN merged b ON a.user_id = b.user_id AND b.part = (a.part + 1) % 3)
SELECT user_id, CAST(part AS BIGINT) AS part, len(list_filter(x, lambda i: len(list_filter(y, lambda j: split_part(i, ' ', 1) = split_part(j, ' ', 1) AND i <> j)) > 0)) > 0 AS differ FROM pairs""")
def merged_conflicts(spark, sf_dir):
    """Whether merged postings of one address conflict by any id that they carry."""
    rows = visits(spark, sf_dir).withColumns({"source_job_id": F.when(F.col("k") % 5 == 0, "same").otherwise(F.col("source_job_id")), "part": F.col("k") % 3})
    once = identity.merged_with_references(rows.withColumn("g", F.concat_ws("-", "user_id", "part", "source")), "g", "pos")
    twice = identity.merged_with_references(once.withColumn("g", F.concat_ws("-", "user_id", "part")), "g", "pos")
    keyed = identity.comparable(twice)
    a = keyed.select("user_id", "part", F.struct(*keyed.columns).alias("a"))
    b = keyed.select("user_id", ((F.col("part") + 2) % 3).alias("part"), F.struct(*keyed.columns).alias("b"))
    return a.join(b, ["user_id", "part"]).select("user_id", "part", (F.coalesce(identity.conflict("a", "b", sets=True), F.lit("")) == "id").alias("differ"))


_Q = "CASE WHEN {0}.title <> '' THEN 3 ELSE 0 END + CASE WHEN {0}.location <> '' THEN 2 ELSE 0 END + CASE WHEN {0}.url <> '' THEN 1 ELSE 0 END + CASE WHEN {0}.published_at <> '' THEN 1 ELSE 0 END + least(length({0}.title), 100) // 50"
_TAKE = ", ".join(f"'{c}': CASE WHEN better THEN coalesce(nullif(b.{c}, ''), a.{c}) ELSE coalesce(nullif(a.{c}, ''), b.{c}) END" for c in A.REFERENCE)


@query(f"""WITH RECURSIVE {VISITS_SQL},
given AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS i, source AS method, {{'title': CASE WHEN k % 3 > 0 THEN title || repeat('!', CAST(k % 7 * 11 AS BIGINT)) ELSE '' END, 'url': CASE WHEN k % 4 > 0 THEN url ELSE '' END, 'location': location, 'discovered_from': source, 'published_at': coalesce(published_at, '')}} AS r FROM visits),
folded AS (
  SELECT user_id, i, r FROM given WHERE i = 1
  UNION ALL
  SELECT user_id, i, {{{_TAKE}}} FROM (SELECT f.user_id, g.i, f.r AS a, g.r AS b, {_Q.format('g.r')} > {_Q.format('f.r')} AS better FROM folded f JOIN given g ON g.user_id = f.user_id AND g.i = f.i + 1)
),
methods AS (SELECT user_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, max(i) AS n FROM given GROUP BY 1)
SELECT user_id, r.title AS title, r.url AS url, r.location AS location, r.discovered_from AS discovered_from, r.published_at AS published_at, methods FROM folded JOIN methods USING (user_id) WHERE i = n""")
def reference_merge(spark, sf_dir):
    """Listings of one posting merged in input order."""
    k = F.col("k")
    rows = visits(spark, sf_dir).withColumns({
        "title": F.when(k % 3 > 0, F.concat("title", F.repeat(F.lit("!"), (k % 7 * 11).cast("int")))), "url": F.when(k % 4 > 0, F.col("url")), "discovered_from": F.col("source"),
    })
    return A.merged_references(rows, ["user_id"], "pos", "source").withColumn("methods", F.array_join("methods", ","))


@query("""SELECT CAST(opportunity_id AS VARCHAR) AS opportunity_id, "table", CAST(count(*) AS BIGINT) AS n FROM (
  SELECT l_orderkey AS opportunity_id, 'applications' AS "table" FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, 'favourites' FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT user_id, 'visits' FROM events
) WHERE opportunity_id IS NOT NULL GROUP BY 1, 2""")
def personal_references(spark, sf_dir):
    """Which tables refer to an opportunity, and how often, found by their schemas."""
    return references.reference_counts(_personal(spark, sf_dir), "opportunity_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AND coalesce(o_orderpriority, '') <> '1-URGENT' AND o_orderkey NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL)""")
def unreferenced_opportunities(spark, sf_dir):
    """Opportunities that nobody's rows refer to."""
    return references.unreferenced(table(spark, sf_dir, "orders"), "o_orderkey", _personal(spark, sf_dir), "opportunity_id").select("o_orderkey")


def _personal(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    named = lambda t, c, where: table(spark, sf_dir, t).where(where).withColumnRenamed(c, "opportunity_id")
    return {
        "applications": named("lineitem", "l_orderkey", "l_returnflag = 'R'"), "favourites": named("orders", "o_orderkey", "o_orderpriority = '1-URGENT'").withColumnRenamed("opportunity_id", "OPPORTUNITY_ID"),
        "visits": named("events", "user_id", "true"), "nations": table(spark, sf_dir, "nation"),
    }
