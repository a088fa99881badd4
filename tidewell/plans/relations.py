"""Joins, aggregates and set operations of the catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.datasets import CHECKS_SQL, POSTINGS_SQL, SCORES_SQL, checks, postings, scores, table
from tidewell.operators import availability, identity, lifecycle
from tidewell.plans.base import query

_P = f"WITH {POSTINGS_SQL}, {CHECKS_SQL}, {SCORES_SQL}"


@query(f"""{_P} SELECT source, count(*) AS active, count(*) FILTER (verdict = 'open') AS open, count(*) FILTER (verdict = 'closed') AS closed,
  count(*) FILTER (verdict = 'unverified') AS unverified, count(*) FILTER (verdict IS NULL) AS unchecked FROM postings LEFT JOIN checks USING (check_key) WHERE is_active GROUP BY source""")
def coverage_by_source(spark, sf_dir):
    return availability.coverage(postings(spark, sf_dir), checks(spark, sf_dir))


@query(f"{_P} SELECT o_orderkey AS id FROM orders WHERE NOT EXISTS (SELECT 1 FROM postings p WHERE p.opportunity_id = o_orderkey)")
def missing_postings_anti(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).join(postings(spark, sf_dir), F.col("id") == F.col("opportunity_id"), "left_anti")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def broken_links_anti(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id", "left_anti")


@query(f"{_P} SELECT DISTINCT opportunity_id FROM postings WHERE is_active")
def active_semi(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("opportunity_id"))
    return ids.join(postings(spark, sf_dir).where("is_active"), "opportunity_id", "left_semi")


@query("""SELECT l.l_orderkey AS k, l.l_partkey AS p, l.l_suppkey AS s, l.l_linenumber AS n FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  WHERE (CASE WHEN l.l_linestatus = 'O' THEN 'O' END) IS DISTINCT FROM (CASE WHEN o.o_orderstatus <> 'P' THEN o.o_orderstatus END)""")
def lifecycle_diff_nullsafe(spark, sf_dir):
    left = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").alias("n"), F.when(F.col("l_linestatus") == "O", "O").alias("a"))
    right = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("b"))
    return left.join(right, "k").where(~F.col("a").eqNullSafe(F.col("b"))).select("k", "p", "s", "n")


@query(f"{_P} SELECT opportunity_id, count(DISTINCT source) AS sources FROM postings GROUP BY 1 HAVING count(DISTINCT source) > 1")
def cross_source_having(spark, sf_dir):
    return postings(spark, sf_dir).groupBy("opportunity_id").agg(F.countDistinct("source").alias("sources")).where("sources > 1")


@query("""SELECT a.ps AS part, a.supplier AS left_supplier, b.supplier AS right_supplier FROM
  (SELECT l_partkey AS ps, min(l_suppkey) AS supplier FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) a JOIN
  (SELECT l_partkey AS ps, min(l_suppkey) AS supplier FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) b USING (ps) WHERE a.supplier <> b.supplier""")
def fk_conflict_join(spark, sf_dir):
    x = table(spark, sf_dir, "lineitem")
    side = lambda status, name: x.where(F.col("l_linestatus") == status).groupBy(F.col("l_partkey").alias("part")).agg(F.min("l_suppkey").alias(name))
    return side("O", "left_supplier").join(side("F", "right_supplier"), "part").where("left_supplier <> right_supplier")


@query(f"{_P} SELECT opportunity_id, min(last_seen_at) AS first_seen, max(last_seen_at) AS last_seen, count(*) AS n FROM postings GROUP BY 1")
def opp_min_max_times(spark, sf_dir):
    return postings(spark, sf_dir).groupBy("opportunity_id").agg(F.min("last_seen_at").alias("first_seen"), F.max("last_seen_at").alias("last_seen"), F.count("*").alias("n"))


@query(f"{_P} SELECT opportunity_id, course_id, CAST(score AS INTEGER) AS score FROM scores")
def course_score_max(spark, sf_dir):
    return scores(spark, sf_dir)


@query(f"{_P} SELECT opportunity_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM postings GROUP BY 1")
def intents_union(spark, sf_dir):
    return postings(spark, sf_dir).groupBy("opportunity_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


_RICH = "CAST(l_quantity AS INTEGER) % 5"
_POS = "l_partkey * 1000000 + l_suppkey * 100 + l_linenumber"


@query(f"SELECT k, pos FROM (SELECT l_orderkey AS k, {_POS} AS pos, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_RICH} DESC, {_POS}) AS r FROM lineitem) WHERE r = 1")
def winner_first_tie(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_quantity").cast("int") % 5).alias("rich"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("pos"))
    return identity.winners(rows, ["k"], F.col("rich"), "pos").select("k", "pos")


@query(f"""SELECT l_orderkey AS k, arg_min(l_returnflag, {_POS}) FILTER (l_returnflag <> 'N') AS flag, arg_min(CAST(l_linenumber AS VARCHAR), {_POS}) FILTER (l_linenumber > 2) AS line
  FROM lineitem GROUP BY 1""")
def gap_fill_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("flag"), F.when(F.col("l_linenumber") > 2, F.col("l_linenumber").cast("string")).alias("line"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("pos"))
    return identity.gap_filled(rows, ["k"], ["flag", "line"], "pos")


@query(f"{_P} SELECT opportunity_id, source, source_job_id FROM (SELECT *, row_number() OVER (PARTITION BY opportunity_id ORDER BY last_seen_at, source, source_job_id) AS r FROM postings) WHERE r = 1")
def anchor_rownum(spark, sf_dir):
    return identity.representative(postings(spark, sf_dir), "opportunity_id", ["last_seen_at", "source", "source_job_id"]).select("opportunity_id", "source", "source_job_id")


@query("SELECT doc_id, source, CAST(n AS INTEGER) AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS n FROM documents) ORDER BY n, source LIMIT 50")
def fair_queue_roundrobin(spark, sf_dir):
    return availability.fair_queue(table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), F.asc("doc_id")], 50).select("doc_id", "source", "turn")


@query(f"""{_P} SELECT source, source_job_id FROM postings LEFT JOIN checks USING (check_key) WHERE is_active
  ORDER BY coalesce(verdict, ''), last_seen_at, source_job_id LIMIT 40""")
def stalest_first(spark, sf_dir):
    rows = postings(spark, sf_dir).where("is_active").join(checks(spark, sf_dir).withColumnRenamed("verdict", "checked_at"), "check_key", "left")
    return availability.stalest(rows, 40).select("source", "source_job_id")


@query("SELECT c_nationkey AS profile, c_custkey AS id, CAST(r AS INTEGER) AS r FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 5")
def top5_per_profile(spark, sf_dir):
    order = Window.partitionBy("profile").orderBy(F.desc("c_acctbal"), "id")
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("profile"), F.col("c_custkey").alias("id"), "c_acctbal").withColumn("r", F.row_number().over(order)).where("r <= 5").select("profile", "id", "r")


@query(f"{_P} SELECT source, count(*) FILTER (verdict = 'open') AS open, count(*) FILTER (verdict = 'closed') AS closed FROM postings JOIN checks USING (check_key) GROUP BY 1")
def verdict_pivot(spark, sf_dir):
    rows = postings(spark, sf_dir).join(checks(spark, sf_dir), "check_key")
    return rows.groupBy("source").pivot("verdict", ["open", "closed"]).count().na.fill(0)


@query(f"""{_P} SELECT 'postings' AS invariant, count(*) AS n FROM postings UNION ALL SELECT 'inactive', count(*) FROM postings WHERE NOT is_active
  UNION ALL SELECT 'bad score', count(*) FROM scores WHERE score NOT BETWEEN 0 AND 100
  UNION ALL SELECT 'orphan posting', count(*) FROM postings WHERE opportunity_id NOT IN (SELECT o_orderkey FROM orders)""")
def validation_counts(spark, sf_dir):
    p = postings(spark, sf_dir)
    found = {
        "postings": p,
        "inactive": p.where(~F.col("is_active")),
        "bad score": scores(spark, sf_dir).where(~F.col("score").between(0, 100)),
        "orphan posting": p.join(table(spark, sf_dir, "orders"), F.col("opportunity_id") == F.col("o_orderkey"), "left_anti"),
    }
    return reduce(lambda a, b: a.unionByName(b), (rows.agg(F.lit(name).alias("invariant"), F.count("*").alias("n")) for name, rows in found.items()))


@query("SELECT source, text, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "text").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT text_key, min(doc_id) AS doc_id FROM (SELECT md5(text) AS text_key, doc_id FROM documents) GROUP BY 1")
def first_occurrence(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_key"), "doc_id")
    return identity.first_occurrences(rows, ["text_key"], "doc_id")


@query("""SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'""")
def known_set_difference(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").subtract(table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id"))


@query("""SELECT count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a = b) AS both_sides FROM
  (SELECT doc_id AS a FROM labels) l FULL JOIN (SELECT doc_id AS b FROM documents WHERE lang = 'en') r ON a = b""")
def shard_coverage(spark, sf_dir):
    left, right = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("a")), table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("b"))
    return left.join(right, F.col("a") == F.col("b"), "full").agg(F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a") == F.col("b")).alias("both_sides"))


@query("""SELECT n_name AS city, c_mktsegment AS company, count(DISTINCT c_custkey) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def city_company_counts(spark, sf_dir):
    n = F.broadcast(table(spark, sf_dir, "nation"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("city"), F.col("c_mktsegment").alias("company")).agg(F.countDistinct("c_custkey").alias("n"))


@query("SELECT doc_id, CASE lang WHEN 'de' THEN 'new' WHEN 'fr' THEN 'changed' WHEN 'es' THEN 'reprocess' ELSE 'unchanged' END AS status FROM documents")
def prepare_status(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", lifecycle.content_hash([F.col("text"), F.col("lang")]).alias("raw_hash"))
    stored = d.where("lang <> 'de'").select("doc_id", F.when(F.col("lang") == "fr", F.reverse("raw_hash")).otherwise(F.col("raw_hash")).alias("raw_hash"), F.when(F.col("lang") == "es", "1").otherwise("2").alias("processing_version"))
    return lifecycle.prepare(d.drop("lang"), stored, ["doc_id"], "2").select("doc_id", "status")


@query("""SELECT doc_id, CASE WHEN old = 'closed' OR new IS NULL THEN old ELSE new END AS verdict, CASE WHEN old = 'closed' OR new IS NULL THEN 'a' ELSE 'b' END AS checked_at FROM
  (SELECT doc_id, CASE WHEN quality = 0 THEN 'closed' ELSE 'open' END AS old FROM labels) FULL JOIN
  (SELECT doc_id, CASE WHEN lang = 'de' THEN 'closed' ELSE 'unverified' END AS new FROM documents WHERE lang <> 'en') USING (doc_id)""")
def upsert_sticky_closed(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "closed").otherwise("open").alias("verdict"), F.lit("a").alias("checked_at"))
    new = table(spark, sf_dir, "documents").where("lang <> 'en'").select("doc_id", F.when(F.col("lang") == "de", "closed").otherwise("unverified").alias("verdict"), F.lit("b").alias("checked_at"))
    return availability.sticky_merge(old, new, ["doc_id"])


@query("""SELECT doc_id, CASE WHEN coalesce(a, 0) >= coalesce(b, 0) THEN a ELSE b END AS rank FROM (SELECT doc_id, quality + 2 * toxic AS a FROM labels WHERE quality + 2 * toxic > 0)
  FULL JOIN (SELECT doc_id, CASE lang WHEN 'de' THEN 3 WHEN 'fr' THEN 2 ELSE 1 END AS b FROM documents WHERE lang <> 'es') USING (doc_id)""")
def discoveries_monotone(spark, sf_dir):
    names = ["seen", "uncertain", "catalogued"]
    d = table(spark, sf_dir, "documents").where("lang <> 'es'")
    name = lambda n: F.element_at(F.array(*map(F.lit, names)), n.cast("int"))
    old = table(spark, sf_dir, "labels").where("quality + 2 * toxic > 0").select("doc_id", name(F.col("quality") + 2 * F.col("toxic")).alias("status"))
    new = d.select("doc_id", name(F.when(F.col("lang") == "de", 3).when(F.col("lang") == "fr", 2).otherwise(1)).alias("status"))
    merged = lifecycle.monotone_status(old, new, ["doc_id"], names)
    return merged.select("doc_id", F.array_position(F.array(*map(F.lit, names)), F.col("status")).alias("rank"))


@query(f"{_P} SELECT source, source_job_id FROM postings WHERE check_key NOT IN (SELECT check_key FROM checks WHERE verdict = 'closed')")
def tombstone_anti(spark, sf_dir):
    return lifecycle.without_tombstones(postings(spark, sf_dir), checks(spark, sf_dir).where("verdict = 'closed'"), ["check_key"]).select("source", "source_job_id")


@query("""WITH e AS (SELECT user_id AS k, event_id, event_type, CAST(ts AS DATE) AS d FROM events), m AS (SELECT min(d) + 15 AS cut FROM e),
s AS (SELECT k, count(*) > 3 AS is_active, CAST(min(event_id) % 3 AS INTEGER) AS miss_count, CASE WHEN min(event_id) % 3 > 0 THEN 'before' END AS missing_since, CAST(NULL AS VARCHAR) AS inactive_at FROM e GROUP BY k),
n AS (SELECT DISTINCT k, TRUE AS seen FROM e WHERE event_type = 'purchase')
SELECT k, CASE WHEN seen THEN TRUE WHEN is_active AND miss_count + 1 >= 2 THEN FALSE ELSE is_active END AS is_active,
  CAST(CASE WHEN seen THEN 0 WHEN is_active THEN miss_count + 1 ELSE miss_count END AS INTEGER) AS miss_count,
  CASE WHEN seen THEN NULL WHEN is_active THEN coalesce(missing_since, 'now') ELSE missing_since END AS missing_since,
  CASE WHEN seen THEN NULL WHEN is_active AND miss_count + 1 >= 2 THEN 'now' ELSE inactive_at END AS inactive_at, 'now' AS last_checked_at
FROM s LEFT JOIN n USING (k)""")
def reconcile_scope(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "k")
    third = (F.min("event_id") % 3).cast("int")
    state = e.groupBy("k").agg((F.count("*") > 3).alias("is_active"), third.alias("miss_count"), F.when(third > 0, "before").alias("missing_since")).withColumns({"inactive_at": F.lit(None).cast("string"), "last_checked_at": F.lit("old")})
    return lifecycle.reconcile(state, e.where("event_type = 'purchase'"), ["k"], complete=True, threshold=1, now=F.lit("now"))


@query("""SELECT k, coalesce(n_old, 0) + CASE WHEN n_new IS NULL THEN 0 ELSE 1 END AS seen_count, coalesce(last_new, last_old) AS last_seen FROM
  (SELECT user_id AS k, count(*) AS n_old, 'old' AS last_old FROM events WHERE event_type = 'view' GROUP BY 1) FULL JOIN
  (SELECT user_id AS k, 1 AS n_new, 'new' AS last_new FROM events WHERE event_type = 'click' GROUP BY 1) USING (k)""")
def mark_seen_counter(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("user_id", "k")
    stored = e.where("event_type = 'view'").groupBy("k").agg(F.count("*").alias("seen_count"), F.lit("old").alias("last_seen"))
    came = e.where("event_type = 'click'").select("k", F.lit("new").alias("last_seen")).distinct()
    return lifecycle.upsert(stored, came, ["k"], "seen_count")


@query("""SELECT a.doc_id FROM documents a JOIN (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'zz' ELSE lang END AS lang, source FROM documents) b USING (doc_id) WHERE a.lang IS DISTINCT FROM b.lang OR a.source IS DISTINCT FROM b.source""")
def delta_changed(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return lifecycle.changed_rows(d, d.withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "zz").otherwise(F.col("lang"))), ["doc_id"], ["lang", "source"])


@query("""SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang END, ''), 'cached-' || lang) AS lang FROM documents""")
def cached_fields_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    light = d.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")))
    return lifecycle.backfilled(light, d.withColumn("lang", F.concat(F.lit("cached-"), "lang")), ["doc_id"], ["lang"])


@query("SELECT source, CAST(count(*) AS BIGINT) AS successful_runs, CAST(min(doc_id) % 9 AS BIGINT) AS last_full_run, count(*) + 1 - min(doc_id) % 9 >= 7 AS full_audit FROM documents GROUP BY source")
def full_audit_due(spark, sf_dir):
    scopes = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("successful_runs"), (F.min("doc_id") % 9).alias("last_full_run"))
    return lifecycle.needs_full_audit(scopes, 7)
