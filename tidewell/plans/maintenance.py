"""Owner-scoped rows and guarded maintenance over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.datasets import table
from tidewell.functions import urls
from tidewell.operators import tracking
from tidewell.plans.base import query


@query("SELECT user_id AS owner, count_k AS item FROM (SELECT DISTINCT user_id, event_id % 7 AS count_k, event_type = 'click' AS side FROM events WHERE event_type IN ('click', 'purchase')) GROUP BY 1, 2 HAVING count(*) = 1")
def toggle_favourites(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("owner"), (F.col("event_id") % 7).alias("item"), "event_type")
    return tracking.toggled(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["owner", "item"])


@query("""WITH own AS (SELECT doc_id, 'own' AS note FROM labels WHERE quality = 0), new AS (SELECT doc_id, 'new' AS note FROM labels WHERE toxic = 1)
SELECT * FROM own UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM own)""")
def import_without_overwrite(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    return tracking.imported(x.where("quality = 0").select("doc_id", F.lit("own").alias("note")), x.where("toxic = 1").select("doc_id", F.lit("new").alias("note")), ["doc_id"])


@query("""SELECT l_orderkey AS parent, l_linenumber AS child FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
UNION ALL SELECT o_orderkey, 0 FROM orders WHERE o_orderstatus = 'P'""")
def replace_children(spark, sf_dir):
    children = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("parent"), F.col("l_linenumber").alias("child"))
    incoming = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("parent"), F.lit(0).alias("child"))
    return tracking.replaced_children(children, incoming, "parent")


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def guarded_delete(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "id")
    references = [table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("id")), c.where("c_mktsegment = 'BUILDING'")]
    return tracking.deletable(c.where("c_acctbal < 0").select("id"), references, "id")


@query("""SELECT doc_id, CASE WHEN b IS NOT NULL THEN b ELSE a END AS lang, source FROM (SELECT doc_id, lang AS a, source FROM documents WHERE lang <> 'de') FULL JOIN (SELECT doc_id, upper(lang) AS b FROM documents WHERE lang <> 'fr') USING (doc_id)""")
def copy_upsert(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    source = d.where("lang <> 'fr'").select("doc_id", F.upper("lang").alias("lang"), F.lit(1).alias("other"))
    return tracking.copied(d.where("lang <> 'de'"), source, ["doc_id"])


@query("""SELECT doc_id, a AS old_group, b AS new_group FROM (SELECT doc_id, source AS a FROM documents WHERE lang <> 'de') FULL JOIN (SELECT doc_id, CASE WHEN lang = 'es' THEN 'src0' ELSE source END AS b FROM documents WHERE lang <> 'fr') USING (doc_id) WHERE a IS DISTINCT FROM b""")
def association_changes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    desired = d.where("lang <> 'fr'").select("doc_id", F.when(F.col("lang") == "es", "src0").otherwise(F.col("source")).alias("source"))
    return tracking.association_changes(d.where("lang <> 'de'").select("doc_id", "source"), desired, ["doc_id"], "source")


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, count(*) AS failures FROM events WHERE event_type = 'error' GROUP BY 1, 2 HAVING count(*) >= 2")
def throttle_windows(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return tracking.throttled(e, "user_id", F.col("ts").cast("timestamp"), 2, "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


@query("""WITH f AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1), x AS (SELECT doc_id AS due FROM documents WHERE lang = 'en')
SELECT coalesce(due, doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN due IS NULL THEN 'unexpected' ELSE 'repeated' END AS error FROM x FULL JOIN f ON due = doc_id WHERE n IS NULL OR due IS NULL OR n > 1""")
def sweep_coverage(spark, sf_dir):
    x = table(spark, sf_dir, "labels")
    found = x.select("doc_id").unionByName(x.where("toxic = 1").select("doc_id"))
    return tracking.coverage_errors(table(spark, sf_dir, "documents").where("lang = 'en'"), found, ["doc_id"])


@query("SELECT doc_id FROM documents ORDER BY sha256(source || ':' || CAST(doc_id AS VARCHAR)) LIMIT 35")
def stable_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256)).select("doc_id").limit(35)


@query("""SELECT shard, count(*) AS n, count(*) FILTER (lang = 'en') AS en FROM (SELECT lang, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16) AS UBIGINT) % 12 AS INTEGER) AS shard FROM documents) GROUP BY 1""")
def shard_manifest(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("shard", urls.shard_number(F.col("doc_id").cast("string"), 12))
    return d.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(F.col("lang") == "en").alias("en"))
