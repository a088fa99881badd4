"""Search queries over orders (opportunities), lines (postings) and labels (checks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.datasets import CHECKS_SQL, OPPORTUNITIES_SQL, POSTINGS_SQL, SCORES_SQL, checks, opportunities, postings, scores
from tidewell.operators import search as ops
from tidewell.plans.base import ORACLE_SQL, QUERIES, query

_WITH = f"WITH {OPPORTUNITIES_SQL}, {POSTINGS_SQL}, {CHECKS_SQL}, {SCORES_SQL}"
_KM = """2 * 6371.0088 * atan2(sqrt(pow(sin(radians(latitude - -22.01) / 2), 2) + cos(radians(-22.01)) * cos(radians(latitude)) * pow(sin(radians(longitude - -47.89) / 2), 2)),
  sqrt(1 - least(1.0, pow(sin(radians(latitude - -22.01) / 2), 2) + cos(radians(-22.01)) * cos(radians(latitude)) * pow(sin(radians(longitude - -47.89) / 2), 2))))"""
_ADMITTED = {
    "current": "AND coalesce(c.verdict, 'unchecked') IN ('open', 'unchecked')",
    "verified": "AND c.verdict = 'open'",
    "unverified": "AND c.verdict = 'unverified'",
    "all": "",
}


def _sql(request: ops.SearchRequest, *, where: str = "", order: str, geo: bool = False) -> str:
    active = "AND p.is_active" if request.active_only else ""
    source = f"AND p.source = '{request.source}'" if request.source else ""
    posting = f"""EXISTS (SELECT 1 FROM postings p LEFT JOIN checks c ON c.check_key = p.check_key
    WHERE p.opportunity_id = o.id {active} {source} {_ADMITTED[request.availability]})""" if request.active_only or request.source or request.availability != "all" else "TRUE"
    course = f"AND s.course_id = '{request.course}'" if request.course else ""
    scored = f"AND EXISTS (SELECT 1 FROM scores s WHERE s.opportunity_id = o.id {course})" if request.course else ""
    least = f"AND affinity >= {request.min_score}" if request.min_score else ""
    remote = "OR lower(coalesce(workplace_type, '')) LIKE '%remot%'" if request.include_remote else ""
    near = f"(km <= {min(request.radius_km, 1000)} {remote})" if request.radius_km else "TRUE"
    return f"""{_WITH},
hits AS (
  SELECT o.*, {_KM if geo else 'CAST(NULL AS DOUBLE)'} AS km,
    coalesce((SELECT max(s.score) FROM scores s WHERE s.opportunity_id = o.id {course}), 0) AS affinity
  FROM opportunities o
  WHERE {posting} {scored} {where}
)
SELECT h.id, h.title, h.published_at, CAST(h.affinity AS INTEGER) AS affinity, round(h.km, 6) AS distance_km,
  CASE WHEN EXISTS (SELECT 1 FROM postings p JOIN checks c ON c.check_key = p.check_key WHERE p.opportunity_id = h.id AND p.is_active AND c.verdict = 'open') THEN 'open'
    WHEN EXISTS (SELECT 1 FROM postings p JOIN checks c ON c.check_key = p.check_key WHERE p.opportunity_id = h.id AND p.is_active AND c.verdict = 'unverified') THEN 'unverified'
    WHEN EXISTS (SELECT 1 FROM postings p JOIN checks c ON c.check_key = p.check_key WHERE p.opportunity_id = h.id AND c.verdict = 'closed') THEN 'closed'
    ELSE 'unchecked' END AS verification
FROM (SELECT * FROM hits WHERE {near} {least} ORDER BY {order} LIMIT {request.size} OFFSET {request.page * request.size}) h
"""


def _register(name: str, request: ops.SearchRequest, **sql: object) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = ops.search(opportunities(spark, sf_dir), postings(spark, sf_dir), checks(spark, sf_dir), scores(spark, sf_dir), request)
        return found.select("id", "title", "published_at", "affinity", F.round("distance_km", 6).alias("distance_km"), "verification")

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = _sql(request, **sql)  # type: ignore[arg-type]


_RECENT = "published_at DESC NULLS FIRST, updated_at DESC NULLS FIRST, id"
_RELEVANT = "affinity DESC, updated_at DESC NULLS FIRST, id"
_HERE = {"latitude": -22.01, "longitude": -47.89}
_HAS = "(lower(o.title) LIKE '%{0}%' OR lower(o.company) LIKE '%{0}%' OR lower(o.description) LIKE '%{0}%')"
_HAY = "contains(lower(coalesce(o.title, '')) || ' ' || lower(coalesce(o.company, '')) || ' ' || lower(coalesce(o.location_text, '')) || ' ' || lower(coalesce(o.description, '')), '{0}')"

_register("search_relevance", ops.SearchRequest(sort="relevance"), order=_RELEVANT)
_register("search_recent", ops.SearchRequest(), order=_RECENT)
_register("search_title", ops.SearchRequest(sort="title"), order="lower(title) NULLS LAST, id")
_register("search_page_offset", ops.SearchRequest(page=5), order=_RECENT)
_register("search_text", ops.SearchRequest(q=" MACHINERY "), order=_RECENT, where="AND " + _HAS.format("machinery"))
_register("search_include_exclude", ops.SearchRequest(include=("urgent", "high"), exclude=("building", "household")), order=_RECENT, where=f"AND ({_HAY.format('urgent')} OR {_HAY.format('high')}) AND NOT {_HAY.format('building')} AND NOT {_HAY.format('household')}")
_register("search_include_place", ops.SearchRequest(include=("nation_7 build", "nation_12"), exclude=("machinery",)), order=_RECENT, where=f"AND ({_HAY.format('nation_7 build')} OR {_HAY.format('nation_12')}) AND NOT {_HAY.format('machinery')}")
_register("search_location", ops.SearchRequest(location=" NATION_1 "), order=_RECENT, where="AND contains(lower(o.location_text), 'nation_1')")
_register("search_workplace", ops.SearchRequest(workplace="remote"), order=_RECENT, where="AND lower(coalesce(o.workplace_type, '')) IN ('remote', 'remoto', 'remota')")
_register("search_workplace_hybrid", ops.SearchRequest(workplace="hybrid"), order=_RECENT, where="AND lower(coalesce(o.workplace_type, '')) IN ('hybrid', 'hibrido', 'híbrido')")
_register("search_workplace_unknown", ops.SearchRequest(workplace="moon"), order=_RECENT, where="AND FALSE")
_register("search_source", ops.SearchRequest(source="N"), order=_RECENT)
_register("search_course", ops.SearchRequest(course="course_3", sort="relevance", min_score=40), order=_RELEVANT)
_register("search_availability_verified", ops.SearchRequest(availability="verified"), order=_RECENT)
_register("search_availability_unverified", ops.SearchRequest(availability="unverified"), order=_RECENT)
_register("search_availability_all", ops.SearchRequest(availability="all", active_only=False), order=_RECENT)
_register("search_no_posting", ops.SearchRequest(availability="all", active_only=False, sort="title"), order="lower(title) NULLS LAST, id")
_register("search_remote_radius", ops.SearchRequest(**_HERE, radius_km=90.0, sort="distance", include_remote=True), order="km NULLS LAST, affinity DESC, id", geo=True)
_register("search_radius_bound", ops.SearchRequest(**_HERE, radius_km=5000.0, sort="distance", page=40), order="km NULLS LAST, affinity DESC, id", geo=True)
_register("search_geo_distance", ops.SearchRequest(**_HERE, radius_km=500.0, sort="distance"), order="km NULLS LAST, affinity DESC, id", geo=True)
_register("search_geo_relevance", ops.SearchRequest(**_HERE, radius_km=800.0, sort="relevance"), order="affinity DESC, km NULLS LAST, id", geo=True)
_register("search_geo_recent", ops.SearchRequest(**_HERE, radius_km=800.0), order="published_at DESC NULLS LAST, id", geo=True)


@query(f"{_WITH} SELECT o.id, CAST(coalesce(max(s.score), 0) AS INTEGER) AS affinity FROM opportunities o LEFT JOIN scores s ON s.opportunity_id = o.id GROUP BY o.id")
def affinity_max(spark, sf_dir):
    return ops.affinity(opportunities(spark, sf_dir), scores(spark, sf_dir)).select("id", "affinity")


@query(f"{_WITH} SELECT o.id, CAST(coalesce(max(s.score), 0) AS INTEGER) AS affinity FROM opportunities o LEFT JOIN scores s ON s.opportunity_id = o.id AND s.course_id = 'course_7' GROUP BY o.id")
def affinity_course(spark, sf_dir):
    return ops.affinity(opportunities(spark, sf_dir), scores(spark, sf_dir), "course_7").select("id", "affinity")


@query(f"""{_WITH} SELECT p.opportunity_id, CASE WHEN bool_or(coalesce(p.is_active AND c.verdict = 'open', FALSE)) THEN 'open' WHEN bool_or(coalesce(p.is_active AND c.verdict = 'unverified', FALSE)) THEN 'unverified'
  WHEN bool_or(coalesce(c.verdict = 'closed', FALSE)) THEN 'closed' ELSE 'unchecked' END AS verification FROM postings p LEFT JOIN checks c USING (check_key) GROUP BY 1""")
def verification_label(spark, sf_dir):
    return ops.verification(postings(spark, sf_dir), checks(spark, sf_dir))


@query(f"{_WITH} SELECT count(*) AS total FROM opportunities o WHERE EXISTS (SELECT 1 FROM postings p LEFT JOIN checks c USING (check_key) WHERE p.opportunity_id = o.id AND p.is_active AND coalesce(c.verdict, 'unchecked') IN ('open', 'unchecked'))")
def search_total(spark, sf_dir):
    return ops.matches(opportunities(spark, sf_dir), postings(spark, sf_dir), checks(spark, sf_dir), scores(spark, sf_dir), ops.SearchRequest()).agg(F.count("*").alias("total"))


@query(f"{_WITH} SELECT DISTINCT source FROM postings")
def facet_sources(spark, sf_dir):
    return postings(spark, sf_dir).select("source").distinct()


@query(f"{_WITH} SELECT course_id, count(*) AS n, CAST(max(score) AS INTEGER) AS best FROM scores GROUP BY 1")
def facet_courses(spark, sf_dir):
    return scores(spark, sf_dir).groupBy("course_id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


@query(f"{_WITH} SELECT workplace_type, count(*) AS n FROM opportunities GROUP BY 1")
def facet_workplaces(spark, sf_dir):
    return opportunities(spark, sf_dir).groupBy("workplace_type").agg(F.count("*").alias("n"))
