"""Faceted, ranked, paginated search over the catalogue."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.geo import haversine_km, in_box

PAGE = 12
MAX_TERMS = 4
MAX_INPUT = 100
MAX_RADIUS_KM = 1000
#: Spellings of each workplace.
WORKPLACES = {"remote": ("remote", "remoto", "remota"), "hybrid": ("hybrid", "hibrido", "híbrido"), "onsite": ("onsite", "on-site", "presencial")}


def tidy(value: str | None) -> str | None:
    """Trimmed input of bounded length; blank counts as absent."""
    value = (value or "").strip()[:MAX_INPUT]
    return value or None


@dataclass(frozen=True)
class SearchRequest:
    q: str | None = None
    location: str | None = None
    source: str | None = None
    course: str | None = None
    intent: str | None = None
    workplace: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    min_score: int | None = None
    active_only: bool = True
    availability: str = "current"
    sort: str = "recent"
    latitude: float | None = None
    longitude: float | None = None
    radius_km: float | None = None
    include_remote: bool = False
    page: int = 0
    size: int = PAGE

    @property
    def least_score(self) -> int:
        return max(0, min(100, self.min_score or 0))

    @property
    def near_km(self) -> float | None:
        """The radius, where there is a place to measure from."""
        return min(self.radius_km, MAX_RADIUS_KM) if self.located and self.radius_km and self.radius_km > 0 else None

    @property
    def needs_posting(self) -> bool:
        return self.active_only or bool(tidy(self.source)) or self.availability != "all"

    @property
    def located(self) -> bool:
        return self.latitude is not None and self.longitude is not None and -90 <= self.latitude <= 90 and -180 <= self.longitude <= 180


def _has(column: str, term: str) -> Column:
    return F.contains(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(term.lower()))


def affinity(opportunities: DataFrame, scores: DataFrame, course: str | None = None) -> DataFrame:
    """``opportunities`` with their best score, or that for one course; none counts as 0."""
    rows = scores if course is None else scores.where(F.col("course_id") == course)
    best = rows.groupBy("opportunity_id").agg(F.max("score").alias("affinity"))
    return opportunities.join(best, opportunities.id == best.opportunity_id, "left").drop("opportunity_id").withColumn("affinity", F.coalesce("affinity", F.lit(0)))


def verification(postings: DataFrame, checks: DataFrame) -> DataFrame:
    """Label of each opportunity: open before unverified (both of an active posting) before closed, else unchecked."""
    seen = postings.join(checks, "check_key", "left")
    flag = lambda verdict, active: F.max(((F.col("verdict") == verdict) & (F.col("is_active") if active else F.lit(True))).cast("int"))
    return (
        seen.groupBy("opportunity_id")
        .agg(flag("open", True).alias("o"), flag("unverified", True).alias("u"), flag("closed", False).alias("c"))
        .select("opportunity_id", F.when(F.col("o") == 1, "open").when(F.col("u") == 1, "unverified").when(F.col("c") == 1, "closed").otherwise("unchecked").alias("verification"))
    )


def available(postings: DataFrame, checks: DataFrame, request: SearchRequest) -> DataFrame:
    """Ids of opportunities with a posting that the request admits."""
    rows = postings.join(checks, "check_key", "left")
    if request.active_only:
        rows = rows.where("is_active")
    if source := tidy(request.source):
        rows = rows.where(F.col("source") == source)
    verdict = F.coalesce("verdict", F.lit("unchecked"))
    if request.availability == "verified":
        rows = rows.where(verdict == "open")
    elif request.availability == "unverified":
        rows = rows.where(verdict == "unverified")
    elif request.availability != "all":  # unknown names count as current
        rows = rows.where(verdict.isin("open", "unchecked"))
    return rows.select("opportunity_id").distinct()


def matches(opportunities: DataFrame, postings: DataFrame, checks: DataFrame, scores: DataFrame, request: SearchRequest, intents: DataFrame | None = None) -> DataFrame:
    """All opportunities that the request admits, with affinity and distance."""
    rows = opportunities
    if q := tidy(request.q):
        rows = rows.where(_has("title", q) | _has("company", q) | _has("description", q))
    if place := tidy(request.location):
        rows = rows.where(F.contains(F.lower("location_text"), F.lit(place.lower())))
    if kind := tidy(request.workplace):
        rows = rows.where(F.lower("workplace_type").isin(*WORKPLACES.get(kind, ())) if kind in WORKPLACES else F.lit(False))
    words = lambda terms: [t for t in map(tidy, terms) if t][:MAX_TERMS]
    hay = F.lower(F.concat(*(F.concat(F.coalesce(c, F.lit("")), F.lit(" ")) for c in ("title", "company", "location_text")), F.coalesce("description", F.lit(""))))
    found = lambda t: F.contains(hay, F.lit(t.lower()))
    if include := words(request.include):
        rows = rows.where(reduce(lambda a, b: a | b, map(found, include)))
    for term in words(request.exclude):
        rows = rows.where(~found(term))
    remote = F.contains(F.lower(F.coalesce("workplace_type", F.lit(""))), F.lit("remot")) & F.lit(request.include_remote)
    if request.near_km:
        rows = rows.where(remote | in_box(F.col("latitude"), F.col("longitude"), request.latitude, request.longitude, request.near_km))
    distance = haversine_km(F.lit(request.latitude), F.lit(request.longitude), F.col("latitude"), F.col("longitude")) if request.located else F.lit(None).cast("double")
    rows = rows.withColumn("distance_km", distance)
    if request.near_km:
        rows = rows.where(remote | (F.col("distance_km") <= request.near_km))
    if request.needs_posting:
        ids = available(postings, checks, request)
        rows = rows.join(ids, rows.id == ids.opportunity_id, "left_semi")
    if intent := tidy(request.intent):
        wanted = intents.where(F.col("intent_id") == intent) if intents is not None else None
        rows = rows.where(F.lit(False)) if wanted is None else rows.join(wanted, rows.id == wanted.opportunity_id, "left_semi")
    course = tidy(request.course)
    if course:
        scored = scores.where(F.col("course_id") == course)
        rows = rows.join(scored, rows.id == scored.opportunity_id, "left_semi")
    rows = affinity(rows, scores, course)
    return rows.where(F.col("affinity") >= request.least_score) if request.least_score else rows


def ordering(request: SearchRequest) -> list[Column]:
    """Sort order; ids break all ties."""
    if request.located:
        orders = {
            "distance": [F.asc_nulls_last("distance_km"), F.desc("affinity")],
            "relevance": [F.desc("affinity"), F.asc_nulls_last("distance_km")],
            "title": [F.asc_nulls_last(F.lower("title"))],
        }
        return [*orders.get(request.sort, [F.desc_nulls_last("published_at")]), F.asc("id")]
    orders = {"relevance": [F.desc("affinity"), F.desc_nulls_first("updated_at")], "title": [F.asc_nulls_last(F.lower("title"))]}
    return [*orders.get(request.sort, [F.desc_nulls_first("published_at"), F.desc_nulls_first("updated_at")]), F.asc("id")]


def page(rows: DataFrame, request: SearchRequest) -> DataFrame:
    """One page; the top rows are found in each partition first."""
    return rows.orderBy(*ordering(request)).offset(min(max(request.page, 0), 10_000) * request.size).limit(request.size)


def search(opportunities: DataFrame, postings: DataFrame, checks: DataFrame, scores: DataFrame, request: SearchRequest, intents: DataFrame | None = None) -> DataFrame:
    top = page(matches(opportunities, postings, checks, scores, request, intents), request)
    labels = verification(postings.join(F.broadcast(top.select(F.col("id").alias("opportunity_id"))), "opportunity_id", "left_semi"), checks)
    return top.join(labels, top.id == labels.opportunity_id, "left").drop("opportunity_id").withColumn("verification", F.coalesce("verification", F.lit("unchecked")))
