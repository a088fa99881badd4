"""Postings and their opportunities: links rebuilt after merges and splits, affected opportunities written again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.careers import reference_quality
from tidewell.functions.urls import canonical_url, stable_id
from tidewell.operators import identity

KEYS = ["source", "source_job_id"]
#: How a posting came to its opportunity.
GROUPED, ALONE = "conservative_url", "identity"
OPPORTUNITY = ("company", "title", "description", "location", "workplace_type", "employment_type", "published_at")


def touched(postings: DataFrame, changed: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """The postings whose groups may change: those at an address that a changed posting has, or had in ``before``.

    Groups never span addresses, so that grouping these alone gives what grouping all would. Postings without a detail
    address stand alone and come in if they changed themselves. ``changed`` has the keys of changed and new postings.
    """
    keyed = lambda rows: identity.comparable(rows).select(*KEYS, F.coalesce("url_key", F.to_json(F.struct(*KEYS))).alias("place"))
    places = keyed(postings).join(changed.select(*KEYS).distinct(), KEYS, "left_semi").select("place")
    if before is not None:
        places = places.unionByName(keyed(before).join(changed.select(*KEYS).distinct(), KEYS, "left_semi").select("place"))
    near = keyed(postings).join(places.distinct(), "place", "left_semi").select(*KEYS)
    return postings.join(near, KEYS, "left_semi")


def desired_links(postings: DataFrame, group: str) -> DataFrame:
    """keys, opportunity_id and association_method of each posting of grouped ``postings``.

    The id is that of the group's earliest member (by first_seen_at, source, source_job_id), so that a group keeps it
    while that member stays, whoever joins or leaves. Anchors come from partial aggregates; null ids are empty strings.
    """
    seen = F.struct("first_seen_at", *(F.coalesce(k, F.lit("")).alias(k) for k in KEYS))
    anchors = postings.groupBy(group).agg(F.min(seen).alias("anchor"), F.count(F.lit(1)).alias("n"))
    named = anchors.select(group, stable_id(F.col("anchor.source"), F.col("anchor.source_job_id")).alias("opportunity_id"), F.when(F.col("n") > 1, GROUPED).otherwise(ALONE).alias("association_method"))
    return postings.select(*KEYS, group).join(named, group).select(*KEYS, "opportunity_id", "association_method")


def link_changes(current: DataFrame, desired: DataFrame) -> DataFrame:
    """Links to be written: keys, old_id (null for a new posting), opportunity_id, association_method. A missing current method is ``identity``."""
    now = current.select(*KEYS, F.col("opportunity_id").alias("old_id"), F.coalesce("association_method", F.lit(ALONE)).alias("old_method"))
    both = desired.join(now, KEYS, "left")
    return both.where(~F.col("opportunity_id").eqNullSafe(F.col("old_id")) | (F.col("association_method") != F.col("old_method"))).select(*KEYS, "old_id", "opportunity_id", "association_method")


def rebuilt_links(current: DataFrame, changes: DataFrame, at: Column) -> DataFrame:
    """The links after the changes: unchanged ones as they were, changed ones with ``associated_at`` of now."""
    new = changes.select(*KEYS, "opportunity_id", "association_method", at.alias("associated_at"))
    return current.join(changes.select(*KEYS), KEYS, "left_anti").select(*new.columns).unionByName(new)


def affected_ids(changes: DataFrame, desired: DataFrame, content_changed: DataFrame | None = None) -> DataFrame:
    """Distinct ids of opportunities that lost or got a posting, or one of whose postings has other content."""
    ids = changes.select(F.explode(F.array("old_id", "opportunity_id")).alias("opportunity_id"))
    if content_changed is not None:
        ids = ids.unionByName(desired.join(content_changed.select(*KEYS).distinct(), KEYS, "left_semi").select("opportunity_id"))
    return ids.where("opportunity_id is not null").distinct()


def rebuilt_opportunities(postings: DataFrame, desired: DataFrame, affected: DataFrame, position: str) -> DataFrame:
    """One row for each affected opportunity that has postings: merged content, created_at, updated_at.

    Created when its first posting was first seen, updated when the last one changed.
    """
    members = postings.join(desired.join(affected, "opportunity_id", "left_semi").select(*KEYS, "opportunity_id"), KEYS)
    content = identity.merged(members, "opportunity_id", position).select("opportunity_id", *OPPORTUNITY, F.coalesce(F.nullif(canonical_url(F.col("url")), F.lit("")), F.nullif("url", F.lit(""))).alias("canonical_url"))
    times = members.groupBy("opportunity_id").agg(F.min("first_seen_at").alias("created_at"), F.max("last_changed_at").alias("updated_at"))
    return content.join(times, "opportunity_id").withColumnRenamed("opportunity_id", "id")


def upserted(opportunities: DataFrame, rebuilt: DataFrame, links: DataFrame) -> DataFrame:
    """All opportunities after the rebuild: rebuilt rows take the place of old ones, those without any link are gone."""
    kept = opportunities.join(rebuilt.select("id"), "id", "left_anti").select(*rebuilt.columns)
    return kept.unionByName(rebuilt).join(links.select(F.col("opportunity_id").alias("id")).distinct(), "id", "left_semi")


def children(postings: DataFrame, desired: DataFrame, affected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Course scores (the best over the postings) and intents (their distinct trimmed names) of affected opportunities.

    ``postings`` carry ``course_scores`` (map of course to score) and ``intents`` (array); nulls count as empty.
    """
    members = postings.join(desired.join(affected, "opportunity_id", "left_semi").select(*KEYS, "opportunity_id"), KEYS)
    scores = members.select("opportunity_id", F.explode("course_scores").alias("course_id", "score")).groupBy("opportunity_id", "course_id").agg(F.max(F.greatest(F.col("score").cast("int"), F.lit(0))).alias("score"))
    intents = members.select("opportunity_id", F.explode(F.transform("intents", lambda i: F.trim(i))).alias("intent_id")).where("intent_id <> ''").distinct()
    return scores, intents


REFERENCE = ("title", "url", "location", "discovered_from", "published_at")


def merged_references(rows: DataFrame, keys: list[str], position: str, method: str = "method") -> DataFrame:
    """One listing for each key: in input order each takes over if it says more than all before it together; what the
    better one lacks the other gives. ``methods`` is the sorted union of how it was found.

    A listing that comes again changes nothing (what it says is there, and no less weighty), so equal ones meet in partial
    aggregates first and a key's task folds its different ones alone. Empty strings are absent; keys may be null.
    """
    fields = [F.coalesce(c, F.lit("")).alias(c) for c in REFERENCE]
    distinct = rows.select(*keys, F.col(position).alias("at"), *fields, F.col(method).alias("how")).groupBy(*keys, *REFERENCE).agg(F.min("at").alias("at"), F.collect_set("how").alias("how"))
    each = F.struct("at", *REFERENCE)
    listed = distinct.groupBy(*keys).agg(F.sort_array(F.collect_list(each)).alias("all"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("how")))).alias("methods"))
    quality = lambda r: reference_quality(r["title"], r["location"], r["url"], r["published_at"])

    def fold(held: Column, new: Column) -> Column:
        take = lambda c: F.when(F.when(quality(new) > quality(held), new[c]).otherwise(held[c]) != "", F.when(quality(new) > quality(held), new[c]).otherwise(held[c])).when(held[c] != "", held[c]).otherwise(new[c])
        return F.struct(held["at"].alias("at"), *(take(c).alias(c) for c in REFERENCE))

    best = F.aggregate(F.slice("all", 2, F.size("all")), F.get("all", F.lit(0)), fold)
    return listed.select(*keys, best.alias("r"), "methods").select(*keys, *(F.col(f"r.{c}") for c in REFERENCE), "methods")
