"""Catalogue rows put together from opportunities, postings and their classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classification(scores: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """(opportunity_id, course_scores, best_course, best_score[, intents]): vocabularies are small, so are the maps."""
    best = F.struct((-F.col("score")).alias("s"), F.col("course_id"))
    rows = scores.groupBy("opportunity_id").agg(
        F.map_from_entries(F.array_sort(F.collect_set(F.struct("course_id", "score")))).alias("course_scores"), F.min_by("course_id", best).alias("best_course"), F.max("score").alias("best_score")
    )
    if intents is None:
        return rows
    named = intents.groupBy("opportunity_id").agg(F.array_sort(F.collect_set("intent_id")).alias("intents"))
    return rows.join(named, "opportunity_id", "full")


def assembled(opportunities: DataFrame, postings: DataFrame, scores: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Opportunities with what their postings and their classification tell.

    Postings are counted and their distinct sources listed; they aren't gathered, as one opportunity may have very many.
    """
    told = postings.groupBy("opportunity_id").agg(F.count("*").alias("postings"), F.count_if("is_active").alias("active"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("last_seen_at").alias("last_seen_at"))
    key = lambda df: df.withColumnRenamed("opportunity_id", "id")
    return opportunities.join(key(told), "id", "left").join(key(classification(scores, intents)), "id", "left").na.fill(0, ["postings", "active"])


def hydrated(postings: DataFrame, scores: DataFrame, intents: DataFrame | None = None) -> DataFrame:
    """Postings with the classification of their opportunity."""
    return postings.join(classification(scores, intents), "opportunity_id", "left")
