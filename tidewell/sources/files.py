"""Catalogue files: tolerant reading, exports, versioned output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a posting row.
POSTING = (
    "source string, source_job_id string, company string, title string, location string, url string, description string, published_at string, employment_type string, workplace_type string, "
    "salary string, source_type string, latitude double, longitude double, location_confidence string, detected_intents array<string>, course_scores map<string,int>, metadata string"
)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON catalogue; unknown fields fall away, rows without source, id and title as well."""
    rows = spark.read.schema(POSTING).json(path, multiLine=True, mode="DROPMALFORMED")
    return rows.where("source is not null and source_job_id is not null and title is not null").fillna({"description": "", "source_type": "official_api"})


def csv_columns(rows: DataFrame) -> DataFrame:
    """The columns of the table export: lists joined by "; ", maps as JSON."""
    return rows.select("source", "source_job_id", "company", "title", "location", "url", "published_at", "employment_type", "workplace_type", "salary", F.concat_ws("; ", "detected_intents").alias("detected_intents"), F.to_json("course_scores").alias("course_scores"))


def write_csv(rows: DataFrame, path: str) -> None:
    csv_columns(rows).write.option("header", True).option("escape", '"').mode("overwrite").csv(path)


def write_version(rows: DataFrame, base: str) -> str:
    """Write a new version of a table beside the others and return its path; readers switch by name, so
    none sees a half-written one."""
    path = f"{base.rstrip('/')}/version-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return path
