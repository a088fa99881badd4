"""Streams of observations: windowed counts, first sightings, failure streaks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from tidewell.session import shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Observations as they come, with an event time that a watermark accepts.

    ``name`` is a file or a folder of files in ``folder``; the source watches the folder.
    """
    source = spark.readStream.schema(SCHEMA).option("pathGlobFilter", name if _is_file(spark, f"{folder}/{name}") else "*.parquet")
    return source.parquet(folder if _is_file(spark, f"{folder}/{name}") else f"{folder}/{name}").withColumn("ts", F.col("ts").cast("timestamp"))


def _is_file(spark: SparkSession, path: str) -> bool:
    """Whether a table is one file, by what Spark's own reader lists."""
    return any(f.rstrip("/").endswith(path.rsplit("/", 1)[-1]) for f in spark.read.parquet(path).inputFiles())


def window_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def first_sightings(events: DataFrame) -> DataFrame:
    """Each (user, kind) once; later sightings are suppressed by state."""
    return events.select("user_id", "event_type").dropDuplicates(["user_id", "event_type"])


_STREAK = "user_id long, last_day string, bad_checks long"


def bad_streaks(events: DataFrame) -> DataFrame:
    """Running streak of bad days of each user; state is the open day, its first check, and the streak before it."""

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        day, bad, streak = state.get if state.exists else ("", False, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        firsts = rows.assign(day=rows["ts"].dt.strftime("%Y-%m-%d")).drop_duplicates("day")
        for d, b in zip(firsts["day"], firsts["event_type"] == "error", strict=True):
            if d > day:  # one check a day counts; days before the open one come too late
                streak = streak + 1 if bad else 0
                day, bad = d, bool(b)
        state.update((day, bad, streak))
        yield pd.DataFrame({"user_id": [key[0]], "last_day": [day], "bad_checks": [streak + 1 if bad else 0]})

    chosen = events.select("user_id", "event_id", "ts", "event_type")
    return chosen.groupBy("user_id").applyInPandasWithState(advance, _STREAK, "day string, bad boolean, streak long", "update", "NoTimeout")


def drained(spark: SparkSession, rows: DataFrame, mode: str, name: str, finish: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over all that is there now into the shared folder and read the result.

    Each micro-batch is a folder of its own that is overwritten if the batch runs again, so every
    batch counts exactly once.
    """
    folder = shared_folder(spark, name)

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    rows.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    result = spark.read.parquet(f"{folder}/out")
    return finish(result) if finish else result.drop("batch")
