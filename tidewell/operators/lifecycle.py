"""Run-to-run state: change detection, upserts, sightings, reconciliation, tombstones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_THRESHOLD = 2


def content_hash(columns: list[Column]) -> Column:
    """SHA-256 of the values as JSON; nulls are kept apart from empty strings."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def prepare(incoming: DataFrame, stored: DataFrame, keys: list[str], version: str) -> DataFrame:
    """``status`` of each incoming row: new, changed, reprocess (older version) or unchanged."""
    known = stored.select(*keys, F.col("raw_hash").alias("known_hash"), F.col("processing_version").alias("known_version"), F.lit(True).alias("known"))
    status = F.when(F.col("known").isNull(), "new").when(~F.col("raw_hash").eqNullSafe(F.col("known_hash")), "changed").when(~F.col("known_version").eqNullSafe(F.lit(version)), "reprocess").otherwise("unchanged")
    return incoming.join(known, keys, "left").withColumn("status", status).drop("known_hash", "known_version", "known")


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str], counter: str | None = None) -> DataFrame:
    """Stored rows with incoming values where there are any; ``counter`` goes up for each row that came in."""
    values = [c for c in stored.columns if c not in keys and c != counter]
    new = incoming.select(*keys, *(F.col(c).alias(f"__new_{c}") for c in values if c in incoming.columns), F.lit(True).alias("__came"))
    merged = stored.join(new, keys, "full")
    cols = [F.coalesce(f"__new_{c}", c).alias(c) if f"__new_{c}" in new.columns else F.col(c) for c in values]
    if counter:
        cols.append((F.coalesce(counter, F.lit(0)) + F.coalesce(F.col("__came"), F.lit(False)).cast("int")).alias(counter))
    return merged.select(*keys, *cols)


def changed_rows(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Keys of both sides whose columns differ, nulls being equal to nulls."""
    other = right.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return left.join(other, keys).where(reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns))).select(*keys)


def reconcile(state: DataFrame, seen: DataFrame, keys: list[str], *, complete: bool, threshold: int, now: Column) -> DataFrame:
    """State after a scan of a scope.

    Only a complete scan counts misses. A seen row is active with all marks reset; an unseen active
    one has one more miss, is missing since the first and inactive from the threshold (two at least)
    on; an unseen inactive one only has been looked at.
    """
    rows = state.join(seen.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "left")
    was_seen, active = F.coalesce("__seen", F.lit(False)), F.col("is_active")
    misses = F.col("miss_count") + 1
    missed = ~was_seen & active & F.lit(complete)
    gone = missed & (misses >= max(LEAST_THRESHOLD, threshold))
    return rows.select(
        *(c for c in state.columns if c not in ("is_active", "miss_count", "missing_since", "inactive_at", "last_checked_at")),
        F.when(was_seen, True).when(gone, False).otherwise(active).alias("is_active"),
        F.when(was_seen, 0).when(missed, misses).otherwise(F.col("miss_count")).alias("miss_count"),
        F.when(was_seen, None).when(missed, F.coalesce("missing_since", now)).otherwise(F.col("missing_since")).alias("missing_since"),
        F.when(was_seen, None).when(gone, F.coalesce("inactive_at", now)).otherwise(F.col("inactive_at")).alias("inactive_at"),
        F.when(was_seen | F.lit(complete), now).otherwise(F.col("last_checked_at")).alias("last_checked_at"),
    )


def needs_full_audit(scopes: DataFrame, every: int) -> DataFrame:
    """Whether each scope is due for a complete scan: never had one, or ``every`` (two at least) runs ago."""
    due = F.col("last_full_run").isNull() | (F.col("successful_runs") + 1 - F.col("last_full_run") >= max(2, every))
    return scopes.withColumn("full_audit", due)


def monotone_status(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Scope status that only rises in ``order``."""
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col(c)), F.lit(0))
    merged = old.withColumnRenamed("status", "old_status").join(new.withColumnRenamed("status", "new_status"), keys, "full")
    return merged.select(*keys, F.when(rank("old_status") >= rank("new_status"), F.col("old_status")).otherwise(F.col("new_status")).alias("status"))


def without_tombstones(rows: DataFrame, purged: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(purged, keys, "left_anti")


def backfilled(incoming: DataFrame, cached: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Incoming rows with cached values where their own are null or empty."""
    old = cached.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    return incoming.join(old, keys, "left").withColumns({c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"__{c}")) for c in columns}).drop(*(f"__{c}" for c in columns))


def counts(state: DataFrame, discoveries: DataFrame) -> DataFrame:
    """(name, n): active, missing (active with misses), inactive, discoveries and those out of scope."""
    n = lambda cond, name: F.count_if(cond).alias(name)
    rows = state.agg(n(F.col("is_active"), "active"), n(F.col("is_active") & (F.col("miss_count") > 0), "missing"), n(~F.col("is_active"), "inactive"))
    found = discoveries.agg(F.count("*").alias("discoveries"), n(F.col("scope_status") == "out_of_scope", "out_of_scope_discoveries"))
    long = lambda df: df.unpivot([], df.columns, "name", "n")
    return long(rows).unionByName(long(found))


def touched(state: DataFrame, seen: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """State with the rows of ``seen`` active and last seen at ``at``; all else stays."""
    rows = state.join(seen.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "left")
    return rows.select(*keys, *(F.when(F.col("__seen"), {"last_seen_at": at, "is_active": F.lit(True)}[c]).otherwise(F.col(c)).alias(c) if c in ("last_seen_at", "is_active") else F.col(c) for c in state.columns if c not in keys))


def closed(state: DataFrame, keys_closed: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """State with rows that their source calls closed: inactive, checked now, missing and inactive since the first time,
    with the misses that a lapse takes."""
    rows = state.join(keys_closed.select(*keys).distinct().withColumn("__shut", F.lit(True)), keys, "left")
    value = {
        "is_active": F.lit(False), "last_checked_at": now, "missing_since": F.coalesce("missing_since", now),
        "inactive_at": F.coalesce("inactive_at", now), "miss_count": F.greatest("miss_count", F.lit(LEAST_THRESHOLD)),
    }
    return rows.select(*keys, *(F.when(F.col("__shut"), value[c]).otherwise(F.col(c)).alias(c) if c in value else F.col(c) for c in state.columns if c not in keys))
