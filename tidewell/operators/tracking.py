"""Owner-scoped rows, guarded maintenance, and association changes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def toggled(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Keys after toggling: those in exactly one of both tables."""
    sides = rows.select(*keys).distinct().withColumn("__n", F.lit(1)).unionByName(changes.select(*keys).distinct().withColumn("__n", F.lit(1)))
    return sides.groupBy(*keys).agg(F.sum("__n").alias("__n")).where("__n = 1").select(*keys)


def imported(own: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Own rows and those incoming ones whose key is free; nothing is overwritten."""
    return own.unionByName(incoming.join(own.select(*keys), keys, "left_anti").select(*own.columns))


def replaced_children(children: DataFrame, incoming: DataFrame, parent: str) -> DataFrame:
    """Children with those of all incoming parents replaced."""
    return children.join(incoming.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(incoming.select(*children.columns))


def deletable(doomed: DataFrame, references: list[DataFrame], key: str) -> DataFrame:
    """Doomed rows that no table of references names."""
    if not references:
        return doomed
    named = reduce(lambda a, b: a.unionByName(b), (r.select(key) for r in references)).distinct()
    return doomed.join(named, key, "left_anti")


def copied(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows with the source's values in the columns that both have, and the source's new rows."""
    shared = [c for c in source.columns if c in target.columns]
    new = source.select(*keys, *(F.col(c).alias(f"__{c}") for c in shared if c not in keys), F.lit(True).alias("__came"))
    merged = target.join(new, keys, "full")
    return merged.select(*keys, *((F.when(F.col("__came"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in shared else F.col(c)) for c in target.columns if c not in keys))


def association_changes(current: DataFrame, desired: DataFrame, keys: list[str], group: str) -> DataFrame:
    """Rows whose group differs from the desired one: keys, old and new group (null where there is none)."""
    a, b = current.select(*keys, F.col(group).alias("old_group")), desired.select(*keys, F.col(group).alias("new_group"))
    return a.join(b, keys, "full").where(~F.col("old_group").eqNullSafe(F.col("new_group")))


def throttled(failures: DataFrame, user: str, at: Column, limit: int, window: str) -> DataFrame:
    """Users and fixed windows with ``limit`` failures or more."""
    return failures.groupBy(user, F.window(at, window).alias("w")).agg(F.count("*").alias("failures")).where(F.col("failures") >= limit).select(user, F.col("w.start").alias("start"), "failures")


def coverage_errors(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Keys missing, unexpected or found more than once, with what is wrong."""
    n = found.groupBy(*keys).agg(F.count("*").alias("n"))
    both = expected.select(*keys).distinct().withColumn("due", F.lit(True)).join(n, keys, "full")
    wrong = F.when(F.col("n").isNull(), "missing").when(F.col("due").isNull(), "unexpected").when(F.col("n") > 1, "repeated")
    return both.select(*keys, wrong.alias("error")).where("error is not null")
