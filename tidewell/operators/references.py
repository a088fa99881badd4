"""Rows of any table that refer to an entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_counts(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """column, ``table``, ``n``: how often each table that has the column (in any case of letters) refers to each id.

    Tables are found by their schemas; only that column is read, and counts meet in partial aggregates. Null refers to
    nothing. Tables without the column are passed over; if none has it, that is an error.
    """
    found = []
    for name, rows in sorted(tables.items()):
        has = [c for c in rows.columns if c.lower() == column.lower()]
        if has:
            found.append(rows.select(F.col(has[0]).cast("string").alias(column)).where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(column, F.lit(name).alias("table"), "n"))
    if not found:
        raise ValueError(f"no table has a column {column}")
    return reduce(DataFrame.unionByName, found)


def unreferenced(rows: DataFrame, key: str, tables: dict[str, DataFrame], column: str) -> DataFrame:
    """Rows whose key no table refers to: those that may be deleted."""
    used = reference_counts(tables, column).select(F.col(column).alias("__used")).distinct()
    return rows.join(used, F.col(key).cast("string") == F.col("__used"), "left_anti")
