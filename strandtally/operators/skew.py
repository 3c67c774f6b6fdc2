"""Joins of many rows with one row for each key, where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than one part in so many of all rows, so there are fewer hot keys than that.
SHARE = 1000


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """The hot keys of a stored table, as its column ``key``."""
    return rows.groupBy(key).agg(F.count("*").alias("__n")).filter(F.col("__n") * SHARE > rows.count()).select(key)


def join_values(rows: DataFrame, values: DataFrame, key: str, hot: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``values``, which has one row for each key. Values of hot keys are broadcast, so their rows
    stay where they are; others are joined by key, and are merged, so their values don't pass the driver."""
    few = F.broadcast(hot)
    here = rows.join(few, key, "left_semi").join(F.broadcast(values.join(few, key, "left_semi")), key, how)
    there = rows.join(few, key, "left_anti").join(values.hint("merge"), key, how)
    return here.unionByName(there)
