"""Joins of corpus preparation. Build sides are left to the planner (broadcast where small, else sorted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fallback(left: DataFrame, right: DataFrame, first: Column, second: Column, key: str, value: str) -> DataFrame:
    """left with right's value looked up by the first key and, failing that, by the second; right's key is
    unique, so every row of left, repeated ones included, comes out once."""
    side = lambda k: right.select(F.col(key).alias(f"_key{k}"), F.col(value).alias(f"_value{k}"))
    tried = left.select("*", first.alias("_first"), second.alias("_second"))
    both = tried.join(side(1), F.col("_first") == F.col("_key1"), "left").join(side(2), F.col("_second") == F.col("_key2"), "left")
    return both.select(*left.columns, F.coalesce("_value1", "_value2").alias(value))


def subset(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the ids; none is an error."""
    out = df.join(ids.select(key).distinct(), key, "left_semi")
    if out.isEmpty():
        raise ValueError("the subset matches no row: are the ids of this corpus?")
    return out


def last_wins(df: DataFrame, key: str, order: Column, *values: str) -> DataFrame:
    """One row a key, that of the greatest order."""
    s = F.max_by(F.struct(*values), order)
    return df.groupBy(key).agg(s.alias("_s")).select(key, *(F.col(f"_s.{v}").alias(v) for v in values))
