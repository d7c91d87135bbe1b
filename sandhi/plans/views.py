"""Inputs that several queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sandhi.functions.normalize import scoring
from sandhi.functions.scripts import tokenize
from sandhi.runtime import table


def utterances(spark: SparkSession, d: str) -> DataFrame:
    """Every delivery."""
    return table(spark, d, "utterances")


def once(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Every utterance once, with the columns named: a distinct cannot be pruned, so each query names its own."""
    return utterances(spark, d).select("utt_id", *cols).distinct()


def with_words(df: DataFrame) -> DataFrame:
    """Adds t (normalized text) and ws (its tokens)."""
    return df.withColumn("t", scoring(F.col("text"))).withColumn("ws", tokenize(F.col("t")))


def each(df: DataFrame, array: Column, name: str, *keep: Column | str) -> DataFrame:
    """keep and one row an element. An inner explode would have the planner test the array's size first, and
    for that work out the array, with all its text functions, a second time below everything else."""
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def corrupted(ws: Column) -> Column:
    """A hypothesis made from a reference: every 11th token lost, every 7th replaced by x."""
    marked = F.transform(ws, lambda w, i: F.when((i + 1) % 11 == 0, F.lit(None)).when((i + 1) % 7 == 0, "x").otherwise(w))
    return F.filter(marked, lambda w: w.isNotNull())


def mucs(df: DataFrame) -> DataFrame:
    """Utterances cut from recordings, with rec and idx."""
    p = F.split("utt_id", "_")
    return df.where("corpus = 'mucs'").withColumn("rec", F.get(p, F.size(p) - 2)).withColumn("idx", F.get(p, F.size(p) - 1).try_cast("int"))
