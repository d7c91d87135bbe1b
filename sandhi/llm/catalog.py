"""Queries of the training-data operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandhi.llm import balance, components, leak, lookalike, mixing, mojibake, neardup, overlap, termcount
from sandhi.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.short_speakers(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "speaker_targets"))


def p1_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.met(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "speaker_targets"))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.speaker_sample(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "speaker_targets"))[1]


def p1_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balance.speaker_sample(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "speaker_targets"))[0]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = termcount.all_counts(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "cs_bigrams"))
    return counts.where(F.col("mark").isNotNull()).select("field", "term", "mark")


def p2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return termcount.all_counts(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "cs_bigrams"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.found(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "cs_bigrams"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.all_groups(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "cs_bigrams"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.all_links(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "cs_bigrams"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.found(table(spark, sf_dir, "utterances"))


def p4_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(table(spark, sf_dir, "utterances"))


def p4_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.by_split(table(spark, sf_dir, "utterances"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.found(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "cs_bigrams"))


def p5_spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike.spelled(table(spark, sf_dir, "utterances"), table(spark, sf_dir, "cs_bigrams"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.spread(table(spark, sf_dir, "utterances"))


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.assign(table(spark, sf_dir, "utterances"))


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.shares(table(spark, sf_dir, "utterances"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.runs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.compose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))[0]


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, demand = mixing.compose(table(spark, sf_dir, "documents"), table(spark, sf_dir, "source_targets"))
    return mixing.report(demand, mixed)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.found(table(spark, sf_dir, "documents"))


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.decode(table(spark, sf_dir, "documents")).select(F.col("doc").alias("doc_id"), "restored", "encodings", "complete")


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from sandhi.llm.oracles import SQL

    return dict(SQL)
