"""Frequency of every distinct value or term (problem 2).

Pairs of term and record identifier are sorted and scanned for runs: once inside every task, where each
record lies whole, so that a term held by a third of all records leaves a task as one run; and once more
over the runs of all tasks, range-partitioned by term. The sorts are Spark's, which spill.

A null or blank text holds no term but counts as a record; repeated deliveries of a record (equal in key
and text) count once; repeated terms of a record add occurrences, not records; terms of equal count need
no order; an empty table has no terms. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandhi.llm.common import term_array
from sandhi.runtime import materialize

RUN = "term string, occurrences long, records long"


def _edges(batch: pa.RecordBatch) -> np.ndarray:
    """True where a row's term differs from the one before (nulls are alike); the first row is True."""
    t = batch.column(0)
    out = np.ones(len(t), dtype=bool)
    if len(t) > 1:
        same = pc.fill_null(pc.equal(t[1:], t[:-1]), False)
        both = pc.and_(pc.is_null(t[1:]), pc.is_null(t[:-1]))
        out[1:] = ~pc.or_(same, both).to_numpy(zero_copy_only=False)
    return out


def _scan(batches: Iterator[pa.RecordBatch], weigh) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term to one row a run; weigh(batch, edges, last) gives occurrences and records a row,
    last being the final row of the batch before."""
    held: tuple | None = None  # term, occurrences, records of the run in progress
    last = None
    for b in batches:
        if not len(b):
            continue
        e = _edges(b)
        goes_on = held is not None and b.column(0)[0].as_py() == held[0]
        occ, rec = weigh(b, e, last if goes_on else None)
        at = np.flatnonzero(e)
        occ, rec = np.add.reduceat(occ, at), np.add.reduceat(rec, at)
        terms = b.column(0).take(pa.array(at))
        if goes_on:
            occ[0] += held[1]
            rec[0] += held[2]
        elif held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]]), pa.array([held[2]])], ["term", "occurrences", "records"])
        if len(at) > 1:
            yield pa.RecordBatch.from_arrays([terms[:-1].cast(pa.string()), pa.array(occ[:-1]), pa.array(rec[:-1])], ["term", "occurrences", "records"])
        held, last = (terms[-1].as_py(), int(occ[-1]), int(rec[-1])), b.slice(len(b) - 1)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([held[0]], pa.string()), pa.array([held[1]]), pa.array([held[2]])], ["term", "occurrences", "records"])


def scan_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (term, record) sorted by both to runs."""

    def weigh(b: pa.RecordBatch, e: np.ndarray, last: pa.RecordBatch | None):
        r = b.column(1).to_numpy(zero_copy_only=False)
        new = e.copy()
        new[1:] |= r[1:] != r[:-1]
        if last is not None:
            new[0] = last.column(1)[0].as_py() != r[0]
        return np.ones(len(r), dtype=np.int64), new.astype(np.int64)

    return _scan(batches, weigh)


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _scan(batches, lambda b, e, last: (b.column(1).to_numpy(zero_copy_only=False).copy(), b.column(2).to_numpy(zero_copy_only=False).copy()))


def frequencies(df: DataFrame, key: str, text: str, terms: Column | None = None) -> DataFrame:
    """(term, occurrences, records) of every term; the row with a null term counts the records.
    terms: the array of terms of a record, if not those of the text."""
    once = df.select(F.col(key).alias("key"), F.col(text).alias("text")).distinct()
    marked = F.concat(F.array(F.lit(None).cast("string")), term_array(F.col("text")) if terms is None else terms)
    # records are told apart inside a task only, where numbers cannot collide as hashes of keys may
    numbered = once.withColumn("record", F.monotonically_increasing_id())
    pairs = numbered.select(F.explode_outer(marked).alias("term"), "record")
    runs = materialize(pairs.sortWithinPartitions("term", "record").mapInArrow(scan_pairs, RUN), "runs")
    return runs.repartitionByRange("term").sortWithinPartitions("term").mapInArrow(merge_runs, RUN)


def marked(freq: DataFrame, rare: str, common: str) -> DataFrame:
    """Adds mark: 'rare', 'common' or null, for freq materialised, whose null row gives the total;
    rare and common are conditions on the columns records and total."""
    total = freq.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    f = freq.where("term is not null").withColumn("total", F.lit(total))
    return f.withColumn("mark", F.when(F.expr(rare), "rare").when(F.expr(common), "common")).drop("total")


def text_terms(utterances: DataFrame) -> DataFrame:
    f = materialize(frequencies(utterances, "utt_id", "text"), "terms")
    return marked(f, "records < 3", "records > 0.05 * total")


def kind_values(switches: DataFrame) -> DataFrame:
    """Values exactly as stored."""
    f = materialize(frequencies(switches, "bigram_id", "kind", F.when(F.col("text").isNotNull(), F.array("text")).otherwise(F.array().cast("array<string>"))), "kinds")
    return marked(f, "records < 0.01 * total", "records > 0.4 * total")


def all_counts(utterances: DataFrame, switches: DataFrame) -> DataFrame:
    """(field, term, occurrences, records, mark) of every term of both fields."""
    t, k = text_terms(utterances), kind_values(switches)
    return t.select(F.lit("text").alias("field"), "*").unionByName(k.select(F.lit("kind").alias("field"), "*"))
