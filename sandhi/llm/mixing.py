"""Mixing sources to target weights (problem 8).

A curriculum gives each source a weight over the course of training, piecewise linear between equally
spaced knots (flat if not named); scaled so that its integral is the tokens the source is to give, it is
the rate at which the source is used. The documents of a source, in hash order and over as many passes as
the demand needs, take up its cumulative demand one after the other; the inverse of the cumulative demand
gives the time at which a document is due, and the demand of all sources up to that time its training
position. A document is used if it begins before the demand ends, so a source that has enough gives what
is wanted, and less than one document more. A source that cannot meet its demand within the allowed repeats
is used in full over the whole course, and reported as short. Rows are range-sorted by position.

Running sums of a source are taken in buckets of its document hashes, offset by the sums of the buckets
before, so that a source holding a third of all rows is no single task.

Documents without source or with a source without target count in the total and are not used; null and
empty texts have no tokens and are not used; ties in hash order are settled by id; a target without
documents is reported as short; an empty table gives an empty mix. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sandhi.llm.common import clean_key
from sandhi.runtime import materialize

#: must be there on every executor; a file sent with SparkContext.addFile is named by its file name alone
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
BUCKET_ROWS = 2_000


@cache
def _counter(path: str):
    """texts -> token counts, for a .model (sentencepiece), .tiktoken or .json (tokenizers) file."""
    if "/" not in path:
        path = SparkFiles.get(path)
    if path.endswith(".model"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
    if path.endswith(".tiktoken"):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(enc.encode_ordinary(x)) for x in texts]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    return lambda texts: [len(x) for x in tok.encode_batch(texts, add_special_tokens=False)]


def token_counts(df: DataFrame, key: str, text: str, source: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc, source, tokens), whole texts; written to the shared folder."""
    kind = dict(df.dtypes)[key]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _counter(tokenizer)
        for b in batches:
            texts = [x or "" for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.array(of(texts), dtype=np.int64))], ["doc", "source", "tokens"])

    rows = df.select(F.col(key).alias("doc"), clean_key(F.col(source)).alias("source"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(count, f"doc {kind}, source string, tokens long"), "tokens")


def cumulative(weights: Sequence[float], knots: int) -> tuple[list[float], list[float]]:
    """Values of a curve at ``knots`` equally spaced knots, scaled to integral 1, and its integral up to each."""
    w = np.interp(np.linspace(0, 1, knots), np.linspace(0, 1, len(weights)), np.maximum(weights, 0.0)) if len(weights) > 1 else np.ones(knots)
    step = 1 / (knots - 1)
    total = float(((w[1:] + w[:-1]) / 2).sum() * step)
    if total <= 0:
        raise ValueError("a curriculum needs a positive weight somewhere")
    w = w / total
    return w.tolist(), np.concatenate([[0.0], np.cumsum((w[1:] + w[:-1]) / 2) * step]).tolist()


def demands(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row a target: share, max_repeats, available and wanted tokens, and use (wanted, but at most what
    the repeats give)."""
    sums = materialize(sized.groupBy("source").agg(F.sum("tokens").alias("available"), F.count("*").alias("docs")), "sources")
    total = sums.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("n")).first()["n"]
    t = targets.select(clean_key(F.col("source")).alias("source"), F.col("source").alias("name"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    t = t.where("source is not null").groupBy("source").agg(F.min("name").alias("name"), F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    t = t.join(sums, "source", "left").fillna(0, ["available", "docs"])
    capacity = (F.col("available") * F.col("max_repeats")).cast("double")
    return t.withColumn("wanted", F.col("target_share") * total).withColumn("use", F.least("wanted", capacity))


def mix(sized: DataFrame, demand: DataFrame, curriculum: Mapping[str, Sequence[float]] | None = None) -> DataFrame:
    """(position, doc, source, pass, tokens): every use of a document, range-sorted by position in [0, 1).
    curriculum: weights of a source (as cleaned) at equally spaced knots of the course."""
    curriculum = curriculum or {}
    knots = 2
    for w in curriculum.values():
        knots = math.lcm(knots - 1, max(1, len(w) - 1)) + 1
    rows = demand.where("use > 0").select("source", "use").collect()  # one a target, of a table that does not grow
    total = sum(r["use"] for r in rows) or 1.0
    curves, rate = [], np.zeros(knots)
    for r in rows:
        w, c = cumulative(curriculum.get(r["source"], (1.0,)), knots)
        curves.append((r["source"], w, c))
        rate += np.array(w) * (r["use"] / total)
    whole = np.concatenate([[0.0], np.cumsum((rate[1:] + rate[:-1]) / 2) / (knots - 1)])
    spark = sized.sparkSession
    curve = spark.createDataFrame(curves, "source string, w array<double>, c array<double>")

    d = sized.where("tokens > 0").join(demand.where("use > 0").select("source", "available", "use", "docs"), "source")
    d = d.withColumn("h", F.xxhash64("doc")).withColumn("bucket", F.pmod(F.shiftright("h", 8), F.greatest(F.lit(1), (F.col("docs") / BUCKET_ROWS).cast("long"))))
    d = materialize(d, "buckets")
    per = d.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    offset = per.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("h", "doc").rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("inside", F.coalesce(inside, F.lit(0))).join(offset, ["source", "bucket"]).withColumn("start", F.col("offset") + F.col("inside"))
    # pass r of a document begins at start + r * available; it is used where that lies before the end of the demand
    passes = F.ceil((F.col("use") - F.col("start")) / F.col("available")).cast("int")
    d = d.where(passes > 0).withColumn("pass", F.explode(F.sequence(F.lit(0), passes - 1)))
    d = d.withColumn("x", (F.col("start") + F.col("pass") * F.col("available")) / F.col("use")).join(curve, "source")
    # the interval of x in the cumulative demand, and in it c + a t + b t^2 = x, t in [0, 1]
    k = F.least(F.size(F.filter("c", lambda c: c <= F.col("x"))), F.lit(knots - 1))
    d = d.withColumn("k", k).withColumn("a", F.element_at("w", F.col("k")) / (knots - 1)).withColumn("e", F.element_at("w", F.col("k") + 1) / (knots - 1))
    b, rest = (F.col("e") - F.col("a")) / 2, F.col("x") - F.element_at("c", F.col("k"))
    root = F.col("a") + F.sqrt(F.greatest(F.lit(0.0), F.col("a") * F.col("a") + 4 * b * rest))
    d = d.withColumn("t", F.when(root > 0, F.least(F.lit(1.0), 2 * rest / root)).otherwise(F.lit(0.0)))
    of = lambda values, i: F.element_at(F.array(*(F.lit(float(v)) for v in values)), i)
    r0, r1 = of(rate / (knots - 1), F.col("k")), of(rate / (knots - 1), F.col("k") + 1)
    position = of(whole, F.col("k")) + r0 * F.col("t") + (r1 - r0) / 2 * F.col("t") * F.col("t")
    return d.select(position.alias("position"), "doc", "source", "pass", "tokens").repartitionByRange("position").sortWithinPartitions("position", "doc", "pass")


def report(demand: DataFrame, mixed: DataFrame) -> DataFrame:
    """One row a target: wanted and actual tokens and share of the mix, documents used, most uses of one, and
    whether the mix has what was wanted."""
    m = materialize(mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("pass") + 1).alias("most_uses")), "mixed")
    total = m.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    got = F.coalesce("tokens", F.lit(0))
    return demand.join(m, "source", "left").select(
        F.col("name").alias("source"), "target_share", "max_repeats", "available", "wanted", got.alias("mixed"),
        (got / F.lit(float(max(total, 1)))).alias("actual_share"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (got >= F.col("wanted")).alias("met"),
    )


def compose(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, curriculum: Mapping[str, Sequence[float]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix, demand)."""
    sized = token_counts(documents, "doc_id", "text", "source", tokenizer)
    demand = materialize(demands(sized, targets), "demand")
    return mix(sized, demand, curriculum), demand


def short_sources(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """p8_found: targets that the mix, with all repeats, did not reach."""
    mixed, demand = compose(documents, targets, tokenizer)
    return report(demand, mixed).where(~F.col("met")).select("source")
