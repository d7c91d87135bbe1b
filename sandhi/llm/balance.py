"""Sample matching target category proportions (problem 1): the cube method.

Every record of category c starts with the inclusion probability (seconds wanted of c) / (seconds
available of c), at most 1. The balancing variables of a record are its category's indicator, once times
its probability (the number drawn) and once times its seconds (the seconds drawn); records of different
categories share no constraint, so a flight runs category by category. Three records have a direction
that keeps both sums; moving along it, to one side or the other with the probabilities that keep the
expectation, settles at least one record at 0 or 1. Flights run over buckets of a category, cut by record
hash; at most two records of a bucket stay unsettled and move up to the next level, where FAN buckets are
one. The landing settles the last two of a category by the least seconds that reach the target: what was
wanted is drawn wherever the records allow it. What remains off is reported: a target counts as met if the
sample reached it.

Buckets and the order in them depend on the records alone, and every record draws its own number from its
hash, so the sample does not depend on how the table is partitioned.

Null, blank and unlisted categories and sizes outside the bounds are not drawn; repeated deliveries count
once; ties in hash order are settled by record; a category without records is reported as short; an empty
table gives an empty sample and a report in which every target is short. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandhi.llm.common import clean_key
from sandhi.runtime import materialize

EPS = 1e-9
FAN = 8  # buckets whose unsettled records one bucket of the next level takes
BUCKET = 20_000  # records of a bucket of the first level
UNIT = "cat string, id string, size double, prob double, goal double, bucket long, h long"


def flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Probabilities of one category after the flight phase: all but two at most are 0 or 1."""
    held: list[int] = []
    val, dur = p.tolist(), size.tolist()
    for i in range(len(val)):
        if EPS < val[i] < 1 - EPS:
            held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        # u is orthogonal to (1, 1, 1) and (size a, size b, size c): number and seconds stay
        u = (dur[c] - dur[b], dur[a] - dur[c], dur[b] - dur[a])
        if max(map(abs, u)) < EPS:
            u = (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, x in zip(held, u):
            if x > EPS:
                up, down = min(up, (1 - val[k]) / x), min(down, val[k] / x)
            elif x < -EPS:
                up, down = min(up, val[k] / -x), min(down, (1 - val[k]) / -x)
        step = up if draws[i] * (up + down) < down else -down
        for k, x in zip(held, u):
            val[k] = min(1.0, max(0.0, val[k] + step * x))
        held = [k for k in held if EPS < val[k] < 1 - EPS]
    return np.round(np.array(val), 12)


def fly(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Flights over rows sorted by category, bucket and hash; unsettled records join those that follow."""
    rest: pd.DataFrame | None = None
    for pdf in pdfs:
        for _, g in pdf.groupby(["cat", "bucket"], sort=False):
            same = rest is not None and (rest["cat"].iloc[0], rest["bucket"].iloc[0]) == (g["cat"].iloc[0], g["bucket"].iloc[0])
            if rest is not None and not same:
                yield rest
                rest = None
            g = pd.concat([rest, g], ignore_index=True) if same else g
            draws = (g["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(11)) * 2.0**-53
            g = g.assign(prob=flight(g["prob"].to_numpy(), g["size"].to_numpy(), draws))
            open_ = g["prob"].between(EPS, 1 - EPS)
            yield g[~open_ & (g["prob"] > 0.5)]
            rest = g[open_] if open_.any() else None
    if rest is not None:
        yield rest


def land(g: pd.DataFrame) -> pd.DataFrame:
    """The last unsettled records of a category, two at most: the least total that reaches the goal."""
    have, goal = g["have"].iloc[0], g["goal"].iloc[0]
    size = g["size"].to_numpy()
    ways = [np.array([(w >> k) & 1 for k in range(len(g))], dtype=bool) for w in range(1 << len(g))]
    best = min(ways, key=lambda w: (have + size[w].sum() < goal - 1e-7, abs(have + size[w].sum() - goal), w.sum()))
    return g[best].drop(columns="have")


def balanced_sample(df: DataFrame, key: str, category: str, size: str, targets: DataFrame, share: str, minimum: str, fraction: float = 0.1, lo: float = 0.5, hi: float = 30.0) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample(key, category, size); report: one row a target with available, wanted
    (the greater of minimum and share of the fraction), drawn, residual and whether it could be met."""
    usable = df.where(F.col(size).between(lo, hi)).select(F.col(key).alias("id"), clean_key(F.col(category)).alias("cat"), F.col(size).alias("size")).distinct()
    micro = F.round(F.col("size") * 1_000_000).cast("long")  # sums of whole numbers do not depend on order
    held = materialize(usable, "usable")
    avail = held.groupBy("cat").agg(F.sum(micro).alias("us"), F.count("*").alias("records"))
    avail = materialize(avail, "available")
    total = avail.agg(F.coalesce(F.sum("us"), F.lit(0)).alias("us")).first()["us"] / 1e6
    t = targets.select(clean_key(F.col(category)).alias("cat"), F.col(category).alias("name"), F.coalesce(F.col(share), F.lit(0.0)).alias("share"), F.coalesce(F.col(minimum), F.lit(0.0)).alias("least")).where("cat is not null")
    t = t.groupBy("cat").agg(F.min("name").alias("name"), F.max("share").alias("share"), F.max("least").alias("least"))
    goal = t.join(avail, "cat", "left").select("cat", "name", "least", F.coalesce("records", F.lit(0)).alias("records"), (F.coalesce("us", F.lit(0)) / 1e6).alias("available"), F.greatest("least", F.col("share") * (fraction * total)).alias("wanted"))
    goal = materialize(goal, "goals")

    prob = F.least(F.lit(1.0), F.col("wanted") / F.col("available"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("records") / BUCKET))
    h = F.xxhash64("id")
    units = held.join(goal.where("available > 0"), "cat").select(
        "cat", "id", "size", prob.alias("prob"), F.least("wanted", "available").alias("goal"), F.pmod(F.xxhash64(h), buckets).alias("bucket"), h.alias("h")
    )
    most = goal.agg(F.max(buckets)).first()[0] or 1
    settled: list[DataFrame] = []
    level = units
    while True:
        sorted_ = level.repartition("cat", "bucket").sortWithinPartitions("cat", "bucket", "h", "id")
        level = materialize(sorted_.mapInPandas(fly, UNIT), "flight")
        settled.append(level.where("prob > 0.999999999"))
        level = level.where("prob <= 0.999999999")
        if most == 1:
            break
        most = -(-most // FAN)
        level = level.withColumn("bucket", F.floor(F.col("bucket") / FAN))
    done = settled[0]
    for s in settled[1:]:
        done = done.unionByName(s)
    have = done.groupBy("cat").agg((F.sum(micro) / 1e6).alias("have"))
    left = level.join(have, "cat", "left").fillna(0.0, ["have"])
    landed = materialize(left.groupBy("cat").applyInPandas(land, UNIT), "landing")  # two records a category at most
    sample = done.unionByName(landed).select(F.col("id").alias(key), F.col("cat").alias(category), F.col("size").alias(size))
    drawn = sample.groupBy(F.col(category).alias("cat")).agg(F.sum(F.round(F.col(size) * 1_000_000).cast("long")).alias("us"), F.count("*").alias("n"))
    got = F.coalesce("us", F.lit(0)) / 1e6
    report = goal.join(drawn, "cat", "left").select(
        F.col("name").alias(category), "available", "least", "wanted", got.alias("drawn"), F.coalesce("n", F.lit(0)).alias("n_drawn"),
        (got - F.col("wanted")).alias("residual"), (got >= F.col("wanted")).alias("met"),
    )
    return sample, report


def speaker_sample(utterances: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    return balanced_sample(utterances, "utt_id", "speaker", "dur", targets, "target_share", "min_seconds")


def short_speakers(utterances: DataFrame, targets: DataFrame) -> DataFrame:
    """p1_found: targets that the sample drawn for them did not reach."""
    _, report = speaker_sample(utterances, targets)
    return report.where(~F.col("met")).select("speaker")


def met(utterances: DataFrame, targets: DataFrame) -> DataFrame:
    """p1_met: (speaker, available, wanted, met, close); close: what was drawn is all there is, or at least what
    was wanted and less than one record of 30 seconds more."""
    _, report = speaker_sample(utterances, targets)
    enough = (F.col("residual") >= 0) & (F.col("residual") < 30)
    return report.select("speaker", "available", "wanted", "met", (enough | (F.col("drawn") == F.col("available"))).alias("close"))
