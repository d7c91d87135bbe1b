"""Same or near-same records across splits (problem 4): winnowing fingerprints.

Small edits and moved words leave short texts no long common run, so fingerprints are taken of the distinct
terms in one order for all texts, from rare to frequent: there, two texts over the threshold always have
common runs. Rolling hashes of two neighbours are taken, and of each text the minima in that order, as many
as it takes for two similar texts to share one for certain (blocks.Minima). They are joined across splits
only, and the pairs checked exactly. For coverage, the texts as written are winnowed: of every WINDOW
consecutive rolling hashes of GRAM terms the least is a seed; shared seeds of a pair are chained collinearly,
the gaps aligned, and the aligned share reported for either record.

Null and blank texts have no fingerprints; null and empty sent_ids tie nothing; repeated deliveries count
once; rows of a split other than train, dev and test are left out; a key delivered in two splits is no
overlap with itself; empty tables give empty results. Only the
named columns are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandhi.llm.blocks import Minima, candidates, entries
from sandhi.llm.common import mix, starts, term_hashes, within
from sandhi.llm.neardup import classes, shared_ids, verified
from sandhi.runtime import materialize

GRAM, WINDOW = 5, 4


def rolling(v: np.ndarray, n: np.ndarray, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive terms of every record, and their numbers."""
    m = np.maximum(n - k + 1, 0)
    h = np.zeros(max(len(v) - k + 1, 0), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + mix(v.view(np.uint64)[j : j + len(h)])
        at = np.repeat(starts(n), m) + within(m)
        return mix(h[at]), m


def minima(h: np.ndarray, m: np.ndarray, w: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: positions of the least hash (the last of equals) of every w consecutive ones of a record,
    or of all where it has fewer, each position once; and their numbers."""
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(len(m), np.int64)
    windows = np.where(m > 0, np.maximum(m - w + 1, 1), 0)
    first = np.repeat(starts(m), windows) + within(windows)
    width = np.repeat(np.minimum(m, w), windows)
    best = first.copy()
    for j in range(1, w):
        at = np.minimum(first + j, len(h) - 1)
        best = np.where((j < width) & (h[at] <= h[best]), at, best)
    rec = np.repeat(np.arange(len(m)), windows)
    keep = np.ones(len(best), dtype=bool)
    keep[1:] = best[1:] != best[:-1]  # minima move forward only
    return best[keep], np.bincount(rec[keep], minlength=len(m))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, a bit a term of a."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & where.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def coverage(a: list, b: list, seeds: list[tuple[int, int]], k: int = GRAM) -> int:
    """Terms aligned: the longest collinear chain of seeds (positions in a and b), and the gaps aligned."""
    tails: list[tuple[int, int]] = []
    back: dict = {}
    for s in sorted(set(seeds), key=lambda x: (x[0], -x[1])):
        p = bisect_left([t[1] for t in tails], s[1])
        back[s] = tails[p - 1] if p else None
        tails[p : p + 1] = [s]
    chain, at = [], tails[-1] if tails else None
    while at:
        chain.append(at)
        at = back[at]
    n, i, j = 0, 0, 0
    for x, y in reversed(chain):
        x0, y0 = max(x, i), max(y, j)
        skip = max(x0 - x, y0 - y)
        if skip >= k:
            continue
        x0, y0 = x + skip, y + skip
        n += lcs(a[i:x0], b[j:y0]) + k - skip
        i, j = x + k, y + k
    return n + lcs(a[i:], b[j:])


def seeds(a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
    """Positions in a and in b of equal winnowed hashes, all of a hash with all of it; None where those would
    be more than four times the terms, as in texts that say the same again and again."""
    v, n = np.array(a + b, dtype=np.int64), np.array([len(a), len(b)])
    h, m = rolling(v, n)
    at, k = minima(h, m)
    mine: dict[int, list[int]] = {}
    for p in at[: k[0]]:
        mine.setdefault(int(h[p]), []).append(int(p))
    if sum(len(mine.get(int(h[p]), ())) for p in at[k[0] :]) > 4 * len(v):
        return None
    return [(i, int(p - m[0])) for p in at[k[0] :] for i in mine.get(int(h[p]), ())]


def aligned(a: list[int], b: list[int]) -> int:
    """Terms aligned along the chain of seeds, or, where there are too many of them, by the whole texts."""
    s = seeds(a, b)
    return lcs(a, b) if s is None else coverage(a, b, s)


def across(utterances: DataFrame, num: int = 7, den: int = 10, least: int = 8) -> DataFrame:
    """(train, held): pairs of near-same texts."""
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("dev", "test"), 1)
    u = utterances.select("utt_id", "text", side.cast("byte").alias("side")).where("side is not null")
    t = classes(u, "utt_id", "text", ["side"], least)
    rule = Minima(num, den)
    rows = t.select(F.col("set_id").alias("id"), F.col("set_lo").alias("lo"), "side", F.col("terms").alias("tokens"))
    pairs = materialize(candidates(entries(rows, rule, least), rule, cross=True), "across")
    links = verified_across(pairs.unionByName(shared_ids(t)), t, num, den)
    m = t.select("set_id", "set_lo", "key", "side").distinct()
    x = m.where("side = 0").select(F.col("set_id").alias("a"), F.col("set_lo").alias("alo"), F.col("key").alias("train"))
    y = m.where("side = 1").select(F.col("set_id").alias("b"), F.col("set_lo").alias("blo"), F.col("key").alias("held"))
    near = links.join(x, ["a", "alo"]).join(y, ["b", "blo"]).select("train", "held")
    equal = x.join(y, (x["a"] == y["b"]) & (x["alo"] == y["blo"])).select("train", "held")
    return near.unionByName(equal).where("train != held")


def verified_across(pairs: DataFrame, t: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, alo, b, blo) from train to held-out sets; those of one id may be linked either way."""
    links = verified(pairs, t, num, den).select("a", "alo", "b", "blo")
    turned = links.where("a = b").select("a", F.col("blo").alias("alo"), "b", F.col("alo").alias("blo"))
    return links.unionByName(turned)


def same_sentence(utterances: DataFrame) -> DataFrame:
    u = utterances.where("sent_id is not null and sent_id != ''").select("utt_id", "sent_id", "split").distinct()
    x = u.where("split = 'train'").select("sent_id", F.col("utt_id").alias("train"))
    y = u.where("split in ('dev', 'test')").select("sent_id", F.col("utt_id").alias("held"))
    return x.join(y, "sent_id").where("train != held").select("train", "held")


def found(utterances: DataFrame) -> DataFrame:
    """p4_found: pairs of a train and a held-out utterance with near-same text or the same sent_id."""
    pairs = across(utterances).unionByName(same_sentence(utterances))
    return pairs.select(F.least("train", "held").alias("utt_a"), F.greatest("train", "held").alias("utt_b")).distinct()


def either(utterances: DataFrame) -> DataFrame:
    """(train, held, by_text, by_sent_id): pairs with near-same text or the same sent_id; written."""
    text = across(utterances).select("train", "held", F.lit(True).alias("by_text"), F.lit(False).alias("by_sent_id"))
    sent = same_sentence(utterances).select("train", "held", F.lit(False).alias("by_text"), F.lit(True).alias("by_sent_id"))
    pairs = text.unionByName(sent).groupBy("train", "held").agg(F.max("by_text").alias("by_text"), F.max("by_sent_id").alias("by_sent_id"))
    return materialize(pairs, "overlaps")


def overlaps(utterances: DataFrame) -> DataFrame:
    """One row a pair of a train and a held-out record, their split and corpus, and how they are alike:
    (train, held, split, corpus, train_corpus, by_text, by_sent_id, aligned, cover_train, cover_held), the
    covers being the share of either record's terms that the alignment holds (null for a text without terms)."""
    pairs = either(utterances)
    keys = pairs.select(F.col("train").alias("utt_id")).unionByName(pairs.select(F.col("held").alias("utt_id"))).distinct()
    rows = utterances.join(keys, "utt_id", "left_semi").groupBy("utt_id").agg(F.max("corpus").alias("corpus"), F.max_by("split", F.when(F.col("split") != "train", F.col("split"))).alias("split"), F.max("text").alias("text"))
    one = materialize(rows.select("utt_id", "corpus", "split", term_hashes(F.col("text")).alias("terms")), "records")
    x = one.select(F.col("utt_id").alias("train"), F.col("corpus").alias("train_corpus"), F.col("terms").alias("a"))
    y = one.select(F.col("utt_id").alias("held"), "split", "corpus", F.col("terms").alias("b"))
    names = ["train", "held", "split", "corpus", "train_corpus", "by_text", "by_sent_id"]
    both = pairs.join(x, "train").join(y, "held").select(*names, "a", "b")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            got, la, lb = [], [], []
            for a, b in zip(r.column(7).to_pylist(), r.column(8).to_pylist()):
                got.append(aligned(a, b))
                la.append(len(a))
                lb.append(len(b))
            n = np.array(got, dtype=np.int64)
            share = lambda k: pa.array([g / m if m else None for g, m in zip(got, k)], pa.float64())
            yield pa.RecordBatch.from_arrays([*r.columns[:7], pa.array(n), share(la), share(lb)], [*names, "aligned", "cover_train", "cover_held"])

    kinds = "train string, held string, split string, corpus string, train_corpus string, by_text boolean, by_sent_id boolean, aligned long, cover_train double, cover_held double"
    return both.mapInArrow(align, kinds)


def by_split(utterances: DataFrame) -> DataFrame:
    """Overlaps per held-out split and corpus: held-out records and pairs concerned, by text and by sent_id."""
    kind = utterances.where("split in ('dev', 'test')").groupBy(F.col("utt_id").alias("held")).agg(F.max("split").alias("split"), F.max("corpus").alias("corpus"))
    each = either(utterances).groupBy("held").agg(F.count_if("by_text").alias("t"), F.count_if("by_sent_id").alias("s")).join(kind, "held")
    return each.groupBy("split", "corpus").agg(
        F.count_if(F.col("t") > 0).alias("held_by_text"), F.sum("t").alias("text_pairs"), F.count_if(F.col("s") > 0).alias("held_by_sent_id"), F.sum("s").alias("sent_id_pairs")
    )
