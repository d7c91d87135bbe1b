"""Candidate pairs of similar token sets: rare-token blocks, compared tile by tile.

A record is a set of 64-bit tokens. Its tokens are put in one global order, rare ones first, by their exact
numbers of records (those of fewer than RARE and ties by token). Its keys name the blocks it enters; two similar records always have a
key in common:

* ``Jaccard`` and ``Edits``: the first p tokens (the prefix) hold a shared token, the first p + 1 two. A token
  of at most TILE records is a key by itself; of the more frequent ones, pairs are the keys (if the first
  shared token is frequent, so is the second, as it comes later in the order).
* ``Minima``: rolling hashes of two neighbours in that order, the first of them that cannot all be missed. If
  hashes turn out to be held by more than TILE records, one more is taken of each record, so that two are
  shared, and pairs of such hashes are the keys.

A key can only name more than TILE records if its tokens are all frequent; such keys are counted, and blocks
that really are larger are cut into tiles by record hash, each pair of tiles being a block of its own. So the
keys a record has do not grow with the table, but for blocks of records with several frequent tokens in
common. A block is compared on bit signatures: numpy
exclusive-or and bit counts over tiles, leaving out tiles whose sizes differ beyond the radius.

Frequencies are sent to the tasks while they are few (KNOWN, 16 MB) and joined by a shuffle beyond that; the
order is the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandhi.llm.common import lists, mix, starts, within
from sandhi.runtime import materialize

TILE = 4096
RARE = 8  # tokens of fewer records are all equally rare in the order
KNOWN = 1 << 20  # tokens of RARE records or more whose frequencies are broadcast at most
WORDS = 2  # 64-bit words of a signature


@dataclass(frozen=True)
class Jaccard:
    """Sets whose shared tokens are at least num/den of all tokens of both."""

    num: int = 7
    den: int = 10
    tile: int = field(default_factory=lambda: TILE)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - (self.num * n + self.den - 1) // self.den + 1

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Sizes that allow it."""
        return np.minimum(a, b) * self.den >= np.maximum(a, b) * self.num

    def radius(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Most tokens in only one of the two: u - i where i >= u * num / den and u + i = a + b."""
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def keys(self, v: np.ndarray, c: np.ndarray, n: np.ndarray, more: int = 0) -> Keys:
        return prefix_keys(v, c, n, self.prefix(n), self.tile)


@cache
def _common(num: int, den: int, n: int) -> int:
    out = n
    for m in range(-(-num * n // den), n * den // num + 1):
        s = -(-num * (n + m) // (num + den))
        if s <= min(n, m):
            out = min(out, 3 * s - n - m - 1)
    return out


@dataclass(frozen=True)
class Minima(Jaccard):
    """The same sets, found by rolling hashes of two neighbours in the order. Of u tokens in all, d not
    shared cut the shared s into d + 1 runs at most, so at least s - d - 1 hashes are shared."""

    def common(self, n: int) -> int:
        """Least number of rolling hashes that a record of n tokens shares with a similar one."""
        return _common(self.num, self.den, n)

    def keys(self, v: np.ndarray, c: np.ndarray, n: np.ndarray, more: int = 0) -> Keys:
        sizes = np.unique(n)
        few = {int(k): self.common(int(k)) for k in sizes}
        if few and min(few.values()) < 1 + more:
            raise ValueError("records are too small to share the rolling hashes for certain")
        k = n - np.array([few[int(x)] for x in n], dtype=np.int64) + more
        rec = np.repeat(np.arange(len(n)), k)
        at = np.repeat(starts(n), k) + within(k)
        return Keys(rec, joined(v[at], v[at + 1]), (c[at] > self.tile) & (c[at + 1] > self.tile))


@dataclass(frozen=True)
class Edits:
    """Sets of padded q-grams of strings at most k edits apart: an edit touches q grams of either."""

    k: int = 2
    q: int = 3
    tile: int = field(default_factory=lambda: TILE)

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return np.minimum(n, self.k * self.q + 1)

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(a - b) <= self.k

    def radius(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.full(np.broadcast(a, b).shape, 2 * self.k * self.q)

    def keys(self, v: np.ndarray, c: np.ndarray, n: np.ndarray, more: int = 0) -> Keys:
        return prefix_keys(v, c, n, self.prefix(n), self.tile)


Rule = Jaccard | Edits


@dataclass(frozen=True)
class Keys:
    """Block keys: record, key, and whether the block may hold more than TILE records."""

    rec: np.ndarray
    key: np.ndarray
    wide: np.ndarray


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rolling hash of two tokens in order."""
    with np.errstate(over="ignore"):
        return mix(mix(a.view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + mix(b.view(np.uint64) + np.uint64(1)))


def prefix_keys(v: np.ndarray, c: np.ndarray, n: np.ndarray, p: np.ndarray, tile: int) -> Keys:
    if (p >= n).any():
        raise ValueError("records are too small to share two tokens for certain")
    rec, pos = np.repeat(np.arange(len(n)), n), within(n)
    hot = c > tile
    one = ~hot & (pos < p[rec])
    frequent = np.flatnonzero(hot & (pos <= p[rec]))
    # those of a record stand together: pairs of each with the ones after it
    last = starts(n)[rec[frequent]] + p[rec[frequent]]
    after = last - frequent
    left = np.repeat(frequent, after)
    right = left + 1 + within(after)
    return Keys(
        np.concatenate([rec[one], rec[left]]),
        np.concatenate([v[one].view(np.uint64), joined(v[left], v[right])]),
        np.concatenate([np.zeros(int(one.sum()), dtype=bool), np.ones(len(left), dtype=bool)]),
    )


def once(b: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of equal id, lo and side once, so that a group of copies, however large, adds one row a batch."""
    at = [b.column(k).to_numpy(zero_copy_only=False) for k in range(3)]
    o = np.lexsort(at)
    new = np.ones(len(o), dtype=bool)
    new[1:] = np.logical_or.reduce([x[o][1:] != x[o][:-1] for x in at])
    return b if new.all() else b.take(pa.array(np.sort(o[new])))


def distinct(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct tokens of every record, sorted, and their numbers."""
    rec = np.repeat(np.arange(len(n)), n)
    o = np.lexsort((v, rec))
    v, rec = v[o], rec[o]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (rec[1:] != rec[:-1])
    return v[keep], np.bincount(rec[keep], minlength=len(n))


def frequencies(df: DataFrame) -> DataFrame:
    """(token, n) of all tokens of RARE records or more of df(id, lo, side, tokens), materialised; the tokens of a
    record are distinct."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, k = np.unique(lists(once(b).column(3))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int64)), pa.array(k.astype(np.int64))], ["token", "n"])

    got = df.select("id", "lo", "side", "tokens").mapInArrow(count, "token long, n long")
    return materialize(got.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= RARE), "frequencies")


def by_join(df: DataFrame, freq: DataFrame) -> DataFrame:
    """df(id, lo, side, tokens) with its tokens in the global order, and their frequencies, by a shuffle."""
    each = df.dropDuplicates(["id", "lo", "side"]).select("id", "lo", "side", F.explode_outer("tokens").alias("token"))
    t = each.join(freq, "token", "left").select("id", "lo", "side", F.struct(F.coalesce("n", F.lit(1).cast("long")).alias("n"), "token").alias("t"))
    t = t.groupBy("id", "lo", "side").agg(F.sort_array(F.collect_list("t")).alias("t"))  # one record's tokens
    return t.select("id", "lo", "side", F.col("t.token").alias("tokens"), F.col("t.n").alias("counts"))


def signatures(v: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """WORDS words a record, one bit a token; all lengths must be positive."""
    h = mix(v.view(np.uint64)) >> np.uint64(57)
    bit = np.uint64(1) << (h & np.uint64(63))
    return [np.bitwise_or.reduceat(np.where((h >> np.uint64(6)) % np.uint64(WORDS) == w, bit, np.uint64(0)), starts(n)) for w in range(WORDS)]


SIGNS = [f"s{w}" for w in range(WORDS)]
ENTRY = "block long, meta int, id long, side byte, " + ", ".join(f"{s} long" for s in SIGNS)


def entries(df: DataFrame, rule: Rule, least: int = 2) -> DataFrame:
    """df(id long, lo long, side byte, tokens array<long>), the tokens of a record being distinct, to block
    entries of the records with at least ``least`` tokens. id and lo together name a set; only id goes on, and sets that share it are
    told apart where pairs are verified. meta is 4 times the size plus the role in a pair of tiles."""
    freq = frequencies(df)
    spark = df.sparkSession
    if joins := freq.count() > KNOWN:
        rows, sent = by_join(df, freq), None
    else:
        rows = df.select("id", "lo", "side", "tokens")
        f = freq.toPandas().sort_values("token")
        sent = spark.sparkContext.broadcast((f["token"].to_numpy(np.int64), f["n"].to_numpy(np.int64)))
    hot = freq.where(F.col("n") > rule.tile)

    def ordered(b: pa.RecordBatch) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]:
        b = once(b)
        v, n = lists(b.column(3))
        if joins:
            c = lists(b.column(4))[0]
        else:
            c = np.ones(len(v), dtype=np.int64)
            t, k = sent.value
            if len(t):
                at = np.minimum(np.searchsorted(t, v), len(t) - 1)
                c = np.where(t[at] == v, k[at], 1)
            o = np.lexsort((v, c, np.repeat(np.arange(len(n)), n)))
            v, c = v[o], c[o]
        big = n >= max(2, least)
        inside = np.repeat(big, n)
        return b.filter(pa.array(big)), v[inside], c[inside], n[big]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, v, c, n = ordered(b)
            k = rule.keys(v, c, n)
            t, m = np.unique(k.key[k.wide], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(m.astype(np.int64))], ["block", "n"])

    def emitted(more: int = 0, wide_only: bool = False) -> DataFrame:
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                b, v, c, n = ordered(b)
                if not len(n):
                    continue
                k, sig = rule.keys(v, c, n, more), signatures(v, n)
                rec, key = (k.rec[k.wide], k.key[k.wide]) if wide_only else (k.rec, k.key)
                ids, side = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array((n[rec] * 4 + 2).astype(np.int32)), pa.array(ids[rec]), pa.array(side[rec].astype(np.int8)), *(pa.array(s[rec].view(np.int64)) for s in sig)],
                    ["block", "meta", "id", "side", *SIGNS],
                )

        return rows.mapInArrow(emit, ENTRY)

    if hot.isEmpty():
        return emitted()
    large = larger(rows.mapInArrow(count, "block long, n long").groupBy("block").agg(F.sum("n").alias("n")), rule.tile)
    if large.isEmpty():
        return emitted()
    if not isinstance(rule, Minima):
        return tiled(emitted(), large, rule.tile)
    # of two shared hashes one is not large and is a key, or both are and the two of them are one
    rest = emitted(1).join(large, "block", "left_anti")
    own = emitted(1, True).join(large, "block", "left_semi").groupBy("id", "side", "meta", *SIGNS).agg(F.sort_array(F.collect_set("block")).alias("h"))
    pairs = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: F.xxhash64(x, y))))
    paired = materialize(own.select(F.explode(pairs).alias("block"), "meta", "id", "side", *SIGNS), "paired")
    still = larger(paired.groupBy("block").agg(F.count("*").alias("n")), rule.tile)
    return rest.select(*paired.columns).unionByName(paired if still.isEmpty() else tiled(paired, still, rule.tile))


def larger(sizes: DataFrame, tile: int) -> DataFrame:
    return materialize(sizes.where(F.col("n") > tile), "large")


def tiled(entered: DataFrame, large: DataFrame, tile: int) -> DataFrame:
    """Entries of blocks in large(block, n) as entries of pairs of tiles. A pair of records meets in the one
    block of their two tiles; within a pair of different tiles only records of different tiles are compared."""
    e = entered.join(large, "block", "left").withColumn("g", F.ceil(F.coalesce("n", F.lit(0)) / F.lit(tile)))
    e = e.withColumn("own", F.when(F.col("g") > 1, F.pmod(F.xxhash64("id", F.lit(1)), "g"))).withColumn("other", F.explode_outer(F.when(F.col("g") > 1, F.sequence(F.lit(0).cast("long"), F.col("g") - 1))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    role = F.when(F.col("own").isNull() | (lo == hi), 2).otherwise((F.col("own") == hi).cast("int"))
    block = F.when(F.col("own").isNull(), F.col("block")).otherwise(F.xxhash64("block", lo, hi))
    return e.select(block.alias("block"), (F.col("meta") - 2 + role).cast("int").alias("meta"), "id", "side", *SIGNS)


def popcount(xs: list[np.ndarray]) -> np.ndarray:
    return sum(np.bitwise_count(x).astype(np.int64) for x in xs)


def pair_finder(rule: Rule, cross: bool) -> Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """For entries of whole blocks, sorted by block: positions of the pairs within the radius.
    cross: only pairs of different sides."""

    def allowed(e: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        n = e["meta"] >> 2
        ok = rule.close(n[i], n[j]) & (e["id"][i] != e["id"][j])
        role = e["meta"] & 3
        ok &= (role[i] == 2) | (role[i] != role[j])
        if cross:
            ok &= e["side"][i] != e["side"][j]
        i, j = i[ok], j[ok]
        near = popcount([e[s][i] ^ e[s][j] for s in SIGNS]) <= rule.radius(n[i], n[j])
        return i[near], j[near]

    def tiles(e: dict, lo: int, hi: int, tile: int = 512):
        """One large block, its entries sorted by size: tile against tile."""
        n = e["meta"] >> 2
        for a in range(lo, hi, tile):
            i = np.arange(a, min(a + tile, hi))
            for b in range(a, hi, tile):
                if not rule.close(n[i[-1:]], n[b : b + 1]).any() and n[b] > n[i[-1]]:
                    break  # sizes only grow from here
                j = np.arange(b, min(b + tile, hi))
                x = sum(np.bitwise_count(e[s][i][:, None] ^ e[s][j][None, :]).astype(np.int16) for s in SIGNS)
                p, q = np.nonzero(x <= rule.radius(n[i][:, None], n[j][None, :]))
                p, q = i[p], j[q]
                yield allowed(e, p[p < q], q[p < q])

    def find(e: dict) -> tuple[np.ndarray, np.ndarray]:
        size = len(e["block"])
        head = np.flatnonzero(np.r_[True, e["block"][1:] != e["block"][:-1]]) if size else np.zeros(0, np.int64)
        length = np.diff(np.r_[head, size])
        out: list = []
        for h, m in zip(head[length > 64], length[length > 64]):
            out.extend(tiles(e, h, h + m))
        small = np.repeat(length <= 64, length)
        at = np.flatnonzero(small)
        end = np.repeat(head + length, length)
        d = 1
        while len(at := at[at + d < end[at]]):
            out.append(allowed(e, at, at + d))
            d += 1
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])

    return find


def candidates(entered: DataFrame, rule: Rule, cross: bool = False) -> DataFrame:
    """Distinct pairs (a, b) whose signatures are within the radius; a < b, or, across sides,
    a of side 0 and b of side 1."""
    find = pair_finder(rule, cross)
    names = entered.columns

    def ordered(parts: list[dict]) -> dict:
        """All parts as one, sorted, without repeated entries (copies from other batches)."""
        e = {k: np.concatenate([x[k] for x in parts]) for k in names}
        o = np.lexsort((*(e[s] for s in SIGNS), e["side"], e["id"], e["meta"], e["block"]))
        e = {k: x[o] for k, x in e.items()}
        keep = np.ones(len(o), dtype=bool)
        keep[1:] = ~np.logical_and.reduce([e[k][1:] == e[k][:-1] for k in names])
        return {k: x[keep] for k, x in e.items()}

    def pairs(e: dict) -> pa.RecordBatch:
        i, j = find(e)
        a, b = e["id"][i], e["id"][j]
        swap = e["side"][i] > e["side"][j] if cross else a > b
        p = np.unique(np.stack([np.where(swap, b, a), np.where(swap, a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(p[0]), pa.array(p[1])], ["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        rows = 0
        for b in batches:
            e = {k: b.column(x).to_numpy(zero_copy_only=False) for x, k in enumerate(names)}
            e |= {s: e[s].view(np.uint64) for s in SIGNS}  # bits of a negative number would be those of its size
            held.append(e)
            rows += len(e["block"])
            if rows < 100_000:
                continue
            e = ordered(held)
            # the last block may go on; what is held of it has no copies, so it is no larger than a pair of tiles
            last = int(np.searchsorted(e["block"], e["block"][-1]))
            if last:
                yield pairs({k: x[:last] for k, x in e.items()})
            held = [{k: x[last:] for k, x in e.items()}]
            rows = len(held[0]["block"])
        if held:
            yield pairs(ordered(held))

    return entered.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long").distinct()
