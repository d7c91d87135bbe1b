"""Splits that keep related records together (problem 6).

Groups are the connected components over shared authors and recordings. The graph is bipartite (authors
and recordings) and far smaller than the records: they are first reduced to distinct pairs. Components
come from hooking and shortcutting over a parent table, a bounded number of joins a round and O(log n)
rounds, each written to the shared folder. Splits are chosen from how many components have which size: a
subset-sum bitset over size multiplicities finds the reachable total closest to each share.

Null and blank authors tie nothing; a record without author and recording is a group of its own; repeated
deliveries count once; components of equal size are interchangeable and are taken in hash order; an empty
table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sandhi.llm.common import clean_key
from sandhi.runtime import materialize

RESOLUTION = 1 << 20  # bits of a subset-sum bitset; totals are counted in units of share / RESOLUTION records
RANK_ROWS = 5_000  # components ranked in one task
SHARES = (("test", 0.1), ("dev", 0.1))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b long) to (node, root): root is the least node of the component."""
    e = materialize(edges.where("a is not null and b is not null").distinct(), "edges")
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node")))
    parent = materialize(nodes.distinct().select("node", F.col("node").alias("root")), "parent")
    for _ in range(rounds):
        # roots joined to the edges; an edge between two trees hooks the larger root below the smaller
        r = parent.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        s = parent.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        across = e.join(r, "a").join(s, "b").where("ra != rb")
        hook = materialize(across.select(F.greatest("ra", "rb").alias("root"), F.least("ra", "rb").alias("to")).groupBy("root").agg(F.min("to").alias("to")), "hook")
        if hook.isEmpty():
            return parent
        # shortcutting: chains of hooks are halved until every root points at the end of its chain
        while True:
            up = hook.select(F.col("root").alias("to"), F.col("to").alias("up"))
            jumped = hook.join(up, "to", "left").select("root", F.coalesce("up", "to").alias("to"), F.col("up").isNotNull().alias("moved"))
            jumped = materialize(jumped, "jump")
            hook = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        parent = materialize(parent.join(hook, "root", "left").select("node", F.coalesce("to", "root").alias("root")), "parent")
    raise RuntimeError(f"components not complete after {rounds} rounds")


def recording(utt_id: Column) -> Column:
    """The middle of <upload>_<recording>_<index>."""
    return F.regexp_extract(utt_id, r"^[^_]*_(.+)_[^_]*$", 1)


def tied(utterances: DataFrame) -> DataFrame:
    """(utt_id, split, speaker_node, recording_node, own) once an utterance; nodes are hashes or null."""
    rec = F.when((F.col("corpus") == "mucs") & (recording(F.col("utt_id")) != ""), F.xxhash64(F.lit("r"), recording(F.col("utt_id"))))
    spk = F.when(clean_key(F.col("speaker")).isNotNull(), F.xxhash64(F.lit("s"), clean_key(F.col("speaker"))))
    return utterances.select("utt_id", "split", spk.alias("speaker_node"), rec.alias("recording_node"))


def roots(t: DataFrame) -> DataFrame:
    """t(…, speaker_node, recording_node) with root: the component of the record."""
    seen = t.select("speaker_node", "recording_node").distinct()
    tree = components(seen.select(F.coalesce("recording_node", "speaker_node").alias("a"), F.coalesce("speaker_node", "recording_node").alias("b")))
    at = F.coalesce("recording_node", "speaker_node")
    own = F.xxhash64(F.lit("u"), "utt_id")
    return t.withColumn("node", F.coalesce(at, own)).join(tree, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def spread(utterances: DataFrame) -> DataFrame:
    """p6_found: utterances whose group lies in more than one split."""
    t = tied(utterances)
    g = t.select("speaker_node", "recording_node", "split").distinct()
    # groups need the nodes only: utterances without any are groups of one split
    at = F.coalesce("recording_node", "speaker_node")
    tree = components(g.select(at.alias("a"), F.coalesce("speaker_node", "recording_node").alias("b")))
    own = g.select(at.alias("node"), "split").where("node is not null").join(tree, "node")
    bad = own.groupBy("root").agg(F.min("split").alias("x"), F.max("split").alias("y")).where("x != y")
    nodes = tree.join(bad, "root", "left_semi").select("node")
    ids = t.select("utt_id", at.alias("node")).join(nodes, "node", "left_semi")
    return ids.select("utt_id").distinct()


def closest(sizes: list[tuple[int, int]], target: int) -> dict[int, int]:
    """How many components of each size to take so that the total is closest to target (to within rounding
    of the sizes, where the target exceeds the resolution). sizes: (size, how many).

    The bitset of reachable totals is kept at every STRIDE-th part only and worked out again between those
    while the choice is traced back, so memory grows with the square root of the number of parts."""
    unit = max(1, -(-target // RESOLUTION))
    goal = target // unit
    mask = (1 << (2 * goal + 2)) - 1
    parts = []  # a multiplicity m is split into 1, 2, 4, ... and a rest: any count up to m is a sum of these
    for size, m in sorted(sizes, reverse=True):
        k = 1
        while m > 0:
            take = min(k, m)
            parts.append((size, take, max(1, round(size * take / unit))))
            m, k = m - take, k * 2
    stride = max(1, math.isqrt(len(parts)))

    def grown(reach: int, w: int) -> int:
        return reach | (reach << w) & mask if w <= 2 * goal + 1 else reach

    reach, kept = 1, []
    for i, (_, _, w) in enumerate(parts):
        if i % stride == 0:
            kept.append(reach)
        reach = grown(reach, w)
    below = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1  # 0 is always reachable
    over = reach >> goal
    above = goal + (over & -over).bit_length() - 1 if over else below
    at = below if goal - below <= above - goal or not over else above
    chosen: dict[int, int] = {}
    for block in range(len(kept) - 1, -1, -1):
        lo, hi = block * stride, min(len(parts), (block + 1) * stride)
        was = [kept[block]]
        for _, _, w in parts[lo : hi - 1]:
            was.append(grown(was[-1], w))
        for i in range(hi - 1, lo - 1, -1):
            size, take, w = parts[i]
            if not (was[i - lo] >> at) & 1:
                at -= w
                chosen[size] = chosen.get(size, 0) + take
    return chosen


def assign(utterances: DataFrame, wanted: tuple[tuple[str, float], ...] = SHARES, rest: str = "train") -> DataFrame:
    """(utt_id, root, new_split): whole components to splits, totals as close to the shares as sizes allow."""
    once = roots(tied(utterances).drop("split").distinct())
    u = materialize(once.select("utt_id", "root"), "rooted")
    comp = materialize(u.groupBy("root").agg(F.count("*").alias("size")), "sizes")
    # distinct sizes are at most the square root of twice the records
    hist = {r["size"]: r["m"] for r in comp.groupBy("size").agg(F.count("*").alias("m")).collect()}
    total = sum(s * m for s, m in hist.items())
    plan, left = [], dict(hist)
    for name, share in wanted:
        got = closest([(s, m) for s, m in left.items() if m], round(share * total))
        plan.append((name, got))
        left = {s: m - got.get(s, 0) for s, m in left.items()}
    bounds, at = [], dict.fromkeys(hist, 0)
    for name, got in plan:
        for s, n in got.items():
            bounds.append((s, at[s], at[s] + n, name))
            at[s] += n
    spark = utterances.sparkSession
    cuts = spark.createDataFrame(bounds or [(-1, 0, 0, rest)], "size long, lo long, hi long, new_split string")
    ranked = rank_in_size(comp)
    split = ranked.join(cuts, (ranked["size"] == cuts["size"]) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left").select("root", F.coalesce("new_split", F.lit(rest)).alias("new_split"))
    return u.join(split, "root").select("utt_id", "root", "new_split")


def shares(utterances: DataFrame, wanted: tuple[tuple[str, float], ...] = SHARES, rest: str = "train") -> DataFrame:
    """(split, records, broken, wanted, share): what each split was to have, and what it has; broken counts its
    components that lie in another split as well."""
    got = materialize(assign(utterances, wanted, rest), "assigned")
    each = got.groupBy("root", F.col("new_split").alias("split")).agg(F.count("*").alias("records"))
    spread_ = each.groupBy("root").agg(F.count("*").alias("splits"))
    n = each.join(spread_, "root").groupBy("split").agg(F.sum("records").alias("records"), F.count_if(F.col("splits") > 1).alias("broken"))
    total = n.agg(F.coalesce(F.sum("records"), F.lit(0)).alias("n")).first()["n"]
    named = [*wanted, (rest, 1 - sum(x for _, x in wanted))]
    goal = utterances.sparkSession.createDataFrame(named, "split string, wanted double")
    out = goal.join(n, "split", "left").fillna(0, ["records", "broken"])
    return out.select("split", "records", "broken", "wanted", (F.col("records") / F.lit(float(max(total, 1)))).alias("share"))


def rank_in_size(comp: DataFrame) -> DataFrame:
    """0, 1, ... among the components of equal size, in hash order. Most components may have one size:
    ranks are counted in buckets of the hash, offset by the counts of the buckets before."""
    buckets = max(1, comp.count() // RANK_ROWS)
    c = comp.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(buckets)))
    n = c.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = n.withColumn("before", F.sum("n").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.row_number().over(Window.partitionBy("size", "bucket").orderBy("root")) - 1
    return c.withColumn("inside", inside).join(before.drop("n"), ["size", "bucket"]).select("root", "size", (F.col("inside") + F.coalesce("before", F.lit(0))).alias("rank"))
