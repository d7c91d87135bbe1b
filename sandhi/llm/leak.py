"""Evaluation texts leaking into training text (problem 7): latent semantic retrieval.

Texts become terms. Passages are windows of WIDE terms, STEP apart, so that any run of RUN terms lies whole
in one. Their TF-IDF vectors over the vocabulary of the held-out items (document frequencies from all
documents) are projected into a latent space of RANK dimensions at most, found by a distributed randomised
SVD: every task multiplies its passages by a random matrix and back, the products are summed, the same is
done with the items' passages, and of both ranges the directions strongest in the items are kept. Tasks
compare the passages of their documents with the items' passages by cosine:

* for verbatim runs the least cosine is what a run of RUN of the item passage's terms gives; the parts of
  both vectors outside the latent space are bounded by Cauchy-Schwarz and added, so no passage with such a
  run is below it;
* for paraphrases (``near``) the cosine in the NEAR_RANK strongest dimensions has to reach COSINE, and a
  passage to have as many terms of the items as the least share of the shortest passage.

Candidates are checked exactly: longest common run, longest common subsequence, coverage of the item and
of its best passage. The items have no answers to check.

The items are a stated query set. All documents are numbered by one vocabulary, once. Items are taken in
groups of GROUP_TERMS terms, each with a space of its own, PASS_GROUPS groups in a pass over the numbered
documents, so what is sent to the tasks is bounded; longer items are cut into segments that overlap.

Null and blank texts hold nothing; equal documents are reported each; repeated items are reported by their
ids; items with fewer terms than RUN cannot leak; empty tables give no rows. Only the named columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandhi.llm.common import list_array, lists, starts, term_hashes, within
from sandhi.llm.overlap import lcs
from sandhi.runtime import materialize

RUN, WIDE, STEP = 8, 16, 8
RANK = 512
SIDE = 64  # random directions multiplied with the passages of the documents
FIT_DOCS = 20_000  # documents, chosen by hash, whose passages shape the latent space; all are searched
GROUP_TERMS = 16_384
SEGMENT = 4_096  # terms of an item, or of a segment of it; segments overlap by WIDE
PASS_GROUPS = 4
NEAR_RANK = 256  # dimensions in which paraphrases are looked for
COSINE, SHARE = 0.45, 0.6  # least cosine of a paraphrase, and least share of the item passage's terms kept in order


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages of records of n terms: record, first position in the flat terms, width."""
    k = np.where(n > 0, 1 + -(-np.maximum(n - WIDE, 0) // STEP), 0)
    rec = np.repeat(np.arange(len(n)), k)
    off = within(k) * STEP
    return rec, np.repeat(starts(n), k) + off, np.minimum(WIDE, n[rec] - off)


def projected(ids: np.ndarray, first: np.ndarray, width: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """Sum of the factor's rows over the distinct terms of every passage; -1 stands for no row."""
    at = np.repeat(first, width) + within(width)
    w = np.repeat(np.arange(len(first)), width)
    x = ids[at]
    known = x >= 0
    x, w = x[known], w[known]
    o = np.lexsort((x, w))
    x, w = x[o], w[o]
    keep = np.ones(len(x), dtype=bool)
    keep[1:] = (x[1:] != x[:-1]) | (w[1:] != w[:-1])
    x, w = x[keep], w[keep]
    out = np.zeros((len(first), factor.shape[1]), dtype=np.float32)
    if len(x):
        head = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
        out[w[head]] = np.add.reduceat(factor[x], head, axis=0)
    return out


def long_runs(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions in a run of RUN or more known terms of one record."""
    ok = ids >= 0
    rec = np.repeat(np.arange(len(n)), n)
    head = np.ones(len(ids), dtype=bool)
    head[1:] = (ok[1:] != ok[:-1]) | (rec[1:] != rec[:-1])
    at = np.flatnonzero(head)
    length = np.diff(np.r_[at, len(ids)])
    return ok & np.repeat(length >= RUN, length)


@dataclass
class Group:
    """Some segments of items: their items' places in the list of items, terms (numbers in the vocabulary of
    the group), passages, and what they become in the latent space."""

    item: np.ndarray  # a segment
    vocab: np.ndarray  # sorted numbers in the vocabulary of all items
    flat: np.ndarray
    n: np.ndarray

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segment, first position and width of the passages that can hold a run."""
        rec, first, width = windows(self.n)
        fits = width >= RUN
        return rec[fits], first[fits], width[fits]


def grouped(terms: list[np.ndarray]) -> list[Group]:
    """Groups of the items' terms (numbers in the vocabulary of all)."""
    parts = []
    for i, t in enumerate(terms):
        for at in range(0, max(1, len(t) - WIDE), SEGMENT - WIDE):
            parts.append((i, t[at : at + SEGMENT]))
    out: list[Group] = []
    held, size = [], 0
    for k, part in enumerate(parts):
        held.append(part)
        size += len(part[1])
        if k + 1 == len(parts) or size + len(parts[k + 1][1]) > GROUP_TERMS:
            flat = np.concatenate([t for _, t in held])
            vocab = np.unique(flat)
            out.append(Group(np.array([i for i, _ in held]), vocab, np.searchsorted(vocab, flat), np.array([len(t) for _, t in held], dtype=np.int64)))
            held, size = [], 0
    return out


def numbered(docs: DataFrame, key: str, text: str, vocab: np.ndarray) -> DataFrame:
    """(doc, ids): vocabulary numbers of the terms in order, -1 for others; written to the shared folder."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = known.value
        for b in batches:
            v, n = lists(b.column(1))
            at = np.minimum(np.searchsorted(voc, v), len(voc) - 1)
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(np.where(voc[at] == v, at, -1).astype(np.int32), n, pa.int32())], ["doc", "ids"])

    rows = docs.select(F.col(key).alias("doc"), term_hashes(F.col(text)).alias("terms"))
    return materialize(rows.mapInArrow(number, f"doc {dict(docs.dtypes)[key]}, ids array<int>"), "numbered")


def document_frequencies(num: DataFrame, size: int) -> tuple[np.ndarray, int]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs = np.zeros(size + 1, dtype=np.int64), 0
        for b in batches:
            v, n = lists(b.column(0))
            rec = np.repeat(np.arange(len(n)), n)[v >= 0]
            total[:size] += np.bincount(np.unique(rec * size + v[v >= 0]) % size, minlength=size)
            docs += len(n)
        total[size] = docs
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    got = num.select("ids").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size + 1, dtype=np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out[:size], int(out[size])


def back(rows: np.ndarray, ids: np.ndarray, first: np.ndarray, width: np.ndarray, w: np.ndarray, total: np.ndarray) -> None:
    """Adds, to the rows of total that the terms of each passage name, the passage's row times the weight."""
    x = ids[np.repeat(first, width) + within(width)]
    r = np.repeat(np.arange(len(first)), width)
    r, x = r[x >= 0], x[x >= 0]
    if len(x):
        o = np.argsort(x, kind="stable")
        head = np.flatnonzero(np.r_[True, x[o][1:] != x[o][:-1]])
        at = x[o][head]
        total[at] += w[at][:, None] * np.add.reduceat(rows[r[o]], head, axis=0)


def local(vocab: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Numbers in a group's vocabulary, -1 for others."""
    at = np.minimum(np.searchsorted(vocab, ids), len(vocab) - 1)
    return np.where(vocab[at] == ids, at, -1)


def latent_space(num: DataFrame, group: Group, idf: np.ndarray, docs: int, rank: int | None = None, seed: int = 7) -> np.ndarray:
    """Orthonormal columns (vocabulary of the group x rank at most) spanning the directions strongest in the
    items' passages among those that their own and the documents' passages have."""
    size = len(group.vocab)
    _, first, width = group.passages()
    rank = min(rank or RANK, len(first), size)
    rng = np.random.default_rng(seed)
    start = rng.standard_normal((size, min(SIDE, size))).astype(np.float32)
    own = np.zeros((size, min(size, rank + 16)), dtype=np.float64)
    back(projected(group.flat, first, width, idf[:, None] * rng.standard_normal(own.shape).astype(np.float32)), group.flat, first, width, idf, own)
    cut = min(1.0, FIT_DOCS / max(docs, 1))
    fit = num.where(F.pmod(F.xxhash64("doc"), F.lit(1_000_000)) < int(cut * 1_000_000)) if cut < 1 else num
    sent = num.sparkSession.sparkContext.broadcast((idf, start, group.vocab))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, omega, vocab = sent.value
        factor = w[:, None] * omega
        total = np.zeros(omega.shape, dtype=np.float64)
        for b in batches:
            v, n = lists(b.column(0))
            v = local(vocab, v)
            _, f, k = windows(n)
            held = np.add.reduceat(v[np.repeat(f, k) + within(k)] >= 0, starts(k)) if len(k) else k
            f, k = f[held >= RUN], k[held >= RUN]
            if len(f):
                back(projected(v, f, k, factor), v, f, k, w, total)
        rows = np.flatnonzero(np.abs(total).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), list_array(total[rows].astype(np.float32).ravel(), np.full(len(rows), omega.shape[1]), pa.float32())], ["term", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for t, r in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.asarray(r.values, dtype=np.float64)
                total[t] = total[t] + x if t in total else x
        if total:
            m = np.stack(list(total.values())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), list_array(m.ravel(), np.full(len(m), m.shape[1]), pa.float32())], ["term", "row"])

    parts = fit.select("ids").mapInArrow(multiply, "term long, row array<float>")
    corpus = np.zeros(start.shape, dtype=np.float64)
    summed = parts.repartition("term").mapInArrow(add, "term long, row array<float>").toPandas()  # vocabulary x SIDE
    if len(summed):
        corpus[summed["term"].to_numpy()] = np.stack(summed["row"].to_numpy())
    q, _ = np.linalg.qr(np.hstack([own / max(np.linalg.norm(own), 1e-12), corpus / max(np.linalg.norm(corpus), 1e-12)]))
    _, _, vt = np.linalg.svd(projected(group.flat, first, width, (idf[:, None] * q).astype(np.float32)), full_matrices=False)
    return (q @ vt[:rank].T).astype(np.float32)


@dataclass
class Index:
    """A group's passages in its latent space."""

    group: Group
    idf: np.ndarray
    basis: np.ndarray
    owner: np.ndarray  # segment of a passage
    first: np.ndarray
    width: np.ndarray
    unit: np.ndarray  # latent vectors of length 1 and below: divided by the length of the whole vector
    rest: np.ndarray  # length of the part outside, divided likewise
    length: np.ndarray
    least: np.ndarray  # least inner product of a passage that holds a run
    member: np.ndarray | None = None  # passages x vocabulary, made in the tasks


def indexed(group: Group, idf: np.ndarray, basis: np.ndarray) -> Index:
    rec, first, width = group.passages()
    square = (idf**2).astype(np.float32)[:, None]
    length = np.sqrt(np.maximum(projected(group.flat, first, width, square)[:, 0], 1e-12))
    unit = projected(group.flat, first, width, idf[:, None] * basis) / length[:, None]
    rest = np.sqrt(np.maximum(1 - (unit**2).sum(axis=1), 0))
    least = np.zeros(len(first), dtype=np.float32)
    for k, (f, w) in enumerate(zip(first, width)):
        least[k] = min(float((idf[np.unique(group.flat[s : s + RUN])] ** 2).sum()) for s in range(f, f + w - RUN + 1))
    return Index(group, idf, basis, rec, first, width, unit, rest, length, least)


def shared_weight(ix: Index, ids: np.ndarray, f: np.ndarray, k: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates (document passage i, item passage j) whose common terms weigh as much as a run does."""
    if not len(i):
        return i, j
    if ix.member is None:
        ix.member = np.zeros((len(ix.first), len(ix.group.vocab)), dtype=bool)
        ix.member[np.repeat(np.arange(len(ix.first)), ix.width), ix.group.flat[np.repeat(ix.first, ix.width) + within(ix.width)]] = True
    at = np.repeat(f[i], k[i]) + within(k[i])
    x = ids[at]
    w = np.where((x >= 0) & ix.member[np.repeat(j, k[i]), x], (ix.idf**2)[x], 0)
    ok = np.add.reduceat(w, starts(k[i])) >= ix.least[j] * (1 - 1e-3)
    return i[ok], j[ok]


def in_group(ix: Index, ids: np.ndarray, n: np.ndarray, near: bool) -> dict[tuple[int, int], list[float]]:
    """(document, segment) to [longest run, best share of a passage], of the documents' numbered terms."""
    doc, f, k = windows(n)
    out: dict[tuple[int, int], list[float]] = {}
    if not len(f):
        return out
    inside = np.repeat(f, k) + within(k)
    run_here = np.add.reduceat(long_runs(ids, n)[inside].astype(np.int64), starts(k)) >= RUN
    known = np.add.reduceat((ids >= 0)[inside].astype(np.int64), starts(k))
    at, seg = starts(n), starts(ix.group.n)
    segments = len(ix.group.n)
    factor = np.hstack([ix.idf[:, None] * ix.basis, (ix.idf**2)[:, None]]).astype(np.float32)
    pairs, close = [], []
    rd, rf, rk = doc[run_here], f[run_here], k[run_here]
    for s in range(0, len(rf), 4096):
        y = projected(ids, rf[s : s + 4096], rk[s : s + 4096], factor)
        norm = np.sqrt(np.maximum(y[:, -1], 1e-12))
        q = y[:, :-1] / norm[:, None]
        rest = np.sqrt(np.maximum(1 - (q**2).sum(axis=1), 0))
        bound = (q @ ix.unit.T + rest[:, None] * ix.rest[None, :]) * norm[:, None]
        i, j = np.nonzero(bound >= (ix.least / ix.length)[None, :] * (1 - 1e-3))
        i, j = shared_weight(ix, ids, rf[s : s + 4096], rk[s : s + 4096], i, j)
        pairs.append(rd[s : s + 4096][i].astype(np.int64) * segments + ix.owner[j])
    if near:
        # the strongest directions, in which both vectors are as long as the parts of them inside
        ok = known >= -(-SHARE * RUN // 1)
        doc, f, k = doc[ok], f[ok], k[ok]
        strong = np.ascontiguousarray(factor[:, : min(NEAR_RANK, ix.basis.shape[1])])
        unit = ix.unit[:, : strong.shape[1]]
        unit = unit / np.sqrt(np.maximum((unit**2).sum(axis=1), 1e-12))[:, None]
        for s in range(0, len(f), 4096):
            q = projected(ids, f[s : s + 4096], k[s : s + 4096], strong)
            i, j = np.nonzero(q @ unit.T >= COSINE * np.sqrt(np.maximum((q**2).sum(axis=1), 1e-12))[:, None])
            close.append(np.stack([i + s, j]))
    for x in np.unique(np.concatenate(pairs)) if pairs else ():
        d, g = divmod(int(x), segments)
        run = common_run(ix.group.flat[seg[g] : seg[g] + ix.group.n[g]], ids[at[d] : at[d] + n[d]])
        if run:
            out[d, g] = [run, 0.0]
    for i, j in np.concatenate(close, axis=1).T if close else ():
        d, g = int(doc[i]), int(ix.owner[j])
        lo, hi = max(at[d], f[i] - STEP), min(at[d] + n[d], f[i] + k[i] + STEP)
        a = ix.group.flat[ix.first[j] : ix.first[j] + ix.width[j]].tolist()
        share = lcs(a, [t for t in ids[lo:hi].tolist() if t >= 0]) / len(a)
        if share >= SHARE:
            got = out.setdefault((d, g), [0, 0.0])
            got[1] = max(got[1], share)
    return out


def search(num: DataFrame, indexes: list[Index], names: list, sizes: list[int], near: bool = False) -> DataFrame:
    """(doc, item, run, share, shared, cover): pairs of a document and an item; run is their longest common
    run of terms (0 below RUN), share the best share of an item passage kept in order (looked for if near),
    shared their longest common subsequence, cover its share of the item."""
    sent = num.sparkSession.sparkContext.broadcast((indexes, names, sizes))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, item_names, lengths = sent.value
        for b in batches:
            v, n = lists(b.column(1))
            at = starts(n)
            rows: dict[tuple[int, int], list] = {}
            for ix in groups:
                ids = local(ix.group.vocab, v)
                seg = starts(ix.group.n)
                for (d, g), (run, share) in in_group(ix, ids, n, near).items():
                    a, t = ix.group.flat[seg[g] : seg[g] + ix.group.n[g]].tolist(), ids[at[d] : at[d] + n[d]].tolist()
                    r = rows.setdefault((d, int(ix.group.item[g])), [0, 0.0, 0])
                    r[0], r[1], r[2] = max(r[0], run), max(r[1], share), r[2] + lcs(a, [x for x in t if x >= 0])
            keep = [(d, i, *r, min(1.0, r[2] / lengths[i])) for (d, i), r in rows.items()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array([x[0] for x in keep], pa.int64())), pa.array([item_names[x[1]] for x in keep], item_type), pa.array([x[2] for x in keep], pa.int32()), pa.array([x[3] for x in keep], pa.float64()), pa.array([x[4] for x in keep], pa.int32()), pa.array([x[5] for x in keep], pa.float64())],
                ["doc", "item", "run", "share", "shared", "cover"],
            )

    kind = dict(num.dtypes)["doc"]
    item_type = pa.string() if names and isinstance(names[0], str) else pa.int64()
    return num.mapInArrow(look, f"doc {kind}, item {'string' if item_type == pa.string() else 'long'}, run int, share double, shared int, cover double")


def common_run(a: np.ndarray, t: np.ndarray) -> int:
    """Longest run of terms of a found in t; 0 below RUN."""
    best, ends = 0, np.zeros(len(t) + 1, dtype=np.int32)
    for x in a:  # ends[j + 1]: length of the common run that ends at this term of a and at t[j]
        ends[1:] = np.where(t == x, ends[:-1] + 1, 0)
        best = max(best, int(ends.max()))
    return best if best >= RUN else 0


def leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", near: bool = False) -> DataFrame:
    """(doc, item, run, share, shared, cover) of every document and item with a common run of RUN terms or,
    if near, with a passage of the item paraphrased."""
    rows = items.select(F.col(item).alias("item"), term_hashes(F.col(text)).alias("terms")).where(F.size("terms") >= RUN)
    held = rows.orderBy("item").collect()
    if not held:
        kinds = dict(documents.dtypes)[doc], dict(items.dtypes)[item]
        return documents.sparkSession.createDataFrame([], f"doc {kinds[0]}, item {kinds[1]}, run int, share double, shared int, cover double")
    terms = [np.array(r["terms"], dtype=np.int64) for r in held]
    vocab = np.unique(np.concatenate(terms))
    num = numbered(documents, doc, text, vocab)
    df, docs = document_frequencies(num, len(vocab))
    idf = np.log1p(docs / (1.0 + df)).astype(np.float32)
    indexes = []
    for g in grouped([np.searchsorted(vocab, t) for t in terms]):
        indexes.append(indexed(g, idf[g.vocab], latent_space(num, g, idf[g.vocab], docs)))
    names = [r["item"] for r in held]
    out = None
    for k in range(0, len(indexes), PASS_GROUPS):
        got = search(num, indexes[k : k + PASS_GROUPS], names, [len(t) for t in terms], near)
        out = got if out is None else out.unionByName(got)
    if len(indexes) > PASS_GROUPS:  # an item's segments may be in two passes
        out = out.groupBy("doc", "item").agg(F.max("run").alias("run"), F.max("share").alias("share"), F.sum("shared").cast("int").alias("shared"), F.least(F.lit(1.0), F.sum("cover")).alias("cover"))
    return out


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p7_found."""
    got = leaks(documents, items).where(F.col("run") >= RUN)
    return got.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def pairs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row a document and an item that leaked into it, verbatim or paraphrased."""
    got = leaks(documents, items, near=True)
    return got.select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), F.when(F.col("run") >= RUN, "verbatim").otherwise("paraphrase").alias("kind"), "run", "share", "shared", "cover")


def report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row an item: documents it leaked into verbatim and by paraphrase only, its longest run and best
    coverage there."""
    got = pairs(documents, items).groupBy("item_id").agg(
        F.count_if(F.col("kind") == "verbatim").alias("verbatim"), F.count_if(F.col("kind") == "paraphrase").alias("paraphrased"), F.max("run").alias("longest_run"), F.max("cover").alias("best_cover")
    )
    base = items.select("item_id", "suite").distinct()
    return base.join(got, "item_id", "left").fillna(0, ["verbatim", "paraphrased", "longest_run"]).fillna(0.0, ["best_cover"])


def runs(documents: DataFrame, items: DataFrame) -> DataFrame:
    """One row an item: documents that hold a run of RUN of its terms, and the longest such run."""
    got = leaks(documents, items).groupBy(F.col("item").alias("item_id")).agg(F.countDistinct("doc").alias("documents"), F.max("run").alias("longest_run"))
    return items.select("item_id", "suite").distinct().join(got, "item_id", "left").fillna(0, ["documents", "longest_run"])
