"""Near-duplicate records with small edits (problem 3).

Records with equal token sets form a class; links are found between classes (blocks.py) and verified
exactly. ``near_texts`` and ``near_pairs`` return links between classes plus membership, so a group of
copies costs one class; ``expand`` turns them into record pairs where a result asks for those.

Nulls and blanks have no tokens and are in no link; repeated deliveries of a record count once; ties do
not arise, as every pair within the threshold is returned; an empty table gives empty results. Only the
named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandhi.llm.blocks import Edits, Jaccard, candidates, distinct, entries
from sandhi.llm.common import lists, list_array, mix, starts, term_hashes
from sandhi.runtime import materialize

SEP = "\u0001"


def classes(df: DataFrame, key: str, text: str, extra: list[str] | None = None, least: int = 1) -> DataFrame:
    """(key, set_id, set_lo, n, terms, *extra) a row of df with at least ``least`` distinct terms: their hashes,
    sorted, their number, and the 128 bits that name the set they form; written to the shared folder."""
    extra = extra or []
    kinds = dict(df.dtypes)
    base = df.select(F.col(key).alias("key"), term_hashes(F.col(text)).alias("terms"), *extra)
    schema = "key " + kinds[key] + ", set_id long, set_lo long, n int, terms array<long>" + "".join(f", {x} {kinds[x]}" for x in extra)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # filtered here: a filter on the array in the plan would work the array out twice
            b = b.filter(pa.array(lists(b.column(1))[1] >= max(1, least)))
            v, n = lists(b.column(1))
            tokens, size = distinct(v, n)
            ident = []
            for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
                with np.errstate(over="ignore"):
                    part = mix(mix(tokens.view(np.uint64) ^ np.uint64(salt)) + np.uint64(salt))
                    ident.append(mix(np.add.reduceat(part, starts(size)) if len(part) else np.zeros(0, np.uint64)))
            ok = pa.array(size >= least)
            out = pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x.view(np.int64)) for x in ident), pa.array(size.astype(np.int32)), list_array(tokens, size, pa.int64()), *b.columns[2:]],
                ["key", "set_id", "set_lo", "n", "terms", *extra],
            )
            yield out.filter(ok)

    return materialize(base.mapInArrow(number, schema), "classes")


def shared_ids(table: DataFrame) -> DataFrame:
    """Pairs (a, b), a = b, of the few ids that name more than one set: those sets may be alike, too."""
    g = table.groupBy("set_id").agg(F.min("set_lo").alias("x"), F.max("set_lo").alias("y")).where("x != y")
    return g.select(F.col("set_id").alias("a"), F.col("set_id").alias("b"))


def verified(pairs: DataFrame, table: DataFrame, num: int, den: int) -> DataFrame:
    """(a, alo, b, blo, shared, joint) of the pairs (a, b) of sets that truly share num/den of their terms;
    table has one row or more a set."""
    ids = pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct()
    one = table.join(ids, "set_id", "left_semi").groupBy("set_id", "set_lo").agg(F.first("terms").alias("terms"))
    one = materialize(one, "ends")
    x, y = (one.select(F.col("set_id").alias(s), F.col("set_lo").alias(f"{s}lo"), F.col("terms").alias(f"{s}terms")) for s in "ab")
    both = pairs.join(x, "a").join(y, "b").where("a != b or alo < blo")
    shared = F.size(F.array_intersect("aterms", "bterms"))
    out = both.select("a", "alo", "b", "blo", shared.alias("shared"), (F.size("aterms") + F.size("bterms")).alias("sum"))
    return out.select("a", "alo", "b", "blo", "shared", (F.col("sum") - F.col("shared")).alias("joint")).where(F.col("shared") * den >= F.col("joint") * num)


def near_texts(df: DataFrame, key: str, text: str, num: int = 7, den: int = 10, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """Links (a, alo, b, blo) between classes of texts with at least ``least`` distinct terms, of which they
    share num/den, and membership (key, set_id, set_lo)."""
    table = classes(df, key, text, least=least)
    rule = Jaccard(num, den)
    sets = table.select(F.col("set_id").alias("id"), F.col("set_lo").alias("lo"), F.lit(0).cast("byte").alias("side"), F.col("terms").alias("tokens"))
    pairs = materialize(candidates(entries(sets, rule, least), rule), "near")
    return verified(pairs.unionByName(shared_ids(table)), table, num, den).select("a", "alo", "b", "blo"), table.select("key", "set_id", "set_lo")


def ends(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members as ends of links: (a, alo, x) and (b, blo, y)."""
    m = members.distinct()  # by record, so that a class of a third of all records is spread; joins split it
    return (
        m.select(F.col("set_id").alias("a"), F.col("set_lo").alias("alo"), F.col("key").alias("x")),
        m.select(F.col("set_id").alias("b"), F.col("set_lo").alias("blo"), F.col("key").alias("y")),
    )


def expand(links: DataFrame, members: DataFrame, inside: bool = True) -> DataFrame:
    """All record pairs of linked classes and (if inside) of the records of a class: (key_a, key_b), ordered."""
    x, y = ends(members)
    if inside:
        many = members.distinct().groupBy("set_id", "set_lo").count().where("count > 1")
        links = links.unionByName(many.select(F.col("set_id").alias("a"), F.col("set_lo").alias("alo"), F.col("set_id").alias("b"), F.col("set_lo").alias("blo")))
    p = links.join(x, ["a", "alo"]).join(y, ["b", "blo"]).where((F.col("a") != F.col("b")) | (F.col("alo") != F.col("blo")) | (F.col("x") < F.col("y")))
    return p.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))


def grams(df: DataFrame, cols: list[str], q: int = 3) -> DataFrame:
    """df(id, lo, *cols) to (id, lo, tokens): hashes of padded q-grams of every column, told apart by column and
    by how often the gram has come before."""
    def of(c: str, k: int) -> Column:
        p = F.concat(F.lit("\u0002" * (q - 1)), F.col(c), F.lit("\u0003" * (q - 1)))
        return F.transform(F.sequence(F.lit(1), F.length(p) - (q - 1)), lambda i: F.concat(F.lit(f"{k}"), p.substr(i, F.lit(q))))

    each = [of(c, k) for k, c in enumerate(cols)]
    g = df.select("id", "lo", F.concat(*each).alias("g"))
    nth = F.transform("g", lambda x, i: F.xxhash64(x, F.size(F.filter(F.slice("g", 1, i), lambda y: y == x))))
    return g.select("id", "lo", nth.alias("tokens"))


def near_pairs(df: DataFrame, key: str, first: str, second: str, k: int = 2, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Links (a, alo, b, blo) between distinct lower-cased word pairs that 1..k edits of one character in all
    turn into each other, all words having ``least`` characters, and membership (key, set_id, set_lo)."""
    rows = df.where((F.length(first) >= least) & (F.length(second) >= least)).select(
        F.col(key).alias("key"), F.lower(first).alias("u"), F.lower(second).alias("v")
    )
    rows = rows.withColumn("set_id", F.xxhash64("u", F.lit(SEP), "v")).withColumn("set_lo", F.xxhash64("v", F.lit(SEP), "u"))
    rows = materialize(rows, "words")
    words = rows.select(F.col("set_id").alias("id"), F.col("set_lo").alias("lo"), "u", "v").distinct()
    rule = Edits(k, 3)
    tokens = materialize(grams(words, ["u", "v"]).withColumn("side", F.lit(0).cast("byte")).select("id", "lo", "side", "tokens"), "grams")
    pairs = candidates(entries(tokens, rule), rule).unionByName(shared_ids(rows))
    w = rows.select("set_id", "set_lo", "u", "v").distinct()
    x, y = (w.select(F.col("set_id").alias(s), F.col("set_lo").alias(f"{s}lo"), F.col("u").alias(f"u{s}"), F.col("v").alias(f"v{s}")) for s in "ab")
    d = F.levenshtein("ua", "ub") + F.levenshtein("va", "vb")
    links = pairs.join(x, "a").join(y, "b").where("a != b or alo < blo").where(d.between(1, k)).select("a", "alo", "b", "blo")
    return materialize(links, "edits"), rows.select("key", "set_id", "set_lo")


def found(utterances: DataFrame, switches: DataFrame) -> DataFrame:
    """p3_found: pairs of both fields as stated for the test tables."""
    t = expand(*near_texts(utterances, "utt_id", "text")).select(F.lit("text").alias("field"), "key_a", "key_b")
    b = expand(*near_pairs(switches, "bigram_id", "first", "second"), inside=False)
    return t.unionByName(b.select(F.lit("bigram").alias("field"), "key_a", "key_b"))


def named(members: DataFrame) -> DataFrame:
    """(set_id, set_lo, class_id, n_copies): a class is named by its least record."""
    return members.distinct().groupBy("set_id", "set_lo").agg(F.min("key").alias("class_id"), F.count("*").alias("n_copies"))


def groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row a record: its class, the records alike in the class, and its class's links to others."""
    x, y = links.select(F.col("a").alias("set_id"), F.col("alo").alias("set_lo")), links.select(F.col("b").alias("set_id"), F.col("blo").alias("set_lo"))
    n = x.unionByName(y).groupBy("set_id", "set_lo").agg(F.count("*").alias("n_links"))
    out = members.distinct().join(named(members).join(n, ["set_id", "set_lo"], "left"), ["set_id", "set_lo"])
    return out.select("key", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def class_links(links: DataFrame, members: DataFrame) -> DataFrame:
    """(class_a, class_b): links by the names of the classes, the smaller first."""
    x, y = (named(members).select(F.col("set_id").alias(s), F.col("set_lo").alias(f"{s}lo"), F.col("class_id").alias(f"c{s}")) for s in "ab")
    j = links.join(x, ["a", "alo"]).join(y, ["b", "blo"])
    return j.select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"))


def _fields(utterances: DataFrame, switches: DataFrame, what) -> DataFrame:
    t = what(*near_texts(utterances, "utt_id", "text")).select(F.lit("text").alias("field"), "*")
    return t.unionByName(what(*near_pairs(switches, "bigram_id", "first", "second")).select(F.lit("bigram").alias("field"), "*"))


def all_groups(utterances: DataFrame, switches: DataFrame) -> DataFrame:
    """p3_groups: groups of both fields, a row a record."""
    return _fields(utterances, switches, groups)


def all_links(utterances: DataFrame, switches: DataFrame) -> DataFrame:
    """p3_links: links between the classes of p3_groups."""
    return _fields(utterances, switches, class_links)
