"""Mixed-language error rate and switch-bigram accuracy.

Records are aligned on a key; a reference without hypothesis is an error (``align``). Null texts count as
empty. References that are blank once normalized are left out of the error rate, with their insertions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandhi.functions.scripts import all_bigrams, cs_bigrams, tag


def edit_distance(r: Column, h: Column) -> Column:
    """Distance of two token arrays with unit costs: every distinct token becomes one character."""
    both = F.array_distinct(F.concat(r, h))
    code = lambda ws: F.array_join(F.transform(ws, lambda x: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, x) + 65536), 8, "0")), "UTF-32")), "")
    return F.levenshtein(code(r), code(h))


def edit_distance_hybrid(r: Column, h: Column) -> Column:
    """The same of tagged tokens (see scripts.tag) where Devanagari words count by code points: those stand for
    themselves, others become one character each."""
    other = lambda ws: F.transform(F.filter(ws, lambda w: w["lang"] != "hi"), lambda w: w["word"])
    both = F.array_distinct(F.concat(other(r), other(h)))
    code = lambda ws: F.array_join(F.transform(ws, lambda w: F.when(w["lang"] == "hi", w["word"]).otherwise(F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, w["word"]) + 65536), 8, "0")), "UTF-32"))), "")
    return F.levenshtein(code(r), code(h))


def mer(df: DataFrame, ref: Column, hyp: Column, hybrid: bool = False) -> DataFrame:
    """df with token arrays ref and hyp to one row: errors, units, mer (percent, 0 without references)."""
    mark = tag if hybrid else lambda ws: ws  # scripts are worked out once a token
    kept = df.select(mark(ref).alias("r"), mark(hyp).alias("h"))  # blank references have no units and are skipped below
    errors = (edit_distance_hybrid if hybrid else edit_distance)(F.col("r"), F.col("h"))
    units = F.aggregate("r", F.lit(0), lambda a, w: a + F.when(w["lang"] == "hi", F.length(w["word"])).otherwise(1)) if hybrid else F.size("r")
    sums = kept.select(F.when(F.size("r") > 0, errors).alias("e"), units.alias("u")).agg(F.coalesce(F.sum("e"), F.lit(0)).cast("long").alias("errors"), F.coalesce(F.sum("u"), F.lit(0)).cast("long").alias("units"))
    return sums.withColumn("mer", F.when(F.col("units") > 0, 100.0 * F.col("errors") / F.col("units")).otherwise(0.0))


def align(refs: DataFrame, hyps: DataFrame, key: str) -> DataFrame:
    """Inner join on the key after checking that every reference has a hypothesis; further hypotheses are
    left out. Raises ValueError naming how many are missing."""
    missing, total = refs.join(hyps, key, "left_anti").count(), refs.count()
    if total and missing == total:
        raise ValueError("no reference has a hypothesis: are the ids of one kind?")
    if missing:
        raise ValueError(f"{missing} of {total} references have no hypothesis")
    return refs.join(hyps, key)


def reference_pairs(df: DataFrame, group: Column, ws: Column) -> DataFrame:
    """(g, kind, first, second, n): switch bigrams of every record, counted per group before any cap."""
    e = df.select(group.alias("g"), F.explode_outer(cs_bigrams(ws)).alias("b")).where("b is not null")
    return e.groupBy("g", F.col("b.kind").alias("kind"), F.col("b.first").alias("first"), F.col("b.second").alias("second")).agg(F.count("*").alias("n"))


def cba(ref_pairs: DataFrame, hyp: DataFrame, mode: str = "adjacent") -> DataFrame:
    """Switch-bigram accuracy: hyp(g, ws) is a group's hypothesis. adjacent: a pair is matched as often as
    the hypothesis has it; lenient: as often as it has both words anywhere."""
    if mode == "adjacent":
        h = hyp.select("g", F.explode_outer(all_bigrams(F.col("ws"))).alias("b")).where("b is not null").groupBy("g", F.col("b.first").alias("first"), F.col("b.second").alias("second")).agg(F.count("*").alias("m"))
        j = ref_pairs.join(h, ["g", "first", "second"], "left").withColumn("hit", F.least("n", F.coalesce("m", F.lit(0))))
    elif mode == "lenient":
        h = hyp.select("g", F.explode_outer("ws").alias("w")).where("w is not null").groupBy("g", "w").agg(F.count("*").alias("m"))
        a, b = h.select("g", F.col("w").alias("first"), F.col("m").alias("ma")), h.select("g", F.col("w").alias("second"), F.col("m").alias("mb"))
        j = ref_pairs.join(a, ["g", "first"], "left").join(b, ["g", "second"], "left").withColumn("hit", F.least("n", F.coalesce("ma", F.lit(0)), F.coalesce("mb", F.lit(0))))
    else:
        raise ValueError(f"unknown mode {mode!r}; adjacent or lenient")
    return rates(j)


def rates(j: DataFrame) -> DataFrame:
    """j(kind, n, hit) summed: matched and total of both directions, and the percentages."""
    s = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    t = j.agg(s("HE", "hit").alias("he_matched"), s("HE", "n").alias("he_total"), s("EH", "hit").alias("eh_matched"), s("EH", "n").alias("eh_total"))
    rate = lambda m, n: F.when(n > 0, 100.0 * m / n).otherwise(0.0)
    c = F.col
    return t.select("*", rate(c("he_matched"), c("he_total")).alias("cba_he"), rate(c("eh_matched"), c("eh_total")).alias("cba_eh"), rate(c("he_matched") + c("eh_matched"), c("he_total") + c("eh_total")).alias("cba_total"))


def cba_within(df: DataFrame, key: str, ref: Column, hyp: Column, mode: str = "adjacent") -> DataFrame:
    """cba where every record is a group of its own. Pairs of both sides leave the record as rows with their
    counts, keyed by the record first: on a table partitioned by the key nothing more is shuffled."""
    if mode not in ("adjacent", "lenient"):
        raise ValueError(f"unknown mode {mode!r}; adjacent or lenient")
    r = df.select(key, cs_bigrams(ref).alias("r"), (all_bigrams(hyp) if mode == "adjacent" else hyp).alias("h"))
    row = lambda b, he, eh, m: F.struct(b["first"].alias("first"), b["second"].alias("second"), he.alias("he"), eh.alias("eh"), m.alias("m"))
    one, none = F.lit(1), F.lit(0)
    side = lambda b, k: (b["kind"] == k).cast("int")
    if mode == "adjacent":
        pairs = F.concat(F.transform("r", lambda b: row(b, side(b, "HE"), side(b, "EH"), none)), F.transform("h", lambda b: row(b, none, none, one)))
        times = F.sum("m")
    else:
        held = lambda w: F.size(F.filter("h", lambda x: x == w))
        pairs = F.transform("r", lambda b: row(b, side(b, "HE"), side(b, "EH"), F.least(held(b["first"]), held(b["second"]))))
        times = F.max("m")
    e = r.select(key, F.explode_outer(pairs).alias("b")).where("b is not null").select(key, "b.*")
    g = e.groupBy(key, "first", "second").agg(F.sum("he").alias("he"), F.sum("eh").alias("eh"), times.alias("m"))
    each = F.array(*(F.struct(F.lit(k.upper()).alias("kind"), F.col(k).alias("n"), F.least(k, "m").alias("hit")) for k in ("he", "eh")))
    return rates(g.where("he + eh > 0").select(F.inline(each)))
