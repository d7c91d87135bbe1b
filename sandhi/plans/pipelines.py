"""Whole pipelines: scoring a system, the text-generation funnel, preparing a manifest.

Each stage is a DataFrame in, DataFrame out; model calls go through ``operators.external`` and are cached
by key, so a stage run again asks nothing twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandhi.functions import parsing as P
from sandhi.functions.normalize import normalize, punct, raw
from sandhi.functions.scripts import cs_bigrams, matrix_lang, tokenize, words
from sandhi.operators import external as ext
from sandhi.operators import metrics as M
from sandhi.operators import select as sel
from sandhi.runtime import materialize
from sandhi.sources import manifests as src


# ---- scoring -------------------------------------------------------------------------------------------
def grouped_refs(refs: DataFrame) -> DataFrame:
    """(utt_id, text) per recording: non-blank texts in order of their index, joined by blanks."""
    r = refs.select(P.recording_id(F.col("utt_id")).alias("rec"), P.segment_index(F.col("utt_id")).alias("i"), raw(F.col("text")).alias("t")).where("t != ''")
    x = r.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("i", "t"))).alias("x"))
    return x.select(F.col("rec").alias("utt_id"), F.array_join(F.transform("x", lambda s: s["t"]), " ").alias("text"))


def score_system(refs: DataFrame, hyps: DataFrame, system: str = "", group: str = "none", mer_mode: str = "word", cba_mode: str = "adjacent", preset: str = "scoring") -> DataFrame:
    """One row for a system. refs(utt_id, text), hyps(utt_id, hyp, or text where there is no hyp).
    group='recording': hypotheses are of whole recordings; the error rate compares recordings, switch
    bigrams are counted per utterance and capped per recording. Raises where references lack a hypothesis."""
    if group not in ("none", "recording") or mer_mode not in ("word", "hybrid"):
        raise ValueError(f"unknown group {group!r} or mer_mode {mer_mode!r}")
    h = hyps.select("utt_id", (F.coalesce("hyp", "text") if {"hyp", "text"} <= set(hyps.columns) else F.col("hyp" if "hyp" in hyps.columns else "text")).alias("hyp"))
    whole = grouped_refs(refs) if group == "recording" else refs.select("utt_id", "text")
    pairs = M.align(whole, h, "utt_id")
    both = materialize(pairs.select("utt_id", normalize(F.col("text"), preset).alias("r"), normalize(F.col("hyp"), preset).alias("h")), "aligned")
    split = (lambda t: tokenize(t)) if mer_mode == "hybrid" else words
    rate = M.mer(both, split(F.col("r")), split(F.col("h")), hybrid=mer_mode == "hybrid")
    key: Column = P.recording_id(F.col("utt_id")) if group == "recording" else F.col("utt_id")
    ref_pairs = M.reference_pairs(refs, key, tokenize(normalize(F.col("text"), preset)))
    hyp_words = (words if cba_mode == "lenient" else tokenize)(F.col("h"))
    acc = M.cba(ref_pairs, both.select(F.col("utt_id").alias("g"), hyp_words.alias("ws")), cba_mode)
    n = both.count()
    one = lambda df: df.withColumn("_k", F.lit(1))
    out = one(rate).join(one(acc), "_k").drop("_k")
    return out.select(F.lit(system).alias("system"), F.lit(n).alias("n_items"), F.lit(group).alias("grouping_applied"), F.lit(mer_mode).alias("mer_mode"), F.lit(cba_mode).alias("cba_mode"), F.round("mer", 2).alias("mer"),
                      *(F.round(c, 2).alias(c) for c in ("cba_he", "cba_eh", "cba_total")), "he_matched", "he_total", "eh_matched", "eh_total")


def append_result(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("append").json(path)


# ---- text generation -----------------------------------------------------------------------------------
def ask(requests: DataFrame, cache: DataFrame, backend: str, **options) -> tuple[DataFrame, DataFrame]:
    """requests(…, prompt) with response, and what is new for the cache(key, response)."""
    keyed = requests.withColumn("key", P.cache_key(F.lit(backend), F.col("prompt")))
    got, new = ext.respond(keyed.select("key", "prompt").distinct(), cache, backend, **options)
    return keyed.join(got, "key").drop("key"), new


def generate_bigrams(texts: DataFrame, calls: int, cache: DataFrame, backend: str, shots: int = 5, seed: int = 1, **options) -> tuple[DataFrame, DataFrame]:
    """(bigram, call_id) of every phrase answered; each call is shown texts drawn by rank, the same for any
    number of shards."""
    t = sel.ranked(texts.where(raw(F.col("text")) != "").select("text").distinct(), sel.seeded(seed, F.col("text")))
    m = max(1, t.count())
    c = texts.sparkSession.range(calls).select(F.col("id").alias("call_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shots - 1).cast("long"))).alias("j"))
    turn = F.floor(F.col("call_id") * shots / m)  # once all texts are used, draws are shifted by one
    x = c.withColumn("rank", (F.col("call_id") * shots + turn + F.col("j")) % m).join(t, "rank").groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("j", "text"))).alias("x"))
    prompt = F.concat(F.lit(P.BIGRAM_SYSTEM + "\n\n" + P.BIGRAM_USER.replace("{n}", "10")), F.array_join(F.transform("x", lambda s: F.trim(s["text"])), " "))
    got, new = ask(x.select("call_id", prompt.alias("prompt")), cache, backend, **options)
    return got.select(F.explode_outer(P.parse_bigrams(F.col("response"))).alias("bigram"), "call_id").where("bigram is not null"), new


def extract_pairs(phrases: DataFrame, strict: bool = False) -> DataFrame:
    """Distinct (bigram, hi_word, en_word): the first switch pair of each phrase."""
    w = phrases.select("bigram").distinct().withColumn("ws", tokenize(raw(F.col("bigram"))))
    w = w.where(F.size("ws") == 2) if strict else w
    b = w.select(F.get(cs_bigrams(F.col("ws")), 0).alias("b")).where("b is not null")
    he = F.col("b.kind") == "HE"
    return b.select(F.concat("b.first", F.lit(" "), "b.second").alias("bigram"), F.when(he, F.col("b.first")).otherwise(F.col("b.second")).alias("hi_word"), F.when(he, F.col("b.second")).otherwise(F.col("b.first")).alias("en_word")).distinct()


def filter_bigrams(pairs: DataFrame, cache: DataFrame, backend: str, passes: int = 3, chunk: int = 20, **options) -> tuple[DataFrame, DataFrame]:
    """Pairs that no majority of passes calls translations, with checks; a pass differs by its prompt's tag."""
    k = sel.ranked(pairs, sel.seeded(5, F.col("bigram")), "r").withColumn("chunk", F.floor(F.col("r") / chunk)).withColumn("item", (F.col("r") % chunk).cast("int"))
    line = F.concat((F.col("item") + 1).cast("string"), F.lit(". "), "hi_word", F.lit(" / "), "en_word")
    c = k.groupBy("chunk").agg(F.count("*").cast("int").alias("n"), F.array_sort(F.collect_list(F.struct("item", line.alias("s")))).alias("x"))
    text = F.concat(F.lit(P.CHECK_SYSTEM + "\n\n" + P.CHECK_USER), F.array_join(F.transform("x", lambda s: s["s"]), "\n"))
    q = c.select("chunk", "n", F.explode(F.sequence(F.lit(1), F.lit(passes))).alias("turn"), text.alias("t")).withColumn("prompt", F.concat("t", F.when(F.col("turn") > 1, F.concat(F.lit("\n\n#"), F.col("turn").cast("string"))).otherwise("")))
    got, new = ask(q.drop("t"), cache, backend, **options)
    v = got.select("chunk", F.explode(P.parse_verdicts(F.col("response"), F.col("n"))).alias("item", "yes")).groupBy("chunk", "item").agg(F.count_if(F.col("yes")).alias("y"), F.count_if(~F.col("yes")).alias("no"))
    out = k.join(v, ["chunk", "item"], "left").where(~F.coalesce(F.col("y") > F.col("no"), F.lit(False)))
    return out.select("bigram", "hi_word", "en_word", F.struct(F.lit(True).alias("script"), F.lit(True).alias("not_translation")).alias("checks")), new


def generate_sentences(bigrams: DataFrame, cache: DataFrame, backend: str, most: int = 400, **options) -> tuple[DataFrame, DataFrame]:
    """(sent_id, text, bigram, matrix_lang): lines answered that are not too long and hold the pair, each
    text once (that of the least bigram)."""
    from sandhi.plans.select_queries import validated

    q = bigrams.select("bigram", "hi_word", "en_word", F.concat(F.lit(P.SENTENCE_SYSTEM + "\n\n" + P.SENTENCE_USER), "bigram").alias("prompt"))
    got, new = ask(q, cache, backend, **options)
    s = got.select("bigram", "hi_word", "en_word", F.explode_outer(P.parse_sentences(F.col("response"))).alias("text")).where(F.char_length("text") <= most)
    s = s.where(validated(F.col("text"), F.col("hi_word"), F.col("en_word"))).groupBy("text").agg(F.min("bigram").alias("bigram"))
    return s.select(P.content_id(F.col("text")).alias("sent_id"), "text", "bigram", matrix_lang(tokenize(F.col("text"))).alias("matrix_lang")), new


def fix_sentences(sentences: DataFrame, bigrams: DataFrame, most: int = 400) -> DataFrame:
    """Cleaned again, checked against known bigrams, each text once; sent_id is kept, matrix_lang renewed."""
    from sandhi.plans.select_queries import validated

    s = sentences.withColumn("text", P.clean_sentence(F.col("text"))).where((F.char_length("text") <= most) & (F.size(F.split("text", " ")) >= 3))
    j = s.join(bigrams.select("bigram", "hi_word", "en_word"), "bigram", "left")
    ok = F.when(F.col("hi_word").isNull(), True).otherwise(validated(F.col("text"), F.col("hi_word"), F.col("en_word")))
    first = j.where(ok).groupBy("text").agg(F.min_by(F.struct("sent_id", "bigram"), "sent_id").alias("s"))
    return first.select("s.sent_id", "text", "s.bigram", matrix_lang(tokenize(F.col("text"))).alias("matrix_lang"))


# ---- preparation ---------------------------------------------------------------------------------------
def build_manifest(transcripts: DataFrame, segments: DataFrame, recordings: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """(utt_id, text, dur, reco_id, path): transcripts with their segments' durations and recordings, where known."""
    t = transcripts.join(keep.select("utt_id").distinct(), "utt_id", "left_semi") if keep is not None else transcripts
    s = segments.select("utt_id", "reco_id", F.round(F.col("end_s") - F.col("start_s"), 3).alias("dur")).distinct()
    return t.join(s, "utt_id", "left").join(recordings.select("reco_id", "path"), "reco_id", "left").select("utt_id", "text", "dur", "reco_id", "path")


def hold_out(manifest: DataFrame, hours: float, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """(held out, rest): rows in seeded order until the hours are reached."""
    d = sel.running_before(manifest, sel.seeded(seed, F.col("utt_id")), F.col("dur"), "_b")
    inside = F.col("_b") < hours * 3600
    return d.where(inside).drop("_b"), d.where(~inside).drop("_b")


def kaldi_tables(spark, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transcripts, segments, recordings) of the text, segments and wav.scp files found below root."""
    def lines(name: str) -> DataFrame:
        path = src.find_one(root, name)
        if path is None:
            raise FileNotFoundError(f"{name} below {root}")
        return spark.read.text(path).withColumn("o", F.monotonically_increasing_id())

    kv = lambda name, value: src.key_values(lines(name), "value", F.col("o")).withColumnRenamed("value", value)
    return kv("text", "text").withColumnRenamed("key", "utt_id"), src.segments(lines("segments")), kv("wav.scp", "path").withColumnRenamed("key", "reco_id")


def issues(sentence: Column) -> Column:
    """Names of what an audit would object to in a sentence."""
    ws = tokenize(punct(sentence))
    hi, en = F.exists(ws, lambda w: w.rlike(r"\p{IsDevanagari}")), F.exists(ws, lambda w: w.rlike("[A-Za-z]"))
    return F.array_compact(F.array(F.when(P.label_leak(sentence), "label leak"), F.when(P.reasoning_leak(sentence), "reasoning"), F.when(~(hi & en), "one language"), F.when(F.char_length(sentence) > 400, "too long")))
