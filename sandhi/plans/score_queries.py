"""Queries of scoring and corpus statistics (A, J7, J10-J14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sandhi.functions import normalize as norm
from sandhi.functions import scripts as S
from sandhi.operators import metrics as M
from sandhi.plans import registry as R
from sandhi.plans.registry import query
from sandhi.plans.views import corrupted, each, mucs, once, utterances, with_words
from sandhi.runtime import table

def n() -> Column:
    return F.count("*").alias("n")



def word_counts(df: DataFrame, *by: str) -> DataFrame:
    """(by, word, lang, n): tokens counted before their class is worked out."""
    w = each(with_words(df), F.col("ws"), "word", *by).groupBy(*by, "word").agg(n())
    return w.withColumn("lang", S.word_lang(F.col("word")))


def switches(df: DataFrame, *by: str) -> DataFrame:
    e = each(with_words(df), S.cs_bigrams(F.col("ws")), "b", *by)
    return e.select(*by, "b.first", "b.second", "b.kind")


CORPUS = f"""WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS},
w AS (SELECT split, unnest(ls) AS l FROM tagged),
wc AS (SELECT split, count(*) FILTER (l = 'hi') AS words_h, count(*) FILTER (l = 'en') AS words_e, count(*) FILTER (l = 'other') AS words_other, count(*) FILTER (l = 'mixed') AS words_mixed, count(*) AS total FROM w GROUP BY split),
bc AS (SELECT split, count(*) FILTER (kind = 'HE') AS he_cs, count(*) FILTER (kind = 'EH') AS eh_cs, count(DISTINCT (first, second)) FILTER (kind = 'HE') AS he_types, count(DISTINCT (first, second)) FILTER (kind = 'EH') AS eh_types FROM cs GROUP BY split),
dc AS (SELECT split, CAST(sum(CAST(round(coalesce(dur, 0) * 1000) AS BIGINT)) AS BIGINT) AS ms FROM utt GROUP BY split)
"""


@query(CORPUS + "SELECT * FROM wc JOIN bc USING (split) JOIN dc USING (split)")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return corpus_totals(once(spark, d, "split", "text", "dur"))


def corpus_totals(u: DataFrame) -> DataFrame:
    """One pass: every row is exploded into its switch points, the first (or none) carrying the row's own counts."""
    w = with_words(u).select("split", "dur", F.transform("ws", S.word_lang).alias("ls"), S.cs_bigrams(F.col("ws")).alias("cs"))
    size = lambda k: F.size(F.filter("ls", lambda x: x == k)).alias(f"words_{k}")
    langs = ("hi", "en", "other", "mixed")
    e = w.select("split", "dur", F.size("ls").alias("total"), *(size(k) for k in langs), F.posexplode_outer("cs").alias("pos", "b"))
    lead = F.coalesce("pos", F.lit(0)) == 0
    row = [F.sum(F.when(lead, F.col(c))).alias(c) for c in ("total", *(f"words_{k}" for k in langs))]
    millis = F.sum(F.when(lead, F.round(F.coalesce("dur", F.lit(0.0)) * 1000).cast("long"))).alias("ms")
    g = e.groupBy("split", F.col("b.kind").alias("kind"), F.col("b.first").alias("first"), F.col("b.second").alias("second")).agg(n(), *row, millis)
    t = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, c)), F.lit(0))
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return g.groupBy("split").agg(
        s("words_hi").alias("words_h"), s("words_en").alias("words_e"), s("words_other").alias("words_other"), s("words_mixed").alias("words_mixed"), s("total").alias("total"),
        t("HE", F.col("n")).alias("he_cs"), t("EH", F.col("n")).alias("eh_cs"), t("HE", F.lit(1)).alias("he_types"), t("EH", F.lit(1)).alias("eh_types"), s("ms").alias("ms"),
    )


def ms(c: str = "dur") -> Column:
    """Milliseconds, summed exactly; null is 0."""
    return F.sum(F.round(F.coalesce(F.col(c), F.lit(0.0)) * 1000).cast("long"))


@query(f"WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS} SELECT kind, first, second, count(*) AS n FROM cs GROUP BY ALL")
def cs_bigram_multiset(spark: SparkSession, d: str) -> DataFrame:
    return switches(once(spark, d, "text")).groupBy("kind", "first", "second").agg(n())


@query(f"WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS} SELECT kind, count(*) AS tokens, count(DISTINCT (first, second)) AS types FROM cs GROUP BY kind")
def cs_token_type(spark: SparkSession, d: str) -> DataFrame:
    b = switches(once(spark, d, "text")).groupBy("kind", "first", "second").agg(n())
    return b.groupBy("kind").agg(F.sum("n").alias("tokens"), F.count("*").alias("types"))


@query(f"WITH {R.UTT} SELECT corpus, CAST(sum(CAST(round(coalesce(dur, 0) * 1000) AS BIGINT)) AS BIGINT) AS ms, CAST(sum(CAST(round(coalesce(dur, 0) * 1000) AS BIGINT)) AS BIGINT) / 3600000.0 AS hours FROM utt GROUP BY corpus")
def total_hours(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "corpus", "dur").groupBy("corpus").agg(ms().alias("ms")).withColumn("hours", F.col("ms") / 3600000.0)


@query(
    f"WITH {R.ONCE}, {R.TAGGED}, w AS (SELECT corpus, unnest(ls) AS l FROM tagged) SELECT corpus, count(*) FILTER (l = 'hi') AS hi, count(*) FILTER (l = 'en') AS en, "
    "count(*) FILTER (l = 'hi') / nullif(count(*) FILTER (l <> 'mixed'), 0) AS hi_share, count(*) FILTER (l = 'en') / nullif(count(*) FILTER (l <> 'mixed'), 0) AS en_share, count(*) FILTER (l = 'en') / count(*) AS en_share_of_all FROM w GROUP BY corpus"
)
def script_mix(spark: SparkSession, d: str) -> DataFrame:
    s = lambda *k: F.coalesce(F.sum(F.when(F.col("lang").isin(*k), F.col("n"))), F.lit(0))
    t = word_counts(once(spark, d, "corpus", "text"), "corpus").groupBy("corpus").agg(s("hi").alias("hi"), s("en").alias("en"), s("hi", "en", "other").alias("three"), F.sum("n").alias("n"))
    return t.select("corpus", "hi", "en", F.try_divide("hi", "three").alias("hi_share"), F.try_divide("en", "three").alias("en_share"), (F.col("en") / F.col("n")).alias("en_share_of_all"))


@query(f"WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS}, k AS (SELECT utt_id, count(*) AS k FROM cs GROUP BY utt_id) SELECT corpus, count(*) AS sentences, CAST(sum(coalesce(k, 0)) AS BIGINT) AS switches, sum(coalesce(k, 0)) / count(*) AS density FROM tagged LEFT JOIN k USING (utt_id) GROUP BY corpus")
def switch_density(spark: SparkSession, d: str) -> DataFrame:
    w = with_words(once(spark, d, "corpus", "text")).select("corpus", F.size(S.cs_bigrams(F.col("ws"))).alias("k"))
    return w.groupBy("corpus").agg(F.count("*").alias("sentences"), F.sum("k").alias("switches"), (F.sum("k") / F.count("*")).alias("density"))


@query(f"WITH {R.ONCE}, {R.TAGGED}, m AS (SELECT corpus, CASE WHEN len(list_filter(ls, lambda l: l = 'hi')) >= len(list_filter(ls, lambda l: l = 'en')) THEN 'hi' ELSE 'en' END AS matrix FROM tagged) SELECT corpus, matrix, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY corpus) AS share FROM m GROUP BY corpus, matrix")
def matrix_split(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = with_words(once(spark, d, "corpus", "text")).select("corpus", S.matrix_lang(F.col("ws")).alias("matrix")).groupBy("corpus", "matrix").agg(n())
    return m.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("corpus")))


from sandhi.plans.text_queries import RUNS  # noqa: E402


@query(RUNS + ", c AS (SELECT r.*, u.corpus FROM r JOIN (SELECT utt_id, corpus FROM utt) u USING (utt_id)) SELECT corpus, lang, count(*) AS runs, CAST(sum(n) AS BIGINT) AS words, sum(n) / count(*) AS mean, 100.0 * count(*) FILTER (n = 1) / count(*) AS one_pct, 100.0 * count(*) FILTER (n >= 4) / count(*) AS four_pct FROM c GROUP BY corpus, lang")
def run_length_profile(spark: SparkSession, d: str) -> DataFrame:
    r = each(with_words(once(spark, d, "corpus", "text")), S.runs(F.col("ws")), "r", "corpus").select("corpus", "r.lang", "r.n")
    k = F.count("*")
    return r.groupBy("corpus", "lang").agg(k.alias("runs"), F.sum("n").cast("long").alias("words"), (F.sum("n") / k).alias("mean"), (100.0 * F.count_if(F.col("n") == 1) / k).alias("one_pct"), (100.0 * F.count_if(F.col("n") >= 4) / k).alias("four_pct"))


@query(
    f"WITH {R.UTT}, c AS (SELECT corpus, len({R.words(R.collapse('text'))}) AS k FROM utt), r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY k) - 1 AS i, count(*) OVER (PARTITION BY corpus) AS m FROM c) "
    "SELECT corpus, max(CASE WHEN i = m // 2 THEN k END) AS median, sum(k) / any_value(m) AS mean FROM r GROUP BY corpus"
)
def length_median(spark: SparkSession, d: str) -> DataFrame:
    """Upper median from the histogram of lengths, so no group is collected."""
    from pyspark.sql import Window

    h = once(spark, d, "corpus", "text").select("corpus", F.size(S.words(norm.raw(F.col("text")))).cast("long").alias("k")).groupBy("corpus", "k").agg(n())
    w = Window.partitionBy("corpus")
    h = h.withColumn("upto", F.sum("n").over(w.orderBy("k"))).withColumn("m", F.sum("n").over(w))
    return h.groupBy("corpus").agg(F.min(F.when(F.col("upto") > F.floor(F.col("m") / 2), F.col("k"))).alias("median"), (F.sum(F.col("k") * F.col("n")) / F.first("m")).alias("mean"))


EN = f"WITH {R.UTT}, e AS (SELECT corpus, unnest({R.words(R.scoring('text'))}) AS w FROM utt), v AS (SELECT corpus, w, count(*) AS n FROM e WHERE ({R.lang('w')}) = 'en' GROUP BY corpus, w)"


def english(df: DataFrame) -> DataFrame:
    """(corpus, w, n): Latin words split at blanks only, so words of both scripts are not among them."""
    w = each(df, S.words(norm.scoring(F.col("text"))), "w", "corpus").groupBy("corpus", "w").agg(n())
    return w.where(S.word_lang(F.col("w")) == "en")


@query(EN + " SELECT * FROM v")
def en_vocab(spark: SparkSession, d: str) -> DataFrame:
    return english(once(spark, d, "corpus", "text"))


@query(EN + ", s AS (SELECT w, n FROM v WHERE corpus = 'synth'), m AS (SELECT w FROM v WHERE corpus = 'mucs') SELECT count(*) AS types, count(m.w) AS shared_types, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (m.w IS NOT NULL), 0) AS BIGINT) AS shared_tokens FROM s LEFT JOIN m USING (w)")
def vocab_overlap(spark: SparkSession, d: str) -> DataFrame:
    v = english(once(spark, d, "corpus", "text").where("corpus in ('synth', 'mucs')"))
    p = v.groupBy("w").agg(F.sum(F.when(F.col("corpus") == "synth", F.col("n"))).alias("s"), F.sum(F.when(F.col("corpus") == "mucs", F.col("n"))).alias("m")).where("s is not null")
    return p.agg(F.count("*").alias("types"), F.count("m").alias("shared_types"), F.sum("s").alias("tokens"), F.coalesce(F.sum(F.when(F.col("m").isNotNull(), F.col("s"))), F.lit(0)).alias("shared_tokens"))


@query(EN + " SELECT w FROM v WHERE corpus = 'synth' INTERSECT SELECT w FROM v WHERE corpus = 'mucs'")
def vocab_intersect(spark: SparkSession, d: str) -> DataFrame:
    v = english(once(spark, d, "corpus", "text"))
    return v.where("corpus = 'synth'").select("w").intersect(v.where("corpus = 'mucs'").select("w"))


@query(EN + ", s AS (SELECT w, n FROM v WHERE corpus = 'synth' ORDER BY n DESC, w LIMIT 400) SELECT w, n FROM s WHERE w NOT IN (SELECT w FROM v WHERE corpus = 'mucs') ORDER BY n DESC, w LIMIT 10")
def oov_topk(spark: SparkSession, d: str) -> DataFrame:
    v = english(once(spark, d, "corpus", "text"))
    top = v.where("corpus = 'synth'").orderBy(F.desc("n"), "w").limit(400).select("w", "n")
    return top.join(v.where("corpus = 'mucs'").select("w"), "w", "left_anti").orderBy(F.desc("n"), "w").limit(10).select("w", "n")


@query(EN + " SELECT w, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY w ORDER BY n DESC, w LIMIT 25")
def topk_words(spark: SparkSession, d: str) -> DataFrame:
    return english(once(spark, d, "corpus", "text")).groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(25)


SWITCH = f"WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS}, v AS (SELECT corpus, first, second, count(*) AS n FROM cs GROUP BY ALL)"


@query(SWITCH + ", s AS (SELECT * FROM v WHERE corpus = 'synth'), m AS (SELECT first, second FROM v WHERE corpus = 'mucs') SELECT count(*) AS types, count(m.first) AS shared_types, CAST(sum(n) AS BIGINT) AS tokens, CAST(coalesce(sum(n) FILTER (m.first IS NOT NULL), 0) AS BIGINT) AS shared_tokens FROM s LEFT JOIN m USING (first, second)")
def switch_overlap(spark: SparkSession, d: str) -> DataFrame:
    v = switches(once(spark, d, "corpus", "text").where("corpus in ('synth', 'mucs')"), "corpus").groupBy("first", "second").agg(F.count_if(F.col("corpus") == "synth").alias("s"), F.count_if(F.col("corpus") == "mucs").alias("m")).where("s > 0")
    return v.agg(F.count("*").alias("types"), F.count_if(F.col("m") > 0).alias("shared_types"), F.sum("s").alias("tokens"), F.coalesce(F.sum(F.when(F.col("m") > 0, F.col("s"))), F.lit(0)).alias("shared_tokens"))


@query(f"WITH {R.UTT}, c AS (SELECT corpus, len({R.words(R.collapse('text'))}) AS k FROM utt) SELECT corpus, CAST(sum(k) AS BIGINT) AS words, sum(k) / 2.4 / 3600 AS hours FROM c GROUP BY corpus")
def estimate_hours(spark: SparkSession, d: str) -> DataFrame:
    c = once(spark, d, "corpus", "text").select("corpus", F.size(S.words(norm.raw(F.col("text")))).alias("k")).groupBy("corpus").agg(F.sum("k").alias("words"))
    return c.withColumn("hours", F.col("words") / 2.4 / 3600)


@query(f"WITH {R.UTT} SELECT corpus, 2000 * 16 / count(*) AS epochs FROM utt GROUP BY corpus")
def epochs(spark: SparkSession, d: str) -> DataFrame:
    """How often 2,000 steps of 16 rows go through a corpus."""
    return once(spark, d, "corpus").groupBy("corpus").agg((F.lit(2000 * 16) / F.count("*")).alias("epochs"))


# ---- scoring against a hypothesis --------------------------------------------------------------------
def scored(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Every utterance's tokens and hypothesis, partitioned by utt_id."""
    u = utterances(spark, d).select("utt_id", "text", *cols).repartition("utt_id").distinct()
    return with_words(u).withColumn("hw", corrupted(F.col("ws")))


CODE = "list_aggregate(list_transform({x}, lambda v: chr(CAST(32 + list_position(list_distinct(list_concat(r, h)), v) AS INTEGER))), 'string_agg', '')"
MER = (
    f"WITH {R.ONCE}, {R.TAGGED}, {R.HYP}, j AS (SELECT {{r}} AS r, {{h}} AS h FROM tagged JOIN (SELECT utt_id, hw FROM hyp) USING (utt_id) WHERE len(ws) > 0), "
    f"e AS (SELECT len(r) AS units, levenshtein(coalesce({CODE.format(x='r')}, ''), coalesce({CODE.format(x='h')}, '')) AS errors FROM j) "
    "SELECT CAST(sum(errors) AS BIGINT) AS errors, CAST(sum(units) AS BIGINT) AS units, 100.0 * sum(errors) / sum(units) AS mer FROM e"
)


def units(x: str) -> str:
    return f"flatten(list_transform({x}, lambda w: CASE WHEN ({R.lang('w')}) = 'hi' THEN string_split(w, '') ELSE [w] END))"


@query(MER.replace("{r}", "ws").replace("{h}", "hw"))
def mer_word(spark: SparkSession, d: str) -> DataFrame:
    return M.mer(scored(spark, d), F.col("ws"), F.col("hw"))


@query(MER.replace("{r}", units("ws")).replace("{h}", units("hw")))
def mer_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return M.mer(scored(spark, d), F.col("ws"), F.col("hw"), hybrid=True)


CBA = """, ref AS (SELECT {g} AS g, kind, first, second, count(*) AS n FROM cs {w} GROUP BY ALL),
hy AS (SELECT {g} AS g, {hw} AS hw FROM hyp {w} {by}),
adj AS (SELECT g, hw[p] AS first, hw[p + 1] AS second, count(*) AS m FROM (SELECT g, hw, unnest(range(1, len(hw))) AS p FROM hy) GROUP BY ALL),
wrd AS (SELECT g, w, count(*) AS m FROM (SELECT g, unnest(hw) AS w FROM hy) GROUP BY ALL),
{j}
SELECT CAST(sum(hit) FILTER (kind = 'HE') AS BIGINT) AS he_matched, CAST(sum(n) FILTER (kind = 'HE') AS BIGINT) AS he_total, CAST(sum(hit) FILTER (kind = 'EH') AS BIGINT) AS eh_matched, CAST(sum(n) FILTER (kind = 'EH') AS BIGINT) AS eh_total,
100.0 * sum(hit) FILTER (kind = 'HE') / sum(n) FILTER (kind = 'HE') AS cba_he, 100.0 * sum(hit) FILTER (kind = 'EH') / sum(n) FILTER (kind = 'EH') AS cba_eh, 100.0 * sum(hit) / sum(n) AS cba_total FROM j"""
ADJ = "j AS (SELECT kind, n, least(n, coalesce(m, 0)) AS hit FROM ref LEFT JOIN adj USING (g, first, second))"
LEN = "j AS (SELECT kind, n, least(n, coalesce(a.m, 0), coalesce(b.m, 0)) AS hit FROM ref LEFT JOIN wrd a ON a.g = ref.g AND a.w = first LEFT JOIN wrd b ON b.g = ref.g AND b.w = second)"
BASE = f"WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS}, {R.HYP}"
ONE = {"g": "utt_id", "w": "", "hw": "hw", "by": ""}
REC = {"g": "string_split(utt_id, '_')[-2]", "w": "WHERE corpus = 'mucs'", "hw": "flatten(list(hw ORDER BY CAST(string_split(utt_id, '_')[-1] AS INTEGER), utt_id))", "by": "GROUP BY string_split(utt_id, '_')[-2]"}


@query(BASE + CBA.format(**ONE, j=ADJ))
def cba_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return M.cba_within(scored(spark, d), "utt_id", F.col("ws"), F.col("hw"))


@query(BASE + CBA.format(**ONE, j=LEN))
def cba_lenient(spark: SparkSession, d: str) -> DataFrame:
    return M.cba_within(scored(spark, d), "utt_id", F.col("ws"), F.col("hw"), "lenient")


def in_order(df: DataFrame, group: str, order: Column, value: str) -> DataFrame:
    """(g, value): arrays of a recording joined in order; a recording is a bounded group."""
    x = df.groupBy(F.col(group).alias("g")).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("utt_id"), F.col(value).alias("v")))).alias("x"))
    return x.select("g", F.flatten(F.transform("x", lambda s: s["v"])).alias("ws"))


@query(BASE + CBA.format(**REC, j=ADJ))
def cba_grouped(spark: SparkSession, d: str) -> DataFrame:
    s = mucs(scored(spark, d, "corpus"))
    return M.cba(M.reference_pairs(s, F.col("rec"), F.col("ws")), in_order(s, "rec", F.col("idx"), "hw"))


@query(
    f"WITH {R.UTT} SELECT string_split(utt_id, '_')[-2] AS rec, string_agg(trim(text), ' ' ORDER BY CAST(string_split(utt_id, '_')[-1] AS INTEGER), utt_id) AS ref FROM utt WHERE corpus = 'mucs' AND trim(text) <> '' GROUP BY 1"
)
def concat_refs(spark: SparkSession, d: str) -> DataFrame:
    u = mucs(once(spark, d, "corpus", "text")).withColumn("s", F.trim("text")).where("s != ''")
    x = u.groupBy("rec").agg(F.array_sort(F.collect_list(F.struct("idx", "utt_id", "s"))).alias("x"))
    return x.select("rec", F.array_join(F.transform("x", lambda s: s["s"]), " ").alias("ref"))


@query(f"WITH {R.UTT} SELECT string_split(utt_id, '_')[-2] AS rec, count(*) AS n_segments, CAST(sum(CAST(round(coalesce(dur, 0) * 1000) AS BIGINT)) AS BIGINT) AS ms FROM utt WHERE corpus = 'mucs' GROUP BY 1")
def recording_summary(spark: SparkSession, d: str) -> DataFrame:
    return mucs(once(spark, d, "corpus", "dur")).groupBy("rec").agg(F.count("*").alias("n_segments"), ms().alias("ms"))


@query(
    f"WITH {R.ONCE}, h AS (SELECT utt_id, 'h ' || text AS hyp FROM utt WHERE split = 'test'), r AS (SELECT utt_id, text FROM utt WHERE split = 'test') SELECT utt_id, text, hyp FROM r JOIN h USING (utt_id)"
)
def refs_hyps_align(spark: SparkSession, d: str) -> DataFrame:
    r = once(spark, d, "split", "text").where("split = 'test'").select("utt_id", "text")
    return M.align(r, r.select("utt_id", F.concat(F.lit("h "), "text").alias("hyp")), "utt_id")


@query(f"WITH {R.ONCE}, {R.TAGGED}, k AS (SELECT coalesce(lower(lang), '?') AS lang, len(ws) AS words FROM tagged) SELECT lang, count(*) AS n, CAST(sum(words) AS BIGINT) AS words, sum(words) / sum(sum(words)) OVER () AS share FROM k GROUP BY lang")
def lang_histogram(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    k = with_words(once(spark, d, "lang", "text")).select(F.coalesce(F.lower("lang"), F.lit("?")).alias("lang"), F.size("ws").alias("words")).groupBy("lang").agg(n(), F.sum("words").alias("words"))
    return k.withColumn("share", F.col("words") / F.sum("words").over(Window.partitionBy(F.lit(1))))


# Published totals and how far a split's own may be off.
WANT = [("test", "words_h", 28215.0, 0.01), ("test", "words_e", 9627.0, None), ("test", "total", 37842.0, 0.02), ("test", "he_cs", 4189.0, 0.03), ("test", "eh_cs", 5176.0, 0.03), ("test", "he_types", 2347.0, None), ("test", "eh_types", 2472.0, None),
        ("train", "words_h", 445762.0, None), ("train", "words_e", 160694.0, None), ("train", "total", 606456.0, None), ("train", "he_cs", 85761.0, None), ("train", "eh_cs", 90802.0, None)]
_V = ", ".join(f"('{s}', '{m}', {w}, {'NULL' if t is None else t})" for s, m, w, t in WANT)


@query(
    CORPUS + f", want AS (SELECT split, metric, CAST(want AS DOUBLE) AS want, tol FROM (VALUES {_V}) v(split, metric, want, tol)), got AS (UNPIVOT (SELECT split, words_h, words_e, total, he_cs, eh_cs, he_types, eh_types FROM wc JOIN bc USING (split)) ON words_h, words_e, total, he_cs, eh_cs, he_types, eh_types INTO NAME metric VALUE got) "
    "SELECT split, metric, got, want, abs(got - want) / want AS rel_err, CASE WHEN tol IS NULL THEN 'info' WHEN abs(got - want) / want <= tol THEN 'PASS' ELSE 'FAIL' END AS status FROM want JOIN got USING (split, metric)"
)
def tolerance_report(spark: SparkSession, d: str) -> DataFrame:
    got = corpus_totals(once(spark, d, "split", "text", "dur")).unpivot(["split"], ["words_h", "words_e", "total", "he_cs", "eh_cs", "he_types", "eh_types"], "metric", "got")
    want = spark.createDataFrame(WANT, "split string, metric string, want double, tol double")
    e = F.when(F.col("want") != 0, F.abs(F.col("got") - F.col("want")) / F.col("want")).otherwise(0.0)
    return got.join(want, ["split", "metric"]).select("split", "metric", "got", "want", e.alias("rel_err"), F.when(F.col("tol").isNull(), "info").when(e <= F.col("tol"), "PASS").otherwise("FAIL").alias("status"))


@query(CORPUS + "SELECT split, words_h > 0 AND words_e > 0 AS both_languages, words_mixed = 0 AS no_mixed, he_cs > 0 AND eh_cs > 0 AS switching FROM wc JOIN bc USING (split)")
def integrity_invariants(spark: SparkSession, d: str) -> DataFrame:
    c = corpus_totals(once(spark, d, "split", "text", "dur"))
    return c.select("split", ((F.col("words_h") > 0) & (F.col("words_e") > 0)).alias("both_languages"), (F.col("words_mixed") == 0).alias("no_mixed"), ((F.col("he_cs") > 0) & (F.col("eh_cs") > 0)).alias("switching"))


@query(
    f"WITH {R.UTT}, a AS (SELECT unnest({R.tokens('t')}) AS w FROM (SELECT {R.scoring('text')} AS t FROM utt)), b AS (SELECT unnest({R.tokens('t')}) AS w FROM (SELECT lower({R.stripped('text', 'MSP')}) AS t FROM utt)), "
    f"x AS (SELECT count(*) AS kept FROM a WHERE ({R.lang('w')}) = 'hi'), y AS (SELECT count(*) AS shattered FROM b WHERE ({R.lang('w')}) = 'hi') SELECT kept, shattered, shattered / kept - 1 AS inflation, shattered / kept - 1 > 0.2 AS guards FROM x, y"
)
def mark_strip_inflation(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d, "text")
    hi = lambda t: F.size(F.filter(S.tokenize(t), lambda w: S.word_lang(w) == "hi"))
    t = u.select(norm.scoring(F.col("text")).alias("a"), norm.whisper_basic(F.col("text")).alias("b")).select(hi(F.col("a")).alias("a"), hi(F.col("b")).alias("b"))
    t = t.agg(F.sum("a").alias("kept"), F.sum("b").alias("shattered"))
    r = F.col("shattered") / F.col("kept") - 1
    return t.select("kept", "shattered", r.alias("inflation"), (r > 0.2).alias("guards"))


@query("WITH b AS (SELECT DISTINCT bigram_id, upper(trim(kind)) AS kind FROM cs_bigrams) SELECT coalesce(kind, '?') AS kind, count(*) AS n FROM b GROUP BY 1")
def direction_skew(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams").select("bigram_id", F.upper(F.trim("kind")).alias("kind")).distinct()
    return b.groupBy(F.coalesce("kind", F.lit("?")).alias("kind")).agg(n())


@query("WITH m AS (SELECT strftime(recorded_at, '%Y-%m') AS month, count(DISTINCT utt_id) AS n FROM utterances GROUP BY 1) SELECT coalesce(bool_and(n <= p), true) AS falling FROM (SELECT n, lag(n) OVER (ORDER BY month) AS p FROM m) WHERE p IS NOT NULL")
def monotone_check(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = utterances(spark, d).groupBy(F.date_format("recorded_at", "yyyy-MM").alias("month")).agg(F.countDistinct("utt_id").alias("n"))
    p = m.withColumn("p", F.lag("n").over(Window.orderBy("month"))).where("p is not null")  # one row a month
    return p.agg(F.coalesce(F.every(F.col("n") <= F.col("p")), F.lit(True)).alias("falling"))
