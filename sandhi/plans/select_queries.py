"""Queries of filters, selection, sorts, set operations and checks (F, W4-W12, T, U, A6-A8, A23-A25)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sandhi.functions import normalize as norm
from sandhi.functions import parsing as P
from sandhi.functions import scripts as S
from sandhi.operators import select as sel
from sandhi.plans import registry as R
from sandhi.plans.registry import query
from sandhi.plans.views import mucs, once, utterances, with_words
from sandhi.runtime import table

def n() -> Column:
    return F.count("*").alias("n")

U = f"WITH {R.UTT}"


# ---- filters -------------------------------------------------------------------------------------------
@query("SELECT utt_id, dur FROM utterances WHERE CASE WHEN corpus LIKE 'cv%' THEN dur BETWEEN 1.0 AND 30 ELSE dur BETWEEN 0.5 AND 30 END")
def dur_filter(spark: SparkSession, d: str) -> DataFrame:
    lo = F.when(F.col("corpus").startswith("cv"), 1.0).otherwise(0.5)
    return utterances(spark, d).where((F.col("dur") >= 0.5) & (F.col("dur") <= 30) & (F.col("dur") >= lo)).select("utt_id", "dur")


@query(f"SELECT utt_id FROM utterances WHERE regexp_replace(text, '{R.WS}', '', 'g') <> ''")
def nonblank(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).where(F.regexp_replace("text", norm.WHITE, "") != "").select("utt_id")


@query(f"SELECT utt_id FROM utterances WHERE length(text) <= 400 AND len(string_split({R.collapse('text')}, ' ')) >= 3")
def length_caps(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).where((F.char_length("text") <= 400) & (F.size(F.split(norm.raw(F.col("text")), " ")) >= 3)).select("utt_id")


BOTH = f"{U}, norm AS (SELECT *, {R.stripped('text', 'PS')} AS t FROM utt), tok AS (SELECT *, {R.tokens('t')} AS ws FROM norm), {R.TAGGED}"


@query(BOTH + " SELECT utt_id FROM tagged WHERE list_contains(ls, 'hi') AND list_contains(ls, 'en')")
def bilingual_rows(spark: SparkSession, d: str) -> DataFrame:
    w = once(spark, d, "text").withColumn("ls", F.transform(S.tokenize(norm.punct(F.col("text"))), S.word_lang))
    return w.where(F.array_contains("ls", "hi") & F.array_contains("ls", "en")).select("utt_id")


@query(f"WITH {R.ONCE}, {R.TAGGED} SELECT utt_id FROM tagged WHERE NOT list_contains(ls, 'hi') OR NOT list_contains(ls, 'en')")
def monolingual_rows(spark: SparkSession, d: str) -> DataFrame:
    w = with_words(once(spark, d, "text")).withColumn("ls", F.transform("ws", S.word_lang))
    return w.where(~F.array_contains("ls", "hi") | ~F.array_contains("ls", "en")).select("utt_id")


def validated(text, hi, en, ordered: bool = False):
    """Both scripts present and the pair adjacent, in either order unless ordered; case does not count."""
    ws = S.tokenize(norm.punct(text))
    low = F.transform(ws, F.lower)
    pair = lambda a, b: F.exists(S.all_bigrams(low), lambda p: (p["first"] == F.lower(a)) & (p["second"] == F.lower(b)))
    langs = F.transform(ws, S.word_lang)
    there = pair(hi, en) if ordered else pair(hi, en) | pair(en, hi)
    return F.array_contains(langs, "hi") & F.array_contains(langs, "en") & there


@query(
    BOTH + ", b AS (SELECT DISTINCT bigram_id, utt_id, first, second FROM cs_bigrams), j AS (SELECT bigram_id, list_transform(ws, lambda w: lower(w)) AS lw, ls, lower(first) AS x, lower(second) AS y FROM b JOIN tagged USING (utt_id)) "
    "SELECT bigram_id, list_contains(ls, 'hi') AND list_contains(ls, 'en') AND len(list_filter(range(1, len(lw)), lambda i: (lw[i] = x AND lw[i + 1] = y) OR (lw[i] = y AND lw[i + 1] = x))) > 0 AS valid, "
    "list_contains(ls, 'hi') AND list_contains(ls, 'en') AND len(list_filter(range(1, len(lw)), lambda i: lw[i] = x AND lw[i + 1] = y)) > 0 AS in_order FROM j"
)
def validate_pair(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams").select("bigram_id", "utt_id", "first", "second").distinct()
    j = b.join(once(spark, d, "text").select("utt_id", "text"), "utt_id")
    v = lambda o: validated(F.col("text"), F.col("first"), F.col("second"), o)
    return j.select("bigram_id", v(False).alias("valid"), v(True).alias("in_order"))


@query(f"{U} SELECT utt_id, corpus FROM utt ORDER BY utt_id LIMIT 100")
def limit_n(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "corpus").select("utt_id", "corpus").orderBy("utt_id").limit(100)


RANK = "SELECT utt_id, {c}row_number() OVER (ORDER BY sha1('{s}|' || utt_id)) - 1 AS r, count(*) OVER () AS m FROM utt"


@query(f"{U}, k AS ({RANK.format(c='', s=7)}) SELECT utt_id FROM k WHERE r < greatest(1, floor(m * 0.25))")
def seeded_fraction(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d).select("utt_id")
    most = max(1, int(u.count() * 0.25))
    return sel.ranked(u, sel.seeded(7, F.col("utt_id"))).where(F.col("rank") < most).select("utt_id")


# ---- selection -----------------------------------------------------------------------------------------
@query(f"{U} SELECT utt_id FROM (SELECT utt_id, row_number() OVER (PARTITION BY {R.collapse('text')} ORDER BY utt_id) AS r FROM utt) WHERE r = 1")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d, "text").select("utt_id", norm.raw(F.col("text")).alias("t"))
    return u.groupBy("t").agg(F.min("utt_id").alias("utt_id")).select("utt_id")  # the first by id, without a sort


@query("SELECT count(*) AS raw, count(DISTINCT (first, second)) AS uniq, count(DISTINCT (first, second)) / greatest(count(*), 1) AS ratio FROM cs_bigrams")
def dedup_yield(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "cs_bigrams").groupBy("first", "second").agg(n())
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("raw"), F.count("*").alias("uniq")).withColumn("ratio", F.col("uniq") / F.greatest("raw", F.lit(1)))


MS = "CAST(round(coalesce(dur, 0) * 1000) AS BIGINT)"


@query(f"{U}, s AS (SELECT utt_id, coalesce(sum({MS}) OVER (ORDER BY sha1('11|' || utt_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM utt WHERE split = 'train') SELECT utt_id FROM s WHERE b < 600000")
def dev_slice(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d, "split", "dur").where("split = 'train'").select("utt_id", F.round(F.coalesce("dur", F.lit(0.0)) * 1000).cast("long").alias("ms"))
    return sel.until(u, sel.seeded(11, F.col("utt_id")), F.col("ms"), 600_000).select("utt_id")


@query(
    f"{U}, g AS (SELECT utt_id, {MS} AS ms, coalesce(speaker, '') AS grp FROM utt WHERE corpus = 'mucs'), k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY sha1('1234|' || utt_id)) - 1 AS depth FROM g), "
    "s AS (SELECT utt_id, coalesce(sum(ms) OVER (ORDER BY depth, sha1('1234|' || grp) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM k) SELECT utt_id FROM s WHERE b < 900000"
)
def round_robin_subset(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d, "corpus", "speaker", "dur").where("corpus = 'mucs'").select("utt_id", "speaker", F.round(F.coalesce("dur", F.lit(0.0)) * 1000).cast("long").alias("ms"))
    return sel.round_robin(u, F.col("speaker"), F.col("utt_id"), F.col("ms"), 900_000).select("utt_id")


@query(f"{U} SELECT utt_id FROM (SELECT utt_id, speaker, row_number() OVER (PARTITION BY speaker ORDER BY utt_id) AS r FROM utt WHERE corpus LIKE 'cv%' AND dur BETWEEN 1.0 AND 30) WHERE speaker IS NULL OR speaker = '' OR r <= 5")
def per_key_cap(spark: SparkSession, d: str) -> DataFrame:
    u = once(spark, d, "corpus", "dur", "speaker").where("corpus like 'cv%' and dur between 1.0 and 30")
    return sel.capped(u.select("utt_id", "speaker"), F.col("speaker"), [F.col("utt_id")], 5).select("utt_id")


@query(f"{U}, k AS ({RANK.format(c='', s=3)}) SELECT utt_id, r % 4 AS shard FROM k")
def stride_shard(spark: SparkSession, d: str) -> DataFrame:
    r = sel.ranked(once(spark, d).select("utt_id"), sel.seeded(3, F.col("utt_id")))
    return r.select("utt_id", (F.col("rank") % 4).alias("shard"))


@query(f"{U}, g AS (SELECT DISTINCT string_split(utt_id, '_')[-2] AS rec FROM utt WHERE corpus = 'mucs'), k AS (SELECT rec, (row_number() OVER (ORDER BY sha1('5|' || rec)) - 1) % 3 AS shard FROM g) SELECT utt_id, shard FROM (SELECT utt_id, string_split(utt_id, '_')[-2] AS rec FROM utt WHERE corpus = 'mucs') JOIN k USING (rec)")
def group_shard(spark: SparkSession, d: str) -> DataFrame:
    m = mucs(once(spark, d, "corpus")).select("utt_id", "rec")
    k = sel.ranked(m.select("rec").distinct(), sel.seeded(5, F.col("rec"))).select("rec", (F.col("rank") % 3).alias("shard"))
    return m.join(k, "rec").select("utt_id", "shard")


CHUNK = "WITH b AS (SELECT DISTINCT bigram_id, first, second FROM cs_bigrams WHERE first IS NOT NULL AND second IS NOT NULL), k AS (SELECT *, row_number() OVER (ORDER BY sha1('2|' || bigram_id)) - 1 AS r FROM b)"


@query(CHUNK + " SELECT r // 20 AS chunk, count(*) AS items, string_agg((r % 20 + 1) || '. ' || first || ' / ' || second, chr(10) ORDER BY r) AS prompt FROM k GROUP BY 1")
def chunk_prompts(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams").where("first is not null and second is not null").select("bigram_id", "first", "second").distinct()
    k = sel.ranked(b, sel.seeded(2, F.col("bigram_id")), "r")
    line = F.concat((F.col("r") % 20 + 1).cast("string"), F.lit(". "), "first", F.lit(" / "), "second")
    g = k.withColumn("chunk", F.floor(F.col("r") / 20)).groupBy("chunk").agg(F.count("*").alias("items"), F.array_sort(F.collect_list(F.struct("r", line.alias("s")))).alias("x"))
    return g.select("chunk", "items", F.array_join(F.transform("x", lambda x: x["s"]), "\n").alias("prompt"))


@query(f"{U}, k AS (SELECT utt_id, length(text) AS len, (row_number() OVER (ORDER BY length(text), sha1('9|' || utt_id)) - 1) // 16 AS batch FROM utt) SELECT * FROM k")
def length_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rank by length through the histogram of lengths: offsets of lengths, ranks within a length."""
    u = once(spark, d, "text").select("utt_id", F.char_length("text").cast("long").alias("len"))
    h = u.groupBy("len").agg(n())
    off = h.withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy("len").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("len").alias("l"), "off")
    i = sel.rank_within(u, F.col("len"), sel.seeded(9, F.col("utt_id")), "i")
    return i.join(off, F.col("len").eqNullSafe(F.col("l"))).select("utt_id", "len", F.floor((F.col("off") + F.col("i")) / 16).alias("batch"))


# ---- sorts and samples ---------------------------------------------------------------------------------
@query("SELECT DISTINCT utt_id FROM utterances ORDER BY utt_id")
def sort_ids(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id").distinct().orderBy("utt_id")


@query("SELECT DISTINCT string_split(utt_id, '_')[-2] AS rec, CAST(string_split(utt_id, '_')[-1] AS BIGINT) AS idx, utt_id FROM utterances WHERE corpus = 'mucs' ORDER BY rec, idx, utt_id")
def natural_sort(spark: SparkSession, d: str) -> DataFrame:
    m = mucs(utterances(spark, d)).select("rec", F.col("idx").cast("long").alias("idx"), "utt_id").distinct()
    return m.orderBy("rec", "idx", "utt_id")


@query(
    "WITH b AS (SELECT DISTINCT bigram_id FROM cs_bigrams), k AS (SELECT bigram_id, row_number() OVER (ORDER BY sha1('4|' || bigram_id)) - 1 AS r, count(*) OVER () AS m FROM b), "
    "c AS (SELECT unnest(range(0, 50)) AS call_id), p AS (SELECT call_id, unnest(range(0, 5)) AS j FROM c) SELECT p.call_id, p.j, k.bigram_id FROM p JOIN k ON k.r = (p.call_id * 5 + p.j) % k.m"
)
def fewshot_sample(spark: SparkSession, d: str) -> DataFrame:
    """Five exemplars a call without replacement: consecutive ranks of one seeded order."""
    b = sel.ranked(table(spark, d, "cs_bigrams").select("bigram_id").distinct(), sel.seeded(4, F.col("bigram_id")), "r")
    m = b.count()
    calls = spark.range(50).select(F.col("id").alias("call_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("j"))
    return calls.withColumn("r", (F.col("call_id") * 5 + F.col("j")) % max(m, 1)).join(b, "r").select("call_id", "j", "bigram_id")


@query(f"{U} SELECT utt_id, substr(text, 1, 96) AS preview FROM utt ORDER BY sha1('7|' || utt_id) LIMIT 20")
def random_preview(spark: SparkSession, d: str) -> DataFrame:
    """Twenty texts at random, their beginnings; the same ones every time."""
    u = once(spark, d, "text").orderBy(sel.seeded(7, F.col("utt_id"))).limit(20)
    return u.select("utt_id", F.substring("text", 1, 96).alias("preview"))


@query(
    f"{U}, m AS (SELECT utt_id, string_split(utt_id, '_')[-2] AS rec, CAST(string_split(utt_id, '_')[-1] AS INTEGER) AS idx, {MS} AS ms FROM utt WHERE corpus = 'mucs'), "
    "s AS (SELECT utt_id, coalesce(sum(ms) OVER (ORDER BY rec, idx, utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m) SELECT utt_id FROM s WHERE b < 600000"
)
def scan_until(spark: SparkSession, d: str) -> DataFrame:
    """Archives (recordings stand in) read in order until ten minutes are reached."""
    m = mucs(once(spark, d, "corpus", "dur")).withColumn("ms", F.round(F.coalesce("dur", F.lit(0.0)) * 1000).cast("long"))
    return sel.until_in_order(m, F.col("rec"), [F.col("idx"), F.col("utt_id")], F.col("ms"), 600_000).select("utt_id")


# ---- set operations ------------------------------------------------------------------------------------
@query("SELECT utt_id, text, 'cv' AS origin FROM utterances WHERE corpus LIKE 'cv%' UNION ALL SELECT utt_id, text, 'synth' FROM utterances WHERE corpus = 'synth'")
def concat_sources(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d)
    part = lambda w, o: u.where(w).select("utt_id", "text", F.lit(o).alias("origin"))
    return part("corpus like 'cv%'", "cv").unionByName(part("corpus = 'synth'", "synth"))


IDS = "a AS (SELECT DISTINCT utt_id FROM utterances), b AS (SELECT DISTINCT utt_id FROM cs_bigrams)"


@query(f"WITH {IDS} SELECT utt_id, 'no switch' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT utt_id, 'no text' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def id_except(spark: SparkSession, d: str) -> DataFrame:
    a, b = utterances(spark, d).select("utt_id"), table(spark, d, "cs_bigrams").select("utt_id")
    return a.subtract(b).select("utt_id", F.lit("no switch").alias("side")).unionByName(b.subtract(a).select("utt_id", F.lit("no text").alias("side")))


@query("SELECT DISTINCT first || ' ' || second AS phrase FROM cs_bigrams")
def distinct_phrases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "cs_bigrams").select(F.concat("first", F.lit(" "), "second").alias("phrase")).distinct()


@query(f"WITH {IDS} SELECT (SELECT count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)) = 0 AS is_subset, (SELECT count(*) FROM b) < (SELECT count(*) FROM a) AS smaller, (SELECT count(*) FROM a) AS n_all, (SELECT count(*) FROM b) AS n_sub")
def subset_integrity(spark: SparkSession, d: str) -> DataFrame:
    a, b = utterances(spark, d).select("utt_id", F.lit(1).alias("a"), F.lit(0).alias("b")), table(spark, d, "cs_bigrams").select("utt_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    g = a.unionByName(b).groupBy("utt_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    c = g.agg(F.count_if(F.col("a") == 0), F.sum("a").alias("n_all"), F.sum("b").alias("n_sub")).toDF("lost", "n_all", "n_sub")
    return c.select((F.col("lost") == 0).alias("is_subset"), (F.col("n_sub") < F.col("n_all")).alias("smaller"), F.col("n_all").cast("long").alias("n_all"), F.col("n_sub").cast("long").alias("n_sub"))


@query(f"SELECT count(*) - count(DISTINCT utt_id) AS duplicates, count(DISTINCT utt_id) AS ids, CAST(sum({MS}) AS BIGINT) AS ms, sum({MS}) >= 8 * 3600000 AS long_enough FROM utterances")
def gate2_checks(spark: SparkSession, d: str) -> DataFrame:
    g = utterances(spark, d).groupBy("utt_id").agg(n(), F.sum(F.round(F.coalesce("dur", F.lit(0.0)) * 1000).cast("long")).alias("ms"))
    return g.agg((F.sum("n") - F.count("*")).alias("duplicates"), F.count("*").alias("ids"), F.sum("ms").alias("ms"), (F.sum("ms") >= 8 * 3_600_000).alias("long_enough"))


# ---- votes and yields ----------------------------------------------------------------------------------
VOTES = "WITH b AS (SELECT DISTINCT bigram_id, first, second, upper(trim(kind)) AS kind FROM cs_bigrams), v AS (SELECT first, second, count(*) FILTER (kind = 'HE') AS yes, count(*) FILTER (kind IS NULL OR kind <> 'HE') AS no FROM b GROUP BY first, second)"


@query(VOTES + " SELECT first, second, yes, no, yes > no AS verdict FROM v")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    """Yes only by a majority; ties and no votes are no."""
    b = table(spark, d, "cs_bigrams").select("bigram_id", "first", "second", F.upper(F.trim("kind")).alias("kind")).distinct()
    he = F.coalesce(F.col("kind") == "HE", F.lit(False))
    v = b.groupBy("first", "second").agg(F.count_if(he).alias("yes"), F.count_if(~he).alias("no"))
    return v.withColumn("verdict", F.col("yes") > F.col("no"))


FUNNEL = f"""WITH b AS (SELECT DISTINCT bigram_id, utt_id, first, second FROM cs_bigrams), raw AS (SELECT count(*) AS raw FROM b), uniq AS (SELECT count(DISTINCT (first, second)) AS uniq FROM b),
p AS (SELECT DISTINCT first, second, {R.lang('first')} AS a, {R.lang('second')} AS b FROM b), val AS (SELECT count(*) AS valid FROM p WHERE (a = 'hi' AND b = 'en') OR (a = 'en' AND b = 'hi')),
s AS (SELECT count(DISTINCT utt_id) AS sentences FROM b)"""


@query(FUNNEL + " SELECT raw, uniq, valid, sentences, uniq / greatest(raw, 1) AS unique_rate, valid / greatest(uniq, 1) AS survival FROM raw, uniq, val, s")
def yield_funnel(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams").select("bigram_id", "utt_id", "first", "second").distinct()
    langs = S.word_lang(F.col("first")), S.word_lang(F.col("second"))
    ok = ((langs[0] == "hi") & (langs[1] == "en")) | ((langs[0] == "en") & (langs[1] == "hi"))
    # three keyed counts in one pass: pairs and sentences as rows of one table
    rows = b.select(F.explode(F.array(F.struct(F.lit("p").alias("k"), F.struct("first", "second").alias("v"), ok.alias("ok")), F.struct(F.lit("s").alias("k"), F.struct(F.col("utt_id").alias("first"), F.lit(None).cast("string").alias("second")).alias("v"), F.lit(False).alias("ok")))).alias("r")).select("r.*")
    g = rows.groupBy("k", "v").agg(n(), F.max("ok").alias("ok"))
    t = g.agg(F.coalesce(F.sum(F.when(F.col("k") == "p", F.col("n"))), F.lit(0)).alias("raw"), F.count_if(F.col("k") == "p").alias("uniq"), F.count_if((F.col("k") == "p") & F.col("ok")).alias("valid"), F.count_if(F.col("k") == "s").alias("sentences"))
    return t.select("*", (F.col("uniq") / F.greatest("raw", F.lit(1))).alias("unique_rate"), (F.col("valid") / F.greatest("uniq", F.lit(1))).alias("survival"))


@query(f"{U}, b AS (SELECT utt_id, count(DISTINCT bigram_id) AS k FROM cs_bigrams GROUP BY utt_id) SELECT coalesce(k, 0) AS k, count(*) AS n FROM utt LEFT JOIN b USING (utt_id) GROUP BY 1")
def yield_histogram(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams").select("utt_id", "bigram_id").distinct().groupBy("utt_id").agg(F.count("*").alias("k"))
    return once(spark, d).select("utt_id").join(b, "utt_id", "left").groupBy(F.coalesce("k", F.lit(0)).alias("k")).agg(n())


@query(
    "WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value) AS loss FROM events GROUP BY 1), b AS (SELECT day, loss, min(loss) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM m), "
    "g AS (SELECT day, CASE WHEN best IS NULL OR loss < best THEN 1 ELSE 0 END AS better FROM b), i AS (SELECT day, better, sum(better) OVER (ORDER BY day) AS run FROM g) "
    "SELECT day, CAST(count(*) FILTER (better = 0) OVER (PARTITION BY run ORDER BY day) AS BIGINT) AS stale FROM i"
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Evaluations since the best so far, over one row a day."""
    m = table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("loss"))
    best = F.min("loss").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    g = m.withColumn("better", F.when(best.isNull() | (F.col("loss") < best), 1).otherwise(0))
    i = g.withColumn("run", F.sum("better").over(Window.orderBy("day")))
    return i.select("day", F.sum(1 - F.col("better")).over(Window.partitionBy("run").orderBy("day")).cast("long").alias("stale"))
