"""Queries of the scalar functions and of pairs and runs (X, W1-W3, W11, A1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandhi.functions import normalize as norm
from sandhi.functions import parsing as P
from sandhi.functions import scripts as S
from sandhi.plans import registry as R
from sandhi.plans.registry import query
from sandhi.plans.views import each, once, utterances, with_words
from sandhi.runtime import table

LANG_W = R.lang("w")


@query(f"SELECT utt_id, {R.collapse('text')} AS t FROM utterances")
def normalize_raw(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", norm.normalize(F.col("text"), "raw").alias("t"))


@query(f"SELECT utt_id, {R.stripped('text', 'PS')} AS t FROM utterances")
def normalize_punct(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", norm.normalize(F.col("text"), "punct").alias("t"))


@query(f"SELECT utt_id, {R.scoring('text')} AS t FROM utterances")
def normalize_scoring(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", norm.normalize(F.col("text"), "scoring").alias("t"))


@query(f"SELECT utt_id, lower({R.stripped('text', 'MSP')}) AS t FROM utterances")
def normalize_whisper_basic(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", norm.normalize(F.col("text"), "whisper_basic").alias("t"))


#: scripts as the engine knows them, less digits and signs of Devanagari and letters not called Latin
BY_SCRIPT = (
    "CASE WHEN regexp_matches(regexp_replace(w, '[०-९॰]', '', 'g'), '\\p{Devanagari}') THEN CASE WHEN regexp_matches(regexp_replace(w, '[ªºＡ-Ｚａ-ｚ\\x{212A}\\x{212B}\\x{2160}-\\x{2188}]', '', 'g'), '\\p{Latin}') THEN 'mixed' ELSE 'hi' END "
    "WHEN regexp_matches(regexp_replace(w, '[ªºＡ-Ｚａ-ｚ\\x{212A}\\x{212B}\\x{2160}-\\x{2188}]', '', 'g'), '\\p{Latin}') THEN 'en' WHEN w IS NOT NULL THEN 'other' END"
)


@query(f"WITH w AS (SELECT first AS w FROM cs_bigrams UNION ALL SELECT second FROM cs_bigrams) SELECT w, {BY_SCRIPT} AS lang, count(*) AS n FROM w GROUP BY ALL")
def word_lang(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams")
    w = b.select(F.col("first").alias("w")).unionByName(b.select(F.col("second").alias("w")))
    return w.groupBy("w").agg(F.count("*").alias("n")).withColumn("lang", S.word_lang(F.col("w")))


@query(f"SELECT utt_id, {R.split_bounds('text')} AS t FROM utterances")
def split_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", S.split_boundaries(F.col("text")).alias("t"))


@query(f"WITH {R.ROWS} SELECT utt_id, array_to_string(ws, '|') AS tokens, len(ws) AS n FROM tok")
def tokenize(spark: SparkSession, d: str) -> DataFrame:
    w = with_words(utterances(spark, d))
    return w.select("utt_id", F.array_join("ws", "|").alias("tokens"), F.size("ws").cast("long").alias("n"))


@query(f"WITH {R.ROWS}, e AS (SELECT unnest(ws) AS w FROM tok) SELECT w AS word, {LANG_W} AS lang, count(*) AS n FROM e GROUP BY ALL")
def tag_words(spark: SparkSession, d: str) -> DataFrame:
    w = each(with_words(utterances(spark, d)), F.col("ws"), "word").groupBy("word").agg(F.count("*").alias("n"))
    return w.select("word", S.word_lang(F.col("word")).alias("lang"), "n")


@query(
    f"WITH {R.ROWS}, {R.TAGGED} SELECT utt_id, len(list_filter(ls, lambda l: l = 'hi')) AS hi, len(list_filter(ls, lambda l: l = 'en')) AS en, "
    "len(list_filter(ls, lambda l: l = 'mixed')) AS mixed, len(list_filter(ls, lambda l: l = 'other')) AS other FROM tagged"
)
def count_words(spark: SparkSession, d: str) -> DataFrame:
    w = with_words(utterances(spark, d)).withColumn("ls", F.transform("ws", S.word_lang))
    n = lambda k: F.size(F.filter("ls", lambda x: x == k)).cast("long").alias(k)
    return w.select("utt_id", *(n(k) for k in ("hi", "en", "mixed", "other")))


@query(f"WITH {R.ROWS}, p AS (SELECT ws, unnest(range(1, len(ws))) AS p FROM tok) SELECT ws[p] AS first, ws[p + 1] AS second, count(*) AS n FROM p GROUP BY ALL")
def all_bigrams(spark: SparkSession, d: str) -> DataFrame:
    e = each(with_words(utterances(spark, d)), S.all_bigrams(F.col("ws")), "b")
    return e.groupBy(F.col("b.first").alias("first"), F.col("b.second").alias("second")).agg(F.count("*").alias("n"))


@query(f"WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS} SELECT utt_id, first, second, kind FROM cs")
def cs_bigrams(spark: SparkSession, d: str) -> DataFrame:
    e = each(with_words(once(spark, d, "text")), S.cs_bigrams(F.col("ws")), "b", "utt_id")
    return e.select("utt_id", "b.first", "b.second", "b.kind")


RUNS = f"""WITH {R.ONCE}, {R.TAGGED},
e AS (SELECT utt_id, p, ls[p] AS l FROM (SELECT utt_id, ls, unnest(range(1, len(ls) + 1)) AS p FROM tagged) WHERE ls[p] IN ('hi', 'en')),
b AS (SELECT *, CASE WHEN l IS DISTINCT FROM lag(l) OVER (PARTITION BY utt_id ORDER BY p) THEN 1 ELSE 0 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY utt_id ORDER BY p) AS run FROM b),
r AS (SELECT utt_id, run, any_value(l) AS lang, count(*) AS n FROM i GROUP BY utt_id, run)"""


@query(RUNS + " SELECT utt_id, CAST(run AS BIGINT) AS run, lang, n FROM r")
def language_runs(spark: SparkSession, d: str) -> DataFrame:
    e = with_words(once(spark, d, "text")).select("utt_id", F.posexplode_outer(S.runs(F.col("ws"))).alias("run", "r")).where("r is not null")
    return e.select("utt_id", (F.col("run") + 1).cast("long").alias("run"), "r.lang", F.col("r.n").cast("long").alias("n"))


LINES = "WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\\r\\n|[\\n\\r\\x{000B}\\x{000C}\\x{001C}-\\x{001E}\\x{0085}\\x{2028}\\x{2029}]')) AS line FROM documents)"
# written for this engine's regular expressions, apart from the patterns of the functions
FRONT = "[0-9]+[ \\t\\r\\n\\f]*[).]|[-•*]|[*]*\\s*(?i:hinglish|english|hindi|हिन्दी|हिंदी|अंग्रेज़ी|अंग्रज़ी)\\s*[*]*\\s*[-:：–—]|[`''\"_*]+"
CLEAN = f"regexp_replace(regexp_replace(line, '^(\\s*({FRONT})\\s*|\\s+)+', ''), '([`''\"_*]+\\s*)+$', '')"


@query(f"SELECT utt_id, {R.collapse(CLEAN.replace('line', 'text'))} AS t FROM utterances")
def clean_sentence(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", P.clean_sentence(F.col("text")).alias("t"))


@query(f"{LINES}, c AS (SELECT doc_id, {R.collapse(CLEAN)} AS s FROM l) SELECT doc_id, s, count(*) AS n FROM c WHERE len(string_split(s, ' ')) >= 3 GROUP BY ALL")
def parse_sentences(spark: SparkSession, d: str) -> DataFrame:
    e = each(table(spark, d, "documents"), P.parse_sentences(F.col("text")), "s", "doc_id")
    return e.groupBy("doc_id", "s").agg(F.count("*").alias("n"))


@query(
    f"{LINES}, s AS (SELECT doc_id, {R.collapse(f"regexp_replace(regexp_replace(trim(line), '^\\s*([0-9]+[).]|[-•*])\\s*', ''), '[.,;]+\\s*$', '')")} AS s FROM l), "
    f"p AS (SELECT doc_id, unnest(string_split(s, ';')) AS part FROM s), q AS (SELECT doc_id, {R.collapse('part')} AS phrase FROM p) SELECT doc_id, phrase, count(*) AS n FROM q WHERE contains(phrase, ' ') GROUP BY ALL"
)
def parse_bigrams(spark: SparkSession, d: str) -> DataFrame:
    e = each(table(spark, d, "documents"), P.parse_bigrams(F.col("text")), "phrase", "doc_id")
    return e.groupBy("doc_id", "phrase").agg(F.count("*").alias("n"))


#: answers of a judge, one line an item, made from the switch points of an utterance
ANSWER = "WITH b AS (SELECT DISTINCT bigram_id, utt_id, pos, first, second, kind FROM cs_bigrams)"


def answers(spark: SparkSession, d: str) -> DataFrame:
    """(utt_id, n, text): a numbered verdict for every switch point of an utterance, HE ones YES."""
    b = table(spark, d, "cs_bigrams").select("bigram_id", "utt_id", "kind").distinct()
    g = b.groupBy("utt_id").agg(F.array_sort(F.collect_list(F.struct("bigram_id", "kind"))).alias("x"))
    line = F.transform("x", lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), F.when(F.upper(F.trim(x["kind"])) == "HE", "YES").otherwise("No, not so")))
    return g.select("utt_id", F.size("x").alias("n"), F.array_join(line, "\n").alias("text"))


@query(
    "WITH b AS (SELECT DISTINCT bigram_id, utt_id, kind FROM cs_bigrams), r AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY bigram_id) - 1 AS idx FROM b) "
    "SELECT utt_id, CAST(idx AS BIGINT) AS idx, coalesce(upper(trim(kind)) = 'HE', false) AS yes FROM r"
)
def parse_verdicts(spark: SparkSession, d: str) -> DataFrame:
    v = answers(spark, d).select("utt_id", F.explode(P.parse_verdicts(F.col("text"), F.col("n"))).alias("idx", "yes"))
    return v.select("utt_id", F.col("idx").cast("long").alias("idx"), "yes")


@query(f"SELECT utt_id, regexp_replace(text, '^{R.WS}|{R.WS}$', '', 'g') AS t FROM utterances")
def strip_thinking(spark: SparkSession, d: str) -> DataFrame:
    """Texts wrapped in reasoning: blocks that come to be when others are taken out, channels, control tokens."""
    nested = "<th<th<think>plan</think>ink>more</think>ink>most</think><REASON a='b'>x\ny</Reason>"
    s = F.concat(F.lit(nested + "<|channel|>analysis<|message|>x<|channel|>final<|message|> <think> <s>"), "text", F.lit("<|end|></s>"))
    return utterances(spark, d).select("utt_id", P.strip_thinking(s).alias("t"))


@query(
    f"{ANSWER}, p AS (SELECT bigram_id, {R.tokens(R.collapse('first || chr(32) || second'))} AS ws FROM b), tagged AS (SELECT *, list_transform(ws, lambda w: {LANG_W}) AS ls FROM p), "
    "x AS (SELECT bigram_id, ws, ls, list_min(list_filter(range(1, len(ws)), lambda i: (ls[i] = 'hi' AND ls[i + 1] = 'en') OR (ls[i] = 'en' AND ls[i + 1] = 'hi'))) AS i FROM tagged) "
    "SELECT bigram_id, ws[i] || ' ' || ws[i + 1] AS bigram, CASE WHEN ls[i] = 'hi' THEN ws[i] ELSE ws[i + 1] END AS hi_word, CASE WHEN ls[i] = 'hi' THEN ws[i + 1] ELSE ws[i] END AS en_word FROM x WHERE i IS NOT NULL"
)
def script_filter(spark: SparkSession, d: str) -> DataFrame:
    return _script_filter(spark, d, False)


@query(
    f"{ANSWER}, p AS (SELECT bigram_id, {R.tokens(R.collapse('first || chr(32) || second'))} AS ws FROM b), tagged AS (SELECT *, list_transform(ws, lambda w: {LANG_W}) AS ls FROM p) "
    "SELECT bigram_id, ws[1] || ' ' || ws[2] AS bigram, CASE WHEN ls[1] = 'hi' THEN ws[1] ELSE ws[2] END AS hi_word, CASE WHEN ls[1] = 'hi' THEN ws[2] ELSE ws[1] END AS en_word FROM tagged "
    "WHERE len(ws) = 2 AND ((ls[1] = 'hi' AND ls[2] = 'en') OR (ls[1] = 'en' AND ls[2] = 'hi'))"
)
def script_filter_strict(spark: SparkSession, d: str) -> DataFrame:
    return _script_filter(spark, d, True)


def _script_filter(spark: SparkSession, d: str, strict: bool) -> DataFrame:
    b = table(spark, d, "cs_bigrams").select("bigram_id", "utt_id", "pos", "first", "second", "kind").distinct()
    w = b.withColumn("ws", S.tokenize(norm.raw(F.concat("first", F.lit(" "), "second"))))
    w = (w.where(F.size("ws") == 2) if strict else w).withColumn("b", F.get(S.cs_bigrams(F.col("ws")), 0)).where("b is not null")
    he = F.col("b.kind") == "HE"
    return w.select("bigram_id", F.concat("b.first", F.lit(" "), "b.second").alias("bigram"), F.when(he, F.col("b.first")).otherwise(F.col("b.second")).alias("hi_word"), F.when(he, F.col("b.second")).otherwise(F.col("b.first")).alias("en_word"))


@query("SELECT DISTINCT utt_id, string_split(utt_id, '_')[-2] AS recording, CAST(string_split(utt_id, '_')[-1] AS BIGINT) AS idx FROM utterances WHERE corpus = 'mucs'")
def id_parts(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d).where("corpus = 'mucs'").select("utt_id").distinct()
    return u.select("utt_id", P.recording_id(F.col("utt_id")).alias("recording"), P.segment_index(F.col("utt_id")).cast("long").alias("idx"))


@query("SELECT utt_id, substr(sha1(text), 1, 16) AS content_id FROM utterances")
def content_id(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", P.content_id(F.col("text")).alias("content_id"))


@query("SELECT utt_id, CAST(instr('0123456789abcdef', substr(sha1(utt_id), 2, 1)) - 1 AS BIGINT) % 2 AS bucket FROM utterances")
def stable_bucket(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", P.stable_bucket(F.col("utt_id")).cast("long").alias("bucket"))


@query("SELECT bigram_id, sha256('[' || to_json('m1'::VARCHAR) || ',' || to_json(coalesce(first, '')) || ',' || to_json(coalesce(second, '')) || ']') AS key FROM cs_bigrams")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams")
    return b.select("bigram_id", P.cache_key(F.lit("m1"), F.coalesce("first", F.lit("")), F.coalesce("second", F.lit(""))).alias("key"))


@query(
    "SELECT bigram_id, sha256('{\"messages\": [{\"content\": ' || to_json(coalesce(first, '')) || ', \"role\": \"system\"}, {\"content\": ' || to_json(coalesce(second, '')) || ', \"role\": \"user\"}], \"model\": \"m1\", \"params\": {\"temperature\": 0.7, \"top_k\": 5}, \"sample\": ' || pos || '}') AS key FROM cs_bigrams"
)
def request_key(spark: SparkSession, d: str) -> DataFrame:
    message = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    key = P.request_key("m1", F.array(message("system", "first"), message("user", "second")), {"top_k": 5, "temperature": 0.7}, F.col("pos"))
    return table(spark, d, "cs_bigrams").select("bigram_id", key.alias("key"))


_Q = P.BIGRAM_USER.replace("{n}", "10").replace("'", "''")


@query(f"SELECT DISTINCT utt_id, '{P.BIGRAM_SYSTEM.replace(chr(39), chr(39) * 2)}' AS system, '{_Q}' || regexp_replace(text, '^{R.WS}|{R.WS}$', '', 'g') AS prompt FROM utterances")
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d).select("utt_id", "text").distinct()
    return u.select("utt_id", F.lit(P.BIGRAM_SYSTEM).alias("system"), F.concat(F.lit(P.BIGRAM_USER.replace("{n}", "10")), F.regexp_replace("text", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).alias("prompt"))


@query("SELECT reco_id, string_split(path, '/')[-1] AS base, regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', '') AS stem FROM recordings")
def basename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "recordings").select("reco_id", P.basename(F.col("path")).alias("base"), P.stem(F.col("path")).alias("stem"))


@query("SELECT utt_id, regexp_matches(lower(text), '^\\s*[*]*\\s*(hindi|hinglish|english)\\s*[*]*\\s*(:|-)') AS leak FROM utterances")
def label_leak(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", P.label_leak(F.col("text")).alias("leak"))


@query(f"WITH {R.ONCE}, {R.TAGGED} SELECT utt_id, array_to_string(flatten(list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN ls[i] = 'hi' THEN string_split(ws[i], '') ELSE [ws[i]] END)), '|') AS units FROM tagged")
def hybrid_units(spark: SparkSession, d: str) -> DataFrame:
    return with_words(once(spark, d, "text")).select("utt_id", F.array_join(S.hybrid_units(F.col("ws")), "|").alias("units"))
