"""Queries of sources, joins, external models, conversations and arrays (S, J, R, X20-X22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sandhi.functions import parsing as P
from sandhi.functions import waveform as W
from sandhi.operators import external as ext
from sandhi.operators import joins as J
from sandhi.plans import registry as R
from sandhi.plans.registry import query
from sandhi.plans.select_queries import validated
from sandhi.plans.views import mucs, once, utterances
from sandhi.runtime import table
from sandhi.sources import manifests as src

def n() -> Column:
    return F.count("*").alias("n")

MS = "CAST(round(coalesce(dur, 0) * 1000) AS BIGINT)"


# ---- scans and sources -----------------------------------------------------------------------------------
@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars")


@query("SELECT utt_id, dur FROM utterances")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    return utterances(spark, d).select("utt_id", "dur")


@query("SELECT utt_id, text, dur, wav, lang, speaker, sent_id, coalesce(array_to_string(list_sort(list_filter(list_transform(map_entries(extra), lambda e: e.key || '=' || e.value), lambda x: x IS NOT NULL)), ';'), '') AS more, count(*) AS n FROM utterances GROUP BY ALL")
def manifest_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """To JSON lines and back, the entries of extra as sorted text."""
    back = src.parse_utterances(src.to_json_lines(utterances(spark, d).select(*src.FIELDS, "extra")))
    more = F.array_join(F.array_sort(F.transform(F.map_entries("extra"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return back.withColumn("more", F.coalesce(more, F.lit(""))).groupBy(*src.FIELDS, "more").agg(n())


@query(f"WITH u AS (SELECT utt_id, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') || ' ' || epoch_us(arrived_at), '^{R.WS}', '') AS t, arrived_at FROM utterances WHERE text IS NOT NULL) SELECT utt_id AS key, arg_max(t, arrived_at) AS value FROM u GROUP BY key")
def kv_parse(spark: SparkSession, d: str) -> DataFrame:
    """Each delivery is a line that ends in its time, so the last one of a key can be told from the others."""
    lines = utterances(spark, d).select(F.concat("utt_id", F.lit(" "), F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit(" "), F.unix_micros("arrived_at")).alias("value"), "arrived_at")
    return src.key_values(lines, "value", F.col("arrived_at"))


SEG = "WITH s AS (SELECT DISTINCT utt_id, reco_id, start_s, end_s FROM segments)"


@query(SEG + " SELECT utt_id, reco_id, CAST(round((end_s - start_s) * 1000) AS BIGINT) AS ms FROM s")
def segments_duration(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "segments").distinct().select(F.concat_ws(" ", "utt_id", "reco_id", F.col("start_s").cast("string"), F.col("end_s").cast("string")).alias("value"))
    return src.segments(lines).select("utt_id", "reco_id", F.round((F.col("end_s") - F.col("start_s")) * 1000).cast("long").alias("ms"))


@query("SELECT to_json(utt_id) AS id FROM (SELECT DISTINCT utt_id FROM cs_bigrams) ORDER BY utt_id")
def id_list(spark: SparkSession, d: str) -> DataFrame:
    """The elements of the id array, all ids, range-sorted; src.write_id_array puts them in one file."""
    ids = table(spark, d, "cs_bigrams").select("utt_id").distinct().orderBy("utt_id")
    return ids.select(P.quoted(F.col("utt_id")).alias("id"))


@query("SELECT to_json({'utt_id': utt_id}) AS line FROM (SELECT DISTINCT utt_id FROM cs_bigrams) ORDER BY utt_id")
def id_lines(spark: SparkSession, d: str) -> DataFrame:
    """The same as JSON lines."""
    return src.id_lines(table(spark, d, "cs_bigrams"), "utt_id")


@query("SELECT count(text) > 0 AS text, count(wav) > 0 AS wav, count(sent_id) > 0 AS sent_id, count(extra) > 0 AS extra FROM utterances WHERE corpus = 'mucs'")
def drop_all_null_columns(spark: SparkSession, d: str) -> DataFrame:
    cols = ("text", "wav", "sent_id", "extra")
    kept = src.drop_all_null(utterances(spark, d).where("corpus = 'mucs'").select(*cols)).columns
    return spark.createDataFrame([tuple(c in kept for c in cols)], ", ".join(f"{c} boolean" for c in cols))


@query(f"SELECT count(*) AS n_left, count(*) AS n_right, CAST(sum({MS}) AS BIGINT) AS ms_left, CAST(sum({MS}) AS BIGINT) AS ms_right, true AS ok FROM utterances")
def round_trip_check(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d)
    return src.round_trip(u, src.parse_utterances(src.to_json_lines(u.select(*src.FIELDS, "extra"))))


@query("SELECT utt_id, text, wav FROM utterances WHERE coalesce(wav, '') <> ''")
def rows_with_payload(spark: SparkSession, d: str) -> DataFrame:
    return src.with_payload(utterances(spark, d)).select("utt_id", "text", "wav")


@query("SELECT DISTINCT utt_id, text FROM utterances ORDER BY utt_id")
def merge_shards(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d).select("utt_id", "text").distinct()
    shards = [u.where(F.pmod(F.hash("utt_id"), F.lit(3)) == k) for k in range(3)]
    return src.unify(*shards).orderBy("utt_id")


# ---- joins -----------------------------------------------------------------------------------------------
@query(f"{SEG}, {R.UTT} SELECT utt_id, reco_id, CAST(round((end_s - start_s) * 1000) AS BIGINT) AS ms FROM utt LEFT JOIN s USING (utt_id) WHERE corpus = 'mucs'")
def join_left_segments(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").distinct().select("utt_id", "reco_id", F.round((F.col("end_s") - F.col("start_s")) * 1000).cast("long").alias("ms"))
    return once(spark, d, "corpus").where("corpus = 'mucs'").select("utt_id").join(s, "utt_id", "left")


@query(f"{SEG} SELECT utt_id, reco_id, path FROM s JOIN recordings USING (reco_id) WHERE path IS NOT NULL")
def join_inner_recordings(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").select("utt_id", "reco_id", "start_s", "end_s").distinct()
    return s.join(table(spark, d, "recordings").where("path is not null"), "reco_id").select("utt_id", "reco_id", "path")


FALL = (
    "WITH f AS (SELECT DISTINCT string_split(path, '/')[-1] AS base, path FROM recordings WHERE path IS NOT NULL), g AS (SELECT base, min(path) AS path FROM f GROUP BY base), r AS (SELECT reco_id, coalesce(string_split(path, '/')[-1], '?') AS want FROM recordings) "
    "SELECT reco_id, coalesce(a.path, b.path) AS path FROM r LEFT JOIN g a ON a.base = r.want || '.wav' LEFT JOIN g b ON b.base = r.reco_id || '.wav'"
)


@query(FALL)
def join_fallback_key(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "recordings")
    files = r.where("path is not null").groupBy(P.basename(F.col("path")).alias("base")).agg(F.min("path").alias("path"))
    want = r.select("reco_id", F.coalesce(P.basename(F.col("path")), F.lit("?")).alias("want"))
    return J.fallback(want, files, F.concat("want", F.lit(".wav")), F.concat("reco_id", F.lit(".wav")), "base", "path").select("reco_id", "path")


@query(f"{SEG} SELECT count(*) AS members, count(r.reco_id) AS matched, count(*) - count(r.reco_id) AS skipped FROM s LEFT JOIN (SELECT reco_id FROM recordings WHERE path IS NOT NULL) r USING (reco_id)")
def join_with_miss_count(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "segments").distinct()
    r = table(spark, d, "recordings").where("path is not null").select("reco_id", F.lit(1).alias("hit"))
    j = s.join(r, "reco_id", "left")
    return j.agg(F.count("*").alias("members"), F.count("hit").alias("matched"), F.count_if(F.col("hit").isNull()).alias("skipped"))


@query(f"WITH {R.UTT} SELECT utt_id, corpus FROM utt WHERE utt_id IN (SELECT utt_id FROM cs_bigrams)")
def semi_keep_ids(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, d, "corpus").select("utt_id", "corpus").join(table(spark, d, "cs_bigrams").select("utt_id"), "utt_id", "left_semi")


@query(f"WITH {R.UTT} SELECT utt_id, text FROM utt WHERE utt_id IN (SELECT utt_id FROM segments)")
def semi_subset(spark: SparkSession, d: str) -> DataFrame:
    return J.subset(once(spark, d, "text").select("utt_id", "text"), table(spark, d, "segments"), "utt_id")


REVALID = (
    f"WITH {R.UTT}, norm AS (SELECT *, {R.stripped('text', 'PS')} AS t FROM utt WHERE corpus = 'synth'), tok AS (SELECT *, {R.tokens('t')} AS ws FROM norm), {R.TAGGED}, b AS (SELECT utt_id, first, second FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY bigram_id) AS r FROM (SELECT DISTINCT bigram_id, utt_id, first, second FROM cs_bigrams)) WHERE r = 1), "
    "j AS (SELECT utt_id, b.first IS NOT NULL AS matched, list_transform(ws, lambda w: lower(w)) AS lw, ls, lower(first) AS x, lower(second) AS y FROM tagged LEFT JOIN b USING (utt_id)) "
    "SELECT utt_id, matched, CASE WHEN matched THEN list_contains(ls, 'hi') AND list_contains(ls, 'en') AND len(list_filter(range(1, len(lw)), lambda i: (lw[i] = x AND lw[i + 1] = y) OR (lw[i] = y AND lw[i + 1] = x))) > 0 ELSE true END AS kept FROM j"
)


@query(REVALID)
def join_left_revalidate(spark: SparkSession, d: str) -> DataFrame:
    """Sentences with a known bigram must hold it; those without one pass."""
    b = table(spark, d, "cs_bigrams").groupBy("utt_id").agg(F.min_by(F.struct("first", "second"), "bigram_id").alias("b"))
    j = once(spark, d, "corpus", "text").where("corpus = 'synth'").select("utt_id", "text").join(b, "utt_id", "left")
    m = F.col("b.first").isNotNull()
    return j.select("utt_id", m.alias("matched"), F.when(m, validated(F.col("text"), F.col("b.first"), F.col("b.second"))).otherwise(True).alias("kept"))


# ---- external models -------------------------------------------------------------------------------------
KEY = "substr(sha1(first || '|' || second), 1, 16)"
REQ = f"WITH q AS (SELECT DISTINCT {KEY} AS key, first || ' ' || second AS prompt FROM cs_bigrams WHERE first IS NOT NULL AND second IS NOT NULL), c AS (SELECT key FROM q WHERE substr(key, 1, 1) < '8')"


def requests(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "cs_bigrams").where("first is not null and second is not null")
    return b.select(P.content_id(F.concat("first", F.lit("|"), "second")).alias("key"), F.concat("first", F.lit(" "), "second").alias("prompt")).distinct()


def cached(req: DataFrame) -> DataFrame:
    """As if an earlier run had answered half of the requests."""
    return req.where(F.substring("key", 1, 1) < "8").select("key", F.concat(F.lit("A: "), "prompt").alias("response"))


@query(REQ + " SELECT key, CASE WHEN key IN (SELECT key FROM c) THEN 'hit' ELSE 'miss' END AS state, 'A: ' || prompt AS response FROM q")
def cache_split(spark: SparkSession, d: str) -> DataFrame:
    req = requests(spark, d)
    hits, misses = ext.split_cache(req, cached(req))
    new = ext.generate(misses, "echo", prefix="A: ")
    return hits.select("key", F.lit("hit").alias("state"), "response").unionByName(new.select("key", F.lit("miss").alias("state"), "response"))


@query(REQ + " SELECT key, prompt FROM q WHERE key NOT IN (SELECT key FROM c)")
def resume_todo(spark: SparkSession, d: str) -> DataFrame:
    req = requests(spark, d)
    return req.join(cached(req).select("key"), "key", "left_anti").select("key", "prompt")


@query(
    "WITH b AS (SELECT DISTINCT bigram_id, utt_id, upper(trim(kind)) AS kind FROM cs_bigrams), r AS (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY bigram_id) - 1 AS item FROM b) "
    "SELECT bigram_id, CAST(item AS BIGINT) AS item, coalesce(kind = 'HE', false) AS verdict FROM r"
)
def verdict_join(spark: SparkSession, d: str) -> DataFrame:
    """Answers joined back to their items by chunk and number, not by position of rows."""
    from pyspark.sql import Window

    from sandhi.plans.text_queries import answers

    a = answers(spark, d).select("utt_id", F.explode(P.parse_verdicts(F.col("text"), F.col("n"))).alias("item", "verdict"))
    b = table(spark, d, "cs_bigrams").select("bigram_id", "utt_id", "kind").distinct()
    i = b.withColumn("item", F.row_number().over(Window.partitionBy("utt_id").orderBy("bigram_id")) - 1)
    return i.join(a, ["utt_id", "item"]).select("bigram_id", F.col("item").cast("long").alias("item"), "verdict")


@query(
    f"WITH {R.UTT}, t AS (SELECT string_split(utt_id, '_')[-2] AS conv, CAST(string_split(utt_id, '_')[-1] AS INTEGER) AS turn, text AS content, CASE WHEN CAST(string_split(utt_id, '_')[-1] AS INTEGER) % 5 = 1 THEN 'system' ELSE 'user' END AS role, utt_id FROM utt WHERE corpus = 'mucs'), "
    "s AS (SELECT conv, string_agg(content, chr(10) || chr(10) ORDER BY turn, utt_id) AS sys FROM t WHERE role = 'system' GROUP BY conv), r AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn, utt_id) AS k FROM t WHERE role <> 'system') "
    "SELECT conv, turn, role, CASE WHEN k = 1 AND sys IS NOT NULL THEN sys || chr(10) || chr(10) || content ELSE content END AS content FROM r LEFT JOIN s USING (conv)"
)
def merge_system_turn(spark: SparkSession, d: str) -> DataFrame:
    """System turns folded into the first other turn of a conversation (a recording's utterances stand in)."""
    from pyspark.sql import Window

    t = mucs(once(spark, d, "corpus", "text")).select(F.col("rec").alias("conv"), F.col("idx").alias("turn"), F.col("text").alias("content"), F.when(F.col("idx") % 5 == 1, "system").otherwise("user").alias("role"), "utt_id")
    s = t.where("role = 'system'").groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "utt_id", "content"))).alias("x"))
    s = s.select("conv", F.array_join(F.transform("x", lambda v: v["content"]), "\n\n").alias("sys"))
    r = t.where("role != 'system'").withColumn("k", F.row_number().over(Window.partitionBy("conv").orderBy("turn", "utt_id")))
    first = (F.col("k") == 1) & F.col("sys").isNotNull()
    return r.join(s, "conv", "left").select("conv", "turn", "role", F.when(first, F.concat("sys", F.lit("\n\n"), "content")).otherwise(F.col("content")).alias("content"))


@query(
    "SELECT count(*) FILTER (dur BETWEEN 1.0 AND 30) AS kept, count(*) FILTER (dur IS NULL OR dur < 1.0 OR dur > 30) AS skipped, count(DISTINCT speaker) FILTER (dur BETWEEN 1.0 AND 30) AS speakers, "
    f"CAST(sum({MS}) FILTER (dur BETWEEN 1.0 AND 30) AS BIGINT) AS ms, sum({MS}) FILTER (dur BETWEEN 1.0 AND 30) < 0.95 * 15 * 3600000 AS short FROM utterances WHERE corpus LIKE 'cv%'"
)
def ingest_counters(spark: SparkSession, d: str) -> DataFrame:
    ok = F.coalesce(F.col("dur").between(1.0, 30), F.lit(False))
    g = utterances(spark, d).where("corpus like 'cv%'").groupBy("speaker").agg(F.count_if(ok).alias("k"), F.count_if(~ok).alias("s"), F.sum(F.when(ok, F.round(F.col("dur") * 1000).cast("long"))).alias("ms"))
    t = g.agg(F.sum("k").alias("kept"), F.sum("s").alias("skipped"), F.count_if((F.col("k") > 0) & F.col("speaker").isNotNull()).alias("speakers"), F.sum("ms").alias("ms"))
    return t.withColumn("short", F.col("ms") < 0.95 * 15 * 3_600_000)


# ---- arrays ----------------------------------------------------------------------------------------------
# arrays are compared whole: every sample in millionths, joined
LOUD = "SELECT vec_id, embedding AS x, list_filter(range(1, len(embedding) + 1), lambda i: abs(embedding[i]) > 0.1) AS loud FROM embeddings"


def samples(x: str) -> str:
    return f"coalesce(array_to_string(list_transform({x}, lambda v: CAST(round(CAST(v AS DOUBLE) * 1000000) AS BIGINT)), ','), '')"


def joined(x: Column) -> Column:
    return F.array_join(F.transform(x, lambda v: F.round(v.cast("double") * 1_000_000).cast("long").cast("string")), ",")


@query(f"WITH l AS ({LOUD}), t AS (SELECT vec_id, CASE WHEN len(loud) = 0 THEN [] ELSE x[greatest(1, list_min(loud) - 2) : least(len(x), list_max(loud) + 2)] END AS x FROM l) SELECT vec_id, {samples('x')} AS samples FROM t")
def trim_silence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", joined(W.trim_silence(F.col("embedding"), 0.1, 2)).alias("samples"))


@query(
    "WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), q AS (SELECT vec_id, x, list_max(list_transform(x, lambda v: abs(v))) AS peak FROM p) "
    "SELECT vec_id, array_to_string(list_transform(x, lambda v: CAST(trunc(least(32767.0, greatest(-32768.0, v / CASE WHEN peak > 1 THEN peak ELSE 1.0 END * 32767.0))) AS BIGINT)), ',') AS samples FROM q"
)
def quantize_pcm16(spark: SparkSession, d: str) -> DataFrame:
    q = W.quantize_pcm16(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(q.cast("array<string>"), ",").alias("samples"))


@query(f"SELECT vec_id, {samples('embedding[CAST(4 + vec_id % 5 AS INTEGER) + 1 : 20]')} AS samples FROM embeddings")
def audio_cut_slice(spark: SparkSession, d: str) -> DataFrame:
    x = W.cut(F.col("embedding"), (4 + F.col("vec_id") % 5) / 16.0, F.lit(20 / 16.0), 16)
    return table(spark, d, "embeddings").select("vec_id", joined(x).alias("samples"))


@query(f"SELECT vec_id, len(embedding) / 16.0 AS seconds, {samples('list_transform(range(1, len(embedding) + 1), lambda i: CAST((embedding[i] + embedding[-i]) / 2.0 AS FLOAT))')} AS samples FROM embeddings")
def mono_clip(spark: SparkSession, d: str) -> DataFrame:
    """Two channels (the second is the first backwards) to their mean."""
    frames = F.zip_with("embedding", F.reverse("embedding"), lambda a, b: F.array(a, b))
    x = F.transform(W.mono(frames), lambda v: v.cast("float"))
    return table(spark, d, "embeddings").select("vec_id", W.duration(F.col("embedding"), 16).alias("seconds"), joined(x).alias("samples"))


AT = "(i * CAST(0.6 AS DOUBLE))"


@query(
    f"WITH r AS (SELECT vec_id, list_transform(range(0, CAST(round(len(embedding) * (1 / CAST(0.6 AS DOUBLE))) AS BIGINT)), lambda i: CAST(CAST(embedding[CAST(least(floor({AT}), len(embedding) - 1) AS BIGINT) + 1] AS DOUBLE) + "
    f"(CAST(embedding[CAST(least(floor({AT}) + 1, len(embedding) - 1) AS BIGINT) + 1] AS DOUBLE) - CAST(embedding[CAST(least(floor({AT}), len(embedding) - 1) AS BIGINT) + 1] AS DOUBLE)) * least(1.0, {AT} - least(floor({AT}), len(embedding) - 1)) AS FLOAT)) AS x FROM embeddings) "
    f"SELECT vec_id, {samples('x')} AS samples FROM r"
)
def resample_clip(spark: SparkSession, d: str) -> DataFrame:
    """From 6 samples a second to 10."""
    return table(spark, d, "embeddings").select("vec_id", joined(W.resample(6, 10)(F.col("embedding"))).alias("samples"))


@query(f"WITH f AS (SELECT vec_id // 8 AS recording, flatten(list(embedding ORDER BY vec_id)) AS x FROM embeddings GROUP BY 1) SELECT recording, {samples('x')} AS samples FROM f")
def concat_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Clips of a recording joined in order; eight clips make one, so no row grows with the table."""
    g = table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("recording")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("x"))
    return g.select("recording", joined(F.flatten(F.transform("x", lambda v: v["embedding"]))).alias("samples"))


@query(
    f"WITH {R.UTT}, l AS (SELECT utt_id, length(text) // 16 AS batch, list_concat(CASE WHEN length(text) // 16 % 2 = 0 THEN [9] ELSE [] END, list_transform(string_split({R.collapse('text')}, ' '), lambda w: length(w))) AS ids FROM utt), "
    "w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width, bool_and(ids[1] = 9) OVER (PARTITION BY batch) AS all_start FROM l) "
    "SELECT utt_id, batch, array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: -100))[CASE WHEN all_start THEN 2 ELSE 1 END : CASE WHEN all_start THEN 449 ELSE 448 END], ',') AS labels FROM w"
)
def pad_labels(spark: SparkSession, d: str) -> DataFrame:
    """Batches of like length; in every second one all rows begin with the start token, which is dropped."""
    from sandhi.functions.normalize import raw

    batch = F.floor(F.char_length("text") / 16)
    begun = F.when(batch % 2 == 0, F.array(F.lit(9))).otherwise(F.array().cast("array<int>"))
    ids = F.concat(begun, F.transform(F.split(raw(F.col("text")), " "), lambda w: F.char_length(w)))
    t = once(spark, d, "text").select("utt_id", batch.alias("batch"), ids.alias("labels"))
    return W.collate(t.where("labels is not null"), "batch", "labels", 9).select("utt_id", "batch", F.array_join(F.col("labels").cast("array<string>"), ",").alias("labels"))
