"""Queries that write files to the shared folder and read them back, and queries over streams (S, 2.9)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sandhi.functions import parsing as P
from sandhi.functions.normalize import collapse_ws
from sandhi.plans import registry as R
from sandhi.plans.ingest_queries import REQ, requests
from sandhi.plans.registry import query
from sandhi.plans.views import once, utterances
from sandhi.runtime import materialize, own_dir, shared_dir, table
from sandhi.sources import manifests as src
from sandhi.streaming import cache


def place(spark: SparkSession, name: str) -> str:
    """A new path beside the application's intermediate tables."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines written in two steps, the second appended, and read."""
    docs, at = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "n_chars"), place(spark, "jsonl")
    for k in range(2):
        src.write_jsonl(docs.where(F.pmod("doc_id", F.lit(2)) == k), at, append=k > 0)
    return src.read_jsonl(spark, at, "doc_id long, text string, lang string, source string, n_chars long")


@query("SELECT DISTINCT utt_id, length(text) AS n FROM utterances WHERE ascii(substr(sha1(utt_id), 1, 1)) % 2 = 0")
def truncated_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Lines cut off in the middle, as a killed writer leaves them, are passed over."""
    u = once(spark, d, "text").select("utt_id", F.char_length("text").cast("long").alias("n"))
    line = F.to_json(F.struct("utt_id", "n"), {"ignoreNullFields": "false"})
    whole = F.ascii(F.sha1(F.encode("utt_id", "UTF-8"))) % 2 == 0
    at = place(spark, "cut")
    u.select(F.when(whole, line).otherwise(F.substring(line, 1, 15)).alias("value")).write.text(at)
    return src.read_jsonl(spark, at, "utt_id string, n long")


_LINE = R.collapse("text")


@query(f"SELECT utt_id AS path, {_LINE} AS sentence, coalesce(speaker, '') AS client_id FROM utterances WHERE {_LINE} <> ''")
def tsv_read(spark: SparkSession, d: str) -> DataFrame:
    """Unquoted TSV, quotation marks in it being text."""
    u = utterances(spark, d).select(F.col("utt_id").alias("path"), collapse_ws(F.col("text")).alias("sentence"), F.coalesce("speaker", F.lit("")).alias("client_id"))
    at = place(spark, "tsv")
    u.write.option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(at)
    return src.read_tsv(spark, at).select("path", "sentence", F.coalesce("client_id", F.lit("")).alias("client_id"))


@query("SELECT DISTINCT utt_id, text, split FROM utterances")
def published_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Published as shards by config and split, loaded again."""
    u, root = materialize(once(spark, d, "text", "split"), "published"), shared_dir(spark)
    repo = place(spark, "hub")[len(root) + 1 :]
    splits = ("train", "dev", "test")
    for s in splits:
        src.publish(u.where(F.col("split") == s).drop("split"), root, repo, "all", s, shard_bytes=2_000_000)
    return src.unify(*(src.load_published(spark, root, repo, "all", s, ["utt_id", "text"]).withColumn("split", F.lit(s)) for s in splits))


@query("SELECT DISTINCT speaker, speaker || ' speaks clearly.' AS description, contains(text, '<think') OR contains(text, '<|channel') OR contains(text, '<|message') AS leak FROM utterances")
def voices(spark: SparkSession, d: str) -> DataFrame:
    u = utterances(spark, d)
    return u.select("speaker", P.voice_description(F.col("speaker"), "{name} speaks clearly.").alias("description"), P.reasoning_leak(F.col("text")).alias("leak")).distinct()


# ---- streams ---------------------------------------------------------------------------------------------
@query(REQ + " SELECT key, 'A: ' || prompt AS response FROM q")
def answer_cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """Requests as a stream, delivered twice: each key is answered once, by whichever run comes first."""
    req, store = place(spark, "requests"), place(spark, "answers")
    requests(spark, d).write.parquet(req)
    for _ in range(2):
        s = spark.readStream.schema("key string, prompt string").parquet(req)
        cache.answer_stream(s, store, place(spark, "state"), prefix="A: ").awaitTermination()
    return spark.read.schema("key string, response string").parquet(store)


@query(
    f"WITH {R.ONCE}, {R.TAGGED}, {R.PAIRS}, t AS (SELECT DISTINCT utt_id, recorded_at FROM utterances) "
    "SELECT strftime(date_trunc('day', recorded_at), '%Y-%m-%d') AS day, kind, count(*) AS n FROM cs JOIN t USING (utt_id) GROUP BY ALL"
)
def switch_stream(spark: SparkSession, d: str) -> DataFrame:
    """Switch points a day of a stream in which utterances are delivered again and late."""
    u = utterances(spark, d).select("utt_id", "text", "recorded_at")
    at, name = place(spark, "stream"), f"switches_{uuid.uuid4().hex}"
    u.write.parquet(at)
    counts = cache.switch_counts(spark.readStream.schema(u.schema).parquet(at), "3650 days")
    q = counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", place(spark, "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "kind", "n")  # two rows a day
