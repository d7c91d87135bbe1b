"""Streams: a response cache that answers every key once, and running counts of switch points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sandhi.functions.normalize import scoring
from sandhi.functions.scripts import cs_bigrams, tokenize
from sandhi.operators.external import generate


def answer_stream(requests: DataFrame, cache_path: str, checkpoint: str, backend: str = "echo", once: bool = True, **options) -> StreamingQuery:
    """requests(key, prompt) as a stream: keys not yet in the cache are answered and appended. A batch that is
    run again after a failure finds its keys in the cache, so each key has one response."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(["key"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache_path)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.schema("key string, response string").parquet(cache_path)
            new = new.join(known.select("key"), "key", "left_anti")
        generate(new, backend, **options).write.mode("append").parquet(cache_path)

    w = requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def switch_counts(utterances: DataFrame, late: str = "30 days", every: str = "1 day") -> DataFrame:
    """Switch points a day and kind of a stream of utterances(utt_id, text, recorded_at), each utterance
    counted once however often delivered within the lateness allowed."""
    u = utterances.withWatermark("recorded_at", late).dropDuplicatesWithinWatermark(["utt_id"])
    b = u.select("recorded_at", F.explode(cs_bigrams(tokenize(scoring(F.col("text"))))).alias("b"))
    return b.groupBy(F.window("recorded_at", every).alias("day"), F.col("b.kind").alias("kind")).agg(F.count("*").alias("n")).select(F.col("day.start").alias("day"), "kind", "n")


def append_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> StreamingQuery:
    """Append-only output that a restarted stream continues."""
    return df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
