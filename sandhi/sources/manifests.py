"""Readers and writers: JSON lines, key-value files, TSV, id lists, tar archives, published Parquet."""

from __future__ import annotations

import io
import json
import os
import tarfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = ("utt_id", "text", "dur", "wav", "lang", "speaker", "sent_id")
UTTERANCE = "utt_id string, text string, dur double, wav string, lang string, speaker string, sent_id string"


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank and broken lines (a cut-off last one) are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> int:
    """Nulls are left out of the objects; returns the rows written, counted while writing."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append" if append else "overwrite").json(path)
    return seen.get["n"]


def parse_utterances(lines: DataFrame, col: str = "value") -> DataFrame:
    """JSON text to the known columns and extra, a map of all other keys to their JSON or text."""
    every = F.from_json(col, "map<string,string>")
    rows = lines.where(F.trim(col) != "").select(F.from_json(col, UTTERANCE).alias("u"), every.alias("m")).where("u.utt_id is not null")
    extra = F.map_filter("m", lambda k, v: ~k.isin(*FIELDS) & v.isNotNull())
    return rows.select("u.*", extra.alias("extra"))


def to_json_lines(df: DataFrame) -> DataFrame:
    """Known columns and the entries of extra as one object a row, nulls left out."""
    known, more = F.to_json(F.struct(*FIELDS)), F.to_json(F.map_filter("extra", lambda k, v: v.isNotNull()))
    both = F.concat(F.expr("substr(known, 1, length(known) - 1)"), F.lit(","), F.expr("substr(more, 2)"))
    return df.select(known.alias("known"), more.alias("more")).select(F.when(F.length("more") > 2, both).otherwise(F.col("known")).alias("value"))


def key_values(lines: DataFrame, col: str, order: Column) -> DataFrame:
    """(key, value): first word and rest of each line; lines of one word are skipped, the last line of a key counts."""
    pat = r"(?U)^\s*(\S+)\s+(\S.*?)\s*$"
    kv = lines.select(F.regexp_extract(col, pat, 1).alias("key"), F.regexp_extract(col, pat, 2).alias("value"), order.alias("_o")).where("key != ''")
    return kv.groupBy("key").agg(F.max_by("value", "_o").alias("value"))


def segments(lines: DataFrame, col: str = "value") -> DataFrame:
    """(utt_id, reco_id, start_s, end_s) of lines with four fields or more."""
    f = F.split(F.trim(col), r"\s+")
    return lines.where(F.size(f) >= 4).select(f[0].alias("utt_id"), f[1].alias("reco_id"), f[2].try_cast("double").alias("start_s"), f[3].try_cast("double").alias("end_s"))


def read_tsv(spark: SparkSession, path: str, schema: str = "path string, sentence string, client_id string") -> DataFrame:
    """Unquoted, with header; rows with a blank sentence are left out."""
    t = spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", False).csv(path)
    return t.where("trim(sentence) != ''")


def write_ids(df: DataFrame, key: str, path: str) -> None:
    """One sorted id a row: a JSON line each, as an id list may be larger than a task."""
    df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).write.mode("overwrite").json(path)


def id_lines(df: DataFrame, key: str) -> DataFrame:
    """The distinct ids, range-sorted, as one JSON line each; no task holds them all."""
    return df.select(key).distinct().orderBy(key).select(F.to_json(F.struct(key)).alias("line"))


def write_id_array(df: DataFrame, key: str, path: str) -> int:
    """The distinct ids as one sorted JSON array in one file, written as the sorted parts come in (the driver
    holds one part at a time); returns their number."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for r in df.select(key).where(F.col(key).isNotNull()).distinct().orderBy(key).toLocalIterator():
            f.write((", " if n else "") + json.dumps(r[0], ensure_ascii=False))
            n += 1
        f.write("]\n")
    return n


def drop_all_null(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one pass."""
    seen = df.agg(*(F.count(F.col(c)).alias(c) for c in df.columns)).first().asDict()
    return df.select(*(c for c in df.columns if seen[c]))


def unify(*parts: DataFrame) -> DataFrame:
    """Rows of all parts under the union of their columns."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def with_payload(df: DataFrame, col: str = "wav") -> DataFrame:
    """Rows that name a payload; none is an error."""
    out = df.where(F.coalesce(F.col(col), F.lit("")) != "")
    if out.isEmpty():
        raise ValueError(f"no row has {col}")
    return out


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: its texts and payloads, 8 for every other column."""
    size = lambda f: F.coalesce(F.octet_length(f.name), F.lit(0)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8)
    out = F.lit(0)
    for f in df.schema.fields:
        out = out + size(f)
    return out


def publish(df: DataFrame, root: str, repo: str, config: str | None = None, split: str = "train", shard_bytes: int = 500_000_000) -> int:
    """Parquet shards of about shard_bytes below root/repo/config/split; returns how many were asked for."""
    total = df.agg(F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    df.repartition(int(shards)).write.mode("overwrite").parquet(published_path(root, repo, config, split))
    return int(shards)


def published_path(root: str, repo: str, config: str | None = None, split: str = "train") -> str:
    return "/".join([root.rstrip("/"), repo.strip("/"), config or "default", split])


def load_published(spark: SparkSession, root: str, repo: str, config: str | None = None, split: str = "train", columns: list[str] | None = None) -> DataFrame:
    """What publish wrote for a repository, config and split; columns are pruned at the scan."""
    df = spark.read.parquet(published_path(root, repo, config, split))
    return df.select(*columns) if columns else df


def round_trip(left: DataFrame, right: DataFrame, dur: str = "dur") -> DataFrame:
    """One row: rows and milliseconds of both sides and whether they agree (within 36 s)."""
    ms = F.sum(F.round(F.coalesce(F.col(dur), F.lit(0.0)) * 1000).cast("long"))
    side = lambda df, s: df.agg(F.count("*").alias("n"), ms.alias("ms")).withColumn("side", F.lit(s))
    p = side(left, "a").unionByName(side(right, "b")).groupBy().pivot("side", ["a", "b"]).agg(F.first("n").alias("n"), F.first("ms").alias("ms"))
    return p.select(F.col("a_n").alias("n_left"), F.col("b_n").alias("n_right"), F.col("a_ms").alias("ms_left"), F.col("b_ms").alias("ms_right"), ((F.col("a_n") == F.col("b_n")) & (F.abs(F.col("a_ms") - F.col("b_ms")) < 36_000)).alias("ok"))


def find_one(root: str, name: str) -> str | None:
    """The shallowest file of that name below root."""
    hits = [os.path.join(p, name) for p, _, files in os.walk(root) if name in files]
    return min(hits, key=lambda h: (h.count(os.sep), h), default=None)


def natural_key(path: Column) -> Column:
    """Number before .tar, 0 if there is none."""
    return F.coalesce(F.regexp_extract(path, r"_(\d+)\.tar", 1).try_cast("int"), F.lit(0))


class _Tar(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class TarReader(DataSourceReader):
    """One task an archive; members are read as the archive streams by, and reading stops with the consumer."""

    def __init__(self, options: dict) -> None:
        self.root, self.suffix, self.most = options["path"], options.get("suffix", ""), int(options.get("limit", 0))

    def partitions(self) -> list[_Tar]:
        paths = [self.root] if os.path.isfile(self.root) else [os.path.join(self.root, f) for f in os.listdir(self.root) if f.endswith(".tar")]
        number = lambda p: int("".join(c for c in os.path.basename(p).rpartition("_")[2] if c.isdigit()) or 0)
        return [_Tar(p) for p in sorted(paths, key=lambda p: (number(p), p))]

    def read(self, part: _Tar) -> Iterator[tuple]:
        n = 0
        with tarfile.open(part.path, "r|*") as tar:
            for m in tar:
                if m.isfile() and m.name.endswith(self.suffix):
                    data = tar.extractfile(m) or io.BytesIO()
                    yield os.path.basename(m.name), data.read(), part.path
                    n += 1
                    if self.most and n >= self.most:
                        return


class TarSource(DataSource):
    """spark.read.format("tar_members").option("suffix", ".mp3").load(path): (name, content, archive)."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType()), T.StructField("archive", T.StringType())])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return TarReader(self.options)
