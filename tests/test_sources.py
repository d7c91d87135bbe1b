import io
import tarfile

import pytest

from sandhi.sources import manifests as src
from sandhi.streaming import cache


def test_jsonl(spark, tmp_path):
    p = tmp_path / "a"
    p.mkdir()
    (p / "x.jsonl").write_text('{"key": "1", "response": "क"}\n\n{"key": "2", "resp')
    assert [tuple(r) for r in src.read_jsonl(spark, str(p), "key string, response string").collect()] == [("1", "क")]
    df = spark.createDataFrame([("1", None), ("2", "x")], "a string, b string")
    assert src.write_jsonl(df, str(tmp_path / "o")) == 2
    assert src.write_jsonl(df, str(tmp_path / "o"), append=True) == 2
    assert spark.read.json(str(tmp_path / "o")).count() == 4


def test_utterances_and_extra(spark):
    lines = spark.createDataFrame([('{"utt_id": "a", "text": "t", "dur": 1.5, "bigram": "x y", "n": 3}',), ("  ",)], "value string")
    u = src.parse_utterances(lines)
    r = u.first()
    assert src.parse_utterances(lines.where("1 = 0")).count() == 0
    assert u.count() == 1 and r["dur"] == 1.5 and r["extra"] == {"bigram": "x y", "n": "3"}
    assert src.parse_utterances(src.to_json_lines(u)).first() == r


def test_key_values_and_segments(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("a one  two", 1), ("b", 2), ("a three", 3)], "value string, i int")
    assert [tuple(r) for r in src.key_values(d, "value", F.col("i")).collect()] == [("a", "three")]
    s = spark.createDataFrame([("u r 0.5 1.25",), ("short r",)], "value string")
    assert [tuple(r) for r in src.segments(s).collect()] == [("u", "r", 0.5, 1.25)]


def test_tsv_and_unify(spark, tmp_path):
    (tmp_path / "t.tsv").write_text('path\tsentence\tclient_id\np1\the said "x\tc\np2\t \tc\n')
    assert [r["sentence"] for r in src.read_tsv(spark, str(tmp_path / "t.tsv")).collect()] == ['he said "x']
    u = src.unify(spark.createDataFrame([("a", 1.0)], "utt_id string, dur double"), spark.createDataFrame([("b",)], "utt_id string"))
    assert u.count() == 2 and u.where("dur is null").count() == 1
    assert src.drop_all_null(u.where("dur is null")).columns == ["utt_id"]
    with pytest.raises(ValueError):
        src.with_payload(u.selectExpr("utt_id", "cast(null as string) wav"))


def test_tar(spark, tmp_path):
    for k in (10, 2):
        with tarfile.open(tmp_path / f"s_{k}.tar", "w") as t:
            for name in ("a.mp3", "b.txt"):
                i = tarfile.TarInfo(f"x/{name}")
                i.size = 3
                t.addfile(i, io.BytesIO(b"abc"))
    spark.dataSource.register(src.TarSource)
    got = spark.read.format("tar_members").option("suffix", ".mp3").load(str(tmp_path)).collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("a.mp3", b"abc")] * 2
    assert src.TarReader({"path": str(tmp_path)}).partitions()[0].path.endswith("s_2.tar")


def test_id_lines_lists_every_id(spark, tmp_path):
    from sandhi.plans import catalog

    ids = [f"r{i % 7}_{i:04}" for i in range(500)]
    spark.createDataFrame([(x,) for x in ids + ids[:9]], "utt_id string").write.parquet(str(tmp_path / "cs_bigrams.parquet"))
    assert [r["line"] for r in catalog.queries()["id_lines"](spark, str(tmp_path)).collect()] == [f'{{"utt_id":"{x}"}}' for x in sorted(ids)]


def test_find_one(tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "text").write_text("")
    assert src.find_one(str(tmp_path), "text").endswith("d/text") and src.find_one(str(tmp_path), "none") is None


def test_answer_stream(spark, tmp_path):
    spark.createDataFrame([("1", "p"), ("1", "p"), ("2", "q")], "key string, prompt string").write.parquet(str(tmp_path / "in"))
    s = lambda: spark.readStream.schema("key string, prompt string").parquet(str(tmp_path / "in"))
    for ck in ("c1", "c2"):  # a second stream over the same requests finds them answered
        cache.answer_stream(s(), str(tmp_path / "cache"), str(tmp_path / ck)).awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "cache")).collect()) == [("1", "p"), ("2", "q")]


def test_switch_stream(spark, data, tmp_path):
    u = spark.read.parquet(f"{data}/utterances.parquet").select("utt_id", "text", "recorded_at")
    u.write.parquet(str(tmp_path / "u"))
    counts = cache.switch_counts(spark.readStream.schema(u.schema).parquet(str(tmp_path / "u")), "3650 days")
    q = counts.writeStream.format("memory").queryName("switches").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(180)
    from sandhi.plans import catalog

    want = catalog.queries()["cs_bigrams"](spark, data).count()
    assert spark.sql("select sum(n) from switches").first()[0] == want


def test_publish_and_load(spark, tmp_path):
    df = spark.createDataFrame([(f"u{i}", "t" * 90, b"x" * 100, 1.0) for i in range(500)], "utt_id string, text string, audio binary, dur double")
    assert src.publish(df, str(tmp_path), "me/corpus", "small", "test", shard_bytes=25_000) == 5
    assert src.load_published(spark, str(tmp_path), "me/corpus", "small", "test").count() == 500
    got = src.load_published(spark, str(tmp_path), "me/corpus", "small", "test", ["utt_id"])
    assert got.columns == ["utt_id"] and got.rdd.getNumPartitions() <= 5
    assert src.publish(df.limit(0), str(tmp_path), "me/corpus") == 1 and src.published_path("/r/", "a/b") == "/r/a/b/default/train"


def test_id_array(spark, tmp_path):
    import json

    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,), ('q"',)], "k string")
    assert src.write_id_array(df, "k", str(tmp_path / "ids.json")) == 3
    assert json.load(open(tmp_path / "ids.json")) == ["a", "b", 'q"']
    src.write_ids(df, "k", str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 3


def test_natural_key(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([("x_10.tar",), ("x_2.tar",), ("x.tar",)], "p string")
    assert [r["p"] for r in d.orderBy(src.natural_key(F.col("p"))).collect()] == ["x.tar", "x_2.tar", "x_10.tar"]


def test_append_sink(spark, tmp_path):
    for k in range(2):  # the second run goes on where the first stopped
        spark.createDataFrame([(f"{k}",)], "key string").write.mode("append").json(str(tmp_path / "in"))
        cache.append_sink(spark.readStream.schema("key string").json(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.schema("key string").json(str(tmp_path / "out")).collect()) == ["0", "1"]
