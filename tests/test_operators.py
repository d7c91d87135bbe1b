import pytest
from pyspark.sql import functions as F

from sandhi.functions import waveform as W
from sandhi.operators import external as ext
from sandhi.operators import joins as J
from sandhi.operators import metrics as M
from sandhi.operators import select as sel


def score(spark, refs, hyps, mode="adjacent", groups=None):
    groups = groups or [str(i) for i in range(len(refs))]
    r = spark.createDataFrame([(g, x.split()) for g, x in zip(groups, refs)], "g string, ws array<string>")
    h = spark.createDataFrame([(g, x.split()) for g, x in hyps.items()] if isinstance(hyps, dict) else [(str(i), x.split()) for i, x in enumerate(hyps)], "g string, ws array<string>")
    return M.cba(M.reference_pairs(r, F.col("g"), F.col("ws")), h, mode).first()


def test_cba(spark):
    s = score(spark, ["इस document और इस document"], ["इस document और इस दस्तावेज़"])
    assert (s["he_total"], s["he_matched"]) == (2, 1)
    s = score(spark, ["इस document", "यह file"], {"R": "इस document यह file"}, groups=["R", "R"])
    assert (s["he_total"], s["eh_total"], s["he_matched"]) == (2, 0, 2)
    s = score(spark, ["इस document", "इस document"], {"R": "इस document और कुछ"}, groups=["R", "R"])
    assert (s["he_total"], s["he_matched"]) == (2, 1)
    for mode, want in (("adjacent", 0.0), ("lenient", 100.0)):
        assert score(spark, ["इस document"], ["document कुछ और इस"], mode)["cba_he"] == want
    s = score(spark, ["इस document", "इस document"], {"R": "इस x document"}, "lenient", ["R", "R"])
    assert (s["he_total"], s["he_matched"]) == (2, 1)
    with pytest.raises(ValueError):
        score(spark, ["a"], ["b"], "other")


@pytest.mark.parametrize("ref, hyp, word, hybrid", [("इस document में", "इस file में", 100 / 3, None), ("है", "हो", 100.0, 50.0), ("a b", "a b", 0.0, 0.0), ("a b", "", 100.0, 100.0), ("", "a b", 0.0, 0.0)])
def test_mer(spark, ref, hyp, word, hybrid):
    df = spark.createDataFrame([(ref.split(), hyp.split())], "r array<string>, h array<string>")
    assert M.mer(df, F.col("r"), F.col("h")).first()["mer"] == pytest.approx(word)
    if hybrid is not None:
        assert M.mer(df, F.col("r"), F.col("h"), hybrid=True).first()["mer"] == pytest.approx(hybrid)


def test_align(spark):
    a, b = spark.createDataFrame([("1",), ("2",)], "k string"), spark.createDataFrame([("1", "x")], "k string, h string")
    with pytest.raises(ValueError, match="1 of 2"):
        M.align(a, b, "k")
    with pytest.raises(ValueError, match="no reference"):
        M.align(a.where("k = '2'"), b, "k")
    assert M.align(a.where("k = '1'"), b, "k").count() == 1


def rows(spark, n=100, groups=10):
    return spark.createDataFrame([(f"u{i}", f"g{i % groups}", 10) for i in range(n)], "utt_id string, bigram string, dur int")


def test_until_and_round_robin(spark):
    r = rows(spark)
    got = sel.round_robin(r, F.col("bigram"), F.col("utt_id"), F.col("dur"), 500)
    total = got.agg(F.sum("dur")).first()[0]
    assert 500 <= total <= 510
    spread = sel.round_robin(r, F.col("bigram"), F.col("utt_id"), F.col("dur"), 100)
    assert spread.select("bigram").distinct().count() >= 8
    assert sel.round_robin(rows(spark, 5), F.col("bigram"), F.col("utt_id"), F.col("dur"), 10_000).count() == 5
    assert sel.until(r, sel.seeded(1, F.col("utt_id")), F.col("dur"), 95).count() == 10
    again = {x["utt_id"] for x in sel.round_robin(r.repartition(7), F.col("bigram"), F.col("utt_id"), F.col("dur"), 500).collect()}
    assert again == {x["utt_id"] for x in got.collect()}
    assert sel.round_robin(r.limit(0), F.col("bigram"), F.col("utt_id"), F.col("dur"), 100).count() == 0


def test_shards_partition(spark):
    r = sel.ranked(rows(spark, 101), sel.seeded(3, F.col("utt_id")))
    assert sorted(x["rank"] for x in r.collect()) == list(range(101))


def test_cap_and_first(spark):
    d = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), (None, 4), (None, 5), ("", 6)], "k string, i int")
    assert sel.capped(d, F.col("k"), [F.col("i")], 2).count() == 5
    assert sel.capped(d, F.col("k"), [F.col("i")], 0).count() == 6
    assert sorted(x["i"] for x in sel.keep_first(d, [F.col("k")], [F.col("i")]).collect()) == [1, 4, 6]


def test_subset_and_fallback(spark):
    d = spark.createDataFrame([("a",), ("b",)], "utt_id string")
    assert J.subset(d, spark.createDataFrame([("a",), ("a",)], "utt_id string"), "utt_id").count() == 1
    with pytest.raises(ValueError):
        J.subset(d, spark.createDataFrame([("z",)], "utt_id string"), "utt_id")
    f = spark.createDataFrame([("a", "pa"), ("b2", "pb"), ("a2", "never")], "base string, path string")
    twice = d.unionByName(d).unionByName(spark.createDataFrame([(None,)], "utt_id string"))
    assert sorted(str(x["path"]) for x in J.fallback(twice, f, F.col("utt_id"), F.concat("utt_id", F.lit("2")), "base", "path").collect()) == ["None", "pa", "pa", "pb", "pb"]
    got = J.fallback(d, f, F.col("utt_id"), F.concat("utt_id", F.lit("2")), "base", "path")
    assert {x["utt_id"]: x["path"] for x in got.collect()} == {"a": "pa", "b": "pb"}


def test_external(spark):
    req = spark.createDataFrame([("1", "p1"), ("2", "p2"), ("2", "p2")], "key string, prompt string")
    cache = spark.createDataFrame([("1", "old")], "key string, response string")
    out, new = ext.respond(req, cache, "echo", prefix="new ")
    assert {(x["key"], x["response"]) for x in out.collect()} == {("1", "old"), ("2", "new p2")}
    assert new.count() == 1
    _, again = ext.respond(req, cache.unionByName(new), "echo", prefix="other ")
    assert again.count() == 0
    with pytest.raises(ValueError, match="unknown backend"):
        ext.build_backend("nothing")
    assert ext.build_backend("echo", model_id="x", filename="y").model_id == "echo"
    t = ext.build_backend("transformers", model_id="m", filename="y", load=lambda: str.upper)
    assert t.filename is None and t.model_id == "m" and t.generate(["a", "b"]) == ["A", "B"]
    assert ext.build_backend("llamacpp", model_id="m", filename="y").filename == "y"


def test_waveform(spark):
    x = [0.0] * 1000 + [0.5] * 500 + [0.0] * 1000
    d = spark.createDataFrame([(x, [0.0] * 10, [2.0, -2.0, 0.0])], "x array<float>, z array<float>, q array<float>")
    r = d.select(F.size(W.trim_silence(F.col("x"), pad=0)).alias("kept"), F.size(W.trim_silence(F.col("z"))).alias("none"), W.quantize_pcm16(F.col("q")).alias("pcm"), F.size(W.resample(8000)(F.col("x"))).alias("r")).first()
    assert (r["kept"], r["none"], r["pcm"], r["r"]) == (500, 0, [32767, -32767, 0], 5000)
    import numpy as np

    y = np.random.default_rng(1).uniform(-1, 1, 44).astype(np.float32)
    got = spark.createDataFrame([([float(v) for v in y],), ([],), ([0.5],)], "y array<float>").select(W.resample(11, 16)(F.col("y")).alias("r")).collect()
    want = np.interp(np.arange(64) * (11 / 16), np.arange(44), y.astype(np.float64))
    assert np.allclose(got[0]["r"], want, atol=1e-6) and got[1]["r"] == [] and got[2]["r"] == [0.5]


@pytest.mark.parametrize("mode", ["adjacent", "lenient"])
def test_cba_within_equals_cba_by_groups(spark, mode):
    import random

    r = random.Random(4)
    words = ["इस", "में", "है", "file", "open", "x", "5"]
    rows = [(str(i), r.choices(words, k=r.randint(0, 12)), r.choices(words, k=r.randint(0, 12))) for i in range(120)]
    d = spark.createDataFrame(rows, "g string, ws array<string>, hw array<string>")
    one = M.cba_within(d, "g", F.col("ws"), F.col("hw"), mode).first()
    two = M.cba(M.reference_pairs(d, F.col("g"), F.col("ws")), d.select("g", F.col("hw").alias("ws")), mode).first()
    assert one == two and one["he_matched"] > 5


def test_rank_within_a_hot_group(spark):
    d = spark.createDataFrame([(f"u{i}", "hot" if i % 3 else None) for i in range(900)], "utt_id string, g string")
    got = sel.rank_within(d, F.col("g"), sel.seeded(1, F.col("utt_id"))).collect()
    for g in ("hot", None):
        mine = [r["rank"] for r in got if r["g"] == g]
        assert sorted(mine) == list(range(len(mine))) and len(mine) in (600, 300)


def test_until_in_order(spark):
    d = spark.createDataFrame([(f"{a}{b}", a, b, 10) for a in "abc" for b in range(5)] + [("n", "a", 9, None)], "utt_id string, part string, place int, dur int")
    got = lambda t: sorted(r["utt_id"] for r in sel.until_in_order(d, F.col("part"), [F.col("place")], F.col("dur"), t).collect())
    assert got(65) == ["a0", "a1", "a2", "a3", "a4", "b0", "b1", "n"] and got(0) == [] and len(got(10**6)) == 16 and got(50) == ["a0", "a1", "a2", "a3", "a4"]


def test_collate(spark):
    d = spark.createDataFrame([(1, [9, 1, 2]), (1, [9, 3]), (2, [9, 1]), (2, [4]), (3, []), (4, [9] + [1] * 500)], "b int, labels array<int>")
    got = sorted(tuple(r["labels"]) for r in W.collate(d, "b", "labels", 9).collect())
    assert got == sorted([(1, 2), (3, -100), (9, 1), (4, -100), (), (1,) * 448])


def test_checkpoints(tmp_path):
    from sandhi.operators import checkpoints as C

    assert C.path_of("/m6/") == "m6/last-checkpoint" and C.path_of("m6", "best") == "m6/best-checkpoint"
    with pytest.raises(ValueError):
        C.path_of("m6", "bogus")
    root, state = str(tmp_path / "root"), tmp_path / "state"
    state.mkdir()
    (state / "weights").write_text("1")
    (state / C.STATE).write_text("{}")
    assert C.resume(root, "m6") is None
    C.push(str(state), root, "m6", best=True)
    (state / "weights").write_text("2")
    C.push(str(state), root, "m6")
    read = lambda kind: open(f"{C.resume(root, 'm6', kind)}/weights").read()
    assert (read("last"), read("best")) == ("2", "1")
    (tmp_path / "root" / "m6" / "last-checkpoint" / C.STATE).unlink()  # an interrupted copy is no state
    assert C.resume(root, "m6") is None
    C.clear(root, "m6")
    assert C.resume(root, "m6", "best") is None
