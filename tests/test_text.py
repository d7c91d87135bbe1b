import pytest
from pyspark.sql import functions as F

from sandhi.functions import normalize as N
from sandhi.functions import parsing as P
from sandhi.functions import scripts as S


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "t string").select(expr(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, tokens",
    [("दायाँclick", ["दायाँ", "click"]), ("करेंspoken", ["करें", "spoken"]), ("detailsको", ["details", "को"]), ("mp3", ["mp3"]), ("334", ["334"]), ("", []), ("gnu/लिनक्स", ["gnu/", "लिनक्स"]), (None, None)],
)
def test_split(spark, text, tokens):
    assert one(spark, text, S.tokenize) == tokens


@pytest.mark.parametrize("words, lang", [("नमस्ते दस्तावेज़ बुनियादी क्लिक है है।", "hi"), ("123 42 ... । ॥ — ५ १२३", "other"), ("फाइलformat", "mixed"), ("click naïve", "en")])
def test_lang(spark, words, lang):
    got = one(spark, words, lambda t: F.transform(F.split(t, " "), S.word_lang))
    assert set(got) == {lang}


def test_presets(spark):
    assert one(spark, "यह ठीक है।", lambda t: N.normalize(t, "scoring")) == "यह ठीक है"
    assert one(spark, " Click  The Button ", lambda t: N.normalize(t, "scoring")) == "click the button"
    assert one(spark, "Ｆｕｌｌ ﬁle", lambda t: N.normalize(t, "scoring")) == "full file"
    assert len(one(spark, "दस्तावेज़", lambda t: N.normalize(t, "whisper_basic")).split()) == 4
    assert one(spark, None, N.scoring) is None
    with pytest.raises(ValueError):
        N.normalize(F.col("t"), "none")


def test_switches(spark):
    got = one(spark, "इस document में formatting ठीक", lambda t: S.cs_bigrams(S.tokenize(t)))
    assert [(b["kind"], b["first"], b["second"]) for b in got] == [("HE", "इस", "document"), ("EH", "document", "में"), ("HE", "में", "formatting"), ("EH", "formatting", "ठीक")]
    assert one(spark, "हर्ट्ज़ 5 hertz", lambda t: S.cs_bigrams(S.tokenize(t))) == []
    assert one(spark, "", lambda t: S.cs_bigrams(S.tokenize(t))) == []


def test_runs(spark):
    got = one(spark, "account 5 button बनाना है x", lambda t: S.runs(S.tokenize(t)))
    assert [(r["lang"], r["n"]) for r in got] == [("en", 2), ("hi", 2), ("en", 1)]


def test_parse_bigrams(spark):
    assert one(spark, "1. प्रतीत document\n- बुनियादी formatting\n* इस spoken", P.parse_bigrams) == ["प्रतीत document", "बुनियादी formatting", "इस spoken"]
    assert one(spark, "a b; c d;\nsingle\n", P.parse_bigrams) == ["a b", "c d"]


def test_clean_sentence(spark):
    for raw in ("1. English: open the file फिर", "**English:** open the file फिर", "English: 1. **open the file फिर**"):
        assert one(spark, raw, P.clean_sentence) == "open the file फिर"
    assert one(spark, "हिंदी: यह  ठीक है", P.clean_sentence) == "यह ठीक है"
    assert one(spark, "English is a language जो सीखना है", P.clean_sentence) == "English is a language जो सीखना है"
    assert one(spark, "1. a b c\nno\n- d e f", P.parse_sentences) == ["a b c", "d e f"]


def test_verdicts(spark):
    assert one(spark, "1: YES\n2: NO\n3: yes", lambda t: P.parse_verdicts(t, F.lit(3))) == {0: True, 1: False, 2: True}
    assert one(spark, "9: YES\nblah\n1: NO", lambda t: P.parse_verdicts(t, F.lit(2))) == {0: False}
    assert one(spark, "1: YES\n1: NO", lambda t: P.parse_verdicts(t, F.lit(2))) == {0: False}


@pytest.mark.parametrize(
    "raw, kept",
    [
        ("<think>a\nb</think>answer", "answer"),
        ("<|channel|>analysis<|message|>x<|channel|>final<|message|>answer<|end|>", "answer"),
        ("<think>answer", "answer"),
        ("<|think|> answer", "answer"),
        ("<thinking a='1'>x</THINKING>answer<pad>", "answer"),
        ("<th<th<th<th<think>1</think>ink>2</think>ink>3</think>ink>4</think>ink>5</think>answer", "answer"),
        ("<channel>answer 42<|channel>final yes", "yes"),
        ("plain </b> text", "plain </b> text"),
        ("", ""),
        (None, None),
    ],
)
def test_thinking(spark, raw, kept):
    got = one(spark, raw, P.strip_thinking)
    assert got == kept and one(spark, got, P.strip_thinking) == got


def test_leaks_and_voices(spark):
    assert one(spark, "<think", P.reasoning_leak) and one(spark, "a <|channel x", P.reasoning_leak) and not one(spark, "think", P.reasoning_leak)
    assert one(spark, " **English**: x", P.label_leak) and one(spark, "hinglish - x", P.label_leak) and not one(spark, "English is", P.label_leak)
    assert one(spark, "Ravi", lambda t: P.voice_description(t, "{name} speaks.")) == "Ravi speaks." and one(spark, "Ravi", P.voice_description).startswith("Ravi ")


def test_request_key(spark):
    import hashlib
    import json

    text = 'ए "quoted" \\ line\nनया /'
    want = hashlib.sha256(json.dumps({"sample": 3, "params": {"top_k": 5, "a": "b"}, "model": "m", "messages": [{"role": "user", "content": text}]}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    got = one(spark, text, lambda t: P.request_key("m", F.array(F.struct(F.lit("user").alias("role"), t.alias("content"))), {"a": "b", "top_k": 5}, 3))
    assert got == want


def test_switch_points_of_sql(spark):
    from sandhi.functions import tables

    tables.register(spark)
    for text in ("इस document में formatting ठीक", "दायाँclick करें, mp3 है", "5 hertz", "", None):
        got = [tuple(r)[1:] for r in spark.createDataFrame([(text,)], "t string").createOrReplaceTempView("u") or spark.sql("SELECT s.* FROM u, LATERAL switch_points(u.t) s").collect()]
        want = one(spark, text, lambda t: S.cs_bigrams(S.tokenize(N.scoring(t)))) or []
        assert got == [(b["first"], b["second"], b["kind"]) for b in want]


def test_ids(spark):
    assert one(spark, "103085_AAA_0002", P.recording_id) == "AAA"
    assert one(spark, "103085_AAA_0002", P.segment_index) == 2
    for bad in ("noseparator", "a_b_xyz"):
        with pytest.raises(Exception):
            one(spark, bad, P.recording_id)
    assert one(spark, "/x/y.wav", P.stem) == "y"
