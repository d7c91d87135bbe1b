"""Parsers and cleaners of generated text, identifiers, prompts, as Column expressions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sandhi.functions.normalize import collapse_ws

# What marks list items, language labels, emphasis, verdicts and reasoning in answers.
BULLETS = "-*•"
NUMBER_ENDS = ".)"
LABELS = ("english", "hindi", "hinglish", "अंग्रेज़ी", "अंग्रज़ी", "हिंदी", "हिन्दी")
LABEL_ENDS = ":：-–—"
EMPHASIS = "*_\"'`"
VERDICT_ENDS = ":.)-"
THINK = ("think", "thinking", "reason", "reasoning")
FINAL_CHANNELS = ("final", "answer")
CONTROL = ("<s>", "</s>", "<start_of_turn>", "<end_of_turn>", "<pad>")


def _words(words) -> str:
    return "(?:" + "|".join(map(re.escape, words)) + ")"


def _chars(chars: str) -> str:
    return "[" + "".join(map(re.escape, chars)) + "]"


def _token(name: str) -> str:
    """A control token of that name, with or without bars."""
    return rf"<\|?{name}\|?>"


#: a number with its end or a bullet
ITEM = rf"(?:\d+\s*{_chars(NUMBER_ENDS)}|{_chars(BULLETS)})"
STRICT_ITEM = rf"(?:\d+{_chars(NUMBER_ENDS)}|{_chars(BULLETS)})"
#: a language's name, perhaps emphasised, and what parts it from the text
LABEL = rf"\**\s*(?i:{_words(LABELS)})\s*\**\s*{_chars(LABEL_ENDS)}"

# Prompts as printed in a published paper on synthesis of code-mixed speech (Interspeech 2025).
BIGRAM_SYSTEM = "You're a helpful mix-bigrams generator, fluent in both English and Hindi, and that only prints out the bigrams and no additional comments."
BIGRAM_USER = (
    "Generate {n} language mix bigrams in Hindi-English. Each bigram is a couple of different words that usually go together and often written this way: "
    "one in Hindi and the other one in English. Never put just a translation of one word next to each other. Hindi words should be in Devnagari and English words "
    "should be in Latin. Follow these examples: प्रस्तुति document; बुनियादी formatting; इस spoken. Use these phrases with mixed language for inspiration. "
    "Use different words for bigrams different from the ones in the text: "
)
SENTENCE_SYSTEM = "You're a helpful sentence generator, fluent in both English and Hindi, and that output only required sentences without any additional comments."
SENTENCE_USER = (
    "Generate four sentences that would use this bigram in Hindi-English in a natural way. Make 2 sentences with English as the main language and "
    "2 sentences with Hindi as the main language. Word bigram to use: "
)
CHECK_SYSTEM = "You are fluent in Hindi and English. For every pair of words you are given, say whether one is the translation of the other: a line 'number: YES' or 'number: NO' for each pair, in order, and nothing more."
CHECK_USER = "Are the two words of each pair translations of each other?\n\n"


def lines(t: Column) -> Column:
    return F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


def clean_sentence(line: Column) -> Column:
    """Item marks, language labels and emphasis off the front, emphasis off the end, blanks squeezed; one
    anchored pattern takes the front parts in any order and number, which is the fixpoint of taking each."""
    marks = _chars(EMPHASIS) + "+"
    s = F.regexp_replace(line, rf"^(?:\s*{ITEM}\s*|\s*{LABEL}\s*|\s*{marks}|\s+)+", "")
    return collapse_ws(F.regexp_replace(s, rf"(?:{marks}\s*)+$", ""))


def parse_sentences(t: Column) -> Column:
    """Cleaned lines of three words or more."""
    return F.filter(F.transform(lines(t), clean_sentence), lambda s: F.size(F.split(s, " ")) >= 3)


def parse_bigrams(t: Column) -> Column:
    """Phrases of two words or more: a line each, or several in a line parted by semicolons."""
    each = F.transform(lines(t), lambda x: collapse_ws(F.regexp_replace(F.regexp_replace(F.trim(x), rf"^\s*{STRICT_ITEM}\s*", ""), r"[;,.]+\s*$", "")))
    parts = F.flatten(F.transform(each, lambda x: F.transform(F.split(x, ";"), collapse_ws)))
    return F.filter(parts, lambda p: p.contains(" "))


def parse_verdicts(t: Column, n: Column) -> Column:
    """map<0-based index, is a translation>; the last verdict of an index counts."""
    shape = rf"^\s*(\d+)\s*{_chars(VERDICT_ENDS)}\s*(?i:(yes|no))\b"

    def read(line: Column, i: Column) -> Column:
        yes = F.lower(F.regexp_extract(line, shape, 2)) == "yes"
        return F.struct(F.regexp_extract(line, shape, 1).try_cast("int").alias("k"), i.alias("i"), yes.alias("yes"))

    found = F.filter(F.transform(lines(t), read), lambda v: v["k"].between(1, n))
    keys = F.array_distinct(F.transform(found, lambda v: v["k"]))
    last = F.transform(keys, lambda k: F.array_max(F.transform(F.filter(found, lambda v: v["k"] == k), lambda v: F.struct(v["i"], v["yes"])))["yes"])
    return F.map_from_arrays(F.transform(keys, lambda k: k - 1), last)


def strip_thinking(t: Column) -> Column:
    """Reasoning blocks, all before the last final channel, an open think token, control tokens. Taking a block
    out may complete another, so blocks are taken out once for every closing tag there is."""

    def pass_(s: Column) -> Column:
        for tag in THINK:
            s = F.regexp_replace(s, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", "")
        return s

    closing = F.size(F.split(t, "</")) - 1
    s = F.aggregate(F.sequence(F.lit(1), F.greatest(closing, F.lit(1))), t, lambda acc, _: F.when(acc.contains("</"), pass_(acc)).otherwise(acc))
    parts = F.split(s, rf"(?i){_token('channel')}\s*{_words(FINAL_CHANNELS)}\b")
    s = F.when(F.size(parts) > 1, F.regexp_replace(F.element_at(parts, -1), rf"(?i)^{_token('message')}", "")).otherwise(s)
    s = F.regexp_replace(s, rf"(?i)^\s*{_token('/?' + THINK[0])}\s*", "")
    return F.regexp_replace(F.regexp_replace(s, rf"(?i)<\|[^>]*\|>|{_words(CONTROL)}", ""), r"(?U)^\s+|\s+$", "")


def label_leak(t: Column) -> Column:
    """A text that begins with the name of a language as a label."""
    return t.rlike(rf"(?i)^\s*\**\s*{_words(LABELS[:3])}\s*\**\s*[:-]")


def id_parts(utt_id: Column) -> Column:
    return F.split(utt_id, "_")


def recording_id(utt_id: Column, strict: bool = True) -> Column:
    """The last part but one of <speaker>_<recording>_<index>; other ids are errors, or null if not strict."""
    p = id_parts(utt_id)
    ok = (F.size(p) >= 3) & F.get(p, F.size(p) - 1).rlike(r"^\d+$")
    bad = F.raise_error(F.concat(F.lit("no recording in id "), utt_id)) if strict else F.lit(None).cast("string")
    return F.when(ok, F.get(p, F.size(p) - 2)).otherwise(bad)


def segment_index(utt_id: Column) -> Column:
    p = id_parts(utt_id)
    return F.get(p, F.size(p) - 1).try_cast("int")


def content_id(t: Column) -> Column:
    return F.substring(F.sha1(F.encode(t, "UTF-8")), 1, 16)


def stable_bucket(key: Column, n: int = 2) -> Column:
    """First byte of the SHA-1 modulo n: the same for every run and machine."""
    return (F.conv(F.substring(F.sha1(F.encode(key, "UTF-8")), 1, 2), 16, 10).cast("int") % n).cast("int")


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts as a JSON array of strings."""
    return F.sha2(F.to_json(F.array(*parts)), 256)


def quoted(c: Column) -> Column:
    """A text as a JSON string (control characters as \\u00XX in capitals)."""
    one = F.to_json(F.array(F.coalesce(c, F.lit(""))))
    return F.substring(one, F.lit(2), F.length(one) - 2)


def request_key(model: str, messages: Column, params: dict | None = None, sample: Column | int = 0) -> Column:
    """SHA-256 of a request as JSON with sorted keys and ", " and ": " between: model, messages
    (array<struct<role, content>>), params and sample, so that equal requests have equal keys."""
    each = F.array_join(F.transform(messages, lambda m: F.concat(F.lit('{"content": '), quoted(m["content"]), F.lit(', "role": '), quoted(m["role"]), F.lit("}"))), ", ")
    rest = f'"model": {json.dumps(model, ensure_ascii=False)}, "params": {json.dumps(params or {}, sort_keys=True, ensure_ascii=False)}, "sample": '
    number = sample if isinstance(sample, Column) else F.lit(sample)
    return F.sha2(F.concat(F.lit('{"messages": ['), each, F.lit("], " + rest), number.cast("string"), F.lit("}")), 256)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def voice_description(name: Column, template: str = "{name} reads aloud, evenly and clearly, close to the microphone.") -> Column:
    """The template with the voice's name put in; a synthesiser's own wording is passed in."""
    before, _, after = template.partition("{name}")
    return F.concat(F.lit(before), name, F.lit(after))


def reasoning_leak(t: Column) -> Column:
    return t.contains("<think") | t.contains("<|channel") | t.contains("<|message")
