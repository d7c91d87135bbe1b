"""Script classes of tokens, boundary splitting, adjacent pairs and runs, as Column expressions.

hi: Devanagari letters and marks only (danda and digits are neither script), en: Latin letters,
mixed: both, other: neither. Nulls give nulls.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points of Devanagari letters and marks, and of letters whose names begin with LATIN.
DEVANAGARI = r"\x{0900}-\x{0963}\x{0971}-\x{097F}\x{1CD0}-\x{1CD2}\x{1CD4}-\x{1CFA}\x{A8E0}-\x{A8F7}\x{A8FB}\x{A8FD}-\x{A8FF}"
LATIN = (
    r"\x{0041}-\x{005A}\x{0061}-\x{007A}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02AF}\x{1D00}-\x{1D25}\x{1D62}-\x{1D65}"
    r"\x{1D6B}-\x{1D77}\x{1D79}-\x{1D9A}\x{1E00}-\x{1EFF}\x{2090}-\x{209C}\x{2184}\x{2C60}-\x{2C7C}\x{2C7E}-\x{2C7F}\x{A722}-\x{A76F}"
    r"\x{A771}-\x{A787}\x{A78B}-\x{A7CA}\x{A7D0}-\x{A7D1}\x{A7D3}\x{A7D5}-\x{A7D9}\x{A7F5}-\x{A7F7}\x{A7FA}-\x{A7FF}\x{AB30}-\x{AB5A}"
    r"\x{AB60}-\x{AB64}\x{AB66}-\x{AB68}\x{FB00}-\x{FB06}\x{1DF00}-\x{1DF1E}\x{1DF25}-\x{1DF2A}"
)
NEITHER = rf"[^{DEVANAGARI}{LATIN}\s]*"


def word_lang(w: Column) -> Column:
    d, e = w.rlike(f"[{DEVANAGARI}]"), w.rlike(f"[{LATIN}]")
    return F.when(d, F.when(e, "mixed").otherwise("hi")).when(e, "en").when(w.isNotNull(), "other")


def split_boundaries(t: Column) -> Column:
    """A blank wherever Devanagari meets Latin; characters of neither stay with the run before them."""
    t = F.regexp_replace(t, rf"([{LATIN}]{NEITHER})([{DEVANAGARI}])", "$1 $2")
    return F.regexp_replace(t, rf"([{DEVANAGARI}]{NEITHER})([{LATIN}])", "$1 $2")


def words(t: Column) -> Column:
    """Tokens of a text with single blanks, without splitting; an empty text has none."""
    return F.array_remove(F.split(t, " "), "")


def tokenize(t: Column) -> Column:
    """Tokens of a normalized text, mixed ones split at script boundaries."""
    return words(split_boundaries(t))


def tag(ws: Column) -> Column:
    """array<struct<word, lang>>."""
    return F.transform(ws, lambda w: F.struct(w.alias("word"), word_lang(w).alias("lang")))


def all_bigrams(ws: Column) -> Column:
    """array<struct<first, second>> of adjacent elements."""
    return F.slice(F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))), lambda a, b: F.struct(a.alias("first"), b.alias("second"))), 1, F.greatest(F.size(ws) - 1, F.lit(0)))


def cs_bigrams(ws: Column) -> Column:
    """array<struct<first, second, kind>>: adjacent hi-en (HE) and en-hi (EH) pairs."""
    pairs = F.transform(
        all_bigrams(tag(ws)),
        lambda p: F.struct(
            p["first"]["word"].alias("first"),
            p["second"]["word"].alias("second"),
            F.when((p["first"]["lang"] == "hi") & (p["second"]["lang"] == "en"), "HE").when((p["first"]["lang"] == "en") & (p["second"]["lang"] == "hi"), "EH").alias("kind"),
        ),
    )
    return F.filter(pairs, lambda p: p["kind"].isNotNull())


def count_lang(ws: Column, lang: str) -> Column:
    return F.size(F.filter(ws, lambda w: word_lang(w) == lang))


def matrix_lang(ws: Column) -> Column:
    """The language of most words; ties are Hindi."""
    return F.when(count_lang(ws, "hi") >= count_lang(ws, "en"), "hi").otherwise("en")


def hybrid_units(ws: Column) -> Column:
    """Scoring units: code points of Devanagari words, other words whole."""
    return F.flatten(F.transform(ws, lambda w: F.when(word_lang(w) == "hi", F.split(w, "")).otherwise(F.array(w))))


def runs(ws: Column) -> Column:
    """array<struct<lang, n>>: same-language runs; other and mixed words are skipped and break none."""
    letters = F.array_join(F.transform(ws, lambda w: F.when(w.rlike(f"[{DEVANAGARI}]"), F.when(~w.rlike(f"[{LATIN}]"), "h").otherwise("")).when(w.rlike(f"[{LATIN}]"), "e").otherwise("")), "")
    parts = F.split(F.regexp_replace(letters, "(?<=h)(?=e)|(?<=e)(?=h)", " "), " ")
    return F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.struct(F.when(p.startswith("h"), "hi").otherwise("en").alias("lang"), F.length(p).alias("n")))
