"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sandhi.functions.scripts import DEVANAGARI, LATIN, NEITHER

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- pieces of SQL -------------------------------------------------------------------------------------
WS = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_FULL = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_HALF = "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")


def collapse(t: str) -> str:
    return f"trim(regexp_replace({t}, '{WS}', ' ', 'g'))"


def folded(t: str) -> str:
    """NFKC of the characters these tables hold: canonical composition and full-width forms."""
    return f"nfc_normalize(translate({t}, '{_FULL}', '{_HALF}'))"


def stripped(t: str, cats: str) -> str:
    inside = "".join(rf"\p{{{c}}}" for c in cats)
    return collapse(f"regexp_replace({folded(t)}, '[{inside}]', ' ', 'g')")


def scoring(t: str) -> str:
    return f"lower({stripped(t, 'PS')})"


def lang(w: str) -> str:
    return f"CASE WHEN regexp_matches({w}, '[{DEVANAGARI}]') AND regexp_matches({w}, '[{LATIN}]') THEN 'mixed' WHEN regexp_matches({w}, '[{DEVANAGARI}]') THEN 'hi' WHEN regexp_matches({w}, '[{LATIN}]') THEN 'en' WHEN {w} IS NOT NULL THEN 'other' END"


def split_bounds(t: str) -> str:
    one = rf"regexp_replace({t}, '([{LATIN}]{NEITHER})([{DEVANAGARI}])', '\1 \2', 'g')"
    return rf"regexp_replace({one}, '([{DEVANAGARI}]{NEITHER})([{LATIN}])', '\1 \2', 'g')"


def words(t: str) -> str:
    return f"CASE WHEN {t} = '' THEN []::VARCHAR[] ELSE string_split({t}, ' ') END"


def tokens(t: str) -> str:
    return words(split_bounds(t))


UTT = "utt AS (SELECT DISTINCT utt_id, text, dur, wav, lang, speaker, sent_id, corpus, split FROM utterances)"
#: every delivery's tokens, and every utterance's
ROWS = f"norm AS (SELECT utt_id, corpus, split, {scoring('text')} AS t FROM utterances), tok AS (SELECT utt_id, corpus, split, t, {tokens('t')} AS ws FROM norm)"
ONCE = f"{UTT}, norm AS (SELECT *, {scoring('text')} AS t FROM utt), tok AS (SELECT *, {tokens('t')} AS ws FROM norm)"
TAGGED = f"tagged AS (SELECT *, list_transform(ws, lambda w: {lang('w')}) AS ls FROM tok)"
PAIRS = """pair AS (SELECT *, unnest(range(1, len(ws))) AS p FROM tagged),
cs AS (SELECT utt_id, corpus, split, p, ws[p] AS first, ws[p + 1] AS second, CASE WHEN ls[p] = 'hi' AND ls[p + 1] = 'en' THEN 'HE' WHEN ls[p] = 'en' AND ls[p + 1] = 'hi' THEN 'EH' END AS kind FROM pair
  WHERE (ls[p] = 'hi' AND ls[p + 1] = 'en') OR (ls[p] = 'en' AND ls[p + 1] = 'hi'))"""
HYP = "hyp AS (SELECT *, list_transform(list_filter(range(1, len(ws) + 1), lambda i: i % 11 <> 0), lambda i: CASE WHEN i % 7 = 0 THEN 'x' ELSE ws[i] END) AS hw FROM tok)"
