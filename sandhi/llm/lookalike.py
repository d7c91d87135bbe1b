"""Visually identical text with different characters (problem 5).

The vocabulary of plainly written tokens is held in tries; tokens with any other character traverse them
with a weighted edit automaton: look-alikes, full-width forms, combining sequences and ignorable characters
cost nothing, the second Latin letter that some characters look like (I and l) costs a little. A token
found gets the vocabulary's spelling, the most frequent one at the least cost; a token not found is spelled
by the character table, in the script of its letters that look like no Latin ones if it has such. Tries
hold the tokens that begin alike once folded; beginnings that too many tokens share are lengthened, so a
match is always in the group, and no task holds the whole vocabulary or a hot beginning.

A null text has no canonical form; empty and blank ones are equal to each other; repeated deliveries
count once; ties between spellings go to the smaller string; empty tables give no rows. Only the named
columns are read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sandhi.runtime import materialize

# Letters of other scripts that look like Latin ones (lower, then upper case).
CYRILLIC = dict(zip("аеорсухѕіјһԁԛԝѵӏАВЕЅІЈКМНОРСТУХҺԀԚԜѴӀ", "aeopcyxsijhdqwvlABESIJKMHOPCTYXhdQWVI"))
GREEK = dict(zip("αινορυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aivopuABEZHIKMNOPTYX"))
ARMENIAN = dict(zip("օսհոցՕՍ", "ouhngOU"))
# Characters that show nothing.
IGNORABLE = "\xad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\u2064\ufeff"
SPACES = "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

CHEROKEE = dict(zip("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZbRWVSLCPKB"))
LISU = dict(zip("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"))
OTHER = {"\u0261": "g"}


def compatible() -> dict[str, str]:
    """Characters that differ from their compatibility decomposition in width or font only, ligatures of Latin
    letters and Roman numerals."""
    out = {}
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        tag = unicodedata.decomposition(c).partition(" ")[0]
        if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and unicodedata.name(c).startswith(("LATIN SMALL LIGATURE", "ROMAN NUMERAL", "SMALL ROMAN NUMERAL")):
            out[c] = unicodedata.normalize("NFKC", c)
    return out


FOLD: dict[str, str] = {
    **compatible(), **CHEROKEE, **LISU, **OTHER, **CYRILLIC, **GREEK, **ARMENIAN,
    **dict.fromkeys(IGNORABLE, ""), **dict.fromkeys(map(chr, range(0xFE00, 0xFE10)), ""), **dict.fromkeys(map(chr, range(0x202A, 0x202F)), ""), **dict.fromkeys(map(chr, range(0x2066, 0x206A)), ""),
    **dict.fromkeys(SPACES, " "),
}
FOLD["Һ"] = "h"
#: characters of other scripts and fonts that look like I look like l, and the other way round
BOTH = {"I": "l", "l": "I"}
SECOND = {c: BOTH[x] for c, x in FOLD.items() if x in BOTH and not unicodedata.decomposition(c).startswith("<wide>")}
#: Latin letters as letters of a script in which words may be written
UNFOLD = {s: {x: c for c, x in reversed(t.items())} for s, t in (("CYRILLIC", CYRILLIC), ("GREEK", GREEK), ("ARMENIAN", ARMENIAN))}

#: Characters that fold to themselves and stand alone: ASCII without controls, Devanagari without composed letters.
PLAIN = " -~\u0900-\u0928\u092a-\u0930\u0932\u0933\u0935-\u0950\u0955-\u0957\u0960-\u097f"
ODD = rf"[^{PLAIN}\u0001]|\u094d\u093c"
SEP = "\u0001"
WIDTHS = (3, 6, 12, 1 << 20)  # characters by which tokens are grouped; the next one where a group is too large
GROUP = 20_000  # tokens of the vocabulary in a trie


def fold(token: str) -> str:
    """What the table makes of a token: decomposed, look-alikes and full-width forms replaced, ignorables gone."""
    return unicodedata.normalize("NFD", "".join(FOLD.get(c, c) for c in unicodedata.normalize("NFD", token)))


def merged(folded: str) -> str:
    """Equal for all tokens that may look like each other, second letters included."""
    return folded.replace("I", "l")


def spell(token: str) -> str:
    """The spelling of a token that no vocabulary has: folded; if letters of another script remain, those that
    look like Latin ones are taken as that script's, too."""
    folded = fold(token)
    for script, back in UNFOLD.items():
        if any(unicodedata.name(c, "").startswith(script) for c in folded):
            folded = "".join(back.get(c, c) for c in folded)
    return unicodedata.normalize("NFC", folded)


class Trie:
    """Decomposed vocabulary tokens with their spelling and count at the end."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, token: str, count: int) -> None:
        node = self.root
        for c in unicodedata.normalize("NFD", token):
            node = node.setdefault(c, {})
        end = node.get("")
        if end is None or (-count, token) < (-end[1], end[0]):
            node[""] = (token, count)

    def find(self, token: str) -> str | None:
        """The spelling reached at the least cost: equal characters, look-alikes and ignorables cost 0, second
        letters 1; there are no other edits."""
        chars = unicodedata.normalize("NFD", token)
        best: tuple | None = None
        seen: dict[tuple[int, int], int] = {}
        stack = [(self.root, 0, 0)]
        while stack:
            node, i, cost = stack.pop()
            at = (id(node), i)
            if seen.get(at, cost + 1) <= cost:
                continue
            seen[at] = cost
            if i == len(chars):
                if (end := node.get("")) and (best is None or (cost, -end[1], end[0]) < best):
                    best = (cost, -end[1], end[0])
                continue
            c = chars[i]
            for look, more in {c: 0, FOLD.get(c, c): 0, SECOND.get(c, c): int(c in SECOND)}.items():
                below = node
                for x in unicodedata.normalize("NFD", look):
                    below = below.get(x) if below else None
                if below is not None:
                    stack.append((below, i + 1, cost + more))
        return best[2] if best else None


def grouped(vocabulary: DataFrame, odd: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Adds prefix to both, by their column m (merged): the first characters of m, more of them where a prefix
    would have more than GROUP tokens of the vocabulary."""
    v, o = (t.withColumn("prefix", F.substring("m", 1, WIDTHS[0])) for t in (vocabulary, odd))
    for width in WIDTHS[1:]:
        big = materialize(v.groupBy("prefix").agg(F.count("*").alias("many")).where(F.col("many") > GROUP), "prefixes")
        if big.isEmpty():
            break
        longer = F.when(F.col("many").isNotNull(), F.substring("m", 1, width)).otherwise(F.col("prefix"))
        v, o = (t.join(big, "prefix", "left").withColumn("prefix", longer).drop("many") for t in (v, o))
    return v, o


def spellings(vocabulary: DataFrame, odd: DataFrame) -> DataFrame:
    """vocabulary(token, n) and odd(token) to (token, canon) for every odd token."""

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([merged(fold(t)) for t in b.column(0).to_pylist()], pa.string())], ["token", "m"])

    o = materialize(odd.distinct().mapInArrow(begin, "token string, m string"), "odd")
    # plain tokens fold to themselves
    v, o = grouped(vocabulary.withColumn("m", F.translate("token", "I", "l")), o)
    v = v.join(o.select("prefix").distinct(), "prefix", "left_semi")
    both = v.select("prefix", F.lit(0).alias("odd"), "token", "n").unionByName(o.select("prefix", F.lit(1).alias("odd"), "token", F.lit(0).cast("long").alias("n")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, trie = None, Trie()
        for b in batches:
            tokens, canon = [], []
            for prefix, is_odd, token, n in zip(*(b.column(k).to_pylist() for k in range(4))):
                if prefix != group:
                    group, trie = prefix, Trie()
                if is_odd:
                    got = trie.find(token)
                    tokens.append(token)
                    canon.append(spell(token) if got is None else unicodedata.normalize("NFC", got))
                else:
                    trie.add(token, n)
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(canon, pa.string())], ["token", "canon"])

    return both.repartition("prefix").sortWithinPartitions("prefix", "odd").mapInArrow(walk, "token string, canon string")


def blanks(c: Column) -> Column:
    """Runs of the ordinary blank as one, outer ones gone."""
    return F.trim(F.regexp_replace(c, " +", " "))


def canonical(records: DataFrame, sep: str = " ") -> tuple[DataFrame, DataFrame]:
    """records(key, raw), raw being tokens joined by sep, to (odd, plain), both (key, raw, canon)."""
    once = records.where("raw is not null").distinct()
    split = materialize(once.withColumn("odd", F.col("raw").rlike(ODD)), "texts")
    odd, plain = split.where("odd").drop("odd"), split.where("not odd").drop("odd")
    spaced = F.translate("raw", SPACES, " " * len(SPACES)) if sep == " " else F.col("raw")
    cut = materialize(odd.select("raw").distinct().select("raw", F.posexplode_outer(F.split(blanks(spaced) if sep == " " else spaced, sep)).alias("pos", "token")), "tokens")
    strange = cut.where(F.col("token").rlike(ODD)).select("token")
    vocabulary = materialize(plain.select(F.explode_outer(F.split("raw", sep)).alias("token")).groupBy("token").agg(F.count("*").alias("n")), "vocabulary")
    spelled = cut.join(spellings(vocabulary, strange), "token", "left").select("raw", "pos", F.coalesce("canon", "token").alias("canon"))
    # a token of nothing but ignorables leaves no blank behind
    text = spelled.groupBy("raw").agg(F.array_sort(F.collect_list(F.struct("pos", "canon"))).alias("t")).select("raw", F.array_join("t.canon", sep).alias("canon"))
    if sep == " ":
        text = text.withColumn("canon", blanks(F.col("canon")))
    return odd.join(text, "raw"), plain.withColumn("canon", F.col("raw"))


def alike(odd: DataFrame, plain: DataFrame) -> DataFrame:
    """Pairs of keys whose canonical forms are equal and whose raw forms are not."""
    o = materialize(odd.select("key", F.xxhash64("raw").alias("raw"), F.unhex(F.md5("canon")).alias("canon")), "odd")
    p = plain.select("key", F.xxhash64("raw").alias("raw"), F.unhex(F.md5("canon")).alias("canon"))
    x = o.select("canon", F.col("key").alias("x"), F.col("raw").alias("rx"))
    y = o.unionByName(p).select("canon", F.col("key").alias("y"), F.col("raw").alias("ry"))
    pairs = x.join(y, "canon").where("rx != ry")
    return pairs.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def utterance_records(utterances: DataFrame) -> DataFrame:
    return utterances.select(F.col("utt_id").alias("key"), blanks(F.col("text")).alias("raw"))


def switch_records(switches: DataFrame) -> DataFrame:
    return switches.where("first is not null and second is not null").select(F.col("bigram_id").alias("key"), F.concat("first", F.lit(SEP), "second").alias("raw"))


def found(utterances: DataFrame, switches: DataFrame) -> DataFrame:
    """p5_found."""
    t = alike(*canonical(utterance_records(utterances)))
    b = alike(*canonical(switch_records(switches), SEP))
    return t.select(F.lit("text").alias("field"), "*").unionByName(b.select(F.lit("bigram").alias("field"), "*"))


def spelled(utterances: DataFrame, switches: DataFrame) -> DataFrame:
    """(field, key, raw, canon): one consistent spelling of every text and switch point."""
    out = []
    for field, (odd, plain) in (("text", canonical(utterance_records(utterances))), ("bigram", canonical(switch_records(switches), SEP))):
        out.append(odd.unionByName(plain).select(F.lit(field).alias("field"), "key", F.translate("raw", SEP, " ").alias("raw"), F.translate("canon", SEP, " ").alias("canon")))
    return out[0].unionByName(out[1])
