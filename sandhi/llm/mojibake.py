"""Garbled text from wrong character encoding (problem 9): noisy-channel decoding.

A wrongly read stretch is turned back into the bytes it came from, once for each encoding it may have been
read in; a character that stands for a lost byte becomes a wildcard. The bytes form a lattice: each unit is
a UTF-8 sequence, or all sequences that a wildcard leaves open. A stretch counts as garbled where its units
decode to characters that belong in these texts, and where the decoded text, under the pairs of characters
of the corpus, is not far less likely than the text as read (``Model.speaks_for``). The encoding that
explains most units is undone, again and again until nothing changes, so text read wrongly several times
comes back too.

Lost bytes are restored word by word. A word with open places is a pattern; the distinct patterns are joined
with the exact counts of all words of the corpus by length and known characters, and every word that fits is
ranked by its count and its pairs of characters. Where no word fits, a Viterbi search under the pairs
chooses. What is sent to the tasks is the table of pairs, which has a fixed size.

Damage that leaves plain ASCII (entities, quoted-printable, rows of question marks) is another kind of loss
and not looked for: a text needs at least one character beyond ASCII and Devanagari.

Null and empty texts are clean; equal documents are each reported; equally likely restorations go to the
first in code point order; lost bytes with no known word are the likeliest by character pairs (in Latin
words left as they are) and the row marked incomplete, as is one that still looks garbled; an empty table
gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import json
import math
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sandhi.llm.common import term_array
from sandhi.runtime import materialize

LOST = "�"
HOLE = "\U0010ffff"  # a place left open; no character of any text
SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp866", "koi8_r", "cp1250")
#: encodings whose high half is mostly letters of one other script, so clean words of it look like units of two
#: bytes; they are tried for Devanagari only
LETTERED = ("iso8859_5", "iso8859_7", "cp1253")
WIDE = "gb18030"
#: two-byte text turns UTF-8 into ideographs, kana, private characters, and now and then signs and letters
WIDE_RUN = re.compile("[^\\x00-\\x7f\\u0900-\\u097f]+")
IDEOGRAPH = re.compile("[\\u2e80-\\u9fff\\ue000-\\uf8ff\\ufe30-\\ufe4f\\uff00-\\uffef]")
ODD_TEXT = "[^\\x00-\\x7f\\u0900-\\u097f]"
#: log odds that a well-formed sequence of bytes gives for garbling, by kind of encoding
FORMED, FORMED_LETTERED = 12.0, -2.0
KEYED = 3  # known characters of a pattern by which it is joined with words

HIGH = "".join(bytes([b]).decode("cp1252", "ignore") for b in range(0x80, 0x100))
PLAUSIBLE = {chr(c) for c in range(0x900, 0x980)} | {chr(c) for c in range(0x80, 0x100)} | set(HIGH) | {"‌", "‍", "₹", "‐", "‑", "‒", "―", "′", "″", "﻿"}
LETTERS = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]


def _bytes_of(codec: str) -> dict[str, int]:
    out = {chr(b): b for b in range(0x80, 0xA0)}  # undefined bytes often pass as controls
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    return out


def _spans(ok: Callable[[str], bool]) -> list[tuple[int, int]]:
    """Ranges of code points for which ok holds."""
    out: list[tuple[int, int]] = []
    for c in range(sys.maxunicode + 1):
        if ok(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1] = (out[-1][0], c)
            else:
                out.append((c, c))
    return out


def _class(chars: list[str]) -> str:
    return "".join(re.escape(c) for c in chars)


class Channel:
    """One single-byte encoding: the stretches that UTF-8 read in it leaves, and their bytes."""

    def __init__(self, codec: str, odds: float = FORMED) -> None:
        self.codec, self.of, self.odds = codec, _bytes_of(codec), odds
        pick = lambda lo, hi: _class([c for c, b in self.of.items() if lo <= b <= hi])
        k, two, three, four = pick(0x80, 0xBF), pick(0xC2, 0xDF), pick(0xE0, 0xEF), pick(0xF0, 0xF4)
        w = LOST + "?"
        self.find = re.compile(f"(?:[{three}][{k}{w}][{k}{w}]|[{two}][{k}]|[{four}][{k}][{k}][{k}]|[{w}][{k}{w}][{k}{w}])+")
        # the second byte of ठ and of a few others reads as a no-break space, which may have become a blank
        self.unit = re.compile(f"[{three}][{k}{w}][{k}{w}]|[{two}][{k}]|[{four}][{k}][{k}][{k}]|[{w}][{k}{w}][{k}{w}]")
        self.left = re.compile(f"[{_class([c for c, b in self.of.items() if b == 0xE0])}{w}][{k}{w}][{k}{w}]")

    def others(self, run: str) -> list[str]:
        return [foreign([self.of.get(c) for c in m.group()]) for m in self.unit.finditer(run)]

    def units(self, run: str) -> list[tuple[str, list[str]]]:
        """(as read, what it may mean); an empty list of meanings where it is no unit after all."""
        out = []
        for m in self.unit.finditer(run):
            out.append((m.group(), meanings([self.of.get(c) for c in m.group()])))
        return out


def meanings(data: list[int | None]) -> list[str]:
    """Characters that a UTF-8 sequence with unknown bytes may be; unknown leads and second bytes are taken
    as Devanagari. Where nearly all is unknown, the units beside it decide (trusted)."""
    if None not in data:
        try:
            c = bytes(data).decode("utf-8")
        except UnicodeDecodeError:
            return []
        return [c] if c in PLAUSIBLE else []
    if len(data) != 3 or data[0] not in (None, 0xE0) or data[1] not in (None, 0xA4, 0xA5):
        return []
    seconds = (0xA4, 0xA5) if data[1] is None else (data[1],)
    thirds = range(0x80, 0xC0) if data[2] is None else (data[2],)
    return [c for s in seconds for t in thirds for c in meanings([0xE0, s, t]) if "ऀ" <= c < "ঀ"]


CHANNELS = [Channel(c) for c in SINGLE] + [Channel(c, FORMED_LETTERED) for c in LETTERED]


#: what may follow a letter in clean text
CLOSING = set("‚„…‹›‘’“”–—«»\u00a0")


def _shaky(read: str, means: str, after: str) -> bool:
    """Capital A with tilde before a quotation mark, dash or ellipsis may well be meant: no letter follows."""
    return read[0] == "Ã" and read[1] in CLOSING and "À" <= means <= "ß" and not after.isalpha() and after not in PLAUSIBLE - {" "}


#: signs that stand before or after letters of clean text
SIGNS = CLOSING | set("®™©°²³¹ªº·•¿¡†‡")


def _script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def foreign(data: list[int | None]) -> str:
    """The letter, mark or symbol of a well-formed sequence that is none of the plausible characters."""
    try:
        c = bytes(data).decode("utf-8") if None not in data else ""
    except UnicodeDecodeError:
        return ""
    return c if c and c not in PLAUSIBLE and unicodedata.category(c)[0] in "LMS" else ""


def spoken_for(units: list[tuple[str, list[str]]], others: list[str], before: str, after: str) -> list[tuple[str, list[str]]]:
    """The units of a run with those of other scripts and of symbols that can hardly be clean text as read. The
    characters as read are weighed: letters of one script may be a word, signs may follow a letter."""
    sure = any(means and ("ऀ" <= means[0] < "ঀ") for _, means in units)
    run, out = "".join(read for read, _ in units), []
    for i, (read, means) in enumerate(units):
        c = others[i]
        if c and not means:
            prev, nxt = (units[i - 1][0][-1:], units[i + 1][0][:1]) if 0 < i < len(units) - 1 else (units[i - 1][0][-1:] if i else before, units[i + 1][0][:1] if i + 1 < len(units) else after)
            signs = all(x in SIGNS for x in read[1:])
            beside = any(others[k] and _script(others[k]) == _script(c) for k in (i - 1, i + 1) if 0 <= k < len(units))
            part = run if beside else read
            word = part.isalpha() and len({_script(x) for x in part}) == 1
            letter = read[0].isalpha()
            if sure or 0x1F000 <= ord(c) < 0x1FB00:
                means = [c]
            elif word:
                pass
            elif beside and (letter or len(read) > 2) or len(read) > 2 and not signs and not any(x in CLOSING for x in read[:1]):
                means = [c]
            elif letter and len(read) == 2 and _script(c) in ("LATIN", "GREEK", "CYRILLIC") and ord(c) < 0x250 + 0x2E0:
                inside = nxt.isalpha() and read[1] not in CLOSING - {"‚", "„"}
                if prev.islower() and read[0].isupper() or inside or not prev.isalpha() and not nxt.isalpha() and _script(c) != "LATIN" and read[1] not in CLOSING:
                    means = [c]
        out.append((read, means))
    return out


def _alone(ch: Channel, text: str, start: int, end: int) -> bool:
    """No other unit of the word, from blank to blank, speaks for the channel."""
    lo, hi = start, end
    while lo and not text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and not text[hi].isspace():
        hi += 1
    for part, base in ((text[lo:start], lo), (text[end:hi], end)):
        for m in ch.find.finditer(part):
            at = base + m.start()
            for read, means in trusted(ch.units(m.group())):
                at += len(read)
                if means and not (len(means) == 1 and _shaky(read, means[0], text[at : at + 1])):
                    return False
    return True


def trusted(units: list[tuple[str, list[str]]]) -> list[tuple[str, list[str]]]:
    """The units of a run without the meanings of those that may be question marks as they stand: a unit needs
    its lead and one more byte, or U+FFFD, or else a unit beside it that has them; without lead and second byte,
    the next unit must show that the word goes on."""
    marks = [read.count("?") for read, _ in units]
    whole = [bool(means) and read[0] != "?" and marks[i] < 2 and (read[0] != LOST or "?" not in read) and read.count(LOST) < 3 for i, (read, means) in enumerate(units)]
    if not any(whole):
        return [(read, []) for read, _ in units]
    out: list[tuple[str, list[str]]] = []
    for i in range(len(units) - 1, -1, -1):
        read, means = units[i]
        bare = marks[i] > 0 and read[0] in "?" + LOST and read[1] in "?" + LOST
        out.append((read, means if not bare or out and out[-1][1] else []))
    return out[::-1]


def single(ch: Channel, text: str) -> tuple[int, list[tuple[int, int, list[list[str]]]]]:
    """Units explained by a channel, and the stretches: start, end, meanings of each unit."""
    n, out = 0, []
    for m in ch.find.finditer(text):
        at, seq, begin = m.start(), [], m.start()
        units = trusted(ch.units(m.group()))
        if not all(means for _, means in units) and any(others := ch.others(m.group())):
            units = spoken_for(units, others, text[max(0, at - 1) : at], text[m.end() : m.end() + 1])
        for read, means in units:
            end = at + len(read)
            if means and not (len(means) == 1 and _shaky(read, means[0], text[end : end + 1]) and _alone(ch, text, at, end)):
                if not seq:
                    begin = at
                seq.append(means)
            elif seq:
                out.append((begin, at, seq))
                n, seq = n + len(seq), []
            at = end
        if seq:
            out.append((begin, at, seq))
            n += len(seq)
    # letters of one other script in ordinary words of it, and nothing else in the whole text to speak for the channel
    if out and all(_ordinary(text, begin, end) for begin, end, _ in out):
        return 0, []
    return n, out


def _ordinary(text: str, begin: int, end: int) -> bool:
    """The stretch lies in a word of letters of one script other than Latin, in usual capitals."""
    if not text[begin:end].isalpha():
        return False
    while begin and text[begin - 1].isalpha():
        begin -= 1
    while end < len(text) and text[end].isalpha():
        end += 1
    word = text[begin:end]
    return (word.islower() or word.isupper() or word.istitle()) and {_script(c) for c in word} in ({"CYRILLIC"}, {"GREEK"})


def _kept(run: str, start: int, seq: list[list[str]], size: int) -> tuple[int, list[list[str]]]:
    """Where a run of two-byte text decodes up to byte ``size`` only: the end of the characters whose bytes
    are whole units, and those units."""
    ends, at = {0: 0}, 0
    for k, c in enumerate(run):
        at += 1 if c == LOST else len(c.encode(WIDE, "ignore"))
        ends[at] = k + 1
    while seq and size not in ends:
        size -= 1 if seq[-1][0].isascii() else len(seq[-1][0].encode())
        seq = seq[:-1]
    return start + ends.get(size, 0), seq


def wide(text: str) -> tuple[int, list[tuple[int, int, list[list[str]]]]]:
    """The same for two-byte text."""
    n, out = 0, []
    for m in WIDE_RUN.finditer(text) if IDEOGRAPH.search(text) else ():
        if not IDEOGRAPH.search(m.group()):
            continue
        data: list[int | None] = []
        for c in m.group():
            if c == LOST:
                data.append(None)
            else:
                data.extend(c.encode(WIDE, "ignore"))
        seq, i, good = [], 0, 0
        while i < len(data):
            b = data[i]
            if b is not None and b < 0x80:  # swallowed by the byte before it
                seq.append([chr(b)])
                i += 1
                continue
            size = 3 if b is None or 0xE0 <= b < 0xF0 else 4 if b is not None and b >= 0xF0 else 2
            part = data[i : i + size]
            part += [None] * (3 - len(part)) if size == 3 and i + len(part) == len(data) and len(part) == 2 else []
            means = meanings(part) or [c for c in [foreign(part)] if c and (unicodedata.category(c) == "So" or size == 2)]
            if not means:
                break
            seq.append(means)
            good += 1
            i += size
        end, seq = (m.end(), seq) if i >= len(data) else _kept(m.group(), m.start(), seq, i)
        before = text[max(0, m.start() - 1) : m.start()]
        indic = any("ऀ" <= x[0] < "ঀ" for x in seq)
        if seq and (indic or end == m.end() and (len(m.group()) == 1 or chr(0x2000) <= seq[0][0] < chr(0x2070) and seq[-1][0].isascii()) and before.isascii() and before.isalpha()):
            out.append((m.start(), end, seq))
            n += len(seq)
    return n, out


#: a lead byte's character before a further byte's, in any of the encodings: what every stretch begins with
PAIR = re.compile("[" + _class(sorted({c for ch in CHANNELS for c, b in ch.of.items() if b >= 0xC2})) + "][" + _class(sorted({c for ch in CHANNELS for c, b in ch.of.items() if b < 0xC0})) + LOST + "?]")


def garbled(text: str, model: Model | None = None) -> bool:
    if LOST in text:
        return True
    if PAIR.search(text) and any(accepted(ch, text, model)[0] for ch in CHANNELS):
        return True
    return bool(IDEOGRAPH.search(text)) and bool(accepted(None, text, model)[0])


def accepted(ch: Channel | None, text: str, model: Model | None) -> tuple[int, list[tuple[int, int, list[list[str]]]]]:
    """The stretches of a channel (None: two-byte text) that the model does not speak against, and their units."""
    n, found_ = wide(text) if ch is None else single(ch, text)
    if model is None or not n:
        return (n, found_) if model is not None or ch is None or ch.odds > 0 else (0, [])
    odds = FORMED if ch is None else ch.odds
    kept = [x for x in found_ if model.speaks_for(text, *x) > -odds and (odds > 0 or any("ऀ" <= u[0] < "ঀ" for u in x[2]))]
    return sum(len(x[2]) for x in kept), kept


def classes_of(points: np.ndarray) -> np.ndarray:
    """Code points to SIZE classes: Latin, Devanagari and general punctuation by themselves, others folded."""
    c = points.astype(np.int64)
    return np.where(c < 0x250, c, np.where((c >= 0x900) & (c < 0x980), c - 0x900 + 0x250, np.where((c >= 0x2000) & (c < 0x2070), c - 0x2000 + 0x2D0, 0x340 + c % 192)))


SIZE = 1024


class Model:
    """Pairs of characters of the corpus: counts, SIZE x SIZE."""

    def __init__(self, pairs: np.ndarray) -> None:
        p = pairs.reshape(SIZE, SIZE).astype(np.float64)
        each = p.sum(axis=0) + 0.01
        each /= each.sum()
        # unseen pairs fall back on the second character's own share
        self.logp = np.log((p + 2 * each[None, :]) / (p.sum(axis=1, keepdims=True) + 2))
        self.place: dict[str, int] = {}

    def at(self, c: str) -> int:
        k = self.place.get(c)
        if k is None:
            k = self.place[c] = int(classes_of(np.array([ord(c)]))[0])
        return k

    def step(self, a: str, b: str) -> float:
        return float(self.logp[self.at(a or " "), self.at(b or " ")])

    def walk(self, text: str, before: str, after: str) -> float:
        k = [self.at(before or " "), *map(self.at, text), self.at(after or " ")]
        return float(self.logp[k[:-1], k[1:]].sum())

    def speaks_for(self, text: str, begin: int, end: int, seq: list[list[str]]) -> float:
        """Log likelihood of a stretch as decoded less that as read, between the characters beside it."""
        before, after = text[begin - 1 : begin] if begin else " ", text[end : end + 1]
        return self.walk(self.likeliest(seq, before), before, after) - self.walk(text[begin:end], before, after)

    def likeliest(self, seq: list[list[str]], left: str) -> str:
        """Viterbi: the reading likeliest by pairs of characters; one state for each last character."""
        states = {left[-1:]: (0.0, "")}
        for means in seq:
            grown: dict[str, tuple[float, str]] = {}
            for last, (score, done) in states.items():
                for c in means:
                    p = (score - self.step(last, c), done + c)
                    if c not in grown or p < grown[c]:
                        grown[c] = p
            states = grown
        return min(states.values())[1]


APART = re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in _spans(lambda c: c.isspace() or unicodedata.category(c)[0] in "PS")) + "]+")
STOPS = "।॥"


def unravel(text: str, model: Model | None = None) -> tuple[str, list[str], list[str], bool]:
    """(text decoded, with a HOLE for every place left open, what each hole may be, encodings undone in order,
    whether nothing undecoded is left)."""
    done, holes, codecs = text, [], []
    while True:  # every round makes the text shorter
        tries = [(*accepted(ch, done, model), ch.codec) for ch in CHANNELS]
        tries.append((*accepted(None, done, model), WIDE))
        n, stretches, codec = max(tries, key=lambda x: x[0])
        if not n:
            break
        codecs.append(codec)
        out, at, before, grown = [], 0, iter(holes), []
        for begin, end, seq in [*stretches, (len(done), len(done), [])]:
            out.append(done[at:begin])
            grown.extend(next(before) for c in out[-1] if c == HOLE)
            out.extend(x[0] if len(x) == 1 else HOLE for x in seq)
            grown.extend("".join(x) for x in seq if len(x) > 1)
            at = end
        done, holes = "".join(out), grown
    left = any(ch.codec in codecs and any(meanings([ch.of.get(c) for c in x.group()]) and x.group() != "???" for x in ch.left.finditer(done)) for ch in CHANNELS)
    if LOST in done:
        out, at, before, grown = [], 0, iter(holes), []
        for m in re.finditer(r"\S+", done):
            upper = m.group().lstrip(LOST)[:1].isupper()
            out.append(done[at : m.start()])
            for c in m.group():
                if c == HOLE:
                    grown.append(next(before))
                elif c == LOST:
                    grown.append(LOST + "".join(x for x in LETTERS if upper or x.islower()))
                out.append(HOLE if c == LOST else c)
            at = m.end()
        done, holes = "".join([*out, done[at:]]), grown
    return done, holes, codecs, not left


def open_words(done: str, holes: list[str]) -> list[tuple[int, list[tuple[list[str], str]]]]:
    """Of every word with holes: where it begins, and its patterns: what each place may be, and what follows.
    A hole at the end may be a full stop; the word is without it then."""
    out, before = [], iter(holes)
    for m in re.finditer(r"\S+", APART.sub(lambda x: " " * len(x.group()), done)):
        if HOLE not in m.group():
            continue
        sets = [next(before).replace(LOST, "") if c == HOLE else c for c in m.group()]
        ways = [(sets, "")]
        if len(sets) > 1 and m.group()[-1] == HOLE:
            ways += [(sets[:-1], stop) for stop in STOPS if stop in sets[-1]]
        out.append((m.start(), ways))
    return out


def pattern(sets: list[str]) -> tuple[str, int, str, str, str | None]:
    """(what each place may be, number of places, the first known ones, the characters there, the word if all
    are known), lower case."""
    low = [x.lower() for x in sets]
    known = [i for i, x in enumerate(low) if len(x) == 1]
    whole = "".join(low) if len(known) == len(low) else None
    return json.dumps(low, ensure_ascii=False), len(low), ",".join(map(str, known[:KEYED])), "".join(low[i] for i in known[:KEYED]), whole


def fits(p: str, word: str) -> bool:
    sets = json.loads(p)
    return len(word) == len(sets) and all(c in x for c, x in zip(word, sets))


def rank(model: Model, word: str, n: int) -> float:
    return 3 * math.log1p(n) + model.walk(word, " ", " ")


def fill(done: str, holes: list[str], known: dict[str, tuple[str, float]], model: Model) -> tuple[str, bool]:
    """(text without holes, whether all were filled by known words). known: pattern to its best word and rank."""
    out, at, ok, before = [], 0, True, iter(holes)
    for begin, ways in open_words(done, holes):
        size = len(ways[0][0])
        found_ = []
        for sets, stop in ways:
            if got := known.get(pattern(sets)[0]):
                found_.append((-got[1] - (model.step(got[0][-1], stop) if stop else 0.0), got[0] + stop))
        word = done[begin : begin + size]
        mine = [next(before) if c == HOLE else c for c in word]
        if found_:
            best = min(found_)[1]
            shout = word.replace(HOLE, "").isupper() and len(word.replace(HOLE, "")) > 1
            text = "".join(b if c == HOLE else c for b, c in zip(best, word))
            text = "".join(b.upper() if shout and c == HOLE and b.upper() in x else b for b, c, x in zip(text, word, mine))
        elif any(x[:1] == LOST for x in mine):
            text, ok = "".join(LOST if x[:1] == LOST else model.likeliest([list(x)], "") for x in mine), False
        else:
            text, ok = model.likeliest([list(x) for x in mine], done[max(0, begin - 1) : begin]), False
        out += [done[at:begin], text]
        at = begin + size
    return "".join([*out, done[at:]]), ok


def pair_counts(texts: DataFrame, col: str) -> np.ndarray:
    """SIZE x SIZE counts of adjacent characters of all texts, by class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE * SIZE, dtype=np.int64)
        for b in batches:
            c = classes_of(np.frombuffer(" ".join(x for x in b.column(0).to_pylist() if x).encode("utf-32-le", "replace"), dtype=np.uint32))
            if len(c) > 1:
                at, n = np.unique(c[:-1] * SIZE + c[1:], return_counts=True)
                total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["slot", "n"])

    got = texts.select(col).mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(SIZE * SIZE, dtype=np.int64)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def best_words(patterns: DataFrame, texts: DataFrame, text: str, model) -> DataFrame:
    """patterns(p, size, places, known, whole) to (p, word, score): of all words of all texts that fit, the best.
    model: a broadcast of the pair counts."""
    words = texts.select(F.explode_outer(term_array(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    words = materialize(words, "vocabulary")
    open_ = patterns.where("whole is null")
    kinds = open_.select("size", "places").distinct()
    at = F.split("places", ",")
    kinds = kinds.select("size", "places", *(F.get(at, k).try_cast("int").alias(f"k{k}") for k in range(KEYED)))
    known = F.concat(*(F.when(F.col(f"k{k}").isNull(), "").otherwise(F.substring("word", F.col(f"k{k}") + 1, F.lit(1))) for k in range(KEYED)))
    # an open place is no ASCII character, so no plain ASCII word fits
    keyed = words.where(F.col("word").rlike("[^\\x00-\\x7f]")).join(kinds, F.char_length("word") == F.col("size")).select("word", "n", "size", "places", known.alias("known"))
    both = keyed.join(open_, ["size", "places", "known"]).select("p", "word", "n")
    both = both.unionByName(words.join(patterns.where("whole is not null"), F.col("word") == F.col("whole")).select("p", "word", "n"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model.value)
        for b in batches:
            rows = [(p, w, rank(m, w, n)) for p, w, n in zip(*(b.column(k).to_pylist() for k in range(3))) if fits(p, w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], ["p", "word", "score"])

    ranked = both.mapInArrow(weigh, "p string, word string, score double")
    best = ranked.groupBy("p").agg(F.min(F.struct((-F.col("score")).alias("score"), "word")).alias("b"))
    return best.select("p", "b.word", (-F.col("b.score")).alias("score"))


def decode(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text, restored, encodings, complete) of every garbled document."""
    rows = documents.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    model = rows.sparkSession.sparkContext.broadcast(pair_counts(rows, "text"))
    kind = dict(documents.dtypes)[key]

    def undo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model.value)
        for b in batches:
            keep, got, pats = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if garbled(t, m):
                    keep.append(i)
                    got.append(unravel(t, m))
                    ps = {pattern(sets) for _, ways in open_words(got[-1][0], got[-1][1]) for sets, _ in ways}
                    pats.append([dict(zip(("p", "size", "places", "known", "whole"), p)) for p in sorted(ps, key=lambda p: p[0])])
            yield pa.RecordBatch.from_arrays(
                [*b.take(pa.array(keep, pa.int64())).columns, pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.list_(pa.string())), pa.array([",".join(x[2]) for x in got], pa.string()), pa.array([x[3] for x in got], pa.bool_()), pa.array(pats, PATTERNS)],
                ["doc", "text", "done", "holes", "encodings", "whole", "patterns"],
            )

    shape = f"doc {kind}, text string, done string, holes array<string>, encodings string, whole boolean, patterns array<struct<p: string, size: int, places: string, known: string, whole: string>>"
    undone = materialize(rows.where(F.col("text").rlike(ODD_TEXT)).mapInArrow(undo, shape).withColumn("row", F.monotonically_increasing_id()), "undone")
    each = undone.select("row", F.explode("patterns").alias("p")).select("row", "p.*")
    patterns = materialize(each.drop("row").distinct(), "patterns")  # its size is known to the planner
    best = materialize(best_words(patterns, rows, "text", model), "words")
    # the words of one document's holes
    words = each.join(best, "p").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("p", F.struct("word", "score")))).alias("known"))
    joined = undone.join(words, "row", "left").select("doc", "text", "done", "holes", "encodings", "whole", F.to_json("known").alias("known"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model.value)
        for b in batches:
            out, complete, names = [], [], []
            for t, done, holes, enc, whole, known in zip(*(b.column(k).to_pylist() for k in range(1, 7))):
                words_ = {p: (w["word"], w["score"]) for p, w in json.loads(known or "{}").items()}
                got, ok = fill(done, holes, words_, m)
                out.append(got)
                complete.append(ok and whole and not garbled(got, m))
                names.append(enc or "lost")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array(names, pa.string()), pa.array(complete, pa.bool_())], ["doc", "text", "restored", "encodings", "complete"])

    return joined.mapInArrow(put, f"doc {kind}, text string, restored string, encodings string, complete boolean")


PATTERNS = pa.list_(pa.struct([("p", pa.string()), ("size", pa.int32()), ("places", pa.string()), ("known", pa.string()), ("whole", pa.string())]))


def found(documents: DataFrame) -> DataFrame:
    """p9_found: documents with a stretch that the lattice decodes and the pairs of characters do not speak
    against. Nothing is restored for it, so words are not counted."""
    kind = dict(documents.dtypes)["doc_id"]
    model = documents.sparkSession.sparkContext.broadcast(pair_counts(documents, "text"))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(model.value)
        for b in batches:
            yield b.select(["doc_id"]).filter(pa.array([garbled(t, m) for t in b.column(1).to_pylist()], pa.bool_()))

    return documents.select("doc_id", "text").where(F.col("text").rlike(ODD_TEXT)).mapInArrow(pick, f"doc_id {kind}").distinct()
