"""Table functions for SQL users: ``register(spark)``, then ``SELECT u.utt_id, s.* FROM u, LATERAL switch_points(u.text) s``.

Row by row in Python, so a convenience; the queries use the column functions of ``scripts``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sandhi.functions.scripts import DEVANAGARI, LATIN


def _plain(chars: str) -> str:
    return re.sub(r"\\x\{(\w+)\}", lambda m: re.escape(chr(int(m.group(1), 16))), chars)


HI, EN = re.compile(f"[{_plain(DEVANAGARI)}]"), re.compile(f"[{_plain(LATIN)}]")


def tokens(text: str) -> list[tuple[str, str]]:
    """(token, script) of a text normalised for scoring, tokens of two scripts parted where they meet."""
    text = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in unicodedata.normalize("NFKC", text)).lower()
    out = []
    for word in text.split():
        part, script = "", ""
        for c in word:
            now = "hi" if HI.match(c) else "en" if EN.match(c) else script
            if part and script and now != script:
                out.append((part, script))
                part = ""
            part, script = part + c, now
        out.append((part, script or "other"))
    return out


@udtf(returnType="pos int, first string, second string, kind string")
class SwitchPoints:
    def eval(self, text: str) -> Iterator[tuple]:
        ts = tokens(text or "")
        for i, ((a, x), (b, y)) in enumerate(zip(ts, ts[1:])):
            if {x, y} == {"hi", "en"}:
                yield i, a, b, "HE" if x == "hi" else "EH"


def register(spark: SparkSession) -> None:
    spark.udtf.register("switch_points", SwitchPoints)
