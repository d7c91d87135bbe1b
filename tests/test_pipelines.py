import http.server
import io
import os
import tarfile
import threading

import pytest

from sandhi.functions.parsing import CHECK_SYSTEM
from sandhi.operators import external as ext
from sandhi.plans import pipelines as pl
from sandhi.sources import download as dl


@ext.register("scripted")
class Scripted:
    """Bigrams, verdicts or sentences, whichever the prompt asks for."""

    def generate(self, prompts):
        return [self.one(p) for p in prompts]

    def one(self, p):
        if p.startswith("You're a helpful mix"):
            return "1. प्रतीत document\n2. बुनियादी formatting; इस spoken\n- menu bar click\nएक one"
        if p.startswith(CHECK_SYSTEM):
            return "\n".join(f"{line.split('.')[0]}: {'YES' if 'एक' in line else 'NO'}" for line in p.split("\n\n")[2].split("\n"))
        b = p.rpartition(": ")[2]
        return f"1. English: open {b} now\n2. Hindi: यह {b} है\n3. {b}\nखाली line without it"


def test_funnel(spark):
    texts = spark.createDataFrame([(f"text number {i}",) for i in range(10)], "text string")
    cache = spark.createDataFrame([], "key string, response string")
    phrases, new1 = pl.generate_bigrams(texts, 3, cache, "scripted")
    assert phrases.count() == 15 and new1.count() == 3
    pairs = pl.extract_pairs(phrases)
    assert {r["bigram"] for r in pairs.collect()} == {"प्रतीत document", "बुनियादी formatting", "इस spoken", "एक one"}
    valid, new2 = pl.filter_bigrams(pairs, cache, "scripted")
    assert {r["bigram"] for r in valid.collect()} == {"प्रतीत document", "बुनियादी formatting", "इस spoken"} and new2.count() == 3
    sents, new3 = pl.generate_sentences(valid, cache, "scripted")
    got = {r["text"]: r["matrix_lang"] for r in sents.collect()}
    assert len(got) == 6 and got["open इस spoken now"] == "en" and got["यह इस spoken है"] == "hi"
    again, none = pl.generate_sentences(valid, new3, "scripted")
    assert none.count() == 0 and {r["sent_id"] for r in again.collect()} == {r["sent_id"] for r in sents.collect()}
    assert pl.fix_sentences(sents, valid).count() == 6


def test_score(spark, tmp_path):
    refs = spark.createDataFrame([("1_R_0000", "इस document में"), ("1_R_0001", "यह file"), ("2_S_0000", "  ")], "utt_id string, text string")
    perfect = pl.score_system(refs, refs, "same").first()
    assert (perfect["mer"], perfect["cba_total"], perfect["n_items"]) == (0.0, 100.0, 3)
    empty = pl.score_system(refs, refs.selectExpr("utt_id", "'' hyp"), mer_mode="hybrid").first()
    assert (empty["mer"], empty["cba_total"]) == (100.0, 0.0)
    whole = spark.createDataFrame([("R", "इस document में यह file")], "utt_id string, hyp string")
    row = pl.score_system(refs, whole, "r", group="recording", cba_mode="lenient")
    r = row.first()
    assert (r["n_items"], r["mer"], r["he_total"], r["eh_total"], r["he_matched"]) == (1, 0.0, 2, 1, 2)
    pl.append_result(row, str(tmp_path / "log"))
    pl.append_result(row, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        pl.score_system(refs, whole)


def test_prepare(spark, tmp_path):
    d = tmp_path / "x" / "train"
    d.mkdir(parents=True)
    (d / "text").write_text("u1 यह file\nu2 open\nu3 last words\n")
    (d / "segments").write_text("u1 r1 0.0 1.5\nu2 r1 1.5 4.0\n")
    (d / "wav.scp").write_text("r1 /data/r1.wav\n")
    m = pl.build_manifest(*pl.kaldi_tables(spark, str(tmp_path)))
    assert {r["utt_id"]: (r["dur"], r["path"]) for r in m.collect()} == {"u1": (1.5, "/data/r1.wav"), "u2": (2.5, "/data/r1.wav"), "u3": (None, None)}
    held, rest = pl.hold_out(m, 1.0 / 3600)
    assert held.count() + rest.count() == 3 and held.count() >= 1


def test_download_resumes(tmp_path):
    body = os.urandom(5000)

    class H(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            at = int((self.headers.get("Range") or "bytes=0-")[6:-1])
            self.send_response(416 if at >= len(body) else 206 if at else 200)
            self.end_headers()
            self.wfile.write(body[at:])

        def log_message(self, *a):
            pass

    s = http.server.HTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    p = tmp_path / "f"
    p.write_bytes(body[:2000])
    for _ in range(2):
        dl.download(f"http://127.0.0.1:{s.server_port}/f", str(p))
        assert p.read_bytes() == body
    s.shutdown()


def test_extract_once(tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        i = tarfile.TarInfo("x")
        i.size = 1
        t.addfile(i, io.BytesIO(b"1"))
    dl.extract(str(tmp_path / "a.tar"), str(tmp_path / "o"))
    os.remove(tmp_path / "o" / "x")
    dl.extract(str(tmp_path / "a.tar"), str(tmp_path / "o"))
    assert not (tmp_path / "o" / "x").exists()
