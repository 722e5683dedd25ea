"""Language identification: held-out accuracy, what is learned from, odd inputs."""

from __future__ import annotations

import zlib

from sparkloupe.llm import language_id as li
from sparkloupe.llm.common import table


def test_held_out_accuracy(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    rows = li.op9_language_id(spark, sf.replace("0.001", "0.01")).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out and r.lang]
    assert len(rows) == docs.count() and len(out) > 100
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def make(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_learns_only_from_the_open_folds(spark):
    words = {"en": "the thing they thought", "de": "zwischen ungefähr schön", "fr": "être élève où çà", "xx": "qqq zzqq wwx", "zz": "only held out"}
    rows = [(k, f"{words[c]} {k % 7}", c, "s") for k, c in enumerate([*words] * 40)]
    rows = [r for r in rows if (zlib.crc32(str(r[0]).encode()) % 5 == 0) == (r[2] == "zz") or r[2] not in ("zz",)]
    rows = [r for r in rows if r[2] != "zz" or zlib.crc32(str(r[0]).encode()) % 5 == 0]
    df = make(spark, rows)
    model = li.train(df)
    assert model.languages == ["de", "en", "fr", "xx"] and model.families == ["germanic", "romance", "xx"]
    got = {r.doc_id: r.lang_pred for r in li.identify(df, model).collect()}
    assert all(got[r[0]] == r[2] for r in rows if r[2] != "zz")


def test_odd_rows(spark):
    train = [(k, t, c, None) for k, (t, c) in enumerate([("the thing", "en"), ("der zwischen", "de")] * 30)]
    odd = [(900, None, "en", None), (901, "", "en", None), (902, "12 %% \n", "de", None), (903, "é", None, None), (904, "the " * 300000, None, None), (None, "the thing", "en", None), (904, "the thing", None, None), (905, "中文", None, None), (906, "€ ²", None, None)]
    model = li.train(make(spark, train))
    got = [(r.doc_id, r.lang_pred, r.score) for r in li.identify(make(spark, odd), model).collect()]
    assert len(got) == len(odd)
    assert {(i, p) for i, p, _ in got} >= {(900, "und"), (901, "und"), (902, "und"), (904, "en"), (None, "en"), (906, "und")}
    assert all(p in ("en", "de") for i, p, _ in got if i in (903, 905))
    assert all(s == 0 for i, p, s in got if p == "und")
    none = li.train(make(spark, train).where("lang = 'no'"))
    assert {r.lang_pred for r in li.identify(make(spark, train), none).collect()} == {"und"}
    one = li.train(make(spark, [r for r in train if r[2] == "en"]))
    assert {r.lang_pred for r in li.identify(make(spark, train), one).collect()} == {"en"}
    assert li.identify(make(spark, []), model).collect() == []


def test_features_against_counting(monkeypatch):
    """Frequencies of letter n-grams as counted one by one; long texts in pieces."""
    from collections import Counter

    import numpy as np

    texts = ["", "Aé b", "12 no 34 digits!", "word " * 300, "ß" * 50, "x"]
    found, has = li.features([memoryview(t.encode()) for t in texts])
    for x, t, h in zip(found, texts, has, strict=True):
        assert h == any(c.isalpha() for c in t)
        data = np.frombuffer(li._letters(memoryview(t.encode()))[0], np.uint8)
        want = np.zeros(li.DIMENSIONS)
        for gram in li._grams(data):
            for k, n in Counter(gram.tolist()).items():
                want[k] = n / len(gram)
        assert np.allclose(x, want)
    monkeypatch.setattr(li, "PIECE_BYTES", 64)
    cut, _ = li.features([memoryview(("some words here " * 40).encode()), memoryview(("é" * 500).encode())])
    monkeypatch.undo()
    whole, _ = li.features([memoryview(("some words here " * 40).encode()), memoryview(("é" * 500).encode())])
    assert np.abs(cut - whole).max() < 0.05
    pieces = [bytes(p) for p in li._cut(memoryview("añ b".encode()))]
    assert b"".join(pieces).decode() == "añ b"
