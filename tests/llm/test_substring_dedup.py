"""Substring deduplication against a brute force over all windows."""

from __future__ import annotations

import hashlib
import random
import re

from sparkloupe.llm import substring_dedup as sd
from sparkloupe.llm.common import WORD, table


def brute(rows, window=13):
    words = {i: re.findall(WORD, t or "") for i, t in rows}
    least = {}
    for i, w in words.items():
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, i), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < i:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def test_whole_table(spark, sf):
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    assert sum(x[1] for x in want.values()) > 1000
    assert got(sd.substring_dedup(docs)) == want


def test_few_words_and_runs(spark):
    rng = random.Random(3)
    rows = []
    for k in range(150):  # two or three words only: runs, periods and many repeats
        rows.append((1000 - 3 * k, " ".join(rng.choice("ab" if k % 3 else "aab c d".split()) for _ in range(rng.randint(0, 90)))))
    rows += [(2000 + k, "x " * n) for k, n in enumerate((5, 12, 13, 14, 30, 31))]
    rows += [(3000 + k, " ".join(f"v{i}" for i in range(k % 40, k % 40 + 10 + k % 3))) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(sd.substring_dedup(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "a"), (-5, "q " * 40000), (6, "q " * 20), (7, "A " * 20), (8, "é " * 20), (9, "é\t" * 20), (None, "q " * 20)]
    df = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, g int, keys binary")
    want = brute(rows[:-1])
    want[None] = (20, 0, hashlib.sha256(" ".join("q" * 20).encode()).hexdigest())
    assert got(sd.substring_dedup(df)) == want
    assert sd.substring_dedup(df.limit(0)).collect() == []


def test_words_that_defeat_polynomial_names(spark):
    """Thue-Morse words differ from their complements; Thue-Morse sequences of two words do as well."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    line = " ".join("q" * 12)
    rows = [(1, f"{line} {word}"), (2, f"{line} {other}"), (3, " ".join(word[:1024])), (4, " ".join(other[:1024])), (5, " ".join(word[1:900]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(sd.substring_dedup(df)) == brute(rows) and got(sd.substring_dedup(df))[2][1] == 0


def test_long_symbols_settle_copies_and_passages(spark):
    """Copies share their last symbol; passages share long symbols; what is settled asks for no windows."""
    rng = random.Random(8)
    make = lambda n: " ".join(f"u{rng.randint(0, 10**9)}" for _ in range(n))
    whole, part = make(700), make(160)
    rows = [(100 - k, whole) for k in range(40)] + [(200 + k, f"{make(30 + k)} {part} {make(50 - k)}") for k in range(40)] + [(400, make(500))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(sd.substring_dedup(df)) == brute(rows)
    block = next(sd.blocks(sd.pa.array([whole, whole])))
    doc, name, other, start, size = sd.long_symbols(block, block.other_names(), 13)
    assert {(int(a), int(n)) for a, n in zip(start, size, strict=True)} >= {(0, 700), (700, 700)}
    assert set(name[doc == 0].tolist()) == set(name[doc == 1].tolist())


def test_every_symbol_is_one_passage():
    """Equal names, equal words, over texts of few words with many runs and periods."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice(("a", "a", "b", "c d")) for _ in range(rng.randint(0, 200))) for _ in range(60)]
    block = next(sd.blocks(sd.pa.array(texts)))
    words = block.data.tobytes().decode().split()
    seen = {}
    for _, n, o, a, size in zip(*sd.long_symbols(block, block.other_names(), 5), strict=True):
        assert seen.setdefault((int(n), int(o)), words[a : a + size]) == words[a : a + size]
    assert len(seen) > 100
