"""The Jaccard join against a brute force, small thresholds for its branches, and odd inputs."""

from __future__ import annotations

import re
from itertools import combinations

import pytest

from sparkloupe.llm import ngram_join
from sparkloupe.llm.common import WORD, table
from sparkloupe.llm.ngram_join import JaccardJoin, jaccard_components


def brute(rows, words=4, percent=85):
    sets = {}
    for i, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(WORD, low)
        k = min(words, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for i, s in sets.items():
        for t in s:
            index.setdefault(t, []).append(i)
    pairs = {p for ids in index.values() if len(ids) < 400 for p in combinations(sorted(set(ids)), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("small", [1, 8])
def test_whole_table(spark, sf, small, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "KERNEL", 3 if small == 1 else 512)
    docs = table(spark, sf.replace("0.001", "0.01"), "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(jaccard_components(docs)) == brute(rows)


def test_chains_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", 2)
    monkeypatch.setattr(ngram_join, "KERNEL", 4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for k in range(24):  # each step changes one more word: neighbours link, ends do not
        base = [*base]
        base[4 * k] = f"x{k}"
        rows.append((k, " ".join(base)))
    rows += [(100 + k, " ".join([*base[:60], *(f"z{k}_{i}" for i in range(60))])) for k in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df)) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "A b"), (5, "a B"), (6, "a b"), (7, "a b c d e"), (8, "a b c d e"), (9, "x " * 30000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, token string")
    assert got(jaccard_components(df)) == brute(rows)
    assert jaccard_components(df.limit(0), JaccardJoin()).collect() == []


def test_words_that_defeat_polynomial_names(spark):
    """Thue-Morse words and their complements are different words of equal length and letters."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word)]
    assert got(jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))) == {1: (1, 1), 2: (1, 2), 3: (1, 1)}


@pytest.mark.parametrize("hot", [1, 4])
def test_hot_tokens_and_classes(spark, sf, hot, monkeypatch):
    """Tokens counted in parts give the same links; a class of copies is joined part by part."""
    monkeypatch.setattr(ngram_join, "HOT", hot)
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(10_000 + k, "one two three four five six") for k in range(300)] + [(20_000 + k, "") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(jaccard_components(df)) == brute(rows)
