"""Decontamination: verbatim and changed passages are found, clean texts are not; recall against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkloupe.llm import decontamination as dc
from sparkloupe.llm.common import table

WORDS = [f"{a}{b}" for a in "ka lo mi nu pe ra so ti vu we".split() for b in "bal dor fen gis hum jat lek mop".split()]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 40))] for _ in range(2))
        assert dc.common_subsequence(np.array(a), np.array(b))[0] == lcs(a, b)


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(4)
    items = [(k, text(rng, rng.randint(14, 60))) for k in range(30)]
    docs, want = [], {}
    for d in range(300):
        body = text(rng, rng.randint(0, 400)).split()
        if d % 5 == 0:
            k = d // 5 % 30
            words = items[k][1].upper().split() if d % 2 else items[k][1].split()
            for p in range(len(words) // 6):  # a paraphrase: some words changed
                words[(p * 5 + 2) % len(words)] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = words
            want[d] = k
        docs.append((d, " ".join(body)))
    return items, docs, want


def got(spark, items, docs, extra=""):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {r.doc_id: r.item_id for r in dc.contaminated(a, b).collect()}


@pytest.mark.parametrize("block", [2048, 7])
def test_planted(spark, planted, block, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", block)
    items, docs, want = planted
    assert got(spark, items, docs) == want


@pytest.mark.parametrize("size", ["0.001", "0.01"])
def test_whole_table(spark, sf, size):
    sf = sf.replace("0.001", size)
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    names = {r.item_id: dc.word_names(r.text.encode()).tolist() for r in items.collect()}
    runs = {}
    for k, w in names.items():
        for p in range(len(w) - 4):
            runs.setdefault(tuple(w[p : p + 5]), set()).add(k)
    want = set()
    for r in docs.collect():
        w = dc.word_names((r.text or "").encode()).tolist()
        count = {}
        for p in range(len(w) - 4):
            for k in runs.get(tuple(w[p : p + 5]), ()):
                count[k] = count.get(k, 0) + 1
        if any(n >= 0.6 * (len(names[k]) - 4) for k, n in count.items()):
            want.add(r.doc_id)
    found = {r.doc_id for r in dc.op10_decontamination(spark, sf).where("contaminated").collect()}
    assert want and found == want


def test_odd_rows(spark):
    items = [(1, None), (2, ""), (3, "one two"), (4, "?!"), (5, "alpha beta gamma delta epsilon zeta eta theta iota? kappa"), (5, "same id other words here now")]
    docs = [(1, None), (2, ""), (3, "x one two y"), (4, "one x two"), (5, "Alpha beta gamma delta epsilon zeta eta, theta iota? KAPPA!"), (6, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "x one two y")]
    assert got(spark, items, docs) == {3: 3, 5: 5}
    assert got(spark, items[:2], docs) == {} and got(spark, items, []) == {}


def zipf_items(count, sizes, seed):
    """Items of Zipf words, nearly unrelated to each other."""
    rng = np.random.default_rng(seed)
    share = 1 / np.arange(20, 20_020)
    return [" ".join(f"w{x}" for x in rng.choice(20_000, sizes[k % len(sizes)], p=share / share.sum())) for k in range(count)]


def test_many_items(spark):
    """Many more items than the basis has directions: every verbatim copy is found."""
    items = zipf_items(2100, [30], 1)
    noise = zipf_items(700, [150], 2)
    docs = [(d, f"{noise[d]} {items[d * 3]} {noise[-d]}" if d < 350 else noise[d]) for d in range(700)]
    assert got(spark, list(enumerate(items)), docs) == {d: d * 3 for d in range(350)}


def test_long_items(spark):
    """Items of many passages are found verbatim and where 65 % of their words, in order, are left."""
    rng = np.random.default_rng(5)
    items = zipf_items(120, [60, 100, 150, 200, 300, 1000], 3)
    noise = zipf_items(300, [200], 4)
    block = dc.Items(list(enumerate(items)))
    docs, want = [], {}
    for d in range(300):
        body = noise[d].split()
        if d < 240:
            words = items[d % 120].split()
            if d >= 120:
                gone = rng.permutation(len(words))[: int(len(words) * 0.35)]
                words = ["changed" if k in set(gone.tolist()) else w for k, w in enumerate(words)]
            body[d % 90 : d % 90] = words
            if dc._verified(block, d % 120, dc.word_names(" ".join(body).encode())):  # a copy may have lost its answer
                want[d] = d % 120
        docs.append((d, " ".join(body)))
    found = got(spark, list(enumerate(items)), docs)
    assert found == want and len(want) > 230


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_recall_of_planted_paraphrases(spark, sf, size):
    """Copies of real items with about two thirds of their words, the others replaced, among real documents:
    at least 0.9 of what verification accepts is found."""
    sf = sf.replace("0.001", size)
    rng = np.random.default_rng(11)
    texts = [r.text or "" for r in table(spark, sf, "documents").select("text").limit(3000).collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    pool = " ".join(texts[:500]).split()
    block = dc.Items(items)
    docs, want = [], {}
    for d, t in enumerate(texts):
        body = t.split()
        if d % 5 == 0:
            k = d // 5 % len(items)
            words = [w if rng.random() < 0.68 else pool[rng.integers(len(pool))] for w in items[k][1].split()]
            at = int(rng.integers(len(body) + 1))
            body[at:at] = words
            if dc._verified(block, k, dc.word_names(" ".join(body[max(0, at - 60) : at + len(words) + 60]).encode())):
                want[d] = items[k][0]
        docs.append((d, " ".join(body)))
    found = got(spark, items, docs)
    hit = sum(found.get(d) == k for d, k in want.items())
    print(f"recall {size}: {hit} of {len(want)}")
    assert len(want) > 100 and hit >= 0.9 * len(want)


def test_basis_is_a_singular_value_decomposition(spark, planted):
    """Orthonormal, and it keeps about as much of the passages as the best basis of that size."""
    items, docs, _ = planted
    df = spark.createDataFrame(docs, "doc_id long, text string")
    blocks = [dc.Items(items)]
    weight = dc.weights(dc.document_counts(df), len(docs), blocks)
    basis = dc.latent_basis(df, blocks, weight, len(docs), components=12)
    assert np.allclose(basis.T @ basis, np.eye(12), atol=1e-4)
    words = dc.Words([memoryview(t.encode()) for _, t in docs])
    exact = dc.Passages(words, weight, np.diag(weight)[:, weight > 0].astype(np.float32)).long()
    kept = np.linalg.norm(exact @ basis[weight > 0]) ** 2
    best = (np.linalg.svd(exact, compute_uv=False)[:12] ** 2).sum()
    assert 0.8 * best < kept <= best * 1.001


def test_basis_is_fitted_on_every_document(spark):
    """Twelve subjects, each of one long document among 40,000 short ones without doc_id or with one they share: the
    basis keeps all of them."""
    subjects = [[f"subject{k}x{j}" for j in range(10)] for k in range(12)]
    rng = random.Random(6)
    rows = [(d, " ".join(rng.choice(subjects[d]) for _ in range(2000)) if d < 12 else " ".join(rng.choice(WORDS) + rng.choice("abcd") for _ in range(3))) for d in range(40_000)]
    items = [dc.Items([(1, text(rng, 20))])]
    for ids in (lambda d: d, lambda d: 17 if d % 2 else None):
        df = spark.createDataFrame([(ids(d), t) for d, t in rows], "doc_id long, text string")
        weight = dc.weights(dc.document_counts(df), len(rows), items)
        basis = dc.latent_basis(df, items, weight, len(rows), components=20)
        for words in subjects:
            row = np.zeros(dc.CELLS, np.float32)
            np.add.at(row, at := dc.cells(dc.word_names(" ".join(words).encode())), weight[at])
            assert np.linalg.norm(row @ basis) > 0.9 * np.linalg.norm(row)
