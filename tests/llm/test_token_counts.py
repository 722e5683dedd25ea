"""Token counts against the tokenizer library."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from sparkloupe.llm import token_counts as tc
from sparkloupe.llm.common import blocks, table

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return tc.PieceModel(PATH)


def mine(model, texts):
    column, memory = pa.array(texts, pa.string()), tc._Memory()
    out = np.zeros(len(texts), np.int64)
    for block in blocks(column):
        out[block.rows] = tc.count_block(model, block, memory)
    return out.tolist()


def test_random_and_odd_texts(model, library):
    rng = random.Random(1)
    letters = [*" \t\n▁aehtnrio1290<>sé中文字ß​😀\x00", "  ", "the", "ing", " hello", "<s>", "</s>", "<0x0A>", "aaaa", "////", "----", "\xa0"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["a" * 4000, " " * 3000, "the" * 3000, "中" * 3000, "=" * 9000, "", " ", "▁", "a▁b", "▁▁ ▁", "x " * 20000]
    assert mine(model, texts) == [len(x) for x in library.encode(texts)]
    assert mine(model, [None]) == [0]


def test_long_sequences_use_the_heap_alike(model, monkeypatch):
    texts = ["thethingsofthe" * 20, "a" * 300, "=-" * 200]
    want = mine(model, texts)
    monkeypatch.setattr(tc, "LONG", 5)
    assert mine(model, texts) == want


def test_whole_table(spark, sf, library):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: r for r in tc.op1_token_counts(spark, sf).collect()}
    for r in docs.collect():
        n = len(library.encode(r.text or ""))
        assert (got[r.doc_id].n_bytes, got[r.doc_id].n_tokens, got[r.doc_id].over_limit) == (len((r.text or "").encode()), n, n > 4096)
    df = spark.createDataFrame([(None, "a b", 1), (1, None, 2), (1, "", 3)], "doc_id long, text string, n_tokens int")
    assert sorted(r.n_tokens for r in tc.token_counts(df, PATH).collect()) == [0, 0, 2]
    assert tc.token_counts(df.limit(0), PATH).collect() == []


def test_words_that_defeat_polynomial_names(model, library):
    """Thue-Morse words and their complements are counted apart, in one block and from the memory of pre-tokens."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:1024], word[:1024].translate(str.maketrans("ab", "ba")), f"x {word}"]
    assert mine(model, texts) == [len(library.encode(t)) for t in texts]
