"""Connected components against union-find; sums over tasks."""

from __future__ import annotations

import random

import numpy as np
import pytest

from sparkloupe.llm import common, graph
from sparkloupe.llm.graph import components


def union_find(edges):
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("hot", [200_000, 3])
def test_components(spark, hot, monkeypatch):
    monkeypatch.setattr(graph, "HOT_DEGREE", hot)
    rng = random.Random(6)
    path = [(k, k + 1) for k in range(100, 160)]
    star = [(500, k) for k in range(501, 600)]
    loose = [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    loose = [e for e in loose if e[0] != e[1]]
    edges = path + star + loose + [(7, 3), (3, 7), (7, 3)]
    rng.shuffle(edges)
    got = components(spark.createDataFrame(edges, "a long, b long"), "test").collect()
    assert len(got) == len({r.id for r in got})
    assert {r.id: r.label for r in got} == union_find(edges)
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_a_round_plans_each_step_once(spark):
    """Each operator of a plan takes memory of the driver; with unions in both steps a round had six windows."""
    edges = common.stored(spark.createDataFrame([(5, 3), (3, 1), (9, 5)], "a long, b long"), "test")
    step = graph._star(graph._star(edges, True, False), False, False)
    plan = step._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == 2 and plan.count("Relation [") == 2
    assert sorted(tuple(r) for r in step.collect()) == [(3, 1), (5, 1), (5, 3), (9, 3)]
    common.discard(edges)


def test_tree_sum(spark, monkeypatch):
    monkeypatch.setattr(common, "FAN_IN", 4)
    rows = [(k, t, np.full(3, t + k, np.int64).tobytes()) for k in range(2) for t in range(50)]
    df = common.tree_sum(spark.createDataFrame(rows, "k int, task int, m binary"), np.int64, lambda x: x * 2)
    assert {r.k: np.frombuffer(r.m, np.int64).tolist() for r in df.collect()} == {k: [2 * sum(t + k for t in range(50))] * 3 for k in range(2)}


def test_words_and_pieces():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice("ab é\t\n\r\x0b\x0c  \xa0") for _ in range(rng.randint(0, 60)))
        data = np.frombuffer(text.encode(), np.uint8)
        start, end, name = common.words_of(data)
        import re

        words = re.findall(common.WORD, text)
        assert [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == words
        assert len(set(name.tolist())) == len(set(words))


def test_long_buffers_are_cut_at_words(monkeypatch):
    monkeypatch.setattr(common, "STEP_BYTES", 100)
    text = " ".join(str(k) * (k % 9 + 1) for k in range(5000)) + " " + "x" * 9000 + " end"
    data = np.frombuffer(text.encode(), np.uint8)
    parts = list(common._pieces(data))
    assert len(parts) > 2 and parts[0][0] == 0 and parts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(parts, parts[1:], strict=False))
    start, end, name = common.words_of(data)
    assert [data[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == text.split()
    assert name[-1] == common.words_of(np.frombuffer(b"end", np.uint8))[2][0]


def test_names_are_sound():
    """Long periodic words, words that differ late, and the two lanes."""
    tm = "a"
    for _ in range(13):
        tm += tm.translate(str.maketrans("ab", "ba"))
    other = tm.translate(str.maketrans("ab", "ba"))
    words = [w[:n] for w in (tm, other) for n in (1, 7, 8, 9, 16, 17, 512, 1023, 1024, 4096, 8192)] + ["x" * n for n in (8, 9, 1023, 1024, 1025)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    start, end, name = common.words_of(data)
    second = common.span_hashes(data, start, end, 1)
    assert len(set(name.tolist())) == len(set(second.tolist())) == len(set(words)) and not set(name.tolist()) & set(second.tolist())


def test_gram_names():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 3, 400).astype(np.uint64)
    for n, found in common.gram_names(names, [1, 2, 3, 5, 8, 10, 13]).items():
        want = {}
        for k in range(len(names) - n + 1):
            want.setdefault(tuple(names[k : k + n].tolist()), set()).add(int(found[k]))
        assert len(found) == len(names) - n + 1 and all(len(x) == 1 for x in want.values()) and len({min(x) for x in want.values()}) == len(want)


def test_stored_tables_are_deleted(spark):
    import os

    df = common.stored(spark.range(3).toDF("x"), "gone")
    assert df.count() == 3 and os.path.isdir(df._sparkloupe_path)
    common.discard(df)
    assert not os.path.isdir(df._sparkloupe_path)
    kept = common.stored(spark.range(3).toDF("x"), "gone")
    common.release(spark)
    assert not os.path.isdir(kept._sparkloupe_path)
