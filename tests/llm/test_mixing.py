"""Source mixing: targets against a plain water filling, fits against brute force, whole tables."""

from __future__ import annotations

import re
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from sparkloupe.llm.common import WORD, table
from sparkloupe.llm.mixing import fit, mix_sources, ranked, size_of


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 3)), min_size=1, max_size=4, unique_by=lambda x: x[0]), st.integers(0, 60))
def test_fit_is_nearest_below(pairs, budget):
    length, count = (np.array(x) for x in zip(*pairs, strict=True))
    take = fit(length, count, budget)
    assert ((take >= 0) & (take <= count)).all()
    sums = {sum(k * n for k, n in zip(ks, length, strict=True)) for ks in product(*(range(c + 1) for c in count))}
    assert int((take * length).sum()) <= budget
    if budget < int((length * count).sum()):
        assert int((take * length).sum()) == max(s for s in sums if s <= budget)


def water(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total > 2 * sizes[s]]
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = 2.0 * sizes[s]
            open_.discard(s)
        left = 1.5 * sum(sizes.values()) - sum(out.values())
    return out


def flat(df):
    return mix_sources(df).select("row.*", "size", "source_size", "target", "taken", "copies").collect()


def check(df):
    rows = df.select("doc_id", "source", "text").collect()
    got = flat(df)
    assert len(got) == len(rows)
    size = {r.doc_id: len(re.findall(WORD, r.text or "")) for r in rows}
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size[r.doc_id]
    want, taken = water(sizes), {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    again = {(r.doc_id, r.taken) for r in flat(df)}
    assert again == {(r.doc_id, r.taken) for r in got}
    return want, taken


def test_whole_table(spark, sf):
    want, taken = check(table(spark, sf, "documents"))
    rows = table(spark, sf, "documents").groupBy("source").count().collect()
    for s, n in rows:
        assert abs(taken[s] - want[s]) <= (1 if n >= 12 else 300)


def test_odd_rows(spark):
    rows = [(k, s, "w " * n) for k, (s, n) in enumerate([("a", 5), ("a", 3), (None, 7), ("é", 2), ("z", 0), ("Z", 9), ("b", 1), ("b", 100), (None, 1)])]
    df = spark.createDataFrame([*rows, (50, "a", None), (51, "a", "")], "doc_id long, source string, text string")
    want, taken = check(df)
    assert all(taken[s] <= t + 0.5 for s, t in want.items())
    assert mix_sources(df.limit(0)).collect() == []
    assert {r.taken for r in mix_sources(df.where("text is null")).collect()} == {0}


def test_rows_without_key(spark):
    """Null and repeated ids are rows of their own: none is lost or multiplied, and a source's words stay near its target."""
    rows = [(None if k % 3 else k % 7, "s" if k % 2 else None, "w " * (k % 23)) for k in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = flat(df)
    assert len(got) == 700
    taken, target = {}, {}
    for r in got:
        taken[r.source], target[r.source] = taken.get(r.source, 0) + r.taken, r.target
    assert all(abs(taken[s] - target[s]) <= 1 for s in target)
    assert sorted(map(str, got)) == sorted(map(str, flat(df)))


def test_many_sources(spark):
    """Ranks over several sorted ranges follow the code points, null last."""
    names = [f"{chr(0x41 + k % 900)}{k}" for k in range(3000)] + [None]
    df = spark.createDataFrame([(s, 1) for s in names], "source string, source_size int").repartition(5)
    got = {r.source: r["rank"] for r in ranked(df).collect()}
    assert got == {s: k for k, s in enumerate([*sorted(names[:-1]), None])}


@pytest.mark.parametrize("text", [None, "", "   ", "a", " a", "a ", "\ta\n b\x0bc ", "é\xa0x  y", "x" * 50000, " x" * 50000])
def test_sizes(spark, text):
    df = spark.createDataFrame([(text,)], "text string").select(size_of(F.col("text")).alias("n"))
    assert df.first().n == len(re.findall(WORD, text or ""))
