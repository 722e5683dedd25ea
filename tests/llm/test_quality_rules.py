"""Quality rules: longest repeats against brute force, verdicts, odd inputs."""

from __future__ import annotations

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloupe.llm.common import blocks
from sparkloupe.llm.quality_rules import covered, judged, longest_repeats, quality_measures


def brute(words):
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c dd é".split()), max_size=24), min_size=1, max_size=6))
def test_longest_repeats(docs):
    column = pa.array([" ".join(d) if d else None for d in docs])
    (block,) = blocks(column)
    longest = longest_repeats(block)
    want = [x for d in docs for x in brute(d)]
    assert longest.tolist() == want
    at = 0
    for k, d in enumerate(docs):
        part, at = want[at : at + len(d)], at + len(d)
        cover = {p for s, x in enumerate(part) if x >= 3 for p in range(s, s + x)}
        assert covered(longest, block.first, 3)[k] == len(cover)


def test_verdicts_and_odd_rows(spark):
    clean = " ".join(f"w{k}" for k in range(100))
    rows = [
        (1, None), (2, ""), (3, " \n"), (4, clean), (5, "word " * 200), (6, " ".join(f"w{k}" for k in range(49))),
        (7, f"{clean} {' '.join(f'w{k}' for k in range(30))}"), (8, " ".join(f"w{k}$$$$" for k in range(60))),
        (9, "\n".join([*(f"a{k} b{k} c{k}" for k in range(20)), "a3 b3 c3", "", "", " "])), (10, clean), (None, clean), (11, "z" * 300000),
    ]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, n_words string")
    got = {r.doc_id: r for r in judged(quality_measures(df)).collect()}
    assert len(got) == len(rows)
    assert {k for k, r in got.items() if r.kept} == {4, 9, 10, None}
    assert {k for k, r in got.items() if r.base_failed} == {1, 2, 3, 5, 6, 11}
    assert got[7].n_repeat_words == 60 and got[7].longest_repeat == 30 and got[7].n_covered_words == 60 and not got[7].kept
    assert got[8].n_symbols == 240 and not got[8].kept and got[9].n_dup_lines == 1
    assert got[11].word_chars == 300000 and got[5].n_repeat_words == 200
    assert quality_measures(df.limit(0)).collect() == []
