"""Operator 6: quality rules over a suffix array with longest common prefixes.

The words of a block of documents form one array; its suffixes are sorted by prefix doubling, each
suffix ranked within its own document only, so neighbours in the suffix array share a document.  The
ranks of every doubling step give the longest common prefix of neighbours by descending powers of two.
A position's longest repeat is the larger prefix shared with either neighbour; these are the left ends of
the maximal repeated substrings (the LCP intervals).  The union of the spans of repeats of at least
min_repeat words, as a share of the document, and the longest repeat are both limited.

Cases: a null, empty or blank text has no words and fails the base rule (fewer than min_words); equal
rows get equal verdicts; documents are judged alone, so ties and other columns do not matter.  Suffix
arrays hold a few arrays of one block; a very long text forms its own block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sparkloupe.llm.common import Block, blocks, table

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class QualityRules:
    """Limits.  Fractions are compared as integers: 100 * words against percent * n_words."""

    min_words: int = 50
    repeat_percent: int = 50  # of words in repeated 3-word windows
    min_repeat: int = 10  # words of a repeat that counts as copied
    covered_percent: int = 30  # of words inside such repeats
    longest_repeat: int = 120  # words
    symbol_percent: int = 20  # of characters in words


PRODUCTION = QualityRules()


def longest_repeats(block: Block) -> np.ndarray:
    """For each word of a block, the length of the longest repeat in its document that starts there."""
    n = len(block.name)
    if not n:
        return np.zeros(0, np.int64)
    size = np.diff(block.first)
    doc = np.repeat(np.arange(len(size)), size)
    last = block.first[1:][doc]  # end of each word's document
    _, name = np.unique(block.name, return_inverse=True)
    key = doc * (int(name.max()) + 2) + name + 1
    levels, step = [], 1
    order = np.argsort(key, kind="stable")
    while True:
        sortedkey = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(0, sortedkey[1:] != sortedkey[:-1]))
        levels.append(rank.astype(np.int32))
        count = np.bincount(rank)
        if len(count) == n:
            break
        at = np.arange(n) + step
        inside = at < last
        after = np.zeros(n, np.int64)
        after[inside] = rank[at[inside]] + 1
        key = rank * (n + 1) + after
        # only suffixes that still share a rank move
        tied = (count > 1)[rank[order]]
        part = order[tied]
        order[tied] = part[np.argsort(key[part], kind="stable")]
        step *= 2
    a, b = order[:-1], order[1:]
    same = doc[a] == doc[b]
    common = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        i, j = a + common, b + common
        ok = same & (i < last[a]) & (j < last[b])
        i, j = np.minimum(i, n - 1), np.minimum(j, n - 1)
        ok &= levels[k][i] == levels[k][j]
        common[ok] += 1 << k
    longest = np.zeros(n, np.int64)
    longest[a] = common
    longest[b] = np.maximum(longest[b], common)
    return longest


def covered(longest: np.ndarray, first: np.ndarray, least: int, span: int | None = None) -> np.ndarray:
    """Words of each document inside spans that start where a repeat of at least `least` words does."""
    n = len(longest)
    at = np.flatnonzero(longest >= least)
    size = longest[at] if span is None else np.full(len(at), span, np.int64)
    edge = np.bincount(at, minlength=n + 1) - np.bincount(np.minimum(at + size, n), minlength=n + 1)
    total = np.append(0, np.cumsum(np.cumsum(edge[:n]) > 0))
    return total[first[1:]] - total[first[:-1]]


def _dup_lines(text: str | None) -> int:
    if not text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat")


def _measured(texts: pa.Array, rules: QualityRules) -> list[np.ndarray]:
    out = {k: np.zeros(len(texts), np.int64) for k in _FIELDS}
    for block in blocks(texts):
        r = block.rows
        longest = longest_repeats(block)
        out["n_words"][r] = np.diff(block.first)
        lead = np.append(0, np.cumsum((block.data & 0xC0) != 0x80))
        own = np.append(0, np.cumsum(lead[block.stop] - lead[block.start]))
        out["word_chars"][r] = own[block.first[1:]] - own[block.first[:-1]]
        marks = np.append(0, np.cumsum(_SYMBOLS[block.data]))
        out["n_symbols"][r] = marks[block.end] - marks[block.begin]
        out["n_repeat_words"][r] = covered(longest, block.first, 3, 3)
        out["n_covered_words"][r] = covered(longest, block.first, rules.min_repeat)
        full = np.diff(block.first) > 0
        if full.any():
            out["longest_repeat"][r[full]] = np.maximum.reduceat(longest, block.first[:-1][full])
    out["n_dup_lines"][:] = [_dup_lines(t) for t in texts.to_pylist()]
    return [out[k] for k in _FIELDS]


def quality_measures(df: DataFrame, rules: QualityRules = PRODUCTION, *, text_col: str = "text") -> DataFrame:
    """The columns of df other than the measures' own, and the measures of each row's text."""
    keep = [c for c in df.columns if c not in _FIELDS]
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, _measured(batch.column(at), rules))], names=[*batch.schema.names, *_FIELDS])

    schema = StructType([df.schema[c] for c in keep] + [StructField(k, LongType(), False) for k in _FIELDS])
    return df.select(*keep).mapInArrow(run, schema)


def judged(measures: DataFrame, rules: QualityRules = PRODUCTION) -> DataFrame:
    """Adds base_failed and kept."""
    n = F.col("n_words")
    failed = (n < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * n)
    bad = (100 * F.col("n_covered_words") > rules.covered_percent * n) | (F.col("longest_repeat") > rules.longest_repeat) | (100 * F.col("n_symbols") > rules.symbol_percent * F.col("word_chars"))
    return measures.withColumn("base_failed", failed).withColumn("kept", ~(failed | bad))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(quality_measures(table(spark, sf_dir, "documents").select("doc_id", "text"))).drop("text", "n_covered_words", "longest_repeat")


_WORD_SQL = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORD_SQL} AS w FROM documents),
x AS (SELECT doc_id, t, w, len(w) AS n FROM d),
pos AS (SELECT doc_id, n, w, unnest(range(1, n + 1)) AS p FROM x),
win AS (SELECT doc_id, p, n, CASE WHEN p + 2 <= n THEN array_to_string(w[p:p + 2], ' ') END AS w3,
        CASE WHEN p + 9 <= n THEN array_to_string(w[p:p + 9], ' ') END AS w10,
        CASE WHEN p + 120 <= n THEN array_to_string(w[p:p + 120], ' ') END AS w121 FROM pos),
rep AS (SELECT doc_id, p, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w3) > 1 AS r3,
        w10 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w10) > 1 AS r10,
        w121 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w121) > 1 AS r121 FROM win),
cov AS (SELECT doc_id, bool_or(r3) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
        bool_or(r10) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, r121 FROM rep),
agg AS (SELECT doc_id, count(*) FILTER (c3) AS n3, count(*) FILTER (c10) AS n10, bool_or(r121) AS long FROM cov GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM x)
          WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT x.doc_id, n::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
      coalesce(n3, 0)::BIGINT AS n_repeat_words, coalesce(n10, 0)::BIGINT AS n_covered_words, coalesce(long, false) AS long
      FROM x LEFT JOIN agg USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_covered_words > 30 * n_words OR long
            OR 100 * n_symbols > 20 * word_chars) AS kept
FROM m
"""
