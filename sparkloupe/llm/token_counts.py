"""Operator 1: token counts by rank-synchronous array merging.

A byte-fallback BPE model gives each piece a score; encoding repeatedly joins the adjacent pair whose
joined piece scores best, the leftmost on ties.  Here all distinct pre-tokens of a batch are held as one
ragged numpy array of symbol ids, and each round every sequence merges its own lowest-rank pair at the
same time; finished sequences leave.  The count is the number of symbols that survive, where a symbol
outside the vocabulary counts as many tokens as it has UTF-8 bytes.

Exactness.  No piece holds a space mark after another character, so a text can be cut before every run
of spaces and the cuts never hide a merge.  When a rank belongs to one piece and no better-ranked piece
can use that piece, all its non-overlapping occurrences in a sequence are merged in one round; otherwise
only the leftmost is.  Sequences of more than LONG symbols are merged with a heap, which gives the same
result in n log n steps.

Cases: null and empty texts have no tokens; other columns are ignored, whatever their names; rows are
independent, so repeats and ties need no rule.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloupe.llm.common import Block, blocks, mix, span_hashes, table

LONG = 1500
#: Distinct pre-tokens whose counts one worker remembers between batches; beyond it the memory is emptied.
REMEMBERED = 1 << 20
_NONE = np.int64(1) << np.int64(40)


class PieceModel:
    """The merge table of a sentencepiece BPE model file."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models without text normalisation are supported")
        self.prefix = spec.add_dummy_prefix
        scores = {p.piece: p.score for p in model.pieces if p.type in (1, 4, 5)}
        if any("▁" in p.lstrip("▁") for p in scores):
            raise ValueError("a piece holds a space mark after another character")
        ids = {p: i for i, p in enumerate(scores)}
        for p in scores:
            for c in p:
                ids.setdefault(c, len(ids))
        self.char = {ord(p): i for p, i in ids.items() if len(p) == 1}
        by_score = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = np.full(len(ids), len(by_score), np.int64)
        for p, s in scores.items():
            self.rank[ids[p]] = by_score[s]
        pairs: dict[int, int] = {}
        uses = np.full(len(ids), len(by_score), np.int64)  # best rank of a piece made from this one
        for p in scores:
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    pairs[(a << 24) | b] = ids[p]
                    for x in (a, b):
                        uses[x] = min(uses[x], self.rank[ids[p]])
        shared = np.bincount(self.rank, minlength=len(by_score) + 1) > 1
        #: Whether all occurrences of this piece may be merged at once.
        self.at_once = ~shared[self.rank] & (uses > self.rank)
        self.pairs = pairs
        #: An open-addressing table of the pairs; a probe costs one gather.
        self.bits = max(12, int(np.ceil(np.log2(max(1, len(pairs)) * 4))))
        keys = np.array(list(pairs), np.int64)
        made = np.array(list(pairs.values()), np.int64)
        self.slot = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int64)
        at, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.slot[at[left]] == -1
            _, first = np.unique(at[left[free]], return_index=True)
            won = left[free][first]
            self.slot[at[won]], self.made[at[won]] = keys[won], made[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
        table = np.full(0x110000, -1, np.int32)
        for c, i in self.char.items():
            table[c] = i
        table[32] = table[0x2581] = self.char[0x2581]
        self.table = table
        self.bytes_only = np.ones(len(ids), bool)
        for p in scores:
            self.bytes_only[ids[p]] = False
        self.weight = np.ones(len(ids), np.int64)
        for p, i in ids.items():
            if self.bytes_only[i]:
                self.weight[i] = len(p.encode())

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        out = np.full(len(a), -1, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = (a[todo].astype(np.int64) << 24) | b[todo]
        at = self._slot(keys)
        for _ in range(self.probes):
            got = self.slot[at]
            hit = got == keys
            out[todo[hit]] = self.made[at[hit]]
            go = ~hit & (got != -1)
            if not go.any():
                break
            todo, keys, at = todo[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def counts(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Token counts of sequences of code points laid end to end."""
        sym = self.table[codes].astype(np.int64)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        seq = np.repeat(np.arange(len(lengths)), lengths)
        out = np.bincount(seq, np.where(sym < 0, width, 0), len(lengths)).astype(np.int64)
        for s in np.flatnonzero(lengths > LONG).tolist():
            end = int(lengths[: s + 1].sum())
            out[s] += self._heap(sym[end - int(lengths[s]) : end].tolist())
        keep = (lengths <= LONG)[seq]
        seq, sym = seq[keep], sym[keep]
        if not len(sym):
            return out
        made = np.full(len(sym), -1, np.int64)
        same = seq[1:] == seq[:-1]
        made[:-1][same] = self.join(sym[:-1][same], sym[1:][same])
        while True:
            # sequences with nothing left to merge leave with their survivors
            rank = np.where(made >= 0, self.rank[made], _NONE)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(seq)))
            live = best < _NONE
            gone = np.repeat(~live, size)
            if gone.any():
                s = sym[gone]
                out += np.bincount(seq[gone], np.where(s >= 0, self.weight[s], 0), len(lengths)).astype(np.int64)
                if not live.any():
                    return out
                seq, sym, made, rank = seq[~gone], sym[~gone], made[~gone], rank[~gone]
                best, size = best[live], size[live]
            lowest = np.repeat(best, size)
            at = np.flatnonzero(rank == lowest)
            own = seq[at]
            head = np.append(True, own[1:] != own[:-1])
            # of a run of overlapping occurrences every second one merges; where only one may, the leftmost
            run = np.append(True, (at[1:] != at[:-1] + 1) | head[1:])
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            take = ((np.arange(len(at)) - start) % 2 == 0) & (head | self.at_once[made[at]])
            at = at[take]
            sym[at] = made[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            new = (np.cumsum(stay) - 1)[at]
            seq, sym, made = seq[stay], sym[stay], made[stay]
            redo = np.unique(np.concatenate([new, new[new > 0] - 1]))
            right = np.minimum(redo + 1, len(sym) - 1)
            ok = (redo + 1 < len(sym)) & (seq[redo] == seq[right])
            made[redo] = np.where(ok, self.join(sym[redo], sym[right]), -1)

    def _heap(self, sym: list[int]) -> int:
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (p := self.pairs.get((sym[i] << 24) | sym[j])) is not None:
                heapq.heappush(heap, (int(self.rank[p]), i, sym[i], sym[j]))

        for i in range(n):
            offer(i)
        dead = [False] * n
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i] = self.pairs[(a << 24) | b]
            dead[j] = True
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return sum(int(self.weight[s]) for s, d in zip(sym, dead, strict=True) if not d and s >= 0)


class _Memory:
    """Counts of pre-tokens seen by this worker, as sorted arrays."""

    def __init__(self) -> None:
        self.key, self.count = np.empty(0, np.uint64), np.empty(0, np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.count[at], -1)

    def add(self, key: np.ndarray, count: np.ndarray) -> None:
        if len(self.key) + len(key) > REMEMBERED:
            self.key, self.count = np.empty(0, np.uint64), np.empty(0, np.int64)
        key, count = np.concatenate([self.key, key]), np.concatenate([self.count, count])
        order = np.argsort(key, kind="stable")
        self.key, self.count = key[order], count[order]


def _pre_tokens(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens: cut at each text's start and before every run of spaces."""
    n = len(data)
    space = data == 32
    mark = np.zeros(n + 2, bool)  # U+2581 in UTF-8 stands for a space
    lead = np.flatnonzero(data[:-2] == 0xE2) if n > 2 else np.empty(0, np.int64)
    lead = lead[(data[lead + 1] == 0x96) & (data[lead + 2] == 0x81)] if len(lead) else lead
    mark[lead] = True
    opens = space | mark[:n]
    closes = space.copy()  # the last byte of a space mark
    closes[lead + 2] = True
    starts = np.flatnonzero(opens[1:] & ~closes[:-1]) + 1
    full = end > begin
    starts = np.unique(np.concatenate([begin[full], starts]))
    text = np.searchsorted(begin[full], starts, "right") - 1
    stop = np.minimum(np.append(starts[1:], n), end[full][text])
    ok = stop > starts  # the newlines between texts belong to none
    return starts[ok], stop[ok]


def count_block(model: PieceModel, block: Block, memory: _Memory) -> np.ndarray:
    """Token counts of the texts of one block."""
    begin, end, data = block.begin, block.end, block.data
    total = np.zeros(len(begin), np.int64)
    start, stop = _pre_tokens(data, begin, end)
    if not len(start):
        return total
    text = np.searchsorted(begin, start, "right") - 1
    opening = start == begin[text]
    key = span_hashes(data, start, stop)
    key = np.where(opening & model.prefix, mix(key, 5), key)  # the first one gets a space mark before it
    unique, where, back = np.unique(key, return_index=True, return_inverse=True)
    count = memory.find(unique)
    new = np.flatnonzero(count < 0)
    if len(new):
        a, b, lead = start[where[new]], stop[where[new]], opening[where[new]] & model.prefix
        size = b - a + lead
        at = np.cumsum(size) - size
        raw = np.full(int(size.sum()), 32, np.uint8)
        body = np.ones(len(raw), bool)
        body[at[lead]] = False
        raw[body] = data[np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(int((b - a).sum()))]
        codes = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        chars = np.add.reduceat((raw & 0xC0) != 0x80, at).astype(np.int64)
        count[new] = model.counts(codes, chars)
        memory.add(unique[new], count[new])
    np.add.at(total, text, count[back])
    return total


_MODELS: dict[str, tuple[PieceModel, _Memory]] = {}


def token_counts(df: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row.  model_path must be readable on every executor."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _MODELS:
            _MODELS[model_path] = PieceModel(model_path), _Memory()
        model, memory = _MODELS[model_path]
        for batch in batches:
            n = batch.num_rows
            size, tokens = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for block in blocks(batch.column(1)):
                size[block.rows] = block.end - block.begin
                tokens[block.rows] = count_block(model, block, memory)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(tokens)], names=["id", "n_bytes", "n_tokens"])

    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return found.withColumnRenamed("id", id_col)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)
